"""Queries for models, training, explanation and feature search (2.G-2.K).

Targets with signal are derived from ``lineitem`` by fixed formulas (the
supplied columns are independent noise); ``embeddings`` gives a 10-class
problem on 64 float features.  Model queries train on whole tables with
5-fold CV and each model's default counts; their checks are rows-only.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strata.functions import features as FE
from strata.functions import stats as S
from strata.operators import eda as E
from strata.operators import explain as X
from strata.operators import search as K
from strata.operators import train as T
from strata.plans.catalog import register, table
from strata.plans.sqlgen import R

KEY6 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
# row key of the model frames (the key columns are passed through, not used as features)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FOLDS = 5
# folds in the SQL of g_knn
KNN_FOLDS = 3


def clf_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    target = ((F.col("l_quantity") * 0.02 + F.col("l_discount") * 10) > 1.0).cast("string")
    return li.select(*KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                     target.alias("target"))


def reg_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    y = F.col("l_quantity") * 100 + F.col("l_discount") * 5000 + F.col("l_extendedprice") / 1000
    return li.select(*KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", y.alias("y"))


def emb_frame(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
                    F.col("label").cast("string").alias("label_class"))


# the key columns are excluded from the features: passed as keys
def _train_clf(spark, sf_dir, models, params=None):
    df = clf_frame(spark, sf_dir)
    return T.whole(T.train(df, "target", "classification", key_cols=KEY, models=models, model_params=params,
                           k=FOLDS, refit=False))


def _train_reg(spark, sf_dir, models, params=None):
    df = reg_frame(spark, sf_dir)
    return T.whole(T.train(df, "y", "regression", key_cols=KEY, models=models, model_params=params,
                           k=FOLDS, refit=False))


def _board(res):
    """Leaderboard without the wall-time column."""
    return res.leaderboard.drop("time_s")


@register("g_logreg")
def g_logreg(spark, sf_dir):
    """Logistic regression (C=1 as regParam=1/n), 5-fold CV leaderboard row."""
    return _board(_train_clf(spark, sf_dir, ["Logistic Regression"]))


@register("g_forest")
def g_forest(spark, sf_dir):
    """Random forest classifier, 100 trees."""
    return _board(_train_clf(spark, sf_dir, ["Random Forest"]))


@register("g_gbt")
def g_gbt(spark, sf_dir):
    """Gradient-boosted trees, 100 rounds of depth 3, all folds in the same passes."""
    return _board(_train_clf(spark, sf_dir, ["Gradient Boosting"]))


@register("g_xgboost")
def g_xgboost(spark, sf_dir):
    """Second-order boosting on histograms, 100 rounds of depth 6."""
    return _board(_train_clf(spark, sf_dir, ["XGBoost"]))


@register("g_lightgbm")
def g_lightgbm(spark, sf_dir):
    """Leaf-wise boosting, 100 rounds of 31 leaves."""
    return _board(_train_clf(spark, sf_dir, ["LightGBM"]))


@register("g_tree")
def g_tree(spark, sf_dir):
    """Decision tree classifier, depth 10."""
    return _board(_train_clf(spark, sf_dir, ["Decision Tree"]))


@register("g_gaussian_nb")
def g_gaussian_nb(spark, sf_dir):
    """Gaussian naive Bayes."""
    return _board(_train_clf(spark, sf_dir, ["Naive Bayes"]))


@register("g_adaboost")
def g_adaboost(spark, sf_dir):
    """SAMME AdaBoost of weighted stumps, 50 rounds."""
    return _board(_train_clf(spark, sf_dir, ["AdaBoost"]))


@register("g_linear")
def g_linear(spark, sf_dir):
    """Linear, ridge and lasso regression."""
    return _board(_train_reg(spark, sf_dir, ["Linear Regression", "Ridge", "Lasso"]))


@register("g_trees_reg")
def g_trees_reg(spark, sf_dir):
    """Tree regressors: forest of 100 unlimited trees, single tree."""
    return _board(_train_reg(spark, sf_dir, ["Random Forest", "Decision Tree"]))


@register("g_gbt_reg")
def g_gbt_reg(spark, sf_dir):
    """Gradient-boosted regression trees."""
    return _board(_train_reg(spark, sf_dir, ["Gradient Boosting"]))


@register("g_xgboost_reg")
def g_xgboost_reg(spark, sf_dir):
    """Second-order boosting of a regression."""
    return _board(_train_reg(spark, sf_dir, ["XGBoost"]))


@register("g_lightgbm_reg")
def g_lightgbm_reg(spark, sf_dir):
    """Leaf-wise boosting of a regression."""
    return _board(_train_reg(spark, sf_dir, ["LightGBM"]))


@register("g_adaboost_reg")
def g_adaboost_reg(spark, sf_dir):
    """AdaBoost.R2 with weighted depth-3 trees, 50 rounds."""
    return _board(_train_reg(spark, sf_dir, ["AdaBoost"]))


@register("g_multiclass")
def g_multiclass(spark, sf_dir):
    """Ten-class problem on 64 float features: multinomial LR, naive Bayes, tree."""
    df = emb_frame(spark, sf_dir)
    res = T.train(df, "label_class", "classification", key_cols=["vec_id"],
                  models=["Logistic Regression", "Naive Bayes", "Decision Tree"], k=FOLDS, refit=False)
    return _board(T.whole(res))


@register("h_train_oof")
def h_train_oof(spark, sf_dir):
    """Out-of-fold predictions: one row per key per model, folds fitted leak-free (H5, H6)."""
    res = _train_clf(spark, sf_dir, ["Decision Tree", "Naive Bayes"])
    return res.oof


@register("h_train_refit")
def h_train_refit(spark, sf_dir):
    """Full run: CV, best model refit on all rows, batch scoring of the table."""
    df = clf_frame(spark, sf_dir)
    res = T.whole(T.train(df, "target", "classification", key_cols=KEY,
                          models=["Logistic Regression", "Decision Tree"], k=FOLDS, refit=True, explain=False))
    scored = T.predict(res.pipeline, df, res.labels)
    return scored.select(*KEY, "target", "predicted_label")


@register("i_sample_300", """
SELECT o_orderkey FROM orders
ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), CAST(o_orderkey AS VARCHAR) LIMIT 300
""")
def i_sample_300(spark, sf_dir):
    """Seeded sample of at most 300 rows for explanation."""
    return X.explain_sample(table(spark, sf_dir, "orders"), ["o_orderkey"], 42, 300).select("o_orderkey")


_KEY6_SQL = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in KEY6) + ")"


@register("i_linear_shap", f"""
WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12,
             covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_extendedprice) AS s1y,
             covar_pop(l_discount, l_extendedprice) AS s2y FROM lineitem),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
smp AS (SELECT l_quantity, l_discount FROM lineitem
        ORDER BY md5(concat_ws('|', '42', {_KEY6_SQL})), {_KEY6_SQL} LIMIT 300)
SELECT 'num__l_quantity' AS feature,
  {R('(SELECT abs(b1) FROM b) * avg(abs(l_quantity - (SELECT avg(l_quantity) FROM smp)))', 3)} AS importance FROM smp
UNION ALL
SELECT 'num__l_discount',
  {R('(SELECT abs(b2) FROM b) * avg(abs(l_discount - (SELECT avg(l_discount) FROM smp)))', 3)} FROM smp
""")
def i_linear_shap(spark, sf_dir):
    """Mean |linear SHAP| on the 300-row sample of an OLS fit on all of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    va = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(li)
    lr = LinearRegression(labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(va)
    sample = X.explain_sample(va, KEY6, 42, 300)
    imp = X.linear_shap(sample, [lr.coefficients.toArray().tolist()], ["num__l_quantity", "num__l_discount"])
    return imp.select("feature", S.rnd(F.col("importance"), 3).alias("importance"))


def _corr_expr(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN "
            f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


_IMP_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("i_top_dead", f"""
WITH imp AS ({' UNION ALL '.join(f"SELECT 'num__{c}' AS feature, abs({R(_corr_expr(c, 'l_extendedprice'))}) AS importance FROM lineitem" for c in _IMP_FEATS)}),
r AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp WHERE importance IS NOT NULL)
SELECT regexp_replace(feature, '^(num|cat)__', '') AS feature, importance, CAST(rank AS INTEGER) AS rank,
  rank <= 3 AS is_top, importance < 0.01 AS is_dead FROM r
""")
def i_top_dead(spark, sf_dir):
    """Top-n and dead features of an importance table, prefixes stripped."""
    li = table(spark, sf_dir, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")
    corr = E.target_correlation(li, "l_extendedprice")
    imp = corr.select(F.concat(F.lit("num__"), F.col("feature")).alias("feature"), F.abs("r").alias("importance"))
    return X.top_and_dead(imp, top_n=3, dead=0.01)


@register("i_tree_importance")
def i_tree_importance(spark, sf_dir):
    """Impurity importances of a refitted tree ensemble, ranked with top / dead flags (I4 cheap path, I6)."""
    df = clf_frame(spark, sf_dir)
    res = T.whole(T.train(df, "target", "classification", key_cols=KEY, models=["Random Forest"],
                          k=FOLDS, refit=True, explain=False))
    from strata.operators.models import importance_vector
    imp = X.native_importance(spark, importance_vector(res.pipeline.stages[-1]), res.feature_names)
    return X.top_and_dead(imp)


def _validate_candidates():
    return [
        ("ratio", [FE.Ratio("price_per_cust", "o_totalprice", "o_custkey")]),
        ("filter", [FE.FrameFunction("f", lambda d: d.where(F.col("o_totalprice") > 200000))]),
        ("empty", [FE.FrameFunction("f", lambda d: d.where(F.lit(False)))]),
        ("no_columns", [FE.FrameFunction("f", lambda d: d.select())]),
        ("all_null", [FE.FrameFunction("f", lambda d: d.select(
            *[F.lit(None).cast("double").alias(c) for c in d.columns]))]),
        ("bad_column", [FE.Expr("x", "no_such_column * 2")]),
    ]


@register("k_validate", """
WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'ratio' AS candidate, TRUE AS ok, CAST(NULL AS VARCHAR) AS kind, n AS rows_in, n AS rows_out FROM n
UNION ALL SELECT 'filter', FALSE, 'row_count', n, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) FROM n
UNION ALL SELECT 'empty', FALSE, 'empty', n, 0 FROM n
UNION ALL SELECT 'no_columns', FALSE, 'no_columns', n, NULL FROM n
UNION ALL SELECT 'all_null', FALSE, 'all_null', n, n FROM n
UNION ALL SELECT 'bad_column', FALSE, 'exception', n, NULL FROM n
""")
def k_validate(spark, sf_dir):
    """Validation of candidate feature steps with structured errors (K1, K2)."""
    o = table(spark, sf_dir, "orders")
    rows = []
    for name, feats in _validate_candidates():
        v = K.validate_step(feats, o)
        rows.append((name, v["kind"] is None, v["kind"], v["rows_in"], v["rows_out"]))
    return spark.createDataFrame(rows, "candidate string, ok boolean, kind string, rows_in bigint, rows_out bigint")


@register("k_search_log")
def k_search_log(spark, sf_dir):
    """Feature search: baseline plus automatic candidates, accepted by CV loss."""
    df = reg_frame(spark, sf_dir)
    cands = K.auto_candidates(df, "y", exclude=KEY)
    res = K.search_features(df, "y", cands, run_id="search", task_type="regression", key_cols=KEY,
                            k=FOLDS)
    return res.log


@register("i_shapley_mc")
def i_shapley_mc(spark, sf_dir):
    """Monte-Carlo Shapley importances of a refitted forest on its 300-row sample."""
    df = clf_frame(spark, sf_dir)
    res = T.whole(T.train(df, "target", "classification", key_cols=KEY, models=["Random Forest"],
                          k=FOLDS, refit=True, explain=False))
    sample = X.explain_sample(df.where(F.col("target").isNotNull()), KEY, 42, 300)
    from pyspark.ml import PipelineModel
    vectors = PipelineModel(stages=res.pipeline.stages[:-1]).transform(sample)
    imp = X.shapley_mc(res.pipeline.stages[-1], vectors, res.feature_names, permutations=8)
    return X.top_and_dead(imp)


@register("g_knn", """
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label,
             (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))),
                                 CAST(vec_id AS VARCHAR)) - 1) % 3 AS fold
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label, list_distance(q.x, t.x) AS dist
      FROM f q JOIN f t ON q.fold <> t.fold),
r AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY dist, CAST(tid AS VARCHAR)) AS rn FROM d),
v AS (SELECT qid, label, count(*) AS c FROM r WHERE rn <= 5 GROUP BY qid, label),
w AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS rk FROM v)
SELECT CAST(qid AS VARCHAR) AS key, CAST(label AS DOUBLE) AS prediction FROM w WHERE rk = 1
""")
def g_knn(spark, sf_dir):
    """Exact 5-NN out-of-fold predictions on the 64-d embeddings."""
    from strata.operators.knn import knn_predict
    return knn_predict(*_knn_sides(spark, sf_dir), k=5, features_col="x", label_col="label", key_col="vec_id", group_col="g")


def _knn_sides(spark, sf_dir):
    """Training rows repeated for each fold that they are not in, and the query rows of each fold."""
    from strata.operators import cv as CV
    e = table(spark, sf_dir, "embeddings")
    f = CV.assign_folds(e, KNN_FOLDS, "label", ["vec_id"], 42)
    q = f.select("vec_id", F.col("embedding").alias("x"), "label", F.col("fold").alias("g"))
    folds = F.array(*[F.lit(i) for i in range(KNN_FOLDS)])
    t = f.select("vec_id", F.col("embedding").alias("x"), "label",
                 F.explode(F.filter(folds, lambda v: v != F.col("fold"))).alias("g"))
    return t, q


@register("g_knn_neighbours", """
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
             (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', CAST(vec_id AS VARCHAR))),
                                 CAST(vec_id AS VARCHAR)) - 1) % 3 AS fold
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, list_distance(q.x, t.x) AS dist
      FROM f q JOIN f t ON q.fold <> t.fold),
r AS (SELECT qid, tid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, CAST(tid AS VARCHAR)) AS rn FROM d)
SELECT CAST(qid AS VARCHAR) AS key, CAST(rn AS INTEGER) AS rank, CAST(tid AS VARCHAR) AS neighbour,
       floor(dist * 10000.0 + 0.5) / 10000.0 AS distance
FROM r WHERE rn <= 5
""")
def g_knn_neighbours(spark, sf_dir):
    """The five nearest training rows of every row outside its fold, with rank and distance."""
    from strata.operators.knn import neighbours
    near = neighbours(*_knn_sides(spark, sf_dir), k=5, features_col="x", label_col="label", key_col="vec_id", group_col="g").rows
    return near.select("key", "rank", "neighbour", S.rnd(F.col("d"), 4).alias("distance"))


_OLS_S = """(SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12,
  covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_extendedprice) AS s1y,
  covar_pop(l_discount, l_extendedprice) AS s2y, avg(l_quantity) AS m1, avg(l_discount) AS m2,
  avg(l_extendedprice) AS my, count(*) AS n FROM lineitem)"""


def _coef_sql(lam: str) -> str:
    # 2x2 normal equations on centred data: (n*S + lam*I) w = n*s_y
    a11, a12, a22 = f"(n * s11 + {lam})", "(n * s12)", f"(n * s22 + {lam})"
    det = f"({a11} * {a22} - {a12} * {a12})"
    w1 = f"(({a22}) * n * s1y - ({a12}) * n * s2y) / {det}"
    w2 = f"(({a11}) * n * s2y - ({a12}) * n * s1y) / {det}"
    return f"""
WITH s AS {_OLS_S}, w AS (SELECT {w1} AS w1, {w2} AS w2, m1, m2, my FROM s)
SELECT 'l_quantity' AS term, {R('w1', 3)} AS value FROM w
UNION ALL SELECT 'l_discount', {R('w2', 3)} FROM w
UNION ALL SELECT 'intercept', {R('my - w1 * m1 - w2 * m2', 3)} FROM w
"""


def _fit_linear(spark, sf_dir, name):
    from strata.operators import models as M
    li = table(spark, sf_dir, "lineitem")
    va = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        li.select("l_quantity", "l_discount", F.col("l_extendedprice").alias("label")))
    ctx = M.fit_context(va, "regression")
    m = M.get_model(name, "regression", ctx).fit(va)
    w = m.coefficients.toArray().tolist()
    rows = [("l_quantity", w[0]), ("l_discount", w[1]), ("intercept", float(m.intercept))]
    return spark.createDataFrame(rows, "term string, value double").select(
        "term", S.rnd(F.col("value"), 3).alias("value"))


@register("g_ols_coef", _coef_sql("0"))
def g_ols_coef(spark, sf_dir):
    """Linear regression coefficients on all of lineitem equal the normal-equation solution."""
    return _fit_linear(spark, sf_dir, "Linear Regression")


@register("g_ridge_coef", _coef_sql("1.0"))
def g_ridge_coef(spark, sf_dir):
    """Ridge (alpha 1) coefficients equal (X'X + I)^-1 X'y on centred data."""
    return _fit_linear(spark, sf_dir, "Ridge")


_NB_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _nb_sql():
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _NB_FEATS)
    terms = " + ".join(f"ln(2 * pi() * (v_{c} + e)) + (li.{c} - m_{c}) * (li.{c} - m_{c}) / (v_{c} + e)"
                       for c in _NB_FEATS)
    keys = ", ".join(f"li.{k}" for k in KEY + _NB_FEATS)
    return f"""
WITH st AS (SELECT l_returnflag AS c, count(*) AS nc, {stats} FROM lineitem GROUP BY l_returnflag),
g AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({c})' for c in _NB_FEATS)}) AS e, count(*) AS n FROM lineitem),
ll AS (SELECT {keys}, st.c, ln(st.nc / g.n) - 0.5 * ({terms}) AS s FROM lineitem li, st, g),
r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(KEY + _NB_FEATS)} ORDER BY s DESC) AS rn FROM ll)
SELECT {', '.join(KEY)}, c AS predicted_flag FROM r WHERE rn = 1
"""


@register("g_nb_predict", _nb_sql())
def g_nb_predict(spark, sf_dir):
    """Gaussian naive Bayes fitted on all of lineitem, predicting every row."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    from strata.operators import models as M
    li = table(spark, sf_dir, "lineitem")
    idx = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(li)
    va = VectorAssembler(inputCols=_NB_FEATS, outputCol="features").transform(idx.transform(li))
    model = M.get_model("Naive Bayes", "classification", M.fit_context(va, "classification")).fit(va)
    out = IndexToString(inputCol="prediction", outputCol="predicted_flag", labels=idx.labels).transform(
        model.transform(va))
    return out.select(*KEY, "predicted_flag")


def _nb_probability_sql():
    inner = _nb_sql()
    ll = inner[:inner.index("r AS (SELECT")]
    return f"""{ll}
p AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM ll WINDOW w AS (PARTITION BY {', '.join(KEY + _NB_FEATS)}))
SELECT {', '.join(KEY)}, c AS flag, {R('p', 6)} AS probability FROM p"""


@register("f_probabilities", _nb_probability_sql())
def f_probabilities(spark, sf_dir):
    """Probability of every class for every row, by a pipeline scored with ``predict``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import StringIndexer
    from strata.operators import models as M
    li = table(spark, sf_dir, "lineitem")
    idx = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(li)
    va = VectorAssembler(inputCols=_NB_FEATS, outputCol="features")
    rows = va.transform(idx.transform(li))
    model = M.get_model("Naive Bayes", "classification", M.fit_context(rows, "classification")).fit(rows)
    out = T.predict(PipelineModel(stages=[va, model]), li, list(idx.labels))
    return out.select(*KEY, F.explode("label_probability").alias("flag", "probability")).select(
        *KEY, "flag", S.rnd(F.col("probability"), 6).alias("probability"))


_SPLIT_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _tree_ctes(depth: int, l2: float, min_hessian: float, rate: float) -> str:
    """Depth-wise tree on squared loss (gradient mean - y, Hessian 1), grown level by level by trying every threshold: (node, f, t, cover, value)."""
    ctes = ["d AS (SELECT l_quantity, l_discount, l_tax, avg(l_extendedprice) OVER () - l_extendedprice AS g FROM lineitem)",
            "n0 AS (SELECT *, 1 AS node FROM d)",
            "m AS (" + " UNION ALL ".join(
                f"SELECT {i} AS f, (v + lead(v) OVER (ORDER BY v)) / 2 AS t FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v FROM lineitem)"
                for i, c in enumerate(_SPLIT_FEATS)) + ")"]
    pick = "CASE m.f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_SPLIT_FEATS)) + " END"
    for k in range(depth):
        ctes.append(f"""c{k} AS (SELECT node, m.f, m.t, sum(g) FILTER ({pick} <= m.t) AS gl, count(*) FILTER ({pick} <= m.t) AS nl, sum(g) AS gs, count(*) AS ns
  FROM n{k}, m WHERE m.t IS NOT NULL GROUP BY node, m.f, m.t)""")
        ctes.append(f"""s{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, t) AS r FROM (
  SELECT *, round(0.5 * (gl * gl / (nl + {l2}) + (gs - gl) * (gs - gl) / (ns - nl + {l2}) - gs * gs / (ns + {l2})), 3) AS gain
  FROM c{k} WHERE nl >= {min_hessian} AND ns - nl >= {min_hessian})) WHERE r = 1 AND gain > 0.000001)""")
        ctes.append(f"""n{k + 1} AS (SELECT n{k}.* EXCLUDE (node), 2 * n{k}.node + CASE WHEN CASE s.f {' '.join(f"WHEN {i} THEN {c}" for i, c in enumerate(_SPLIT_FEATS))} END <= s.t THEN 0 ELSE 1 END AS node
  FROM n{k} JOIN s{k} s ON s.node = n{k}.node)""")
    parts = []
    for k in range(depth + 1):
        leaf = f"-{rate} * sum(g) / (count(*) + {l2})"
        if k < depth:
            parts.append(f"SELECT n{k}.node, any_value(s.f) AS f, any_value(s.t) AS t, count(*) AS cover, CASE WHEN any_value(s.f) IS NULL THEN {leaf} END AS value "
                         f"FROM n{k} LEFT JOIN s{k} s ON s.node = n{k}.node GROUP BY n{k}.node")
        else:
            parts.append(f"SELECT node, NULL, NULL, count(*), {leaf} FROM n{k} GROUP BY node")
    return f"{', '.join(ctes)}, tree AS ({' UNION ALL '.join(parts)})"


_NAME = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SPLIT_FEATS)) + " END"
_FIRST_TREE = f"WITH {_tree_ctes(4, 1.0, 1, 0.1)} SELECT CAST(node AS BIGINT) AS node, {_NAME} AS feature, {R('t', 4)} AS threshold, cover, {R('value', 4)} AS value FROM tree"


def _one_tree(spark, sf_dir, depth):
    """A booster of one round on lineitem, and its rows."""
    from strata.operators import boost
    li = table(spark, sf_dir, "lineitem")
    va = VectorAssembler(inputCols=_SPLIT_FEATS, outputCol="features").transform(
        li.select(*dict.fromkeys([*_SPLIT_FEATS, *KEY6]), F.col("l_extendedprice").alias("label")))
    params = boost.depth_wise({"n_estimators": 1, "learning_rate": 0.1, "max_depth": depth})
    return boost.HistBooster(params, "regression").fit(va), va


@register("g_xgboost_tree", _FIRST_TREE)
def g_xgboost_tree(spark, sf_dir):
    """First tree of second-order boosting on all of lineitem: splits, covers and leaf values."""
    tree = _one_tree(spark, sf_dir, 4)[0].rounds[0][0]
    place, rows = {0: 1}, []
    for i, f, t, _, left, right, cover, value in tree.rows():
        if f is not None:
            place[left], place[right] = 2 * place[i], 2 * place[i] + 1
        rows.append((place[i], None if f is None else _SPLIT_FEATS[f], t, int(cover), None if f is not None else value[0]))
    out = spark.createDataFrame(rows, "node bigint, feature string, threshold double, cover bigint, value double")
    return out.select("node", "feature", S.rnd(F.col("threshold"), 4).alias("threshold"), "cover", S.rnd(F.col("value"), 4).alias("value"))


@register("i_tree_shap", f"""
WITH {_tree_ctes(3, 1.0, 1, 0.1)},
smp AS (SELECT row_number() OVER () AS rid, l_quantity, l_discount, l_tax FROM (
  SELECT * FROM lineitem ORDER BY md5(concat_ws('|', '42', {_KEY6_SQL})), {_KEY6_SQL} LIMIT 300)),
edge AS (SELECT l.node AS leaf, l.value, a.f, a.t, c.node % 2 = 0 AS goes_left, c.cover / a.cover AS share
         FROM tree l, range(1, 5) r(k), tree a, tree c WHERE l.f IS NULL AND a.node = l.node >> k AND c.node = l.node >> (k - 1)),
part AS (SELECT rid, s, leaf, any_value(value) * product(CASE WHEN (s >> f) & 1 = 0 THEN share
           WHEN (CASE f WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END <= t) = goes_left THEN 1 ELSE 0 END) AS v
         FROM smp, range(8) u(s), edge GROUP BY rid, s, leaf),
v AS (SELECT rid, s, sum(v) AS v FROM part GROUP BY rid, s),
phi AS (SELECT a.rid, g.f, sum((b.v - a.v) * CASE bit_count(a.s) WHEN 1 THEN 1.0 / 6 ELSE 1.0 / 3 END) AS phi
        FROM v a, range(3) g(f), v b WHERE (a.s >> g.f) & 1 = 0 AND b.rid = a.rid AND b.s = a.s + (1 << g.f) GROUP BY a.rid, g.f)
SELECT {_NAME} AS feature, {R('avg(abs(phi))', 3)} AS importance FROM phi GROUP BY f""")
def i_tree_shap(spark, sf_dir):
    """Mean |exact tree Shapley value| on the 300-row sample of a boosted tree of lineitem."""
    from strata.operators.treeshap import shap_importance
    model, va = _one_tree(spark, sf_dir, 3)
    imp = shap_importance(model, X.explain_sample(va, KEY6, 42, 300), _SPLIT_FEATS)
    return imp.select("feature", S.rnd(F.col("importance"), 3).alias("importance"))


_LASSO = """
WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS d,
             covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
             avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem),
sign AS (SELECT i - 1 AS s1, j - 1 AS s2 FROM range(3) x(i), range(3) y(j)),
w AS (SELECT *, CASE WHEN s1 <> 0 AND s2 <> 0 THEN (d * (p - s1) - b * (q - s2)) / (a * d - b * b) WHEN s1 <> 0 THEN (p - s1) / a ELSE 0 END AS w1,
             CASE WHEN s1 <> 0 AND s2 <> 0 THEN (a * (q - s2) - b * (p - s1)) / (a * d - b * b) WHEN s2 <> 0 THEN (q - s2) / d ELSE 0 END AS w2 FROM s, sign),
best AS (SELECT * FROM w WHERE sign(w1) = s1 AND sign(w2) = s2 AND abs(p - a * w1 - b * w2) <= 1 + 1e-6 AND abs(q - b * w1 - d * w2) <= 1 + 1e-6)
"""


@register("g_lasso_coef", f"""{_LASSO} SELECT 'l_quantity' AS term, {R('w1', 3)} AS value FROM best
UNION ALL SELECT 'l_discount', {R('w2', 3)} FROM best UNION ALL SELECT 'intercept', {R('my - w1 * m1 - w2 * m2', 3)} FROM best""")
def g_lasso_coef(spark, sf_dir):
    """Lasso (alpha 1) coefficients on all of lineitem meet the optimality conditions."""
    return _fit_linear(spark, sf_dir, "Lasso")


def _fold_sql(alpha: str) -> str:
    w1 = f"((n * d + {alpha}) * n * p - n * b * n * q) / ((n * a + {alpha}) * (n * d + {alpha}) - n * b * n * b)"
    w2 = f"((n * a + {alpha}) * n * q - n * b * n * p) / ((n * a + {alpha}) * (n * d + {alpha}) - n * b * n * b)"
    return f"""SELECT f, {w1} AS w1, {w2} AS w2, m1, m2, my FROM s"""


@register("g_linear_folds", f"""
WITH s AS (SELECT f, count(*) AS n, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS d,
             covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
             avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem, range(5) r(f) WHERE l_orderkey % 5 <> f GROUP BY f),
w AS (SELECT 'Linear Regression' AS model, * FROM ({_fold_sql('0')}) UNION ALL SELECT 'Ridge', * FROM ({_fold_sql('1.0')}))
SELECT model, CAST(f AS INTEGER) AS fold, {R('w1', 3)} AS l_quantity, {R('w2', 3)} AS l_discount, {R('my - w1 * m1 - w2 * m2', 3)} AS intercept FROM w""")
def g_linear_folds(spark, sf_dir):
    """Least squares and ridge of every fold's training rows, from one pass over all rows."""
    from strata.operators import linear
    li = table(spark, sf_dir, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    rows = []
    for f, p in linear.by_fold(li, ["l_quantity", "l_discount"], "l_extendedprice", "fold").items():
        for name, alpha in (("Linear Regression", 0.0), ("Ridge", 1.0)):
            w, b = linear.ridge(p, alpha)
            rows.append((name, f, float(w[0]), float(w[1]), b))
    out = spark.createDataFrame(rows, "model string, fold int, l_quantity double, l_discount double, intercept double")
    return out.select("model", "fold", *[S.rnd(F.col(c), 3).alias(c) for c in ("l_quantity", "l_discount", "intercept")])


_MODEL_KEY = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in KEY) + ")"


@register("h_oof_keys", f"""
WITH d AS (SELECT {_MODEL_KEY} AS key, CAST((l_quantity * 0.02 + l_discount * 10) > 1.0 AS INTEGER) AS y FROM lineitem)
SELECT 'Naive Bayes' AS model, key, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || key), key) - 1) % {FOLDS} AS INTEGER) AS fold,
  CAST(y AS DOUBLE) AS y FROM d""")
def h_oof_keys(spark, sf_dir):
    """Out-of-fold table of a training: one row a key, in the fold that held it out, with its label (H5, H6)."""
    return _train_clf(spark, sf_dir, ["Naive Bayes"]).oof.select("model", "key", "fold", "y")

