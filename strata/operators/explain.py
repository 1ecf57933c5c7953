"""Explanation of a fitted model (survey 2.I).

* sample: at most 300 rows, the first ones in md5(seed|key) order (a
  ``TakeOrdered``; deterministic and reproducible outside Spark);
* linear models: exact linear SHAP against the sample mean, mean |value|
  per feature = mean_k |coef_kj| * mean |x_j - mean_j| (averaged over classes);
* trees, forests and boosters: exact path-dependent Shapley values (``treeshap``);
  the model's impurity importances are the cheap path;
* other models: empty importance table (I7).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.cv import fold_hash
from strata.operators.linear import LinearModel, LogisticModel
from strata.operators.models import importance_vector

SAMPLE_ROWS = 300
TOP_N = 10
DEAD_THRESHOLD = 0.001
_SCHEMA = "feature string, importance double"


def explain_sample(df: DataFrame, key_cols: list[str] | None = None, seed: int = 42,
                   n: int = SAMPLE_ROWS) -> DataFrame:
    """Seeded sample without replacement of at most n rows."""
    from strata.operators.cv import key_string
    return (df.withColumn("__sh", fold_hash(df, key_cols, seed)).withColumn("__sk", key_string(df, key_cols))
            .orderBy("__sh", "__sk").limit(n).drop("__sh", "__sk"))


def linear_shap(vectors: DataFrame, coef_rows: list[list[float]], names: list[str],
                features_col: str = "features") -> DataFrame:
    """Mean |SHAP| per feature of a linear model on the explained rows."""
    spark = vectors.sparkSession
    if not names:
        return spark.createDataFrame([], _SCHEMA)
    d = len(names)
    weight = [sum(abs(row[j]) for row in coef_rows) / len(coef_rows) for j in range(d)]
    long = vectors.select(F.posexplode(vector_to_array(features_col)).alias("pos", "x"))
    centred = long.withColumn("m", F.avg("x").over(Window.partitionBy("pos")))
    per = centred.groupBy("pos").agg(F.avg(F.abs(F.col("x") - F.col("m"))).alias("dev"))
    w = F.element_at(F.array(*[F.lit(float(v)) for v in weight]), F.col("pos") + 1)
    nm = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    return per.select(nm.alias("feature"), (w * F.col("dev")).alias("importance"))


def shapley_mc(model, vectors: DataFrame, names: list[str], permutations: int = 8, seed: int = 42,
               features_col: str = "features") -> DataFrame:
    """Monte-Carlo Shapley values of any fitted model, mean |value| per feature.

    For explained row x, permutation pi and feature j, two hybrid rows take
    x on the features placed before j (with / without j itself) and a
    background row z elsewhere; phi_j is the mean of f(with) - f(without).
    Background rows are other rows of the explained sample.  All hybrid rows
    (at most 2 * rows * permutations * features) are generated with array
    functions and scored by the model in one job; classifiers are explained
    on their class probabilities, averaged over classes.
    """
    spark = vectors.sparkSession
    d = len(names)
    if d == 0:
        return spark.createDataFrame([], _SCHEMA)
    rng = np.random.default_rng(seed)
    ranks = []
    for _ in range(permutations):
        perm = rng.permutation(d)
        inv = np.empty(d, dtype=int)
        inv[perm] = np.arange(d)
        ranks.append([int(v) for v in inv])
    base = vectors.select(vector_to_array(features_col).alias("x"))
    w = Window.orderBy(F.md5(F.to_json(F.col("x"))), F.to_json(F.col("x")))
    rows = base.withColumn("rid", F.row_number().over(w) - 1)   # bounded: the explained sample
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], _SCHEMA)
    perms = spark.createDataFrame([(m, r) for m, r in enumerate(ranks)], "m int, rank array<int>")
    # each (row, permutation) gets a background partner: row (rid + m + 1) mod n
    cand = rows.select("rid", "x").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    cand = cand.withColumn("zid", (F.col("rid") + F.col("m") + 1) % F.lit(n))
    z = rows.select(F.col("rid").alias("zid"), F.col("x").alias("z"))
    paired = cand.join(z, "zid").join(F.broadcast(perms), "m")
    hyb = paired.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    rj = F.element_at("rank", F.col("j") + 1)

    def mix(strict: bool):
        return F.transform(F.col("x"), lambda v, p: F.when(
            (F.element_at(F.col("rank"), p + 1) < rj) if strict else (F.element_at(F.col("rank"), p + 1) <= rj),
            v).otherwise(F.element_at(F.col("z"), p + 1)))

    both = hyb.select("rid", "m", "j", F.explode(F.array(
        F.struct(F.lit(1.0).alias("sign"), mix(False).alias("v")),
        F.struct(F.lit(-1.0).alias("sign"), mix(True).alias("v")))).alias("h"))
    scored = model.transform(both.select("rid", "m", "j", "h.sign", array_to_vector("h.v").alias(features_col)))
    if "probability" in scored.columns:
        out = vector_to_array("probability")
    else:
        out = F.array(F.col("prediction").cast("double"))
    contrib = scored.select("rid", "m", "j", F.posexplode(out).alias("k", "f"), "sign") \
        .groupBy("rid", "j", "k").agg((F.sum(F.col("sign") * F.col("f")) / permutations).alias("phi"))
    per = contrib.groupBy("j", "k").agg(F.avg(F.abs("phi")).alias("a")).groupBy("j").agg(F.avg("a").alias("imp"))
    nm = F.element_at(F.array(*[F.lit(v) for v in names]), F.col("j") + 1)
    return per.select(nm.alias("feature"), F.col("imp").alias("importance"))


def native_importance(spark, values: list[float] | None, names: list[str]) -> DataFrame:
    """Importances reported by the model itself (tree ensembles)."""
    if not values or len(values) != len(names):
        return spark.createDataFrame([], _SCHEMA)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], _SCHEMA)


def explain_model(pipeline: PipelineModel, data: DataFrame, names: list[str],
                  key_cols: list[str] | None = None, seed: int = 42, n: int = SAMPLE_ROWS,
                  method: str = "auto", permutations: int = 8) -> DataFrame:
    """Importance table of the pipeline's final model.

    ``auto``: linear models -> exact linear SHAP; trees, forests and boosters ->
    exact tree SHAP; other ensembles -> Monte-Carlo Shapley, as with ``sampled``;
    other models -> empty table.  ``native`` uses the model's own impurity
    importances (the cheap path).
    """
    spark = data.sparkSession
    model = pipeline.stages[-1]
    try:
        if method == "native":
            return native_importance(spark, importance_vector(model), names)
        sample = explain_sample(data, key_cols, seed, n)
        vectors = PipelineModel(stages=pipeline.stages[:-1]).transform(sample)
        if isinstance(model, (LogisticRegressionModel, LinearRegressionModel, LogisticModel, LinearModel)):
            if isinstance(model, (LogisticRegressionModel, LogisticModel)):
                coefs = model.coefficientMatrix.toArray().tolist()
            else:
                coefs = [model.coefficients.toArray().tolist()]
            return linear_shap(vectors, coefs, names)
        if method == "auto" and names:
            from strata.operators.treeshap import shap_importance

            exact = shap_importance(model, vectors, names)
            if exact is not None:
                return exact
        if importance_vector(model) is not None:
            return shapley_mc(model, vectors, names, permutations, seed)
        return spark.createDataFrame([], _SCHEMA)
    except Exception:
        return spark.createDataFrame([], _SCHEMA)


def strip_prefix(col) -> F.Column:
    """Drop the ``num__`` / ``cat__`` route prefix from a feature name (I8)."""
    return F.regexp_replace(col, r"^(num|cat)__", "")


def top_and_dead(importance: DataFrame, top_n: int = TOP_N, dead: float = DEAD_THRESHOLD) -> DataFrame:
    """Rank features by importance; flag the top n and the dead ones (< threshold).

    Output: feature (prefix stripped), importance, rank, is_top, is_dead.
    """
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    ranked = importance.withColumn("rank", F.row_number().over(w).cast("int"))
    return ranked.select(strip_prefix(F.col("feature")).alias("feature"), "importance", "rank",
                         (F.col("rank") <= top_n).alias("is_top"), (F.col("importance") < dead).alias("is_dead"))


def top_dead_lists(importance: DataFrame, top_n: int = TOP_N, dead: float = DEAD_THRESHOLD) -> tuple[list, list]:
    """The two short name lists kept in the experiment log (collected: at most the feature count)."""
    rows = top_and_dead(importance, top_n, dead).orderBy("rank").collect()
    return ([r["feature"] for r in rows if r["is_top"]], [r["feature"] for r in rows if r["is_dead"]])
