"""Cleaning droppers and preprocessing stages on hand-sized frames."""

import math

from strata.operators import clean as C
from strata.operators import prep as PR


def _kept(spark, rows, schema, **kw):
    df = spark.createDataFrame(rows, schema)
    return C.ColumnCleaner(distinctMode="exact", **kw).fit(df).feature_names()


def test_constant_column_dropped(spark):
    assert _kept(spark, [(1, 1), (1, 2), (1, 3)], "a int, b int", cardinalityThreshold=1.1) == ["b"]


def test_fit_decides_not_the_applied_frame(spark):
    fit = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
    model = C.ColumnCleaner(distinctMode="exact", cardinalityThreshold=1.1).fit(fit)
    other = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int")
    assert model.transform(other).columns == ["b"]


def test_mostly_null_dropped_and_half_null_kept(spark):
    kept = _kept(spark, [(None, 1.0), (None, 2.0), (None, 3.0), (1.0, None)], "bad double, ok double",
                 cardinalityThreshold=1.1)
    assert kept == ["ok"]


def test_id_dropped_category_kept(spark):
    rows = [(i, "a" if i % 2 else "b") for i in range(100)]
    assert _kept(spark, rows, "id int, cat string") == ["cat"]


def test_float_columns_escape_the_id_rule(spark):
    rows = [(float(i) + 0.5, i) for i in range(50)]
    assert _kept(spark, rows, "f double, i int") == ["f"]


def test_median_imputer_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    out = PR.MedianImputer(inputCols=["x"], mode="exact").fit(df).transform(df)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.0, 10.0]


def test_standard_scaler_population_std_and_zero_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = PR.Scaler(inputCols=["x", "c"]).fit(df).transform(df).collect()
    assert sorted(r["x"] for r in out) == [-1.0, 1.0]
    assert all(r["c"] == 0.0 for r in out)


def test_robust_scaler(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "x double")
    out = PR.Scaler(inputCols=["x"], method="robust", mode="exact").fit(df).transform(df)
    assert sorted(r["x"] for r in out.collect()) == [-1.0, -0.5, 0.0, 0.5, 1.0]


def test_onehot_unseen_is_zero_vector_and_names(spark):
    from pyspark.ml import Pipeline
    train = spark.createDataFrame([("red", 1.0), ("blue", 2.0), (None, 3.0)], "color string, x double")
    test = spark.createDataFrame([("green", 1.0)], "color string, x double")
    model = Pipeline(stages=PR.preprocessing_stages(["x"], ["color"])).fit(train)
    vec = model.transform(test).first()["features"].toArray()
    assert list(vec[1:]) == [0.0, 0.0, 0.0]
    assert PR.feature_names(model) == ["num__x", "cat__color_blue", "cat__color_missing", "cat__color_red"]
    assert math.isclose(sum(abs(v) for v in vec[:1]), 1.224744871391589)


def test_vocabulary_bound_keeps_most_frequent(spark):
    from pyspark.ml import Pipeline
    rows = [("a",)] * 5 + [("b",)] * 3 + [("c",)] * 1
    df = spark.createDataFrame(rows, "c string")
    model = Pipeline(stages=PR.preprocessing_stages([], ["c"], max_categories=2)).fit(df)
    assert PR.feature_names(model) == ["cat__c_a", "cat__c_b"]
    vecs = {r["c"]: r["features"].toArray().tolist() for r in model.transform(df).collect()}
    assert vecs["c"] == [0.0, 0.0] and vecs["a"] == [1.0, 0.0]


def test_bracketed_quantiles_equal_exact(spark):
    from pyspark.sql import functions as F
    from strata.functions.quantiles import exact_quantiles
    df = spark.range(5003).select((F.col("id") * 7 % 1009).cast("double").alias("a"),
                                  (F.sin(F.col("id")) * 100).alias("b"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, bracket_rows=200)
    ref = df.agg(*[F.percentile(c, probs).alias(c) for c in ["a", "b"]]).first()
    for c in ["a", "b"]:
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[c], ref[c]))


def test_large_table_paths_stay_exact(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strata.operators import profile as P
    df = spark.range(3001).select((F.col("id") % 97).cast("double").alias("x"), F.lit(1).alias("t"))
    exact = P.column_profile(df, target="t", exact=True).first()["median"]
    monkeypatch.setattr(P, "EXACT_MEDIAN_ROWS", 10)
    assert P.column_profile(df, target="t", exact="auto").first()["median"] == exact
    imp = PR.MedianImputer(inputCols=["x"], mode="bracket").fit(df)
    assert imp.getOrDefault("values")[0] == exact


def _aggregates(spark, monkeypatch, run):
    """(rows, text of the expressions given to DataFrame.agg) of what ``run`` builds."""
    cls = type(spark.range(1))
    seen, agg = [], cls.agg

    def noted(self, *exprs):
        seen.extend(str(e) for e in exprs)
        return agg(self, *exprs)
    with monkeypatch.context() as m:
        m.setattr(cls, "agg", noted)
        out = run().collect()
    return out, " ".join(seen)


def test_strata_and_medians_of_a_large_table_take_no_value_map(spark, monkeypatch):
    """Half a million rows are too many for one task's value -> count map, whatever ``exact`` says."""
    from pyspark.sql import functions as F
    from strata.operators import cv as CV
    from strata.operators import profile as P
    few = spark.range(499_000).select("id", (F.col("id") * 7919 % 100_003).cast("double").alias("y"))
    many = few.union(few.limit(1500).select(F.col("id") + 1_000_000, "y"))
    for run in (lambda d: CV.regression_strata(d, "y", exact=True).groupBy("stratum").count().orderBy("stratum"),
                lambda d: P.column_profile(d, columns=["y"]).select("col", "median")):
        _, small = _aggregates(spark, monkeypatch, lambda: run(few))
        got, large = _aggregates(spark, monkeypatch, lambda: run(many))
        assert "percentile(" in small and "percentile(" not in large
        with monkeypatch.context() as m:
            m.setattr(CV, "EXACT_ROW_LIMIT", 10**9)
            m.setattr(P, "EXACT_MEDIAN_ROWS", 10**9)
            assert run(many).collect() == got


def test_two_categorical_columns_pipeline(spark):
    from pyspark.ml import Pipeline
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("a", "y", 3.0)], "c1 string, c2 string, v double")
    model = Pipeline(stages=PR.preprocessing_stages(["v"], ["c1", "c2"])).fit(df)
    assert PR.feature_names(model) == ["num__v", "cat__c1_a", "cat__c1_b", "cat__c2_x", "cat__c2_y"]
    assert len(model.transform(df).first()["features"]) == 5


def test_hot_slot_of_a_wide_vector_reads_its_entries_only(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as ST

    wide = 500_000_000   # 4 GB as a plain array
    rows = [(1, Vectors.sparse(wide, [7], [1.0])), (2, Vectors.sparse(wide, [3, wide - 1], [0.5, 1.0])), (3, Vectors.sparse(wide, [], [])),
            (4, Vectors.dense([0.0, 1.0])), (5, Vectors.dense([0.0, 0.0]))]
    df = spark.createDataFrame(rows, ST.StructType([ST.StructField("id", ST.IntegerType()), ST.StructField("features", VectorUDT())]))
    slot, width = PR.hot_slot("features")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", slot, width).collect()}
    assert got == {1: (7, wide), 2: (wide - 1, wide), 3: (-1, wide), 4: (1, 2), 5: (-1, 2)}
