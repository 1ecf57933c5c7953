"""Column cleaning: ID-like, constant and mostly-null columns (survey 2.E).

The three column droppers (cardinality -> variance -> null share) each
test one column at a time, so applying them in sequence equals applying
them side by side: :class:`ColumnCleaner` computes every statistic in **one**
aggregate pass and keeps the per-column reasons as a report table.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.functions import types as TY
from strata.operators.mlparams import float_param, list_param, str_param

# Default cleaning thresholds.
CARDINALITY_THRESHOLD = 0.9
VARIANCE_THRESHOLD = 0.0
NULL_LIMIT = 0.5
RSD = 0.01   # of the sketches that distinctMode="approx" asks for


def cleaning_stats(df: DataFrame, columns: list[str], distinct: str = "exact",
                   threshold: float = CARDINALITY_THRESHOLD) -> DataFrame:
    """Per-column statistics the cleaning rules need, one aggregate pass.

    Output: col, n_rows, n_unique, null_share, variance, is_float, is_numeric,
    is_real_numeric.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    approx = distinct == "approx"   # only when asked for by name; the same at every size
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        col, dt = F.col(c), fields[c]
        aggs.append(F.count_if(col.isNull()).alias(f"z{i}"))
        if TY.is_numeric(dt):
            x = col.cast("double") if TY.is_real_numeric(dt) else col.cast("int").cast("double")
            aggs.append(F.var_samp(x).alias(f"v{i}"))
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        dt = fields[c]
        var = F.col(f"v{i}") if TY.is_numeric(dt) else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("col"), F.col("__n").cast("bigint").alias("n_rows"),
            F.coalesce(F.try_divide(F.col(f"z{i}"), F.col("__n")), F.lit(0.0)).alias("null_share"),
            var.alias("variance"), F.lit(TY.is_float(dt)).alias("is_float"),
            F.lit(TY.is_numeric(dt)).alias("is_numeric"),
            F.lit(TY.is_real_numeric(dt)).alias("is_real_numeric")))
    stats = wide.select(F.inline(F.array(*rows)))
    card = S.distinct_counts(df, columns, exact=not approx, rsd=RSD)
    if approx:
        card = _recount_near_threshold(df, stats, card, threshold)
    # one row per column on both sides: bounded broadcast
    out = stats.join(F.broadcast(card), "col")
    return out.select("col", "n_rows", "n_unique", "null_share", "variance", "is_float", "is_numeric",
                      "is_real_numeric")


def _recount_near_threshold(df: DataFrame, stats: DataFrame, card: DataFrame, threshold: float) -> DataFrame:
    """Exact distinct counts for the columns whose sketch is near the ID threshold.

    Only those columns (usually none) are recounted exactly; the small
    per-column tables are collected to decide which.
    """
    n = stats.select("n_rows").first()[0] or 0
    approx = {r["col"]: r["n_unique"] for r in card.collect()}
    near = [c for c, u in approx.items() if n and abs(u / n - threshold) <= 3 * RSD]
    if near:
        exact = {r["col"]: r["n_unique"] for r in S.distinct_counts(df, near, exact=True).collect()}
        approx.update(exact)
    return df.sparkSession.createDataFrame(list(approx.items()), "col string, n_unique bigint")


def cleaning_report(stats: DataFrame, cardinality_threshold: float = CARDINALITY_THRESHOLD,
                    variance_threshold: float = VARIANCE_THRESHOLD,
                    numeric_null_limit: float = NULL_LIMIT,
                    categorical_null_limit: float = NULL_LIMIT) -> DataFrame:
    """Decision per column (E1-E4): drop flags, first reason, kept."""
    card = (~F.col("is_float")) & (F.coalesce(F.try_divide(F.col("n_unique"), F.col("n_rows")), F.lit(0.0))
                                   >= cardinality_threshold)
    var = (F.col("is_numeric") & F.coalesce(F.col("variance") <= variance_threshold, F.lit(False))) \
        | (F.col("n_unique") <= 1)
    limit = F.when(F.col("is_real_numeric"), F.lit(numeric_null_limit)).otherwise(F.lit(categorical_null_limit))
    nulls = F.col("null_share") > limit
    reason = (F.when(card, F.lit("cardinality")).when(var, F.lit("variance"))
              .when(nulls, F.lit("nulls")).otherwise(F.lit(None).cast("string")))
    return stats.select(
        "col", "n_unique", "null_share", "variance",
        card.alias("drop_cardinality"), var.alias("drop_variance"), nulls.alias("drop_nulls"),
        reason.alias("reason"), (~(card | var | nulls)).alias("kept"))


def cleaning_report_rows(rows: list[tuple], cardinalityThreshold: float = CARDINALITY_THRESHOLD,
                         varianceThreshold: float = VARIANCE_THRESHOLD, numericNullLimit: float = NULL_LIMIT,
                         categoricalNullLimit: float = NULL_LIMIT, distinctMode: str | None = None) -> list[str]:
    """The same decision as :func:`cleaning_report` on statistics already at hand.

    rows: (col, n_rows, n_unique, null_share, variance, is_float, is_numeric,
    is_real_numeric).  Returns the kept columns in input order.
    """
    kept = []
    for col, n, u, null_share, var, is_float, is_num, is_real in rows:
        card = (not is_float) and n > 0 and (u / n) >= cardinalityThreshold
        low_var = (is_num and var is not None and var <= varianceThreshold) or u <= 1
        limit = numericNullLimit if is_real else categoricalNullLimit
        if not (card or low_var or null_share > limit):
            kept.append(col)
    return kept


class _CleanerParams(DefaultParamsReadable, DefaultParamsWritable):
    excludeCols = list_param("excludeCols", "columns passed through untouched (target, keys)")
    cardinalityThreshold = float_param("cardinalityThreshold", "unique share at which a non-float column is dropped")
    varianceThreshold = float_param("varianceThreshold", "numeric columns with variance <= this are dropped")
    numericNullLimit = float_param("numericNullLimit", "null share above which a numeric column is dropped")
    categoricalNullLimit = float_param("categoricalNullLimit", "null share above which other columns are dropped")
    distinctMode = str_param("distinctMode", "exact | approx (sketches, recounted near the threshold)")


class ColumnCleaner(Estimator, _CleanerParams):
    """Estimator: fit decides the kept columns from the training rows (E5)."""

    @keyword_only
    def __init__(self, *, excludeCols=None, cardinalityThreshold=CARDINALITY_THRESHOLD,
                 varianceThreshold=VARIANCE_THRESHOLD, numericNullLimit=NULL_LIMIT,
                 categoricalNullLimit=NULL_LIMIT, distinctMode="exact"):
        super().__init__()
        self._setDefault(excludeCols=[], cardinalityThreshold=CARDINALITY_THRESHOLD,
                         varianceThreshold=VARIANCE_THRESHOLD, numericNullLimit=NULL_LIMIT,
                         categoricalNullLimit=NULL_LIMIT, distinctMode="exact")
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def report(self, df: DataFrame) -> DataFrame:
        excl = set(self.getOrDefault("excludeCols"))
        cols = [c for c in df.columns if c not in excl]
        stats = cleaning_stats(df, cols, self.getOrDefault("distinctMode"), self.getOrDefault("cardinalityThreshold"))
        return cleaning_report(stats, self.getOrDefault("cardinalityThreshold"),
                               self.getOrDefault("varianceThreshold"),
                               self.getOrDefault("numericNullLimit"),
                               self.getOrDefault("categoricalNullLimit"))

    def _fit(self, df: DataFrame) -> "ColumnCleanerModel":
        excl = set(self.getOrDefault("excludeCols"))
        cols = [c for c in df.columns if c not in excl]
        decisions = {r["col"]: r["kept"] for r in self.report(df).select("col", "kept").collect()}
        kept = [c for c in cols if decisions.get(c, True)]
        dropped = [c for c in cols if not decisions.get(c, True)]
        model = ColumnCleanerModel(keptCols=kept, droppedCols=dropped,
                                   excludeCols=self.getOrDefault("excludeCols"))
        return model


class ColumnCleanerModel(Model, _CleanerParams):
    """Keeps the fitted column list (in input order) plus pass-through columns."""

    keptCols = list_param("keptCols", "feature columns kept by the fit")
    droppedCols = list_param("droppedCols", "feature columns dropped by the fit")

    @keyword_only
    def __init__(self, *, keptCols=None, droppedCols=None, excludeCols=None):
        super().__init__()
        self._setDefault(keptCols=[], droppedCols=[], excludeCols=[])
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = set(self.getOrDefault("keptCols"))
        excl = set(self.getOrDefault("excludeCols"))
        return df.select(*[c for c in df.columns if c in kept or c in excl])

    def feature_names(self) -> list[str]:
        """Names of the kept columns (the fitted output, not the dropped list)."""
        return list(self.getOrDefault("keptCols"))
