"""EDA tables: the data behind every chart of the report (survey section 2.D).

Histograms need the column range first: one ``min/max`` aggregate, whose two
scalars per column become literals of the binning expression (a statistic,
not data, reaches the driver).  Counting is then one ``groupBy`` with
map-side combine; empty bins come from a left join with the (tiny) bin list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.functions import types as TY
from strata.operators import profile as P
from strata.operators import widecorr as WC

# Chart parameters of the report.
TARGET_BINS = 40
FEATURE_BINS = 30
MAX_HIST_COLUMNS = 12
BALANCE_WARN_SHARE = 0.75
SKEW_LIMIT = 1.0


def _range(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    row = df.agg(*[e for c in cols for e in (F.min(F.col(c).cast("double")).alias(f"mn{c}"),
                                             F.max(F.col(c).cast("double")).alias(f"mx{c}"))]).first()
    return {c: (row[f"mn{c}"], row[f"mx{c}"]) for c in cols}


def left_edges(mn: float, mx: float, bins: int) -> tuple[float, float]:
    """numpy.histogram range: a constant column gets (v - 0.5, v + 0.5)."""
    if mn == mx:
        return mn - 0.5, mx + 0.5
    return mn, mx


def right_edges(mn: float, mx: float) -> tuple[float, float]:
    """pandas.cut range for an integer bin count: widen a constant column by 0.1 %."""
    if mn == mx:
        adj = 0.001 * abs(mn) if mn != 0 else 0.001
        return mn - adj, mx + adj
    return mn, mx


def left_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin, left-closed, last bin closed (matplotlib / numpy)."""
    width = F.lit(hi) - F.lit(lo)
    raw = F.floor((x.cast("double") - F.lit(lo)) / width * F.lit(float(bins)))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def right_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin, right-closed with the lowest value included (pandas.cut).

    Bin = number of inner edges strictly below x; edge i is ``i*step + lo``
    as numpy.linspace builds it.
    """
    step = (hi - lo) / bins
    x = x.cast("double")
    flags = [F.when(x > F.lit(i * step + lo), 1).otherwise(0) for i in range(1, bins)]
    total = flags[0] if flags else F.lit(0)
    for f in flags[1:]:
        total = total + f
    return total.cast("int")


def _format_intervals(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([f"{x:.2g}–{y:.2g}" for x, y in zip(a, b)])


def _interval_label(lo, hi):
    """Text label ``{lo:.2g}–{hi:.2g}`` per bin (Python general format).

    Runs over the finished histogram (one row per bin), never over data rows.
    """
    return F.pandas_udf(_format_intervals, "string")(lo, hi)


def histogram(df: DataFrame, col: str, bins: int = FEATURE_BINS, closed: str = "left",
              labels: bool = False) -> DataFrame:
    """Histogram with every bin present (D2 left-closed, D3 right-closed).

    Output: bin, lo, hi, n (lo/hi rounded to 4 digits), plus ``label`` when
    ``labels``: the interval text of the right-closed view, whose first
    interval starts 0.1 % of the range below the minimum (pandas.cut).
    """
    mn, mx = _range(df, [col])[col]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    if closed == "left":
        lo, hi = left_edges(mn, mx, bins)
        b = left_bin(F.col(col), lo, hi, bins)
    else:
        lo, hi = right_edges(mn, mx)
        b = right_bin(F.col(col), lo, hi, bins)
    counts = (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    step = (hi - lo) / bins
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    lo_c = F.col("bin") * F.lit(step) + F.lit(lo)
    hi_c = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise((F.col("bin") + 1) * F.lit(step) + F.lit(lo))
    out = frame.join(counts, "bin", "left").select(
        "bin", S.rnd(lo_c, 4).alias("lo"), S.rnd(hi_c, 4).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("bin") == 0, F.lit(lo - (hi - lo) * 0.001)).otherwise(lo_c).alias("__l"),
        hi_c.alias("__r"))
    if labels:
        out = out.withColumn("label", _interval_label(F.col("__l"), F.col("__r")))
    return out.drop("__l", "__r")


def feature_histograms(df: DataFrame, target: str | None = None, bins: int = FEATURE_BINS,
                       max_cols: int = MAX_HIST_COLUMNS) -> DataFrame:
    """Histograms of the first ``max_cols`` numeric features in one job.

    The numeric columns are unpivoted and binned with per-column literal
    ranges; one ``groupBy(col, bin)`` counts all of them.
    Output: col, bin, n (non-empty bins only).
    """
    cols = [c for c in TY.numeric_columns(df) if c != target][:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "col string, bin int, n bigint")
    ranges = _range(df, cols)
    parts = []
    for c in cols:
        mn, mx = ranges[c]
        if mn is None:
            continue
        lo, hi = left_edges(mn, mx, bins)
        parts.append(F.struct(F.lit(c).alias("col"),
                              F.when(F.col(c).isNotNull(), left_bin(F.col(c), lo, hi, bins)).alias("bin")))
    long = df.select(F.explode(F.array(*parts)).alias("kv")).select("kv.col", "kv.bin")
    return (long.where(F.col("bin").isNotNull()).groupBy("col", "bin")
            .agg(F.count(F.lit(1)).alias("n")))


def target_bars(df: DataFrame, target: str, task_type: str) -> DataFrame:
    """Target chart data (D1): class counts, or a 40-bin histogram for regression."""
    if task_type == "classification":
        return P.class_distribution(df, target)
    return histogram(df, target, bins=TARGET_BINS, closed="left")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Pairwise-complete Pearson matrix of numeric columns.

    Output long: col_a, col_b, r (rounded; NULL for a constant column).
    Empty when fewer than two numeric columns exist.  Up to ``widecorr.ABOVE``
    columns all pairs are scored in one aggregate (see
    :func:`strata.functions.stats.pairwise_corrs`), more by matrix products.
    """
    cols = cols if cols is not None else TY.numeric_columns(df)
    if len(cols) > WC.ABOVE:
        return WC.wide_correlation(df, cols).select("col_a", "col_b", S.rnd(F.col("r"), digits).alias("r"))
    spark = df.sparkSession
    schema = "col_a string, col_b string, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    rs = S.pairwise_corrs(df, pairs)
    rows = []
    for a, b in pairs:
        rows.append((a, b, rs[(a, b)]))
        if a != b:
            rows.append((b, a, rs[(a, b)]))
    return spark.createDataFrame(rows, schema).select("col_a", "col_b", S.rnd(F.col("r"), digits).alias("r"))


def target_correlation(df: DataFrame, target: str, digits: int = 4) -> DataFrame:
    """Feature -> target correlation ranked by |r| (D8). Output: feature, r, rank."""
    cols = [c for c in TY.numeric_columns(df) if c != target]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, r double, rank int")
    rs = S.pairwise_corrs(df, [(c, target) for c in cols])
    long = spark.createDataFrame([(c, rs[(c, target)]) for c in cols], "feature string, r double").select(
        "feature", S.rnd(F.col("r"), digits).alias("r")).where(F.col("r").isNotNull())
    w = Window.orderBy(F.abs("r").desc(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w).cast("int"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group (D11); NULLs group together.

    One ``groupBy`` over all columns with map-side combine, so a hot
    duplicate group collapses before the shuffle.  Output: duplicate_rows.
    """
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def missing_table(col_profile: DataFrame) -> DataFrame:
    """Missing share per column in percent (round 1), only > 0, largest first."""
    return (col_profile.where(F.col("null_rate") > 0)
            .select("col", S.rnd(F.col("null_rate") * 100, 1).alias("missing_pct"))
            .orderBy(F.col("missing_pct").desc(), "col"))


def missing_pct(df: DataFrame, target: str | None = None) -> DataFrame:
    """Exact missing % per column from the data (D9); one aggregate pass."""
    cols = [c for c in df.columns if c != target]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}")
                                                    for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"),
                 S.rnd(F.try_divide(F.col(f"m{i}") * 100.0, F.col("__n")), 1).alias("missing_pct"))
        for i, c in enumerate(cols)])))
    return long.where(F.col("missing_pct") > 0)


def shape_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric / categorical counts, missing cells, duplicates.

    All from the one ``groupBy(all columns)`` that finds duplicates: each
    group carries its size and its number of NULL cells.
    """
    num = len(TY.numeric_columns(df))
    row_nulls = F.lit(0)
    for c in df.columns:
        row_nulls = row_nulls + F.when(F.col(c).isNull(), 1).otherwise(0)
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("rows"),
        F.lit(len(df.columns)).cast("int").alias("columns"),
        F.lit(num).cast("int").alias("numeric"),
        F.lit(len(df.columns) - num).cast("int").alias("categorical"),
        F.coalesce(F.sum(F.col("__n") * row_nulls), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Categorical target view.

    Output one row: n_classes, nulls, majority_share (round 4), is_binary,
    imbalanced (binary and majority share > 0.75).  One ``groupBy`` that
    keeps the NULL group gives every field.
    """
    groups = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    agg = groups.agg(F.count_if(known).alias("n_classes"),
                     F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
                     F.max(F.when(known, F.col("n"))).alias("mx"), F.sum(F.when(known, F.col("n"))).alias("tot"))
    share = S.rnd(F.try_divide(F.col("mx").cast("double"), F.col("tot")), 4)
    return agg.select(
        F.col("n_classes").cast("bigint").alias("n_classes"), F.col("nulls").cast("bigint").alias("nulls"),
        share.alias("majority_share"), (F.col("n_classes") == 2).alias("is_binary"),
        ((F.col("n_classes") == 2) & (share > BALANCE_WARN_SHARE)).alias("imbalanced"))


def target_range(df: DataFrame, target: str) -> DataFrame:
    """Numeric target min / mean / max, 2 digits as displayed."""
    x = F.col(target).cast("double")
    return df.agg(S.rnd(F.min(x), 2).alias("min"), S.rnd(F.avg(x), 2).alias("mean"),
                  S.rnd(F.max(x), 2).alias("max"))


def column_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """Per column: dtype, non_null, null_pct (1), unique, min, mean (3), max."""
    cp = P.column_profile(df, target=target, round_digits=None, include_n=True)
    return cp.select(
        "col", "dtype", (F.col("n_rows") - F.col("null_count")).cast("bigint").alias("non_null"),
        S.rnd(F.col("null_rate") * 100, 1).alias("null_pct"),
        F.col("cardinality").alias("unique"), S.rnd(F.col("min"), 4).alias("min"),
        S.rnd(F.col("mean"), 3).alias("mean"), S.rnd(F.col("max"), 4).alias("max"))


def null_totals(col_profile: DataFrame) -> DataFrame:
    """Total nulls and their % of all feature cells, round 1.

    ``col_profile`` must carry ``n_rows`` (``column_profile(include_n=True)``).
    """
    return col_profile.agg(
        F.coalesce(F.sum("null_count"), F.lit(0)).cast("bigint").alias("total_nulls"),
        S.rnd(F.coalesce(F.try_divide(F.sum("null_count") * 100.0,
                                      F.max("n_rows") * F.count(F.lit(1))), F.lit(0.0)), 1).alias("null_pct"))


def most_skewed(col_profile: DataFrame, limit: float = SKEW_LIMIT, top: int = 5) -> DataFrame:
    """Numeric features with |skew| > 1, the five largest (D18). Output: col, skew, rank."""
    w = Window.orderBy(F.abs("skew").desc(), F.col("col"))
    return (col_profile.where(F.col("is_numeric") & (F.abs("skew") > limit))
            .select("col", "skew").withColumn("rank", F.row_number().over(w).cast("int"))
            .where(F.col("rank") <= top))
