"""Aggregate expressions whose semantics follow pandas / numpy.

Spark's plain aggregates differ from pandas in a few documented places
(skew is the population g1, ``corr`` raises on a constant column under ANSI,
``percentile`` is exact but memory-bound).  These helpers give the
pandas-compatible forms as Spark expressions so they stay inside one
``agg`` and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skew(c: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``Series.skew``).

    G1 = g1 * sqrt(n (n-1)) / (n-2); NULL for fewer than three values and 0
    for a constant column, as pandas returns.
    """
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    corrected = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).otherwise(F.coalesce(corrected, F.lit(0.0)))


def pairwise_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both values are present (pandas ``corr``).

    NULL when either side is constant instead of a division error.
    """
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    denom = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(denom > 0, F.covar_pop(x, y) / denom)


def median(c: Column, exact: bool = True, accuracy: int = 10000) -> Column:
    """Median with linear interpolation (exact) or a bounded-memory sketch."""
    if exact:
        return F.percentile(c, 0.5)
    return F.percentile_approx(c, 0.5, accuracy).cast("double")


def quantiles(c: Column, probs: list[float], exact: bool = True,
              accuracy: int = 10000) -> Column:
    """Array of quantiles, exact (linear interpolation) or approximate."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    if exact:
        return F.percentile(c, arr)
    return F.percentile_approx(c, arr, accuracy)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or NULL (no ANSI division error)."""
    return F.try_divide(num, den)


def rnd(c: Column, digits: int = 4) -> Column:
    """Round half up as plain IEEE arithmetic: floor(x * 10^d + 0.5) / 10^d.

    Deterministic across engines (the same bits in Spark and in SQL
    engines), unlike decimal-string based rounding.  Values too large to
    carry fractional digits are returned unchanged.  NULL stays NULL.
    """
    scale = float(10 ** digits)
    x = c.cast("double")
    rounded = (F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))
    return F.when(F.abs(x) * F.lit(scale) < F.lit(4.5e15), rounded).otherwise(x)


def distinct_counts(df, columns: list[str], exact: bool = True, rsd: float = 0.01):
    """Distinct non-null values per column as a long table (col, n_unique).

    Exact: the columns are unpivoted to (col, value) and counted by two
    ``groupBy`` passes with map-side combine — cheaper than many
    ``count_distinct`` in one aggregate (which expands every row once per
    column) and never mixed with other aggregates.  The unpivoted value is a
    typed triple (double, long, text) with one field set, so numbers are
    grouped without a text cast; ``-0.0`` is folded into ``0.0`` as grouping
    does.  Approximate: one HyperLogLog aggregate.
    """
    from pyspark.sql import types as T
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "col string, n_unique bigint")
    fields = {f.name: f.dataType for f in df.schema.fields}
    if not exact:
        wide = df.agg(*[F.approx_count_distinct(F.col(c), rsd).alias(f"u{i}") for i, c in enumerate(columns)])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(f"u{i}").cast("bigint").alias("n_unique"))
            for i, c in enumerate(columns)])))

    def typed(i: int, c: str):
        dt = fields[c]
        is_f = isinstance(dt, (T.FloatType, T.DoubleType))
        is_i = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        d = (F.col(c).cast("double") + F.lit(0.0)) if is_f else F.lit(None).cast("double")
        n = F.col(c).cast("long") if is_i else F.lit(None).cast("long")
        t = F.lit(None).cast("string") if (is_f or is_i) else F.col(c).cast("string")
        return F.struct(F.lit(i).alias("k"), d.alias("d"), n.alias("n"), t.alias("t"))

    long = df.select(F.explode(F.array(*[typed(i, c) for i, c in enumerate(columns)])).alias("kv")).select("kv.*")
    pairs = long.where(F.col("d").isNotNull() | F.col("n").isNotNull() | F.col("t").isNotNull()).distinct()
    counts = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n_unique"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "k int, col string")
    # names has one row per column: a bounded broadcast
    return names.join(F.broadcast(counts), "k", "left").select(
        "col", F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint").alias("n_unique"))


def pairwise_corrs(df, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson r of many column pairs, pairwise complete, NULL for a constant side.

    Fast path: Spark's one-state ``corr`` aggregate (it already skips rows
    where either side is NULL) for all pairs in one job, after a min/max pass
    sets aside columns that are constant overall.  ``corr`` raises under ANSI
    when a side is constant only within a pair's complete rows; then the
    guarded covariance form is used instead.  Returns a small dict (one
    number per pair) for the caller to lay out.
    """
    if not pairs:
        return {}
    cols = sorted({c for p in pairs for c in p})
    mm = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(F.col(c).cast("double")).alias(f"a{i}"),
                                                           F.max(F.col(c).cast("double")).alias(f"b{i}"))]).first()
    varying = {c for i, c in enumerate(cols)
               if mm[f"a{i}"] is not None and mm[f"a{i}"] != mm[f"b{i}"]}
    live = [p for p in pairs if p[0] in varying and p[1] in varying]
    out: dict[tuple[str, str], float | None] = {p: None for p in pairs}
    if not live:
        return out
    try:
        row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}")
                       for k, (a, b) in enumerate(live)]).first()
    except Exception as e:  # constant inside a pair's complete rows: guarded form
        if "DIVIDE_BY_ZERO" not in str(e):
            raise
        row = df.agg(*[pairwise_corr(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(live)]).first()
    for k, p in enumerate(live):
        v = row[f"r{k}"]
        out[p] = None if v is None or v != v else float(v)
    return out
