"""Table profiling and task detection (survey section 2.C).

The statistics of every column come out of two jobs: one aggregate for null
counts, moments, min/max, medians and skew, and one unpivot + ``groupBy``
for distinct counts (map-side combined, so a hot value collapses before the
shuffle; kept apart because distinct aggregates next to ``percentile`` make
Spark expand and sort every row).  The one-row result is turned into the
long ``column_profile`` table inside Spark (``inline`` of an array of
structs), so nothing is collected to build it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import stats as S
from strata.functions import types as TY
from strata.sources.readers import require_column

# Rows above which medians take the bracketing plan (same values): the plain
# percentile merges a value -> count map of the whole column in one task.
EXACT_MEDIAN_ROWS = 500_000

# Thresholds of the profiler and its warnings.
NULL_WARN_RATE = 0.3
ID_WARN_RATE = 0.9
IMBALANCE_RATIO = 3.0
UNIQUE_RATIO_THRESHOLD = 0.05
MAX_UNIQUE_FOR_CLASSIFICATION = 20

_PROFILE_SCHEMA = (
    "col string, dtype string, is_numeric boolean, null_count bigint, null_rate double, "
    "cardinality bigint, cardinality_rate double, mean double, std double, min double, "
    "max double, median double, skew double")


def _pandas_like_dtype(dt: T.DataType) -> str:
    """The pandas dtype name a column of this Spark type would carry."""
    mapping = {T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16",
               T.ByteType: "int8", T.DoubleType: "float64", T.FloatType: "float32",
               T.BooleanType: "bool", T.StringType: "object"}
    for k, v in mapping.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return "float64" if dt.scale > 0 else "int64"
    return dt.simpleString()


def _use_exact(df: DataFrame, exact: bool | str) -> tuple[bool, bool]:
    """(exact distinct counts, exact medians) for this table."""
    if exact == "auto":
        return True, df.count() <= EXACT_MEDIAN_ROWS
    return bool(exact), bool(exact)


def _num(c: str, dt: T.DataType) -> Column:
    col = F.col(c)
    return col.cast("int").cast("double") if isinstance(dt, T.BooleanType) else col.cast("double")


def column_profile(df: DataFrame, target: str | None = None, columns: list[str] | None = None,
                   exact: bool | str = "auto", round_digits: int | None = 4,
                   include_n: bool = False) -> DataFrame:
    """Long table, one row per feature column.

    Columns: col, dtype, is_numeric, null_count, null_rate, cardinality,
    cardinality_rate, mean, std, min, max, median, skew.  Statistics of
    non-numeric columns are NULL.  ``exact=False`` uses HyperLogLog distinct
    counts and a bounded-memory median sketch; ``"auto"`` is exact at every
    size: distinct counts by shuffle, medians in the aggregate up to
    ``EXACT_MEDIAN_ROWS`` rows and by bracketing (bounded memory) above.
    """
    cols = columns if columns is not None else [c for c in df.columns if c != target]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _PROFILE_SCHEMA)
    use_exact, exact_median = _use_exact(df, exact)
    fields = {f.name: f.dataType for f in df.schema.fields}
    # job 1: counts, nulls, moments and medians (no distinct aggregate here)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        col, dt = F.col(c), fields[c]
        aggs.append(F.count_if(col.isNull()).alias(f"nul{i}"))
        if TY.is_numeric(dt):
            x = _num(c, dt)
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                     *([S.median(x, exact=True).alias(f"med{i}")] if exact_median else []),
                     S.sample_skew(x).alias(f"skew{i}")]
    wide = df.agg(*aggs)
    large_medians = {}
    if not exact_median and exact is not False:
        # large table: exact medians by bracketing (three bounded jobs for all columns)
        from strata.functions.quantiles import exact_quantiles
        nums = [c for c in cols if TY.is_numeric(fields[c])]
        casted = df.select(*[_num(c, fields[c]).alias(c) for c in nums])
        large_medians = {c: v[0] for c, v in exact_quantiles(casted, nums, [0.5]).items()}
    elif not exact_median:
        wide = df.agg(*aggs, *[S.median(_num(c, fields[c]), exact=False).alias(f"med{i}")
                               for i, c in enumerate(cols) if TY.is_numeric(fields[c])])

    def rnd(c: Column) -> Column:
        return S.rnd(c, round_digits) if round_digits is not None else c

    n = F.col("__n")
    rows = []
    nulld = F.lit(None).cast("double")
    for i, c in enumerate(cols):
        dt = fields[c]
        numeric = TY.is_numeric(dt)
        if numeric and c in large_medians:
            med = F.lit(large_medians[c]).cast("double")
            stat = (lambda p, i=i, med=med: rnd(med if p == "med" else F.col(f"{p}{i}")))
        else:
            stat = (lambda p, i=i: rnd(F.col(f"{p}{i}"))) if numeric else (lambda p: nulld)
        rows.append(F.struct(
            F.lit(c).alias("col"),
            F.lit(dt.simpleString()).alias("dtype"),
            F.lit(numeric).alias("is_numeric"),
            F.col(f"nul{i}").cast("bigint").alias("null_count"),
            rnd(F.coalesce(F.try_divide(F.col(f"nul{i}"), n), F.lit(0.0))).alias("null_rate"),
            stat("mean").alias("mean"), stat("std").alias("std"), stat("min").alias("min"),
            stat("max").alias("max"), stat("med").alias("median"), stat("skew").alias("skew"),
            n.cast("bigint").alias("n_rows"),
        ))
    stats = wide.select(F.inline(F.array(*rows)))
    # job 2: distinct counts; both sides have one row per column (bounded broadcast)
    card = S.distinct_counts(df, cols, exact=use_exact)
    out = stats.join(F.broadcast(card), "col").select(
        "col", "dtype", "is_numeric", "null_count", "null_rate",
        F.col("n_unique").alias("cardinality"),
        rnd(F.coalesce(F.try_divide(F.col("n_unique"), F.col("n_rows")), F.lit(0.0))).alias("cardinality_rate"),
        "mean", "std", "min", "max", "median", "skew", *(["n_rows"] if include_n else []))
    return out


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Top-n values per column with counts, nulls excluded.

    Unpivot -> count per (col, value) with map-side combine -> ``row_number``
    limited to n per column; Spark plans the limit as a partial
    ``WindowGroupLimit`` before the shuffle, so an ID-like column never lands
    whole in one task.  Ties break on the value.  Output: col, rank, value, n.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "col string, rank int, value string, n bigint")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.col", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    w = F.row_number().over(_w_rank("col"))
    return (counts.withColumn("rank", w).where(F.col("rank") <= n)
            .select("col", F.col("rank").cast("int").alias("rank"), "value", "n"))


def _w_rank(part: str):
    from pyspark.sql import Window
    return Window.partitionBy(part).orderBy(F.col("n").desc(), F.col("value"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Class counts of the target, nulls excluded (C14). Output: value, n."""
    return (df.where(F.col(target).isNotNull())
            .groupBy(F.col(target).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# Task detection: six voting rules
# ---------------------------------------------------------------------------

def _target_facts(df: DataFrame, target: str) -> DataFrame:
    """One-row statistics the detection rules need."""
    y = F.col(target)
    dt = df.schema[target].dataType
    if TY.is_numeric(dt):
        yd = _num(target, dt)
        in01 = F.coalesce(F.bool_and(F.when(y.isNotNull(), yd.isin(0.0, 1.0))), F.lit(True))
    else:
        # strings never equal the numbers 0/1; the empty set is still a subset
        in01 = F.count(y) == 0
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count(y).alias("n_nonnull"),
        F.count_distinct(y).alias("n_unique"),
        in01.alias("in01"),
    )


def task_votes(df: DataFrame, target: str) -> DataFrame:
    """The votes of the six rules as rows: rule, task, confidence."""
    require_column(df, target)
    pdt = _pandas_like_dtype(df.schema[target].dataType)
    facts = _target_facts(df, target)
    nu, nn = F.col("n_unique"), F.col("n_nonnull")
    ratio = F.try_divide(nu.cast("double"), nn.cast("double"))

    def vote(rule: str, task: str, conf: float) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(task).alias("task"),
                        F.lit(conf).alias("confidence"))

    none = F.lit(None).cast("struct<rule:string,task:string,confidence:double>")
    r1 = (vote("data_type", "classification", 0.95) if pdt == "object"
          else vote("data_type", "classification", 0.99) if pdt == "bool" else none)
    r2 = (F.when(F.col("in01"), vote("binary", "classification", 0.99))
          .when(nu == 2, vote("binary", "classification", 0.90)).otherwise(none))
    r3 = (F.when((nu <= 10) & (nn > 20) & (ratio < 0.3), vote("unique_count", "classification", 0.95))
          .when(nu <= MAX_UNIQUE_FOR_CLASSIFICATION, vote("unique_count", "classification", 0.80))
          .otherwise(vote("unique_count", "regression", 0.75)))
    r4 = (F.when(nn == 0, none)
          .when(ratio < UNIQUE_RATIO_THRESHOLD, vote("unique_ratio", "classification", 0.85))
          .when(ratio > 0.5, vote("unique_ratio", "regression", 0.80)).otherwise(none))
    is_int = pdt in ("int64", "int32", "int16", "int8")
    r5 = F.when(nu < 20, vote("integer_pattern", "classification", 0.70)).otherwise(none) \
        if is_int else none
    if pdt in ("float64", "float32", "int64", "int32"):
        r6 = F.when(nn == 0, none).when(ratio > 0.8, vote("continuous", "regression", 0.95))
        if pdt in ("int64", "int32"):
            r6 = r6.when(ratio > 0.5, vote("continuous", "regression", 0.90))
        r6 = r6.otherwise(none)
    else:
        r6 = none
    return (facts.select(F.explode(F.array(r1, r2, r3, r4, r5, r6)).alias("v"))
            .where(F.col("v").isNotNull()).select("v.rule", "v.task", "v.confidence"))


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """Classification vs regression by vote (C28). One row: task_type, confidence.

    The class with the larger sum of confidences wins (ties -> classification);
    confidence is the mean of the winner's votes; no votes -> (classification, 0.5).
    """
    votes = task_votes(df, target)
    sums = votes.agg(
        F.coalesce(F.sum(F.when(F.col("task") == "classification", F.col("confidence"))), F.lit(0.0)).alias("clf"),
        F.coalesce(F.sum(F.when(F.col("task") == "regression", F.col("confidence"))), F.lit(0.0)).alias("reg"),
        F.avg(F.when(F.col("task") == "classification", F.col("confidence"))).alias("clf_mean"),
        F.avg(F.when(F.col("task") == "regression", F.col("confidence"))).alias("reg_mean"),
    )
    clf_wins = F.col("clf") >= F.col("reg")
    return sums.select(
        F.when(clf_wins, F.lit("classification")).otherwise(F.lit("regression")).alias("task_type"),
        S.rnd(F.coalesce(F.when(clf_wins, F.col("clf_mean")).otherwise(F.col("reg_mean")),
                           F.lit(0.5)), 4).alias("confidence"))


def detection_details(df: DataFrame, target: str, n_samples: int = 10) -> dict:
    """Detection facts for display (C29): a few scalars plus sample values."""
    decision = detect_task(df, target).first()
    facts = _target_facts(df, target).first()
    nn = facts["n_nonnull"]
    sample = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).limit(n_samples).collect()]
    nulls = facts["n_samples"] - nn
    return {
        "task_type": decision["task_type"], "confidence": decision["confidence"],
        "n_samples": facts["n_samples"], "n_unique": facts["n_unique"],
        "unique_ratio": round(facts["n_unique"] / nn, 4) if nn else 0,
        "dtype": _pandas_like_dtype(df.schema[target].dataType),
        "null_count": nulls,
        "null_rate": round(nulls / facts["n_samples"], 4) if facts["n_samples"] else 0.0,
        "sample_values": sample,
    }


def simple_task_type(df: DataFrame, target: str, threshold: int = 15) -> str:
    """Fallback detector (C30): strings -> classification; <= threshold distinct -> classification."""
    return simple_task_types(df, [target], threshold).first()["task_type"]


def simple_task_types(df: DataFrame, targets: list[str], threshold: int = 15) -> DataFrame:
    """Fallback detector for several candidate targets in one aggregate.

    Output: target, task_type.
    """
    text = {t for t in targets if isinstance(df.schema[t].dataType, (T.StringType, T.BooleanType))}
    counted = [t for t in targets if t not in text]
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_distinct(t).alias(f"u{i}") for i, t in enumerate(counted)])
    rows = []
    for t in targets:
        if t in text:
            task = F.lit("classification")
        else:
            u = F.col(f"u{counted.index(t)}")
            task = F.when(u <= threshold, F.lit("classification")).otherwise(F.lit("regression"))
        rows.append(F.struct(F.lit(t).alias("target"), task.alias("task_type")))
    return wide.select(F.inline(F.array(*rows)))


def detection_details_table(df: DataFrame, target: str, order_by: list[str], n_samples: int = 10) -> DataFrame:
    """Detection facts as one row (C29): decision, counts, ratio, dtype, nulls, sample values.

    The sample is the first ``n_samples`` non-null values in ``order_by``
    order (a distributed top-k; at most n values reach the driver).
    """
    facts = _target_facts(df, target)
    decision = detect_task(df, target).first()
    sample = [str(r[0]) for r in df.where(F.col(target).isNotNull()).orderBy(*order_by)
              .select(target).limit(n_samples).collect()]
    nn, n = F.col("n_nonnull"), F.col("n_samples")
    return facts.select(
        F.lit(decision["task_type"]).alias("task_type"), F.lit(decision["confidence"]).alias("confidence"),
        n.cast("bigint").alias("n_samples"), F.col("n_unique").cast("bigint").alias("n_unique"),
        F.coalesce(S.rnd(F.try_divide(F.col("n_unique").cast("double"), nn), 4), F.lit(0.0)).alias("unique_ratio"),
        F.lit(_pandas_like_dtype(df.schema[target].dataType)).alias("dtype"),
        (n - nn).cast("bigint").alias("null_count"),
        F.coalesce(S.rnd(F.try_divide((n - nn).cast("double"), n), 4), F.lit(0.0)).alias("null_rate"),
        F.array(*[F.lit(v) for v in sample]).cast("array<string>").alias("sample_values"))


# ---------------------------------------------------------------------------
# Target statistics and warnings
# ---------------------------------------------------------------------------

def target_stats(df: DataFrame, target: str, task_type: str) -> DataFrame:
    """One-row target profile.

    Classification: dtype, null_count, null_rate, cardinality, n_classes,
    imbalance_ratio (max/min class count, rounded 4), is_imbalanced (> 3.0).
    The class counts come from one ``groupBy`` that keeps the NULL group, so
    every field derives from that small table (no second pass, no join).
    Regression: dtype, null_count, null_rate, cardinality, mean, std, min,
    max, skew, is_imbalanced = false (one aggregate).
    """
    y = F.col(target)
    dt = df.schema[target].dataType
    dtype = F.lit(dt.simpleString()).alias("dtype")
    if task_type == "classification":
        groups = df.groupBy(y.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        known = F.col("value").isNotNull()
        agg = groups.agg(
            F.sum("n").alias("rows"), F.sum(F.when(~known, F.col("n"))).alias("nulls"),
            F.count_if(known).alias("n_classes"),
            F.max(F.when(known, F.col("n"))).alias("max_n"), F.min(F.when(known, F.col("n"))).alias("min_n"))
        nulls = F.coalesce(F.col("nulls"), F.lit(0))
        ratio = S.rnd(F.try_divide(F.col("max_n").cast("double"), F.col("min_n")), 4)
        return agg.select(
            dtype, nulls.cast("bigint").alias("null_count"),
            S.rnd(F.coalesce(F.try_divide(nulls, F.col("rows")), F.lit(0.0)), 4).alias("null_rate"),
            F.col("n_classes").cast("bigint").alias("cardinality"),
            F.col("n_classes").cast("bigint").alias("n_classes"),
            ratio.alias("imbalance_ratio"),
            F.coalesce(ratio > IMBALANCE_RATIO, F.lit(False)).alias("is_imbalanced"))
    x = _num(target, dt)
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count(y).alias("nn"),
                  F.count_distinct(y).alias("cardinality"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                  S.sample_skew(x).alias("skew"))
    return base.select(
        dtype, (F.col("n") - F.col("nn")).cast("bigint").alias("null_count"),
        S.rnd(F.coalesce(F.try_divide(F.col("n") - F.col("nn"), F.col("n")), F.lit(0.0)), 4).alias("null_rate"),
        F.col("cardinality").cast("bigint").alias("cardinality"),
        *[S.rnd(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "max", "skew")],
        F.lit(False).alias("is_imbalanced"))


def fmt1(c: Column) -> Column:
    """Fixed one-decimal text, rounding the exact binary value half-even like Python."""
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def build_warnings(col_profile: DataFrame, target: str, tstats: DataFrame | None = None) -> DataFrame:
    """Human-readable warnings (C17-C19). Output: kind, col, message.

    Fixed values: the three message formats below.
    """
    nulls = col_profile.where(F.col("null_rate") > NULL_WARN_RATE).select(
        F.lit("missing").alias("kind"), "col",
        F.format_string("'%s' has %s%% missing values — may be dropped by cleaning",
                        F.col("col"), fmt1(F.col("null_rate") * 100)).alias("message"))
    ids = col_profile.where((F.col("cardinality_rate") > ID_WARN_RATE) & ~F.col("is_numeric")).select(
        F.lit("id_like").alias("kind"), "col",
        F.format_string("'%s' has %s%% unique values — likely an ID column, will be dropped",
                        F.col("col"), fmt1(F.col("cardinality_rate") * 100)).alias("message"))
    out = nulls.unionByName(ids)
    if tstats is not None and "imbalance_ratio" in tstats.columns:
        imb = tstats.where(F.col("is_imbalanced")).select(
            F.lit("imbalanced").alias("kind"), F.lit(target).alias("col"),
            F.format_string("Target '%s' is imbalanced (ratio %sx) — consider class weighting",
                            F.lit(target), fmt1(F.col("imbalance_ratio"))).alias("message"))
        out = out.unionByName(imb)
    return out


def memory_bytes(df: DataFrame) -> DataFrame:
    """Logical size of the table in bytes (C12, re-aimed): fixed widths + string bytes."""
    width = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.FloatType: 4, T.ShortType: 2,
             T.ByteType: 1, T.BooleanType: 1, T.TimestampType: 8, T.TimestampNTZType: 8,
             T.DateType: 4}
    terms = []
    for f in df.schema.fields:
        w = next((v for k, v in width.items() if isinstance(f.dataType, k)), None)
        if w is not None:
            terms.append(F.lit(w))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            terms.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)))
        else:
            terms.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    agg = df.agg(F.coalesce(F.sum(total.cast("bigint")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("memory_mb", S.rnd(F.col("bytes") / 1048576.0, 3))


@dataclass
class Profile:
    """Profile of one table: scalars plus the result DataFrames."""
    n_rows: int
    n_cols: int
    target: str
    task_type: str
    task_confidence: float
    memory_mb: float
    columns: DataFrame
    target_stats: DataFrame
    votes: DataFrame
    warnings: DataFrame
    extras: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        """Small JSON-able summary (the profile document), collected from tiny tables."""
        return {
            "n_rows": self.n_rows, "n_cols": self.n_cols, "target_col": self.target,
            "task_type": self.task_type, "task_confidence": self.task_confidence,
            "memory_mb": self.memory_mb,
            "columns": {r["col"]: r.asDict() for r in self.columns.collect()},
            "target": self.target_stats.first().asDict(),
            "warnings": [r["message"] for r in self.warnings.collect()],
        }


def profile(df: DataFrame, target: str, exact: bool | str = "auto") -> Profile:
    """Full table profile (C20): detection, column stats, target stats, warnings."""
    require_column(df, target)
    decision = detect_task(df, target).first()
    cols = [c for c in df.columns if c != target]
    cp = column_profile(df, target, exact=exact).cache()
    ts = target_stats(df, target, decision["task_type"]).cache()
    agg = memory_bytes(df).first()
    return Profile(
        n_rows=agg["n"], n_cols=len(cols), target=target, task_type=decision["task_type"],
        task_confidence=decision["confidence"],
        memory_mb=round((agg["bytes"] or 0) / 1024 ** 2, 3),
        columns=cp, target_stats=ts, votes=task_votes(df, target),
        warnings=build_warnings(cp, target, ts))
