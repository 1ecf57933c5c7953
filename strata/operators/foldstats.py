"""Training-fold statistics of every fold from two jobs.

The training rows of fold f are all rows outside fold f, so any statistic
that merges exactly can be computed once per fold and combined:

* job 1 (``groupBy(fold)``): row count and, per column, null count, count,
  mean and second central moment; the moments of "all folds but f" are
  merged with Chan's parallel formula (exact up to rounding);
* job 2 (unpivot -> ``groupBy(col, value)``): per distinct value a bitmask
  of the folds it occurs in and its count per fold; the distinct count of
  the training rows of f counts values whose mask has a bit other than f,
  and the category vocabulary of f is the top-N by count outside f.

This replaces k cleaning fits (two jobs each), k scaler fits, k category
fits and k context jobs with two jobs for all folds.  Medians and quartiles
do not merge, but brackets around their ranks do: see
``functions.quantiles.quantiles_outside_folds``, whose number of jobs does not
depend on k either.  Medians are taken for columns with NULLs only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import types as TY
from strata.functions.quantiles import quantiles_outside_folds
from strata.operators.cells import WEIGHT


@dataclass
class Moments:
    n: float = 0.0
    mean: float = 0.0
    m2: float = 0.0

    def merge(self, other: "Moments") -> "Moments":
        if other.n == 0:
            return Moments(self.n, self.mean, self.m2)
        if self.n == 0:
            return Moments(other.n, other.mean, other.m2)
        n = self.n + other.n
        delta = other.mean - self.mean
        return Moments(n, self.mean + delta * other.n / n, self.m2 + other.m2 + delta * delta * self.n * other.n / n)

    def var_samp(self):
        return self.m2 / (self.n - 1) if self.n > 1 else None

    def std_pop(self):
        return (self.m2 / self.n) ** 0.5 if self.n > 0 else None


@dataclass
class FoldStats:
    k: int
    n_rows: dict = field(default_factory=dict)        # fold -> training rows
    nulls: dict = field(default_factory=dict)         # fold -> col -> nulls in training rows
    moments: dict = field(default_factory=dict)       # fold -> col -> Moments
    n_unique: dict = field(default_factory=dict)      # fold -> col -> distinct non-null values
    vocab: dict = field(default_factory=dict)         # fold -> col -> [top values]
    fills: dict = field(default_factory=dict)         # fold -> col -> median of the training rows, 0 without values
    quartiles: dict = field(default_factory=dict)     # fold -> col -> [q1, median, q3] of the imputed rows


def _weighted_moments(data: DataFrame, columns: list[str], numeric: list[str], num) -> dict[int, dict]:
    """What job 1 gives, for rows that stand for WEIGHT rows each: sums about the mean of all rows, brought to each fold's."""
    w = F.col(WEIGHT)
    given = [F.when(num(c).isNotNull(), w) for c in numeric]
    at = data.agg(*[(F.sum(num(c) * w) / F.sum(g)).alias(f"m{i}") for i, (c, g) in enumerate(zip(numeric, given))]).first() if numeric else {}
    aggs = [F.sum(w).alias("__n"), *[F.coalesce(F.sum(F.when(F.col(c).isNull(), w)), F.lit(0)).alias(f"z{i}") for i, c in enumerate(columns)]]
    for i, (c, g) in enumerate(zip(numeric, given)):
        x = num(c) - F.lit(at[f"m{i}"] or 0.0)
        aggs += [F.sum(g).alias(f"c{i}"), F.sum(x * w).alias(f"s{i}"), F.sum(x * x * w).alias(f"q{i}")]
    out = {}
    for r in data.groupBy("fold").agg(*aggs).collect():
        out[r["fold"]] = got = r.asDict()
        for i in range(len(numeric)):
            if n := got[f"c{i}"]:
                d = got[f"s{i}"] / n
                got[f"m{i}"], got[f"v{i}"] = at[f"m{i}"] + d, max(got[f"q{i}"] / n - d * d, 0.0)
    return out


def fold_statistics(data: DataFrame, columns: list[str], label: str, k: int, max_categories: int | None,
                    missing_token: str = "missing", scaler: str = "standard", rows: DataFrame | None = None) -> FoldStats:
    """Statistics of ``data``; where its rows stand for several (WEIGHT), ``rows`` are these, for the quantiles."""
    rows, weighted = data if rows is None else rows, WEIGHT in data.columns
    fields = {f.name: f.dataType for f in data.schema.fields}
    numeric = [c for c in columns if TY.is_numeric(fields[c])] + [label]

    def num(c):
        dt = fields[c]
        return F.col(c).cast("double") if TY.is_real_numeric(dt) else F.col(c).cast("int").cast("double")

    # job 1: per fold counts, nulls and moments
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"z{i}"))
    for i, c in enumerate(numeric):
        x = num(c)
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per_fold = _weighted_moments(data, columns, numeric, num) if weighted else {r["fold"]: r for r in data.groupBy("fold").agg(*aggs).collect()}
    st = FoldStats(k)
    for f in range(k):
        others = [per_fold[g] for g in per_fold if g != f]
        st.n_rows[f] = sum(r["__n"] for r in others)
        st.nulls[f] = {c: sum(r[f"z{i}"] for r in others) for i, c in enumerate(columns)}
        mom = {}
        for i, c in enumerate(numeric):
            acc = Moments()
            for r in others:
                n = r[f"c{i}"] or 0
                if n:
                    acc = acc.merge(Moments(float(n), r[f"m{i}"], (r[f"v{i}"] or 0.0) * n))
            mom[c] = acc
        st.moments[f] = mom

    # medians of the columns with NULLs, and for the robust scaler the quartiles after imputation
    real = [c for c in columns if TY.is_real_numeric(fields[c])]
    gaps = [c for c in real if any(st.nulls[f][c] for f in range(k))]
    medians = quantiles_outside_folds(rows, gaps, [0.5], "fold", k)
    st.fills = {f: {c: medians[f][c][0] if medians[f][c][0] is not None else 0.0 for c in gaps} for f in range(k)}
    if scaler == "robust":
        copies = {f: {c: (st.fills[f][c], st.nulls[f][c]) for c in gaps} for f in range(k)}
        st.quartiles = quantiles_outside_folds(rows, real, [0.25, 0.5, 0.75], "fold", k, copies)

    # job 2: per (column, value) fold mask and per-fold counts
    def typed(c):
        # numbers group as numbers (no text cast); floats fold -0.0 into 0.0 as grouping does
        dt = fields[c]
        is_f = isinstance(dt, (T.FloatType, T.DoubleType))
        is_i = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        d = (F.col(c).cast("double") + F.lit(0.0)) if is_f else F.lit(None).cast("double")
        n = F.col(c).cast("long") if is_i else F.lit(None).cast("long")
        t = F.lit(None).cast("string") if (is_f or is_i) else F.col(c).cast("string")
        return F.struct(F.lit(c).alias("col"), d.alias("d"), n.alias("n"), t.alias("value"))

    own = [WEIGHT] if weighted else []
    long = data.select("fold", *own, F.explode(F.array(*[typed(c) for c in columns])).alias("kv")) \
        .select("fold", *own, "kv.col", "kv.d", "kv.n", "kv.value")

    def in_fold(g):
        here = F.col("fold") == g
        return F.coalesce(F.sum(F.when(here, F.col(WEIGHT))), F.lit(0).cast("long")) if weighted else F.count_if(here)

    by_value = long.groupBy("col", "d", "n", "value").agg(
        F.bit_or(F.expr("shiftleft(1L, fold)")).alias("mask"), *[in_fold(g).alias(f"n{g}") for g in range(k)])
    present = F.col("d").isNotNull() | F.col("n").isNotNull() | F.col("value").isNotNull()
    uniq = by_value.where(present).groupBy("col").agg(*[
        F.count_if(F.col("mask").bitwiseAND(F.lit(~(1 << f))) != 0).alias(f"u{f}") for f in range(k)]).collect()
    for f in range(k):
        st.n_unique[f] = {r["col"]: r[f"u{f}"] for r in uniq}
    # vocabularies of the categorical columns (after NULL -> missing), top-N by training count
    cats = [c for c in columns if not TY.is_real_numeric(fields[c])]
    st.vocab = {f: {c: [] for c in cats} for f in range(k)}
    if cats:
        total = sum(F.col(f"n{g}") for g in range(k))
        filled = (by_value.where(F.col("col").isin(cats))
                  .withColumn("value", F.coalesce("value", F.lit(missing_token)))
                  .groupBy("col", "value").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(k)],
                                               F.sum(total).alias("tot")))
        per_f = filled.select("col", "value", F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), (F.col("tot") - F.col(f"n{f}")).alias("cnt")) for f in range(k)]))
            .alias("t")).select("col", "value", "t.f", "t.cnt").where(F.col("cnt") > 0)
        if max_categories:
            w = Window.partitionBy("col", "f").orderBy(F.col("cnt").desc(), F.col("value"))
            per_f = per_f.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_categories)
        top = per_f.select("col", "f", "value").collect()
        for r in top:
            st.vocab[r["f"]][r["col"]].append(r["value"])
    return st
