"""Declarative feature catalogue (survey 2.J) and the feature step.

Each feature is a small spec: ``fit(df)`` computes the statistics it needs
from the training rows (a few scalars, or a grouped table for group
aggregates) and ``apply(df, stats)`` adds the column as a Spark expression.
Column-only features of one step are applied in a single ``select``; the
two features that need other rows (group aggregates, percentile ranks) are
joins against aggregated tables, broadcast only under a row-count check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator as _Estimator
from pyspark.ml import Model as _Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import stats as S
from strata.functions.joins import join_small
from strata.functions.scan import value_counts_with_prefix
from strata.operators.persist import Saved
from strata.session import cut_lineage

EPS = 1e-9
# Rows above which quantiles take the bracketing plan (same values, bounded memory).
EXACT_ROWS = 10_000_000


def _column_quantiles(df: DataFrame, col: str, probs: list[float], exact: bool = True) -> list:
    x = F.col(col).cast("double")
    if exact and df.count() > EXACT_ROWS:
        from strata.functions.quantiles import exact_quantiles
        return exact_quantiles(df.select(x.alias("x")), ["x"], probs)["x"]
    got = df.agg(S.quantiles(x, probs, exact=exact)).first()[0]
    return list(got) if got is not None else [None] * len(probs)


class Feature:
    """Base spec. ``name`` is the output column (an existing name is overwritten)."""

    name: str
    #: True when the value of a row depends only on that row (plus fitted scalars)
    row_local: bool = True

    def fit(self, df: DataFrame):
        return None

    def column(self, stats) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, stats) -> DataFrame:
        return df.withColumn(self.name, self.column(stats))

    def describe(self) -> str:
        return f"{type(self).__name__}({self.name})"


@dataclass
class Expr(Feature):
    """Any row-wise expression: sums, differences, products, powers, trig,
    weighted scores, closed formulas, constants (J1, J2, J4, J7, J19-J21, J23, J24)."""
    name: str
    expr: str | Column

    def column(self, stats) -> Column:
        return F.expr(self.expr) if isinstance(self.expr, str) else self.expr

    def describe(self) -> str:
        return f"{self.name} = {self.expr}" if isinstance(self.expr, str) else super().describe()


@dataclass
class Ratio(Feature):
    """num / (den + eps); NULL where the denominator is 0."""
    name: str
    num: str
    den: str
    eps: float = EPS

    def column(self, stats) -> Column:
        return F.try_divide(F.expr(self.num).cast("double"), F.expr(self.den).cast("double") + F.lit(self.eps))


def family_ratios(columns: list[str], num_suffix: str, den_suffix: str, out_suffix: str = "_ratio") -> list[Ratio]:
    """One ratio for every measurement that has a column with either suffix, in column order."""
    have = set(columns)
    stems = [c[:-len(num_suffix)] for c in columns if c.endswith(num_suffix) and len(c) > len(num_suffix)]
    return [Ratio(f"{x}{out_suffix}", f"`{x}{num_suffix}`", f"`{x}{den_suffix}`") for x in stems if f"{x}{den_suffix}" in have]


@dataclass
class Remap(Feature):
    """Values of a column by a map; values outside it become NULL."""
    name: str
    col: str
    mapping: dict

    def column(self, stats) -> Column:
        if not self.mapping:
            return F.lit(None).cast("string")
        pairs = [F.lit(v) for kv in self.mapping.items() for v in kv]
        return F.try_element_at(F.create_map(*pairs), F.col(self.col))


def added_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns that a transform added, in their order."""
    have = set(before.columns)
    return [c for c in after.columns if c not in have]


@dataclass
class Log1p(Feature):
    """log(1 + x); NULL out of domain."""
    name: str
    col: str

    def column(self, stats) -> Column:
        return F.log1p(F.col(self.col).cast("double"))


@dataclass
class Log2Floor(Feature):
    """log2(max(x, floor))."""
    name: str
    col: str
    floor: float = 1.0

    def column(self, stats) -> Column:
        return F.log2(F.greatest(F.col(self.col).cast("double"), F.lit(self.floor)))


@dataclass
class SqrtAbs(Feature):
    """sqrt(|x|)."""
    name: str
    col: str

    def column(self, stats) -> Column:
        return F.sqrt(F.abs(F.col(self.col).cast("double")))


@dataclass
class Power(Feature):
    """x ** p (J4)."""
    name: str
    col: str
    p: float = 2.0

    def column(self, stats) -> Column:
        return F.pow(F.col(self.col).cast("double"), F.lit(self.p))


@dataclass
class Hypot(Feature):
    """sqrt(a^2 + b^2)."""
    name: str
    a: str
    b: str

    def column(self, stats) -> Column:
        return F.hypot(F.col(self.a).cast("double"), F.col(self.b).cast("double"))


@dataclass
class ZScore(Feature):
    """(x - mean) / (sample std + eps) with statistics from the fit rows."""
    name: str
    col: str
    eps: float = EPS

    def fit(self, df):
        x = F.col(self.col).cast("double")
        r = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        return (r["m"], r["s"])

    def column(self, stats) -> Column:
        m, s = stats
        if m is None:
            return F.lit(None).cast("double")
        return (F.col(self.col).cast("double") - F.lit(m)) / (F.lit(s or 0.0) + F.lit(self.eps))


@dataclass
class Clip(Feature):
    """Clip to constants; NULL stays NULL."""
    name: str
    col: str
    lo: float | None = None
    hi: float | None = None

    def column(self, stats) -> Column:
        x = F.col(self.col).cast("double")
        out = x
        if self.lo is not None:
            out = F.greatest(out, F.lit(float(self.lo)))
        if self.hi is not None:
            out = F.least(out, F.lit(float(self.hi)))
        return F.when(x.isNotNull(), out)


@dataclass
class IQRClip(Feature):
    """Clip to the fences q1 - k*IQR .. q3 + k*IQR of the fit rows."""
    name: str
    col: str
    k: float = 1.5
    exact: bool = True

    def fit(self, df):
        q = _column_quantiles(df, self.col, [0.25, 0.75], self.exact)
        if not q or q[0] is None:
            return (None, None)
        iqr = q[1] - q[0]
        return (q[0] - self.k * iqr, q[1] + self.k * iqr)

    def column(self, stats) -> Column:
        lo, hi = stats
        x = F.col(self.col).cast("double")
        if lo is None:
            return x
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


@dataclass
class EqualWidthBins(Feature):
    """Equal-width bin codes 0..n-1, right-closed, lowest included."""
    name: str
    col: str
    bins: int = 5

    def fit(self, df):
        x = F.col(self.col).cast("double")
        r = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()
        return (r["mn"], r["mx"])

    def column(self, stats) -> Column:
        from strata.operators.eda import right_bin, right_edges
        mn, mx = stats
        if mn is None:
            return F.lit(None).cast("int")
        lo, hi = right_edges(mn, mx)
        x = F.col(self.col).cast("double")
        return F.when(x.isNotNull(), right_bin(x, lo, hi, self.bins))


@dataclass
class NamedBins(Feature):
    """Labels for right-closed intervals between cut points (J13); outside -> NULL."""
    name: str
    col: str
    cuts: list[float]
    labels: list[str]

    def column(self, stats) -> Column:
        x = F.col(self.col).cast("double")
        out = None
        for i, lab in enumerate(self.labels):
            cond = (x > F.lit(float(self.cuts[i]))) & (x <= F.lit(float(self.cuts[i + 1])))
            out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
        return out


@dataclass
class Flag(Feature):
    """Indicator 1/0 of a predicate; NULL predicate -> 0."""
    name: str
    predicate: str

    def column(self, stats) -> Column:
        return F.coalesce(F.expr(self.predicate).cast("int"), F.lit(0))


@dataclass
class RegexNumber(Feature):
    """First capture group as a number; no match -> NULL."""
    name: str
    col: str
    pattern: str
    group: int = 1

    def column(self, stats) -> Column:
        txt = F.regexp_extract(F.col(self.col).cast("string"), self.pattern, self.group)
        return F.nullif(txt, F.lit("")).try_cast("double")


@dataclass
class RegexText(Feature):
    """First capture group as text; no match -> NULL (J15, e.g. a title from a name)."""
    name: str
    col: str
    pattern: str
    group: int = 1

    def column(self, stats) -> Column:
        return F.nullif(F.regexp_extract(F.col(self.col).cast("string"), self.pattern, self.group), F.lit(""))


@dataclass
class Fill(Feature):
    """Missing values filled with the fit median, mean or a constant."""
    name: str
    col: str
    strategy: str = "median"
    value: float | str | None = None

    def fit(self, df):
        x = F.col(self.col).cast("double")
        if self.strategy == "median":
            return _column_quantiles(df, self.col, [0.5])[0]
        if self.strategy == "mean":
            return df.agg(F.avg(x)).first()[0]
        return self.value

    def column(self, stats) -> Column:
        return F.coalesce(F.col(self.col), F.lit(stats))


@dataclass
class RowCount(Feature):
    """The number of fit rows as a constant column."""
    name: str

    def fit(self, df):
        return df.count()

    def column(self, stats) -> Column:
        return F.lit(stats).cast("bigint")


@dataclass
class GroupAgg(Feature):
    """Aggregate of a column per group, joined back.

    Fit computes the grouped table on the fit rows (kept as a DataFrame, not
    collected); apply left-joins it on the group key, broadcasting it only
    when its row count is under the limit.  Unseen groups get NULL.
    """
    name: str
    by: str
    col: str
    agg: str = "mean"
    row_local = False

    def _agg(self) -> Column:
        x = F.col(self.col)
        funcs = {"mean": F.avg(x.cast("double")), "sum": F.sum(x), "min": F.min(x), "max": F.max(x),
                 "count": F.count(x), "std": F.stddev_samp(x.cast("double")),
                 "median": F.percentile(x.cast("double"), 0.5)}
        return funcs[self.agg]

    def fit(self, df):
        return df.groupBy(F.col(self.by).alias("__g")).agg(self._agg().alias("__v"))

    def apply(self, df, stats):
        joined = join_small(df.withColumn("__g", F.col(self.by)), stats, "__g", "left")
        return joined.withColumn(self.name, F.col("__v")).drop("__g", "__v")


@dataclass
class PctRank(Feature):
    """Percentile rank with average ties, as pandas ``rank(pct=True)``.

    Computed on the frame being transformed (frame-scope semantics):
    value counts, an exact prefix count over the global value order without
    a single-partition window, then a join back on the value.
    """
    name: str
    col: str
    row_local = False

    def apply(self, df, stats):
        vc, n_distinct = value_counts_with_prefix(df, self.col)
        ranks = vc.select(F.col("value").alias("__v"),
                          ((F.col("below") + (F.col("cnt") + 1) / 2.0) / F.col("total")).alias("__pct"))
        joined = join_small(df.withColumn("__v", F.col(self.col).cast("double")), ranks, "__v", "left",
                            rows=n_distinct)
        return joined.withColumn(self.name, F.col("__pct")).drop("__v", "__pct")


@dataclass
class PandasMap(Feature):
    """Element-wise user function over Arrow batches (J26); use only without a built-in."""
    name: str
    cols: list[str]
    fn: Callable
    return_type: str = "double"

    def column(self, stats) -> Column:
        udf = F.pandas_udf(self.fn, self.return_type)
        return udf(*[F.col(c) for c in self.cols])


@dataclass
class FrameFunction(Feature):
    """A whole-frame user function DataFrame -> DataFrame (J27, the user surface)."""
    name: str
    fn: Callable[[DataFrame], DataFrame]
    row_local = False

    def apply(self, df, stats):
        return df.transform(self.fn)


def _inf_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    floats = {f.name for f in df.schema.fields if f.name in cols
              and isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    bad = lambda c: F.isnan(F.col(c)) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.select(*[F.when(bad(c), F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                       if c in floats else F.col(c) for c in df.columns])


@dataclass
class FittedFeatures:
    """A feature list with its fitted statistics."""
    features: list[Feature]
    stats: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        batch: list[tuple[Feature, object]] = []

        def flush(frame):
            if not batch:
                return frame
            names = [f.name for f, _ in batch]
            cols = [F.col(c) for c in frame.columns if c not in names]
            frame = frame.select(*cols, *[f.column(s).alias(f.name) for f, s in batch])
            batch.clear()
            return frame

        for f, s in zip(self.features, self.stats):
            if f.row_local:
                batch.append((f, s))
            else:
                out = flush(out)
                out = f.apply(out, s)
        out = flush(out)
        new = [c for c in out.columns if c not in df.columns] + [f.name for f in self.features]
        return _inf_to_null(out, list(dict.fromkeys(new)))


def fit_features(features: list[Feature], df: DataFrame) -> FittedFeatures:
    """Fit every feature on the given (training) rows."""
    return FittedFeatures(list(features), [f.fit(df) for f in features])


def apply_features(features: list[Feature], df: DataFrame) -> DataFrame:
    """Frame scope: statistics from the frame that is transformed."""
    return fit_features(features, df).transform(df)


# ---------------------------------------------------------------------------
# The feature step as a pipeline stage (fit on training rows, K3 fallback)
# ---------------------------------------------------------------------------


_ROW = "__row"


def _run_hidden(run: Callable[[DataFrame], DataFrame], features: list[Feature], df: DataFrame,
                hidden: list[str], key: str | None) -> DataFrame:
    """``run`` on the feature columns of ``df``; the hidden columns come along unseen.

    Declarative features are resolved against the feature columns alone first,
    so an expression that names a hidden column fails.  A frame function gets
    the feature columns and an opaque row key, and the hidden columns are
    joined back on it.
    """
    hidden = [c for c in hidden if c in df.columns]
    visible = [c for c in df.columns if c not in hidden]
    taken = sorted({f.name for f in features} & set(hidden))
    if taken:
        raise ValueError(f"feature names already taken by other columns: {', '.join(taken)}")
    if not hidden:
        return run(df)
    if not any(isinstance(f, FrameFunction) for f in features):
        run(df.select(*visible)).schema
        return run(df)
    if key not in df.columns:
        # rows to score carry no key: number them once, written down so that both sides of the join agree
        numbered = cut_lineage(df.withColumn("__number", F.monotonically_increasing_id()))
        return _run_hidden(run, features, numbered, [*hidden, "__number"], "__number").drop("__number")
    out = run(df.select(*visible, F.col(key).alias(_ROW)))
    if _ROW not in out.columns:
        raise ValueError("the feature step lost the row key")
    if set(out.columns) & set(hidden):
        raise ValueError("the feature step made columns of hidden names")
    rest = df.select(F.col(key).alias("__rest"), *hidden)
    return rest.join(out, rest["__rest"] == out[_ROW]).select(*[c for c in out.columns if c != _ROW], *hidden)


class FeatureStep(_Estimator):
    """Pipeline stage wrapping a feature list (J27 surface).

    ``stat_scope="train"`` fits statistics on the training rows and reuses
    them on any frame; ``"frame"`` recomputes them on each transformed frame.
    ``hidden`` columns (target, label, fold, keys) pass through unseen;
    ``key`` is unique per row.  A step that fails, or whose output on the
    training rows is invalid, becomes the identity and records the error (K3).
    """

    def __init__(self, features: list[Feature], stat_scope: str = "train", hidden: list[str] | tuple = (), key: str | None = None):
        super().__init__()
        self.features, self.stat_scope = list(features), stat_scope
        self.hidden, self.key = list(hidden), key

    def over(self, hidden: list[str], key: str | None) -> "FeatureStep":
        """The same step for frames with these hidden columns."""
        return FeatureStep(self.features, self.stat_scope, hidden, key)

    def _fit(self, df: DataFrame) -> "FeatureStepModel":
        visible = df.select(*[c for c in df.columns if c not in self.hidden])
        try:
            fitted = None if self.stat_scope == "frame" else fit_features(self.features, visible)
        except Exception as e:  # recorded, the step becomes the identity
            return FeatureStepModel(self.features, None, f"{type(e).__name__}: {e}", self.hidden, self.key)
        model = FeatureStepModel(self.features, fitted, None, self.hidden, self.key)
        model.error = model.problem(df)
        return model

    def describe(self) -> str:
        return "; ".join(f.describe() for f in self.features)


class FeatureStepModel(_Model, Saved):
    """A fitted step; group tables are kept as tables when it is saved."""

    def parts(self):
        stats = list(self.fitted.stats) if self.fitted is not None else None
        tables = {f"stats{i}": s for i, s in enumerate(stats or []) if isinstance(s, DataFrame)}
        plain = [None if isinstance(s, DataFrame) else s for s in stats] if stats is not None else None
        return (self.features, plain, self.error, self.hidden, self.key), tables, []

    @classmethod
    def from_parts(cls, state, tables, models):
        features, stats, error, hidden, key = state
        fitted = None
        if stats is not None:
            fitted = FittedFeatures(features, [tables.get(f"stats{i}", s) for i, s in enumerate(stats)])
        return cls(features, fitted, error, hidden, key)

    def __init__(self, features, fitted, error, hidden=(), key=None):
        super().__init__()
        self.features, self.fitted, self.error = features, fitted, error
        self.hidden, self.key = list(hidden), key

    def _run(self, df: DataFrame) -> DataFrame:
        run = self.fitted.transform if self.fitted is not None else lambda d: apply_features(self.features, d)
        return _run_hidden(run, self.features, df, self.hidden, self.key)

    def problem(self, df: DataFrame) -> str | None:
        """Why the step can't be used on ``df``: its error or the failed validation; None if it can."""
        from strata.operators.validate import error_text, inspect
        key = self.key if self.key in df.columns else None
        try:
            out = self._run(df)
            made = out.select(*[c for c in out.columns if c not in self.hidden], *([key] if key in self.hidden else []))
            return inspect(made, df.count(), key)[1]
        except Exception as e:
            return error_text(e)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.error is not None:
            return df
        try:
            out = self._run(df)
            out.schema  # analysis errors surface here
            return out
        except Exception as e:
            self.error = f"{type(e).__name__}: {e}"
            return df
