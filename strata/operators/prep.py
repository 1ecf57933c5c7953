"""Preprocessing stages: impute, scale, encode, assemble (survey 2.F).

Numeric columns: exact median imputation, then standard (population std) or
robust (median / IQR) scaling.  Other columns: cast to string, NULL ->
"missing", ``StringIndexer`` (alphabetical, unseen kept) + ``OneHotEncoder``
(last slot dropped, so unseen values give the all-zero vector).  Statistics
come from one aggregate per stage over the training rows only.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.operators.mlparams import float_list_param, list_param, str_param

# exact medians / quantiles merge a value -> count map in one task: sketch above this
EXACT_ROW_LIMIT = 10_000_000
MISSING_TOKEN = "missing"
# Categories per column: None keeps them all.  A number, only if a caller asks
# for it, keeps the most frequent ones; the rest encode like unseen values.
MAX_CATEGORIES = None


class _ColsParams(DefaultParamsReadable, DefaultParamsWritable):
    inputCols = list_param("inputCols", "columns to transform in place")


def _quantile_mode(df: DataFrame, mode: str) -> str:
    """exact (in-aggregate map) | bracket (exact, bounded memory) | approx (sketch)."""
    if mode == "auto":
        return "exact" if df.count() <= EXACT_ROW_LIMIT else "bracket"
    return mode


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], mode: str) -> dict[str, list]:
    """Quantiles of several columns in the requested mode (small result on the driver)."""
    m = _quantile_mode(df, mode)
    if m == "bracket":
        from strata.functions.quantiles import exact_quantiles
        return exact_quantiles(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, probs)
    row = df.agg(*[S.quantiles(F.col(c).cast("double"), probs, exact=(m == "exact")).alias(c)
                   for c in cols]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}


class MedianImputer(Estimator, _ColsParams):
    """Median imputation with the exact (linear interpolation) median (F1).

    ``mode``: exact (in one aggregate), bracket (exact, bounded memory),
    approx (sketch) or auto (exact up to ``EXACT_ROW_LIMIT`` rows, bracket above).
    """

    mode = str_param("mode", "exact | bracket | approx | auto")

    @keyword_only
    def __init__(self, *, inputCols=None, mode="auto"):
        super().__init__()
        self._setDefault(inputCols=[], mode="auto")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "FillModel":
        cols = self.getOrDefault("inputCols")
        if not cols:
            return FillModel(inputCols=[], values=[])
        q = _quantiles(df, cols, [0.5], self.getOrDefault("mode"))
        return FillModel(inputCols=cols, values=[float(q[c][0]) if q[c][0] is not None else 0.0 for c in cols])


class FillModel(Model, _ColsParams):
    """coalesce(column, fitted value) per column."""

    def _values(self) -> dict:
        return dict(zip(self.getOrDefault("inputCols"), self.getOrDefault("values")))

    values = float_list_param("values", "fill value per input column")

    @keyword_only
    def __init__(self, *, inputCols=None, values=None):
        super().__init__()
        self._setDefault(inputCols=[], values=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = dict(zip(self.getOrDefault("inputCols"), self.getOrDefault("values")))
        return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(fills[c])).alias(c) if c in fills
                           else F.col(c) for c in df.columns])


class Scaler(Estimator, _ColsParams):
    """Centre and scale numeric columns in place.

    ``method="standard"``: (x - mean) / population std;
    ``method="robust"``: (x - median) / (q3 - q1).  A zero scale becomes 1.
    NULLs pass through.  Statistics in one aggregate over the training rows.
    """

    method = str_param("method", "standard | robust")
    mode = str_param("mode", "exact | bracket | approx | auto (robust quantiles)")

    @keyword_only
    def __init__(self, *, inputCols=None, method="standard", mode="auto"):
        super().__init__()
        self._setDefault(inputCols=[], method="standard", mode="auto")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "AffineModel":
        cols = self.getOrDefault("inputCols")
        if not cols:
            return AffineModel(inputCols=[], centers=[], scales=[])
        method = self.getOrDefault("method")
        if method == "standard":
            aggs = [e for i, c in enumerate(cols)
                    for e in (F.avg(F.col(c).cast("double")).alias(f"c{i}"),
                              F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))]
            row = df.agg(*aggs).first()
            centers = [row[f"c{i}"] for i in range(len(cols))]
            scales = [row[f"s{i}"] for i in range(len(cols))]
        elif method == "robust":
            q = _quantiles(df, cols, [0.25, 0.5, 0.75], self.getOrDefault("mode"))
            qs = [q[c] for c in cols]
            centers = [q[1] for q in qs]
            scales = [(q[2] - q[0]) if q[0] is not None else None for q in qs]
        else:
            raise ValueError(f"unknown scaling method {method!r}")
        centers = [float(c) if c is not None else 0.0 for c in centers]
        scales = [float(s) if s not in (None, 0.0) else 1.0 for s in scales]
        return AffineModel(inputCols=cols, centers=centers, scales=scales)


class AffineModel(Model, _ColsParams):
    """(x - center) / scale per column."""

    centers = float_list_param("centers", "centre per input column")
    scales = float_list_param("scales", "scale per input column")

    @keyword_only
    def __init__(self, *, inputCols=None, centers=None, scales=None):
        super().__init__()
        self._setDefault(inputCols=[], centers=[], scales=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("inputCols")
        p = {c: (m, s) for c, m, s in zip(cols, self.getOrDefault("centers"), self.getOrDefault("scales"))}
        return df.select(*[((F.col(c).cast("double") - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c)
                           if c in p else F.col(c) for c in df.columns])


class CategoricalFill(Transformer, _ColsParams):
    """Cast to string and replace NULL by a constant."""

    value = str_param("value", "replacement for NULL")

    @keyword_only
    def __init__(self, *, inputCols=None, value=MISSING_TOKEN):
        super().__init__()
        self._setDefault(inputCols=[], value=MISSING_TOKEN)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = set(self.getOrDefault("inputCols"))
        val = self.getOrDefault("value")
        return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(val)).alias(c) if c in cols
                           else F.col(c) for c in df.columns])


class CategoryIndexer(Estimator, _ColsParams):
    """Alphabetical category codes.

    Every value of the training rows gets a code (``maxCategories`` 0); with a
    positive ``maxCategories`` only the most frequent ones do (ties by value,
    found by a distributed top-k).  Values outside get the extra "unseen"
    code, which the one-hot stage maps to the all-zero vector.  As in MLlib's
    own indexer, a fitted column's values are part of the model.
    """

    outputCols = list_param("outputCols", "index columns")
    maxCategories = Param(Params._dummy(), "maxCategories", "vocabulary size per column, 0 for all values",
                          typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, maxCategories=MAX_CATEGORIES):
        super().__init__()
        self._setDefault(inputCols=[], outputCols=[], maxCategories=MAX_CATEGORIES or 0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PipelineModel:
        from strata.operators.profile import top_values
        cols, most = self.getOrDefault("inputCols"), self.getOrDefault("maxCategories")
        if most:
            top = top_values(df, cols, most).select("col", "value").collect()
        else:
            every = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols]))
            top = df.select(every.alias("t")).select("t.*").where(F.col("value").isNotNull()).distinct().collect() if cols else []
        vocab = {c: [] for c in cols}
        for r in top:
            vocab[r["col"]].append(r["value"])
        # one single-column model per input: their output metadata is what the one-hot stage reads
        return PipelineModel(stages=[
            StringIndexerModel.from_labels(sorted(vocab[c]), inputCol=c, outputCol=o, handleInvalid="keep")
            for c, o in zip(cols, self.getOrDefault("outputCols"))])


def preprocessing_stages(num_cols: list[str], cat_cols: list[str], scaler: str = "standard",
                         features_col: str = "features", mode: str = "auto",
                         max_categories: int | None = MAX_CATEGORIES) -> list:
    """Stages of the typed column transformer (F6): numeric and categorical routes."""
    stages: list = []
    if num_cols:
        stages.append(MedianImputer(inputCols=num_cols, mode=mode))
        stages.append(Scaler(inputCols=num_cols, method=scaler, mode=mode))
    ohe_cols = []
    if cat_cols:
        idx = [f"{c}__idx" for c in cat_cols]
        ohe_cols = [f"{c}__ohe" for c in cat_cols]
        stages.append(CategoricalFill(inputCols=cat_cols))
        stages.append(CategoryIndexer(inputCols=cat_cols, outputCols=idx, maxCategories=max_categories))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe_cols, dropLast=True))
    stages.append(VectorAssembler(inputCols=list(num_cols) + ohe_cols, outputCol=features_col,
                                  handleInvalid="keep"))
    return stages


def _flat(stages) -> list:
    out = []
    for st in stages:
        out += _flat(st.stages) if isinstance(st, PipelineModel) else [st]
    return out


def feature_names(model: PipelineModel | list) -> list[str]:
    """Names of the assembled vector slots: ``num__x`` and ``cat__x_value``."""
    stages = _flat(model.stages if isinstance(model, PipelineModel) else model)
    names: list[str] = []
    num: list[str] = []
    for st in stages:
        if isinstance(st, AffineModel):
            num = list(st.getOrDefault("inputCols"))
    names += [f"num__{c}" for c in num]
    for st in stages:
        if isinstance(st, StringIndexerModel):
            if st.isSet("inputCol"):
                pairs = [(st.getInputCol(), st.labels)]
            else:
                pairs = list(zip(st.getInputCols(), st.labelsArray))
            for c, labels in pairs:
                names += [f"cat__{c}_{v}" for v in labels]
    return names


def label_indexer(target: str, label_col: str = "label") -> StringIndexer:
    """Label encoding of a categorical target, alphabetical codes."""
    return StringIndexer(inputCol=target, outputCol=label_col, stringOrderType="alphabetAsc",
                         handleInvalid="error")


def fit_preprocessor(df: DataFrame, num_cols: list[str], cat_cols: list[str],
                     scaler: str = "standard", mode: str = "auto") -> PipelineModel:
    return Pipeline(stages=preprocessing_stages(num_cols, cat_cols, scaler, mode=mode)).fit(df)


def hot_slot(vector: str) -> tuple[Column, Column]:
    """Position of the first 1.0 of a vector column (-1 without one) and the vector's width.

    Read from the stored entries, so that a row costs as much as it has entries, not slots.
    """
    v = F.unwrap_udt(F.col(vector))
    entry = F.array_position(v["values"], F.lit(1.0)).cast("int")
    sparse = v["type"] == 0
    at = F.when(sparse & (entry > 0), F.try_element_at(v["indices"], entry)).otherwise(F.when(sparse, -1).otherwise(entry - 1))
    return at.cast("int"), F.when(sparse, v["size"]).otherwise(F.size(v["values"]))
