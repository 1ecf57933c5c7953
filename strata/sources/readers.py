"""Readers: CSV with pandas-style NA tokens and type inference, parquet, tables.

A CSV is scanned as strings first; NA tokens become NULL and the column types
are then inferred by one aggregate pass (``try_cast`` succeeds on every
non-null value), so a numeric column that contains ``NA`` stays numeric, as it
does for ``pandas.read_csv``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default NA tokens of pandas.read_csv (public pandas docs).
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Order in which a string column is tried: the first type whose pattern every
# non-null value matches (and which can hold them all) wins.
_CANDIDATE_TYPES = [
    ("bigint", T.LongType(), r"^\s*[+-]?[0-9]+\s*$"),
    ("double", T.DoubleType(), r"^\s*[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"),
    ("boolean", T.BooleanType(), r"^(true|True|TRUE|false|False|FALSE)$"),
]


def quoted(c: str) -> str:
    """A column name as an identifier, also when it has dots or blanks."""
    return "`" + c.replace("`", "``") + "`"


def require_column(df: DataFrame, column: str) -> None:
    """Raise before any job runs when the target column is missing (A3)."""
    if column not in df.columns:
        raise ValueError(
            f"Target column '{column}' not found. Available columns: {', '.join(df.columns)}")


def _null_tokens(c: str, tokens: list[str]) -> Column:
    col = F.col(quoted(c))
    return F.when(col.isin(tokens), F.lit(None)).otherwise(col)


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast string columns to bigint / double / boolean when every value allows it.

    One aggregate pass over the data decides all columns together.  Only the
    spellings true and false are booleans; a number must look like one.
    """
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    checks = []
    for i, c in enumerate(cols):
        col = F.col(quoted(c))
        for j, (_, ttype, pattern) in enumerate(_CANDIDATE_TYPES):
            ok = col.isNull() | (col.rlike(pattern) & F.trim(col).try_cast(ttype).isNotNull())
            checks.append(F.bool_and(ok).alias(f"t{i}_{j}"))
        checks.append(F.count(col).alias(f"n{i}"))
    row = df.agg(*checks).first()
    casts = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"]:
            casts.update({c: t for j, (_, t, _) in reversed(list(enumerate(_CANDIDATE_TYPES))) if row[f"t{i}_{j}"]})
    return df.select(*[F.trim(F.col(quoted(f.name))).try_cast(casts[f.name]).alias(f.name) if f.name in casts
                       else F.col(quoted(f.name)) for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, na_values: list[str] | None = None,
             infer: bool = True, multiline: bool | str = True) -> DataFrame:
    """CSV scan with a header, NA tokens to NULL, then type inference (A1).

    Quotes inside quotes are doubled and a quoted line break stays in its
    field; files are read by byte ranges either way (``quoted_csv``).
    ``multiline=False`` is for files known to have no such breaks;
    ``multiline="whole"`` has each file read by one task, for files with quotes
    inside unquoted fields.
    """
    tokens = PANDAS_NA_TOKENS if na_values is None else na_values
    if multiline is True:
        from strata.sources.quoted_csv import read_quoted_csv

        raw = read_quoted_csv(spark, path)
    else:
        raw = (spark.read.option("header", "true").option("inferSchema", "false").option("quote", '"').option("escape", '"')
               .option("multiLine", str(bool(multiline)).lower()).csv(path))
    cleaned = raw.select(*[_null_tokens(c, tokens).alias(c) for c in raw.columns])
    return infer_types(cleaned) if infer else cleaned


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read a table by format (parquet, csv, json, orc) or by catalog name."""
    if fmt is None:
        low = path.lower()
        fmt = next((f for f in ("parquet", "csv", "json", "orc") if low.endswith("." + f)),
                   "parquet" if "/" in path else "table")
    if fmt == "table":
        df = spark.table(path)
    elif fmt == "csv":
        df = read_csv(spark, path, **options)
    else:
        df = spark.read.options(**options).format(fmt).load(path)
    return canonical_nulls(df)


def _float_fields(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))}


def canonical_nulls(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every float column, in one projection (A2).

    pandas counts NaN as missing everywhere; Spark does not, so every source
    goes through this before statistics are computed.
    """
    floats = _float_fields(df)
    if not floats:
        return df
    return df.select(*[
        F.nanvl(F.col(quoted(c)), F.lit(None).cast(df.schema[c].dataType)).alias(c)
        if c in floats else F.col(quoted(c)) for c in df.columns])


def inf_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """+-Inf and NaN -> NULL on float columns."""
    floats = _float_fields(df)
    if columns is not None:
        floats &= set(columns)
    if not floats:
        return df

    def clean(c: str) -> Column:
        col = F.col(quoted(c))
        bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
        return F.when(bad, F.lit(None).cast(df.schema[c].dataType)).otherwise(col).alias(c)

    return df.select(*[clean(c) if c in floats else F.col(quoted(c)) for c in df.columns])
