"""Validation of a feature step's output (survey 2.K, K1-K2).

``inspect`` answers with a kind, a sentence made from the facts, and the
number of rows that came out; ``None`` as kind means valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_DATAFRAME, NO_COLUMNS, EMPTY, ROW_COUNT, ALL_NULL, EXCEPTION = (
    "not_dataframe", "no_columns", "empty", "row_count", "all_null", "exception")


def inspect(result, rows_in: int, key: str | None = None) -> tuple[str | None, str | None, int | None]:
    """(kind, message, rows_out): one aggregate evaluates every cell and counts rows (and distinct keys)."""
    if not isinstance(result, DataFrame):
        return NOT_DATAFRAME, f"{NOT_DATAFRAME}: expected a DataFrame, found {type(result).__name__}", None
    cols = [c for c in result.columns if c != key]
    if not cols:
        return NO_COLUMNS, f"{NO_COLUMNS}: expected at least one column, found none", None
    filled = F.lit(0)
    for c in cols:
        filled = filled + F.when(F.col(_quoted(c)).isNotNull(), 1).otherwise(0)
    aggs = [F.count(F.lit(1)).alias("n"), F.max(filled).alias("cells")]
    if key is not None:
        aggs.append(F.count_distinct(F.col(_quoted(key))).alias("keys"))
    r = result.agg(*aggs).first()
    n = r["n"]
    if n == 0 and rows_in > 0:
        return EMPTY, f"{EMPTY}: expected {rows_in} rows, found 0", 0
    if n != rows_in or (key is not None and r["keys"] != rows_in):
        found = n if n != rows_in else f"{n} with {r['keys']} different keys"
        return ROW_COUNT, f"{ROW_COUNT}: expected {rows_in} rows, found {found}", n
    if n and not r["cells"]:
        return ALL_NULL, f"{ALL_NULL}: expected values, found {n} rows of NULL", n
    return None, None, n


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def error_text(e: Exception) -> str:
    return f"{EXCEPTION}: {type(e).__name__}: {e}"
