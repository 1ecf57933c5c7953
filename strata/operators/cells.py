"""Equal rows as one row with a weight.

Sums over rows (histograms, gradients, Newton steps, votes) do not tell rows apart
that have the same features, and for classes the same label.  Where the features
take few different vectors, one aggregate with map-side combining leaves one
row for each, and the passes that follow cost by the number of vectors.  An
estimate of that number decides; if the rows hardly repeat they stay as they are.

``cells`` does the same to the columns of a training table before any features are
made of them, once for all folds: what trains on it carries a column WEIGHT.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which on merging is tried, and how many rows a merged one must stand for on average.
MERGE_FROM, MERGE_RATIO = 100_000, 3
#: Column with the number of rows that a row stands for, and how many cells a table may have (they are broadcast).
WEIGHT, CELLS_MOST = "__w", 500_000


def weight(df: DataFrame) -> Column:
    """How many rows each row of ``df`` stands for."""
    return F.col(WEIGHT).cast("double") if WEIGHT in df.columns else F.lit(1.0)


def cells(rows: DataFrame, columns: list[str], mean_of: str | None = None) -> DataFrame | None:
    """One row for all rows that are equal in ``columns``, with their number (WEIGHT) and the mean of ``mean_of``; None if they hardly repeat."""
    if any(t in rows.schema[c].dataType.simpleString() for c in columns for t in ("map<", "variant", "vector", "matrix")):
        return None
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*columns)).alias("d")).first()
    if r["d"] > CELLS_MOST or r["d"] * MERGE_RATIO > r["n"]:
        return None
    y = [F.avg(F.col(mean_of).cast("double")).alias(mean_of)] if mean_of else []
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(WEIGHT), *y)


def merged(rows: DataFrame, by_label: bool, always: bool = False) -> DataFrame | None:
    """One row (model, x, y, w, ...) for all rows of a model with equal ``x`` (and label); ``y`` is their mean, ``w`` their number.

    Rows may have a weight ``w`` already.  Cached: the caller unpersists it.  None if the rows hardly repeat
    (with ``always``: never).
    """
    keys = ["model", "x", *(["y"] if by_label else [])]
    if not always:
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("d")).first()
        if r["n"] < MERGE_FROM or r["d"] * MERGE_RATIO > r["n"]:
            return None
    if "w" in rows.columns:
        w, y = F.sum("w"), F.sum(F.col("y") * F.col("w")) / F.sum(F.when(F.col("y").isNotNull(), F.col("w")))
    else:
        w, y = F.count(F.lit(1)).cast("double"), F.avg("y")
    out = rows.groupBy(*keys).agg(w.alias("w"), *([] if by_label else [y.alias("y")]))
    out = out.select("model", "x", "y", "w").persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out
