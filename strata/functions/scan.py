"""Prefix sums over a global order without a single-partition window.

A window ``ORDER BY value`` with no ``PARTITION BY`` runs in one task.  Here
the distinct values are cut into ordered buckets at approximate quantiles
(a few hundred numbers reach the driver), each bucket's total comes from a
tiny table whose own prefix sum is broadcast (its size is bounded by the
bucket count), and the running sum inside a bucket is a partitioned window.
The result is exact; only the bucket boundaries are approximate.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 512


def value_counts_with_prefix(df: DataFrame, value_col: str, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Distinct non-null values with their count and the count of smaller values.

    Returns (table of value (double), cnt, below, total; number of distinct
    values).  The statistics job that finds the bucket bounds also counts the
    distinct values, so callers can size a join without another pass.
    """
    vc = (df.where(F.col(value_col).isNotNull())
          .groupBy(F.col(value_col).cast("double").alias("value"))
          .agg(F.count(F.lit(1)).alias("cnt")))
    probs = [i / buckets for i in range(1, buckets)]
    stats = vc.agg(F.percentile_approx("value", probs, 10000).alias("b"),
                   F.count(F.lit(1)).alias("distinct")).first()
    bounds = stats["b"] or []
    splits = [float("-inf")] + sorted(set(float(b) for b in bounds)) + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(vc)
    totals = bucketed.groupBy("bucket").agg(F.sum("cnt").alias("btot"))
    wo = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket", F.coalesce(F.sum("btot").over(wo), F.lit(0)).alias("offset"),
        F.sum("btot").over(Window.partitionBy()).alias("total"))
    # offsets has at most len(splits) - 1 rows: a proven bound, safe to broadcast
    joined = bucketed.join(F.broadcast(offsets), "bucket")
    wb = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = joined.select(
        "value", "cnt", (F.col("offset") + F.coalesce(F.sum("cnt").over(wb), F.lit(0))).alias("below"),
        "total")
    return out, stats["distinct"]
