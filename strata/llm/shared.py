"""Spark helpers of the llm operators: shared folder, ordered numbering, components."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.session import checkpoint_dir

#: Rows that one bucket of an ordered numbering holds, about.
BUCKET_ROWS = 200_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/strata-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names built from ``stems`` that ``df`` does not have (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        name = f"__{s}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, order: list[str], out: str, by: str | None = None, hint: int | None = None,
             bucket_rows: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based row number in the order of ``order``, over all rows or within ``by``.

    No window runs over all rows: approximate quantiles of the first order
    column (a number) cut them into buckets of about BUCKET_ROWS (fewer rows
    for wide ones, ``bucket_rows``), a window
    numbers each bucket, and the buckets' counts (one row each, broadcast
    only when few) give the offsets.  The numbers are exact whatever the
    cuts.  Rows equal in the first order column share a bucket, so give an
    almost unique one first.
    """
    bkt, sub, off = fresh(df, "bkt", "sub", "off")
    n = df.count() if hint is None else hint
    pieces = max(1, math.ceil(n / (bucket_rows or BUCKET_ROWS)))
    keys = [by] if by else []
    first = F.col(order[0])
    if pieces == 1:
        cut = df.withColumn(bkt, F.lit(0))
    else:
        marks = df.select(F.percentile_approx(first, [i / pieces for i in range(1, pieces)], 100 * pieces).alias("q")).first()["q"] or []
        marks = sorted(set(marks))
        # the number of marks below a value, by bisection in a literal array
        arr = F.array(*[F.lit(m) for m in marks])
        lo = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(marks) + 1))))),
                         F.struct(F.lit(0).alias("l"), F.lit(len(marks)).alias("h")),
                         lambda a, _: F.when(a["l"] >= a["h"], a).otherwise(
                             F.when(F.element_at(arr, (F.floor((a["l"] + a["h"]) / 2) + 1).cast("int")) < first,
                                    F.struct((F.floor((a["l"] + a["h"]) / 2) + 1).cast("int").alias("l"), a["h"].alias("h")))
                             .otherwise(F.struct(a["l"].alias("l"), F.floor((a["l"] + a["h"]) / 2).cast("int").alias("h")))),
                         lambda a: a["l"])
        cut = df.withColumn(bkt, F.when(first.isNull(), F.lit(-1)).otherwise(lo))
    counts = cut.groupBy(*keys, bkt).agg(F.count(F.lit(1)).alias(sub))
    w = Window.partitionBy(*keys).orderBy(bkt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"{off}_{c}") for c in [*keys, bkt]], F.coalesce(F.sum(sub).over(w), F.lit(0)).alias(off))
    joined = join_small(cut, offsets, [F.col(c).eqNullSafe(F.col(f"{off}_{c}")) for c in [*keys, bkt]],
                        rows=None if by else pieces + 1)
    rank = F.row_number().over(Window.partitionBy(*keys, bkt).orderBy(*order)) - 1
    return joined.withColumn(out, (rank + F.col(off)).cast("long")).select(*df.columns, out)


#: Rows of one range partition of ``range_numbered``, about.
RANGE_ROWS = 500_000


def range_numbered(df: DataFrame, by: list[str], order: list[str], out: str, size: str) -> DataFrame:
    """Add ``out``, the 0-based row number in the order of ``order`` within ``by``, and ``size``, the rows of that group.

    Rows are dealt to range partitions of (by, order, salt), sorted there and
    written; a row's place in its partition is then fixed, and the counts of
    every (partition, group) - as many rows as partitions and groups together -
    give the offsets.  No cut point passes through an expression, and the salt
    spreads equal rows, which are interchangeable.  Give narrow rows: they are
    written once.
    """
    salt, at, part, first, off = fresh(df, "salt", "at", "part", "first", "off")
    spark = df.sparkSession
    n = (df := written(df, "rows")).count()
    pieces = max(1, math.ceil(n / RANGE_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 4096)))
    keys = [*by, *order, salt]
    dealt = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).drop(salt)
    dealt = written(dealt.withColumn(at, F.monotonically_increasing_id()), "ranges").withColumn(part, F.shiftright(at, 33))
    counts = dealt.groupBy(*by, part).agg(F.count(F.lit(1)).alias(off), F.min(at).alias(first))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    named = {c: f"{off}_{c}" for c in [*by, part]}
    offsets = counts.select(*[F.col(c).alias(v) for c, v in named.items()], first, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off),
                            F.sum(off).over(Window.partitionBy(*by)).alias(size))
    joined = join_small(dealt, offsets, [F.col(c).eqNullSafe(F.col(v)) for c, v in named.items()])
    return joined.withColumn(out, F.col(at) - F.col(first) + F.col(off)).select(*df.columns, out, size)


def components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(node, component): smallest node reachable over the undirected ``edges`` (long ids).

    Alternating large-star / small-star rounds; every round is one shuffle by
    node with map-side minima, written to the shared folder, so no component
    is ever held in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, name)
    while True:
        # large star: every larger neighbour points at the smallest one in reach
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and the node itself point at the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = written(small, name)
        same = now.join(e, ["u", "v"], "left_semi").count()
        if same == now.count() == e.count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        e = now
