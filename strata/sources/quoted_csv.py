"""CSV with quoted line breaks, read in parallel by byte ranges (survey A1).

Spark deals out a text file as byte ranges of physical lines.  A line break
belongs to a field where an odd number of quotes stands before it, so one pass
counts the quotes of every range, a prefix over the ranges (a small table)
tells which of them begin inside quotes, and each range then puts its lines
together into records on its own.  What a range cannot know alone - the end of
a record begun earlier, the beginning of one that ends later - are at most two
fragments a range, which are joined in a table of their own.

Quotes stand around fields and are doubled inside them (RFC 4180); a quote
inside an unquoted field is not supported.  A blank line between records is
skipped.  Every file has a header line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.joins import join_small

_PIECE = "file string, first long, kind string, header boolean, record string"
#: Characters of records that one Arrow batch holds, about.
BATCH_CHARS = 4 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of every range, and its fragments: ``head`` ends a record of an earlier range, ``tail`` begins one, ``all`` does neither."""
    out: list[tuple[str, int, str, bool, str]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        made = pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "first", "kind", "header", "record"])
        out.clear()
        return made

    at, held, inside, begun, top = None, [], False, False, False
    for b in batches:
        for file, first, open_, line in zip(*(b.column(c).to_pylist() for c in ("file", "first", "open", "value"))):
            if at != (file, first):
                if at is not None and held:
                    out.append((*at, "tail" if begun else "all", top, "\n".join(held)))
                at, held, inside, begun, top = (file, first), [], open_, not open_, first == 0
            held.append(line)
            size += len(line)
            if line.count('"') % 2:
                inside = not inside
            if not inside:
                out.append((file, first, "whole" if begun else "head", top, "\n".join(held)))
                held, begun, top = [], True, False
            if size > BATCH_CHARS:
                yield batch()
                size = 0
    if at is not None and held:
        out.append((*at, "tail" if begun else "all", top, "\n".join(held)))
    yield batch()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, record) of every record; ``header`` marks the first record of a file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("first"), F.col("value"))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "first").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("file").alias("in_file"), F.col("first").alias("from"),
                           (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("open"))
    known = join_small(lines, ranges, (F.col("file") == F.col("in_file")) & (F.col("first") == F.col("from"))).select("file", "first", "open", "value")
    pieces = known.mapInArrow(_pieces, _PIECE)
    whole = pieces.where("kind = 'whole'").select("file", "header", "record")
    # a fragment belongs to the last record begun before it
    parts = pieces.where("kind <> 'whole'").withColumn("rank", F.when(F.col("kind") == "tail", 1).otherwise(0))
    order = Window.partitionBy("file").orderBy("first", "rank")
    parts = parts.withColumn("begins", F.sum(F.col("rank")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = parts.groupBy("file", "begins").agg(
        F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "rank", "record"))), lambda s: s["record"]), "\n").alias("record"))
    both = whole.unionByName(joined.select("file", "header", "record"))
    return both.select("file", "header", F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, as the built-in reader gives them for one task a file."""
    plain = spark.read.option("header", "true").option("inferSchema", "false").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    names = plain.columns
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    rows = records(spark, path).where("not header").select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    return rows.toDF(*names)
