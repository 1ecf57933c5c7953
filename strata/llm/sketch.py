"""Threshold-scaled sketches of documents: mergeable fingerprints (operator 12).

The fingerprint of a text keeps the 64-bit hash of every distinct 5-word
shingle (lower-cased A-Z; a shorter text is one shingle) that falls below a
fixed fraction of the hash space.  The kept hashes of a union are the union of
the kept hashes, and the intersection of two sketches, divided by the smaller
one, estimates containment however unequal the documents are.  A short text
would keep next to nothing, so a sketch holds its FLOOR smallest hashes in any
case and says up to which hash it is complete; two sketches are compared below
the smaller of their two bounds, where both are complete.

A fingerprint is a string: 16 hex digits of the bound (all hashes below it are
there), then 16 for each hash, ascending.  DataFrame functions only.

Neighbours: the text that follows in descending key order is needed beside
each text, and no window may run over all rows.  Keys and checksums alone are
range-partitioned; the first key of every partition is a cut point, so a text
finds its bucket by bisection and is shuffled once; every bucket also gets the
first row of the next one, after its own.

Defined results: a NULL text counts as empty; rows are ordered by key
descending, NULL keys last, rows equal in key by checksum; rows equal in key
and text follow each other, so all but the last are their own next document; a
single row is its own next document; texts without words are alike (1) and
unlike all others (0); no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.llm.shared import fresh, written

WORDS = 5
#: Hashes kept: one in FRACTION, and the FLOOR smallest at least.
FRACTION, FLOOR = 8, 48
_ALL = (1 << 62) - 1
#: Bytes of text in one bucket of the neighbour search, about, and buckets at most.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# sketches -----------------------------------------------------------------------------------------

def word_hashes(text: Column) -> Column:
    found = F.split(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int = WORDS) -> Column:
    """Distinct 62-bit hashes of the k-word shingles of an array of word hashes, ascending."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))
    few = F.array(F.aggregate(words, F.lit(k).cast("long"), lambda a, w: F.xxhash64(a, w)))
    hashes = F.when(F.size(words) >= k, many).when(F.size(words) > 0, few).otherwise(F.array().cast("array<long>"))
    return F.array_sort(F.array_distinct(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 2))))


def kept(hashes: Column, fraction: int = FRACTION, floor: int = FLOOR) -> Column:
    """struct(bound, hashes): the sketch of ascending distinct hashes."""
    limit = F.lit((_ALL + 1) // fraction)
    below = F.filter(hashes, lambda h: h < limit)
    return (F.when(F.size(hashes) <= floor, F.struct(F.lit(_ALL).alias("bound"), hashes.alias("hashes")))
            .when(F.size(below) >= floor, F.struct(limit.alias("bound"), below.alias("hashes")))
            .otherwise(F.struct((F.get(hashes, F.lit(floor - 1)) + 1).alias("bound"), F.slice(hashes, 1, floor).alias("hashes"))))


def fingerprint(s: Column) -> Column:
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(digits(s["bound"]), F.array_join(F.transform(s["hashes"], digits), ""))


def parsed(text: Column) -> Column:
    """The sketch that a fingerprint string stands for."""
    part = lambda i: F.conv(F.substring(text, i * 16 + 1, F.lit(16)), 16, 10).cast("long")
    return F.struct(part(F.lit(0)).alias("bound"), F.when(F.length(text) > 16, F.transform(F.sequence(F.lit(1), (F.length(text) / 16).cast("int") - 1), part))
                    .otherwise(F.array().cast("array<long>")).alias("hashes"))


def merged(a: Column, b: Column) -> Column:
    """Sketch of the union of two texts' shingles: complete below the smaller bound."""
    bound = F.least(a["bound"], b["bound"])
    return F.struct(bound.alias("bound"), F.array_sort(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h < bound)).alias("hashes"))


def compared(a: Column, b: Column) -> Column:
    """struct(a, b, both): hashes of two sketches, and those in both, below the smaller bound."""
    bound = F.least(a["bound"], b["bound"])
    cut = lambda s: F.filter(s["hashes"], lambda h: h < bound)
    return F.struct(F.size(cut(a)).alias("a"), F.size(cut(b)).alias("b"), F.size(F.array_intersect(cut(a), b["hashes"])).alias("both"))


def resemblance(c: Column) -> Column:
    """Estimated share of the union that two texts have in common, from ``compared``."""
    union = c["a"] + c["b"] - c["both"]
    return F.when(union == 0, F.lit(1.0)).otherwise(c["both"] / union)


def containment(c: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has."""
    return F.when(c["a"] == 0, F.when(c["b"] == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(c["both"] / c["a"])


def with_sketch(df: DataFrame, text: str, out: str, fraction: int = FRACTION, floor: int = FLOOR) -> DataFrame:
    """Add the sketch of column ``text``; word and shingle hashes are columns of their own on the way, so each is made once."""
    words, shingles = fresh(df, "words", "shingles")
    df = df.withColumn(words, word_hashes(F.col(text)))
    df = df.withColumn(shingles, shingle_hashes(F.col(words)))
    return df.withColumn(out, kept(F.col(shingles), fraction, floor)).drop(words, shingles)


# neighbours ---------------------------------------------------------------------------------------

def _bisect(cuts: Column, x: Column) -> Column:
    """Number of elements of the ascending array ``cuts`` that are not above ``x``."""
    step = lambda s: F.struct(
        F.when(F.get(cuts, F.floor((s["l"] + s["h"]) / 2).cast("int")) <= x, F.floor((s["l"] + s["h"]) / 2).cast("int") + 1).otherwise(s["l"]).alias("l"),
        F.when(F.get(cuts, F.floor((s["l"] + s["h"]) / 2).cast("int")) <= x, s["h"]).otherwise(F.floor((s["l"] + s["h"]) / 2).cast("int")).alias("h"))
    turns = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(MAX_BUCKETS)) + 1))
    return F.aggregate(turns, F.struct(F.lit(0).alias("l"), F.size(cuts).alias("h")),
                       lambda s, _: F.when(s["l"] >= s["h"], s).otherwise(step(s)), lambda s: s["l"])


def _place(key: Column, text: Column) -> Column:
    """Ascending where the key descends and NULL keys come last."""
    k = key.cast("long")
    return F.struct(k.isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(k), F.lit(0).cast("long")).alias("down"), F.xxhash64(text).alias("tie"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch, copies): every distinct (key, text) with the row after it."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = base.withColumn("place", _place(F.col("doc_id"), F.col("text")))
    slim = written(placed.groupBy("place").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).cast("long").alias("bytes")), "places")
    total = slim.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).first()
    pieces = min(MAX_BUCKETS, max(1, math.ceil((total["b"] or 0) / bucket_bytes)))
    pieces = min(max(pieces, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), max(1, math.ceil(total["n"] / 64)))
    # the first place of every range partition is a cut point
    cuts = written(slim.select("place").repartitionByRange(pieces, "place").groupBy(F.spark_partition_id().alias("p")).agg(F.min("place").alias("place")).select("place"), "cuts")
    marks = cuts.agg(F.sort_array(F.collect_list("place"))).scalar()
    bucket = F.greatest(_bisect(F.col("marks"), F.col("place")) - 1, F.lit(0))
    if (total["most"] or 1) > 1:
        # copies of a row meet before the shuffle: one stays, with their number
        again = slim.where("copies > 1").select(F.col("place").alias("at"), "copies")
        once = join_small(placed, again, F.col("place") == F.col("at"), "left")
        rows = once.where("copies is null").select("doc_id", "text", "place", F.lit(1).cast("long").alias("copies")).unionByName(
            once.where("copies is not null").groupBy("place", "doc_id", "copies").agg(F.min("text").alias("text")))
    else:
        rows = placed.withColumn("copies", F.lit(1).cast("long"))
    # the first row of a bucket is also the row after the last one of the bucket before
    firsts = join_small(rows, cuts.select(F.col("place").alias("at")), F.col("place") == F.col("at"), "left_semi")
    firsts = written(firsts, "firsts")
    n = F.size("marks")
    dealt = rows.withColumn("marks", marks).withColumn("bucket", bucket).withColumn("extra", F.lit(0)).unionByName(
        firsts.withColumn("marks", marks).withColumn("bucket", F.pmod(bucket - 1 + n, n)).withColumn("extra", F.lit(1))).drop("marks")
    # one shuffle of the texts, beyond which the sketches are taken and kept beside them
    dealt = with_sketch(dealt.repartition("bucket"), "text", "sketch")
    after = Window.partitionBy("bucket").orderBy("extra", "place")
    near = dealt.withColumn("next_text", F.lead("text").over(after)).withColumn("next_sketch", F.lead("sketch").over(after))
    return near.where("extra = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch", "copies")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many code points from the start of ``following``."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    near = with_next(docs, key, text)
    # of c copies of a row, c - 1 are followed by a copy of themselves
    near = near.withColumn("own", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    either = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b))
    near = near.select("doc_id", "text", "sketch", either("text", "next_text").alias("next_text"), either("sketch", "next_sketch").alias("next_sketch"),
                       F.when(F.col("own"), F.col("copies") - 1).otherwise(F.lit(1)).alias("times"))
    near = with_sketch(near.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "edited_sketch")
    near = near.withColumn("with_edited", compared(F.col("sketch"), F.col("edited_sketch"))).withColumn("with_next", compared(F.col("sketch"), F.col("next_sketch")))
    out = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                      resemblance(F.col("with_edited")).alias("near_edited"), resemblance(F.col("with_next")).alias("near_next"),
                      containment(F.col("with_edited")).alias("contained_edited"), containment(F.col("with_next")).alias("contained_next"),
                      F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return out.drop("copy")
