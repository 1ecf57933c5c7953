"""Sharding by a Feistel permutation with cycle walking (operator 10).

Rows get global numbers 0..N-1 (order of key, then size and checksum).  An
unbalanced Feistel network permutes the numbers of ceil(log2 N) bits; a result
of N or more is permuted again until it falls below N (cycle walking), which
leaves a permutation of 0..N-1.  Position p goes to shard p mod k, slot
p div k: shard sizes differ by one row at most, slots have no gaps, and shard
and slot of any row number (and back, ``row_at``) follow from N, k and the
seed alone.  DataFrame functions only: no Python runs on executors.

Defined results: a NULL text has size 1 and checksum 0; NULL keys are numbered
first; rows equal in key, size and checksum are interchangeable and get
different slots; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import numbered, written

ROUNDS = 8
#: Cycle walking leaves with probability over 1/2 a step, so this many never run out in practice; if they did, the job stops.
MAX_WALK = 128


def bits_for(n: int) -> int:
    return max(2, (n - 1).bit_length())


def _network(x: Column, bits: int, seed: int, forward: bool) -> Column:
    """One pass of the network over ``bits`` bits: even rounds change the left part, odd ones the right."""
    right = bits - bits // 2
    left_mask, right_mask = (1 << (bits // 2)) - 1, (1 << right) - 1

    def turn(half: Column, i: Column, mask: int) -> Column:
        return F.xxhash64(F.lit(seed).cast("long"), i, half).bitwiseAND(F.lit(mask).cast("long"))

    def step(s: Column, i: Column) -> Column:
        even = F.struct(s["l"].bitwiseXOR(turn(s["r"], i, left_mask)).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), s["r"].bitwiseXOR(turn(s["l"], i, right_mask)).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit(right_mask).cast("long")).alias("r"))
    rounds = F.array(*[F.lit(i) for i in (range(ROUNDS) if forward else reversed(range(ROUNDS)))])
    return F.aggregate(rounds, start, step, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def _walk(x: Column, n: int, seed: int, forward: bool) -> Column:
    bits = bits_for(n)
    step = lambda y: _network(y, bits, seed, forward)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_WALK)), step(x), lambda y, _: F.when(y < n, y).otherwise(step(y)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """Position of row ``number`` in the shuffle of n rows."""
    return _walk(number.cast("long"), n, seed, True)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """Number of the row that holds ``slot`` of ``shard``: the permutation backwards."""
    return _walk((slot * shards + shard).cast("long"), n, seed, False)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, position, shard, slot) of every row."""
    slim = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    slim = written(slim, "shards")
    n = slim.count()
    out = numbered(slim, ["doc_id", "size", "text_crc32"], "row_number", hint=n)
    out = out.withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    return out.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / shards).cast("long"))
