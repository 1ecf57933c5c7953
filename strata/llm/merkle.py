"""Merkle manifest of a dataset as a postorder append log (operator 13).

Every row is a leaf; per tree (language) the leaves ascend by key and every
eight consecutive nodes become one node of the next level (the last run of a
level may be shorter), until one is left.  Aligned builders, one task call per
block of 8^LEVELS consecutive leaves, write the nodes of their block in the
order in which they are completed, so a block is one contiguous segment of the
log; the segments' last nodes are the leaves of the next round of builders.
Subroots form one more tree in the same way.

A node (level, index) of a tree of n leaves is completed by leaf
e = min((index + 1) * 8^level, n) - 1, before which e leaves and
floor(e / 8^j) nodes of every level j are in the log, so it stands at

    position = e + sum over j >= 1 of floor(e / 8^j) + level

Siblings are addressed by that formula alone (``position``,
``sibling_positions``): a proof needs no search and no pointers.  ``prove``
extracts all proofs from the top down, a block at a time; ``proofs_at`` fetches
single ones from the log by position.

Defined results: NULL fields are ``-``; the tree of a NULL language comes
first; NULL keys come first in their tree; rows equal in key are ordered by
their leaf digest, and rows with equal digests are interchangeable; a NULL key
is never tampered with; a tree of one leaf is that leaf; no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.llm.shared import range_numbered, written

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels that one builder completes: blocks of 4,096 leaves.
LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# positions ----------------------------------------------------------------------------------------

def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the postorder log of a tree of n leaves."""
    e = min((index + 1) << (ARITY_BITS * level), n) - 1
    at, up = e + level, e >> ARITY_BITS
    while up:
        at, up = at + up, up >> ARITY_BITS
    return at


def siblings(level: int, index: int, n: int) -> list[int]:
    """Indices of the other nodes of the run that holds (level, index), left to right."""
    first = index & ~(ARITY - 1)
    width = -(-n // (1 << (ARITY_BITS * level)))
    return [i for i in range(first, min(first + ARITY, width)) if i != index]


def sibling_positions(leaf: int, n: int) -> list[list[int]]:
    """For every level below the root, the log positions of the siblings on the way of ``leaf``."""
    return [[position(lv, i, n) for i in siblings(lv, leaf >> (ARITY_BITS * lv), n)] for lv in range(height(n))]


# leaves -------------------------------------------------------------------------------------------

def _field(v: Column) -> Column:
    s = v.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, changed): digests of every row, and of the tampered row where there is one."""
    cols = [F.col(f"`{c}`") for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.translate(F.col("text"), _UPPER, _LOWER)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # '-' sorts before '='
    return docs.select(F.col("doc_id"), tree.alias("tree"), leaf_digest(cols).alias("leaf"),
                       F.when(hit, leaf_digest([*cols[:-1], text])).alias("changed"))


# builders -----------------------------------------------------------------------------------------

def _digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def completed(items: list[bytes], levels: int) -> bytes:
    """Digests of ``items`` and of the nodes above them, in the order of completion."""
    log, runs = bytearray(), [[] for _ in range(levels + 1)]

    def add(level: int, d: bytes) -> None:
        log.extend(d)
        if level < levels:
            runs[level].append(d)
            if len(runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        d, runs[level] = _digest(runs[level]), []
        add(level + 1, d)

    for d in items:
        add(0, d)
    for level in range(levels):
        if runs[level]:
            close(level)
    return bytes(log)


_SEGMENT = "tree string, block long, n long, m int, levels int, nodes binary"


def _build(levels: int):
    def build(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        n, m = block["n"][0].as_py(), block.num_rows
        up = height(n) if n <= 1 << (ARITY_BITS * levels) else levels
        nodes = completed(block["digest"].to_pylist(), up)
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "m": pa.array([m], pa.int32()),
                         "levels": pa.array([up], pa.int32()), "nodes": [nodes]})
    return build


@dataclass
class Forest:
    """Segments of every round of builders, bottom round first; the last round holds one segment a tree or less."""
    rounds: list[DataFrame]
    levels: int

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree: the last node of the segment that closes it."""
        out = [r.where("block = 0").where(F.col("n") <= 1 << (ARITY_BITS * self.levels)) for r in self.rounds]
        both = out[0]
        for r in out[1:]:
            both = both.unionByName(r)
        return both.select("tree", F.expr("substring(nodes, -32)").alias("digest"))


def build(items: DataFrame, most: int, levels: int = LEVELS) -> Forest:
    """Builders over (tree, idx, n, digest), idx being gapless from 0 in each tree of n items; ``most``: the largest n."""
    span, rounds = 1 << (ARITY_BITS * levels), []
    while True:
        cut = items.withColumn("block", F.expr(f"idx div {span}"))
        seg = written(cut.select("tree", "block", "idx", "n", "digest").groupBy("tree", "block").applyInArrow(_build(levels), _SEGMENT), "merkle")
        rounds.append(seg)
        if most <= span:
            return Forest(rounds, levels)
        most = -(-most // span)
        items = seg.where(F.col("n") > span).select("tree", F.col("block").alias("idx"), F.expr(f"(n + {span - 1}) div {span}").alias("n"),
                                                    F.expr("substring(nodes, -32)").alias("digest"))


def log_rows(forest: Forest) -> DataFrame:
    """The append log as rows (tree, position, level, index, digest), every node once."""
    levels, out = forest.levels, None

    def rows_of(r: int):
        def rows(key: tuple, seg: pa.Table) -> pa.Table:
            s = {c: seg[c][0].as_py() for c in seg.column_names}
            got = {"tree": [], "position": [], "level": [], "index": [], "digest": []}
            for lv in range(0 if r == 0 else 1, s["levels"] + 1):
                for i in range(-(-s["m"] // (1 << (ARITY_BITS * lv)))):
                    at, index = position(lv, i, s["m"]) * 32, (s["block"] << (ARITY_BITS * (levels - lv))) + i
                    level = r * levels + lv
                    for c, v in zip(got, (s["tree"], position(level, index, s["leaves"]), level, index, s["nodes"][at:at + 32])):
                        got[c].append(v)
            return pa.table(got, pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary())]))
        return rows

    sizes = forest.rounds[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    for r, seg in enumerate(forest.rounds):
        part = seg.join(sizes, "tree").groupBy("tree", "block").applyInArrow(
            rows_of(r), "tree string, position long, level int, index long, digest binary")
        out = part if out is None else out.unionByName(part)
    return out


def proofs_at(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tree, idx, siblings): sibling digests, level by level and left to right, of the leaves ``wanted`` (tree, idx, n), fetched by position."""
    where = F.udf(lambda i, n: [p for lv in sibling_positions(i, n) for p in lv], "array<long>", useArrow=True)
    asked = wanted.select("tree", "idx", F.posexplode(where("idx", "n")).alias("k", "position"))
    got = asked.join(log.select("tree", "position", "digest"), ["tree", "position"])
    return got.groupBy("tree", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "digest"))), lambda s: s["digest"]).alias("siblings"))


# proofs -------------------------------------------------------------------------------------------

def _way(nodes: bytes, i: int, m: int, levels: int, upper: bytes) -> bytes:
    """Steps from item i to the root: for each level the slot in its run, the number of siblings and their digests."""
    out = []
    for lv in range(levels):
        j = i >> (ARITY_BITS * lv)
        others = siblings(lv, j, m)
        out.append(bytes([j & (ARITY - 1), len(others)]))
        for s in others:
            at = position(lv, s, m) * 32
            out.append(nodes[at:at + 32])
    return b"".join([*out, upper])


def steps(way: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(way):
        slot, k = way[at], way[at + 1]
        yield slot, [way[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(k)]
        at += 2 + 32 * k


def fold(digest: bytes, way: bytes) -> bytes:
    """Root that ``digest`` and the siblings of ``way`` give."""
    for slot, others in steps(way):
        digest = _digest([*others[:slot], digest, *others[slot:]])
    return digest


_WAY = "tree string, idx long, way binary"


def _ways(bits: int):
    def ways(key: tuple, seg: pa.Table) -> pa.Table:
        s = {c: seg[c][0].as_py() for c in seg.column_names}
        first = s["block"] << bits
        return pa.table({"tree": [s["tree"]] * s["m"], "idx": pa.array(range(first, first + s["m"]), pa.int64()),
                         "way": pa.array([_way(s["nodes"], i, s["m"], s["levels"], s["way"]) for i in range(s["m"])], pa.binary())})
    return ways


def _with_upper(seg: DataFrame, lower: DataFrame | None, top: DataFrame, span: int) -> DataFrame:
    """Segments with the way of their last node: from the round above, or the tree's own when they close it."""
    closing = seg.where(F.col("n") <= span).join(top, "tree")
    if lower is None:
        return closing
    inner = seg.where(F.col("n") > span).join(lower.withColumnRenamed("idx", "block"), ["tree", "block"])
    return closing.unionByName(inner)


def block_ways(forest: Forest, top: DataFrame) -> DataFrame:
    """Bottom segments with the way of their last node to the root; ``top`` has (tree, way) of every tree's root."""
    lower, span, bits = None, 1 << (ARITY_BITS * forest.levels), ARITY_BITS * forest.levels
    for seg in forest.rounds[:0:-1]:
        lower = written(_with_upper(seg, lower, top, span).groupBy("tree", "block").applyInArrow(_ways(bits), _WAY), "merkle")
    return _with_upper(forest.rounds[0], lower, top, span)


_PROOF = "doc_id long, tree string, leaf string, proof_sha256 string, folded_root string"


def _proofs(key: tuple, block: pa.Table, seg: pa.Table) -> pa.Table:
    s = {c: seg[c][0].as_py() for c in seg.column_names}
    base, proof, folded = s["block"] * s["span"], [], []
    leaf, changed = block["leaf"].to_pylist(), block["changed"].to_pylist()
    for i, own, other in zip(block["idx"].to_pylist(), leaf, changed):
        way = _way(s["nodes"], i - base, s["m"], s["levels"], s["way"])
        proof.append(hashlib.sha256(b"".join(d.hex().encode() for _, ds in steps(way) for d in ds)).hexdigest())
        folded.append(fold(own if other is None else other, way).hex())
    return pa.table({"doc_id": block["doc_id"], "tree": block["tree"], "leaf": pa.array([d.hex() for d in leaf], pa.string()),
                     "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})


def manifest(docs: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, Forest, Forest, DataFrame]:
    """Numbered leaves, the forest of the trees, the tree over their roots, and the numbered roots.

    Leaves are numbered by range partitions of (tree, key, leaf, salt), so a
    language or a repeated row that holds most of the table is spread too.
    """
    rows = range_numbered(leaves(docs), ["tree"], ["doc_id", "leaf"], "idx", "n")
    most = rows.agg(F.max("n")).first()[0] or 0
    forest = build(rows.withColumnRenamed("leaf", "digest"), most, levels)
    roots = range_numbered(forest.roots().select(F.lit("").alias("top"), "tree", "digest"), ["top"], ["tree"], "idx", "n")
    crown = build(roots.select(F.col("top").alias("tree"), "idx", "n", "digest"), roots.count(), levels)
    return rows, forest, crown, roots


def prove(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root folded from the (tampered) leaf, for every row."""
    rows, forest, crown, roots = manifest(docs, levels)
    span = 1 << (ARITY_BITS * levels)
    root = crown.roots().select(F.col("tree").alias("top"), F.col("digest").alias("root"))
    crown_ways = block_ways(crown, crown.roots().select("tree", F.lit(b"").alias("way")))
    ways = crown_ways.groupBy("tree", "block").applyInArrow(_ways(ARITY_BITS * levels), _WAY)
    named = (roots.select("top", "idx", F.col("tree").alias("own"), F.col("digest").alias("subroot"))
             .join(ways.select(F.col("tree").alias("top"), "idx", "way"), ["top", "idx"]).join(root, "top"))
    named = written(named.select(F.col("own").alias("tree"), "way", F.hex("subroot").alias("subroot"), F.hex("root").alias("root")), "merkle")
    segs = block_ways(forest, named.select("tree", "way")).withColumn("span", F.lit(span).cast("long"))
    leaf_rows = rows.select("doc_id", "tree", "idx", "leaf", "changed", F.expr(f"idx div {span}").alias("block"))
    got = leaf_rows.groupBy("tree", "block").cogroup(segs.groupBy("tree", "block")).applyInArrow(_proofs, _PROOF)
    out = join_small(got, named.drop("way"), "tree")
    return out.select("doc_id", "leaf", F.lower("subroot").alias("subroot"), F.lower("root").alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.lower("root")).alias("verified"))
