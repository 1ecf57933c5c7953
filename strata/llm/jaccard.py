"""N-gram Jaccard join by prefix trees (operator 1).

Documents are sets of distinct 5-word shingles (64-bit fingerprints); two link
when 100 * |A and B| >= 80 * |A or B|.  The join is exact over fingerprints
and never forms the pairs of a group:

1. ``shared``: shingles are dealt by range; those of one document only leave.
   A document that keeps fewer than 80 in 100 shingles can have no partner.
   A block of documents sends a shingle once however many of its documents
   hold it, so a shingle of every third document is one entry a block.
2. Equal sets collapse to one representative; step 1 repeats among these.
3. In the global order (rarest first) partners share a shingle among the
   first n - ceil(0.8 n) + 1.  Documents that share such a shingle form
   candidate groups (connected components, found by star contraction).
4. Each group's sets go into a trie, common shingles first.  A document walks
   the trie, sharing the overlap counted so far along a path, and leaves a
   subtree as soon as the remaining lengths can't reach the bound, or when
   all below it is already connected to it.  Groups beyond CELL_BYTES are
   dealt into pairs of blocks (cells), so no task holds a whole large group.
5. Links found (a spanning forest of each cell) give the final components.

Defined results: NULL, empty or blank texts have the empty set and link with
nothing; fewer than five words form one shingle, the whole sequence; repeated
rows link with each other; a NULL doc_id takes part, and a component's id is
its smallest non-NULL doc_id (NULL if it has none); an empty table gives no
rows; extra columns are ignored (``links``) or kept (``one_of_each``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.llm import textcols as X
from strata.llm.packing import pack, unpack
from strata.llm.shared import components, fresh, written

SHINGLE = 5
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
CELL_BYTES = 16 << 20


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint) of every distinct shingle, sorted by both, and each row's number of them."""
    buf = X.lower_ascii(buf)
    start, end, row = X.words(buf, off)
    fp = X.fingerprints(buf, start, end)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.flatnonzero(row[size - 1:] == row[:len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = X.mix(h, fp[at + k])
    rows = row[at]
    few = np.flatnonzero((count > 0) & (count < size))
    g = count[few].astype(np.uint64)
    for k in range(size - 1):
        live = count[few] > k
        g[live] = X.mix(g[live], fp[first[few[live]] + k])
    rows, h = np.concatenate((rows, few)), np.concatenate((h, g))
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[keep], h[keep]
    return rows, h, np.bincount(rows, minlength=n)


def _pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).astype(np.uint64), dtype=np.uint64)


_SENT = "task long, kind int, block long, ids array<long>, uids array<long>, tags array<string>, n binary, fps binary, at binary, counts binary"
_SENT_NAMES = [f.split()[0] for f in _SENT.split(", ")]
_SENT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SENT_TYPES)], _SENT_NAMES)


def _send(block: int, ids: list, uids: list, tags: list, n: np.ndarray, rows: np.ndarray, fps: np.ndarray, shift: int) -> pa.RecordBatch:
    """Rows of a block: its documents (kind 0), its shingles by range (kind 1: of one document, kind 2: of several)."""
    order = np.argsort(fps, kind="stable")
    f, r = fps[order], rows[order]
    new = np.ones(len(f), dtype=bool)
    new[1:] = f[1:] != f[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(f)))
    alone = count == 1
    out = []
    for kind, pick in ((1, alone), (2, ~alone)):
        x, s, c = f[start[pick]], start[pick], count[pick]
        task = (x >> np.uint64(shift)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))) if len(x) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(x)).tolist()):
            out.append((int(task[a]), kind, block, None, None, None, None, _pack_sorted(x[a:b]),
                        pack(r[s[a:b]]) if kind == 1 else None, None if kind == 1 else pack(c[a:b])))
    # shingles of several documents stay with the block's documents: which they are, and who holds them
    many = ~alone
    held = X.ragged(start[many], count[many])
    out.append((xxhash.xxh3_64_intdigest(block.to_bytes(8, "little")) >> shift, 0, block, ids, uids, tags, pack(n),
                _pack_sorted(f[start[many]]), pack(r[held]), pack(count[many])))
    return _batch(out)


def _count_range(t: pa.Table) -> pa.Table:
    """Answers the blocks: shingles of the range held by two documents or more, with their number; documents pass."""
    rows = t.to_pylist()
    sent = [r for r in rows if r["kind"]]
    fps = [_unpack_sorted(r["fps"]) for r in sent]
    weight = [np.ones(len(f), np.int64) if r["kind"] == 1 else unpack(r["counts"]).astype(np.int64) for r, f in zip(sent, fps)]
    out = [tuple(r[c] for c in _SENT_NAMES) for r in rows if not r["kind"]]
    if sent:
        every = np.concatenate(fps)
        order = np.argsort(every, kind="stable")
        f = every[order]
        new = np.ones(len(f), dtype=bool)
        new[1:] = f[1:] != f[:-1]
        group = np.cumsum(new) - 1
        total = np.empty(len(f), np.int64)
        total[order] = np.bincount(group, np.concatenate(weight)[order]).astype(np.int64)[group] if len(f) else 0
        at = 0
        for r, f in zip(sent, fps):
            n = total[at:at + len(f)]
            at += len(f)
            keep = n > 1
            if keep.any():
                out.append((r["task"], r["kind"], r["block"], None, None, None, None, _pack_sorted(f[keep]),
                            pack(unpack(r["at"])[keep]) if r["kind"] == 1 else None, pack(n[keep])))
    if not out:
        return pa.table({c: pa.array([], ty) for c, ty in zip(_SENT_NAMES, _SENT_TYPES)})
    return pa.Table.from_batches([_batch(out)])


_SETS = "uid long, doc_id long, tag string, n long, n_shared long, fps binary"


def _gather(t: pa.Table) -> pa.Table:
    """Per document of a block: its shared shingles, rarest first; none if too few to link."""
    rows = t.to_pylist()
    own = next(r for r in rows if r["kind"] == 0)
    n = unpack(own["n"]).astype(np.int64)
    f = [_unpack_sorted(r["fps"]) for r in rows if r["kind"] == 1]
    d = [unpack(r["at"]).astype(np.int64) for r in rows if r["kind"] == 1]
    c = [unpack(r["counts"]).astype(np.int64) for r in rows if r["kind"] == 1]
    many = _unpack_sorted(own["fps"])
    if len(many):
        known = [(_unpack_sorted(r["fps"]), unpack(r["counts"]).astype(np.int64)) for r in rows if r["kind"] == 2]
        kf, kc = np.concatenate([a for a, _ in known]), np.concatenate([b for _, b in known])
        order = np.argsort(kf)
        held = unpack(own["counts"]).astype(np.int64)
        f.append(np.repeat(many, held))
        d.append(unpack(own["at"]).astype(np.int64))
        c.append(np.repeat(kc[order][np.searchsorted(kf[order], many)], held))
    f, d, c = (np.concatenate(x) if x else np.zeros(0, y) for x, y in ((f, np.uint64), (d, np.int64), (c, np.int64)))
    shared = np.bincount(d, minlength=len(n))
    may = (shared > 0) & (100 * shared >= 80 * n)
    keep = may[d]
    f, d, c = f[keep], d[keep], c[keep]
    order = np.lexsort((f, c, d))
    f, edge = f[order], np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(n))))).tolist()
    blobs = [f[a:b].astype("<u8").tobytes() if b > a else None for a, b in zip(edge[:-1], edge[1:])]
    return pa.table({"uid": pa.array(own["uids"], pa.int64()), "doc_id": pa.array(own["ids"], pa.int64()),
                     "tag": pa.array(own["tags"], pa.string()), "n": pa.array(n), "n_shared": pa.array(shared),
                     "fps": pa.array(blobs, pa.binary())})


def _shift(size: int) -> int:
    """Ranges of the fingerprints so that about RANGE_BYTES of them meet in one."""
    return 64 - max(3, int(size // RANGE_BYTES).bit_length())


def _shared(sent: DataFrame) -> DataFrame:
    return (sent.groupBy("task").applyInArrow(_count_range, _SENT).groupBy("block").applyInArrow(_gather, _SETS))


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(uid, doc_id, tag, n, n_shared, fps) of rows (doc_id, tag, text): set size, and shared shingles if the row may link."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = _shift(total)  # about as many bytes of fingerprints as of text

    def run(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(X.batches_of(batches, "text", BLOCK_BYTES)):
            rows, fps, n = shingle_sets(*X.text_buffer(b.column("text")), size)
            if i >= 1 << 20:
                raise ValueError("a partition of over a million blocks: read it in smaller splits")
            block = part << 20 | i
            yield _send(block, b.column("doc_id").to_pylist(), [block << 16 | k for k in range(b.num_rows)],
                        b.column("tag").to_pylist(), n, rows, fps, shift)

    return _shared(docs.select("doc_id", "tag", "text").mapInArrow(run, _SENT))


def set_blocks(sets: DataFrame) -> DataFrame:
    """``document_sets`` once more, among rows (uid, n, fps) that are sets already."""
    total = sets.agg(F.sum(F.octet_length("fps"))).first()[0] or 0
    shift = _shift(total)

    def run(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(X.batches_of(batches, "fps", BLOCK_BYTES)):
            raw, off = X.text_buffer(b.column("fps"))
            rows = np.repeat(np.arange(b.num_rows), np.diff(off) // 8)
            none = [None] * b.num_rows
            yield _send(part << 20 | i, none, b.column("uid").to_pylist(), none, b.column("n").to_numpy().astype(np.int64),
                        rows, raw.view("<u8") if len(raw) else np.zeros(0, np.uint64), shift)

    return _shared(sets.select("uid", "n", "fps").mapInArrow(run, _SENT))


class _Node:
    __slots__ = ("seg", "children", "docs", "least", "rest", "one", "doc", "seen")

    def __init__(self, seg, doc, least, rest):
        self.seg, self.children, self.docs = seg, {}, []
        self.least, self.rest = least, rest      # smallest set size below; most shingles after this segment
        self.one, self.doc = True, doc           # everything below is one component, that of ``doc``
        self.seen = 0                            # visits since that was last looked into


def trie_links(sets: list[np.ndarray], sizes: list[int]) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a group: a spanning forest over their indices.

    ``sets`` are the shared shingles, ``sizes`` the full set sizes.
    """
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[code]  # common shingles first, so that paths are shared
    edge = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    parent = list(range(len(sets)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    root = _Node(code[:0], None, 1 << 62, 0)
    inside = np.zeros(len(order), dtype=bool)
    out = []
    for i in sorted(range(len(sets)), key=lambda k: sizes[k]):
        x, n = np.sort(code[edge[i]:edge[i + 1]]), sizes[i]
        inside[x] = True
        todo = [(root, 0)]
        while todo:
            node, overlap = todo.pop()
            if not node.one:
                node.seen += 1
                if node.seen >= len(node.children) + len(node.docs):  # one look costs as much as the visits since the last
                    node.seen = 0
                    below = {find(c.doc) if c.one else -1 for c in node.children.values()} | {find(d) for d in node.docs}
                    node.one = len(below) == 1 and -1 not in below
            if node.one and node.doc is not None and find(node.doc) == find(i):
                continue
            if len(node.seg):
                overlap += int(np.count_nonzero(inside[node.seg]))
                left = len(x) - int(np.searchsorted(x, node.seg[-1], side="right"))
            else:
                left = len(x)
            if 9 * (overlap + min(left, node.rest)) < 4 * (n + node.least):
                continue
            for d in node.docs:
                if 9 * overlap >= 4 * (n + sizes[d]) and find(d) != find(i):
                    parent[find(i)] = find(d)
                    out.append((i, d))
            todo += [(c, overlap) for c in node.children.values()]
        inside[x] = False
        # insert: follow the path, split a segment where it parts
        node, at = root, 0
        while True:
            node.least, node.rest = min(node.least, n), max(node.rest, len(x) - at)
            if node.doc is None:
                node.doc = i
            elif node.one and find(node.doc) != find(i):
                node.one = False
            child = node.children.get(int(x[at])) if at < len(x) else None
            if child is None:
                if at == len(x):
                    node.docs.append(i)
                else:
                    leaf = _Node(x[at:], i, n, 0)
                    leaf.docs.append(i)
                    node.children[int(x[at])] = leaf
                break
            m = min(len(child.seg), len(x) - at)
            differ = np.flatnonzero(child.seg[:m] != x[at:at + m])
            k = int(differ[0]) if len(differ) else m
            if k < len(child.seg):
                upper = _Node(child.seg[:k], child.doc, child.least, child.rest + len(child.seg) - k)
                upper.one = child.one
                upper.children[int(child.seg[k])] = child
                node.children[int(x[at])] = upper
                child.seg = child.seg[k:]
                child = upper
            node, at = child, at + k
    return out


def _join_groups(t: pa.Table) -> pa.Table:
    """Links of the groups in a task (columns grp, uid, n, fps)."""
    grp, uid, n = (t[c].to_numpy() for c in ("grp", "uid", "n"))
    raw, off = X.text_buffer(t["fps"].combine_chunks())
    fps = raw.view("<u8") if len(raw) else np.zeros(0, np.uint64)
    order = np.lexsort((uid, grp))
    edges = np.flatnonzero(np.concatenate(([True], grp[order][1:] != grp[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
    u, v = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order[a:b]
        for p, q in trie_links([fps[off[r] // 8:off[r + 1] // 8] for r in rows], n[rows].tolist()):
            u.append(int(uid[rows[p]]))
            v.append(int(uid[rows[q]]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _candidates(reps: DataFrame) -> DataFrame:
    """(uid, grp) of the sets that share a shingle within their prefixes with another."""
    def run(batches):
        for b in batches:
            raw, off = X.text_buffer(b.column("fps"))
            fps, off = (raw.view("<u8") if len(raw) else np.zeros(0, np.uint64)), off // 8
            n, m = b.column("n").to_numpy(), np.diff(off)
            need = -((-80 * n) // 100)
            # shingles of no other set come first in the order and fill part of the prefix
            size = np.clip(n - need + 1 - (n - m), 0, m)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("uid").to_numpy(), size)),
                                              pa.array(fps[X.ragged(off[:-1], size)].view(np.int64))], ["uid", "fp"])

    tokens = written(reps.select("uid", "n", "fps").mapInArrow(run, "uid long, fp long"), "prefixes")
    low = tokens.groupBy("fp").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high")
    edges = tokens.join(low, "fp").select("uid", "low").where("uid <> low").distinct()
    return components(edges, "uid", "low", "candidates")


def _classes(may: DataFrame) -> DataFrame:
    """(uid, cls): rows of equal sets have the same class."""
    def run(batches):
        for b in batches:
            raw, off = X.text_buffer(b.column("fps"))
            f = raw.view("<u8") if len(raw) else np.zeros(0, np.uint64)
            rows = np.repeat(np.arange(b.num_rows), np.diff(off) // 8)
            data, off = f[np.lexsort((f, rows))].tobytes(), off.tolist()
            whole = (b.column("n").to_numpy() == b.column("n_shared").to_numpy()).tolist()  # equal sets share every shingle
            cls = [hashlib.blake2b(data[a:z], digest_size=16).hexdigest() if w else f"row {u}"
                   for a, z, w, u in zip(off[:-1], off[1:], whole, b.column("uid").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(cls, pa.string())], ["uid", "cls"])

    return may.select("uid", "n", "n_shared", "fps").mapInArrow(run, "uid long, cls string")


def _nodes(docs: DataFrame, key: str, text: str, tag) -> DataFrame:
    """(uid, doc_id, tag, n, root) of every row; rows of one component have the same root."""
    df = docs.select(F.col(key).cast("long").alias("doc_id"), tag.alias("tag"), F.col(text).alias("text"))
    sets = written(document_sets(df), "sets")
    may = sets.where("fps is not null")
    classes = written(_classes(may), "classes")
    member = written(classes.join(classes.groupBy("cls").agg(F.min("uid").alias("rep")), "cls").select("uid", "rep"), "members")
    heads = member.where("uid = rep").select("uid")
    reps = join_small(may, heads, "uid", "left_semi")
    reps = written(set_blocks(reps).where("fps is not null").select("uid", "n", "fps"), "reps")
    pairs = components(_group_links(reps, _candidates(reps)), "u", "v", "links")
    found = (member.join(pairs, member["rep"] == pairs["node"], "left")
             .select("uid", F.coalesce("component", "rep").alias("root")))
    return sets.select("uid", "doc_id", "tag", "n").join(found, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def _group_links(reps: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v) links inside the candidate groups (node, component); large groups in cells of two blocks each."""
    x = join_small(reps, groups.select(F.col("node").alias("uid"), F.col("component").alias("grp")), "uid")
    x = written(x, "grouped")
    weight = written(x.groupBy("grp").agg(F.sum(F.octet_length("fps")).alias("size")), "groups")
    total = weight.agg(F.sum("size")).first()[0] or 0
    tasks = 4 * (1 + int(total // CELL_BYTES))
    # a group of b blocks is joined in b (b - 1) / 2 cells, one for each two blocks
    x = join_small(x, weight.withColumn("b", F.when(F.col("size") <= CELL_BYTES, 1).otherwise(F.ceil(2 * F.col("size") / CELL_BYTES)).cast("int")), "grp")
    x = x.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("b")).cast("int"))
    x = x.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("b") - 1), lambda k: (k != F.col("own")) | (F.col("b") == 1))))
    small = F.col("b") == 1
    x = x.withColumn("task", F.when(small, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.col("grp")))
    x = x.withColumn("cell_i", F.when(small, -1).otherwise(F.least("own", "other"))).withColumn("cell_j", F.when(small, -1).otherwise(F.greatest("own", "other")))
    return (x.select("task", "cell_i", "cell_j", "grp", "uid", "n", "fps").groupBy("task", "cell_i", "cell_j")
            .applyInArrow(_join_groups, "u long, v long"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; exact over fingerprints."""
    nodes = _nodes(docs, key, text, F.lit(None).cast("string"))
    ids = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return nodes.join(ids, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) with one row of every component: that of its smallest key.

    Rows are told apart by key and text; of rows equal in both, one stays.
    Rows without a word all stay.
    """
    tag = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    nodes = written(_nodes(docs, key, text, tag), "nodes")
    first = nodes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), "tag", "uid"))["uid"].alias("uid"))
    kept = nodes.join(first.withColumn("stays", F.lit(1)), "uid", "left")
    rows = kept.groupBy("doc_id", "tag").agg(F.count("stays").alias("stay"), F.count(F.lit(1)).alias("of")).where("stay < of")
    mine, k, t, stay = fresh(docs, "tag", "k", "t", "stay")
    rows = written(rows.select(F.col("doc_id").alias(k), F.col("tag").alias(t), F.col("stay").alias(stay)), "dropped")
    same = F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(mine) == F.col(t))
    tagged = docs.withColumn(mine, tag)
    out = join_small(tagged, rows, same, "left_anti")
    again = join_small(tagged, rows.where(F.col(stay) > 0), same, "left_semi").dropDuplicates([key, mine])
    return out.unionByName(again).select(*docs.columns)
