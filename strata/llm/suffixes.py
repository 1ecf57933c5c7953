"""Suffix-array dedup: remove every byte of a 400-byte string that starts elsewhere too (operator 5).

Sorting all suffixes of a corpus would move every byte hundreds of times.  A
repeated string is found through its anchor instead: the 32-byte gram with the
smallest hash among its own grams (rightmost of equals), which its content
alone decides, so both places choose it at the same offset.  Only suffixes
around anchors that occur twice or more are sorted:

1. ``anchors``: position, gram and context (368 bytes before, 400 after) of
   the anchors of every whole text, as hashes.  Grams seen once leave.
2. Contexts seen twice are covered whole.  A repeated string reaches half of
   its other bytes to one side of its gram, so of the other contexts only
   those stay open whose hash of that side occurs twice with the gram; their
   bytes are fetched, one copy of each.
3. Per gram, right contexts and reversed left contexts are suffix-sorted
   deep-shallow: multikey quicksort (8 bytes a step) to SHALLOW bytes, then a
   blind trie orders what is still tied.  The longest common prefixes of
   neighbours cut both orders into runs for every offset of the 400-byte
   string; two contexts in the same right run and left run share that string.
4. The covered spans go back to all places of a context, and the texts lose
   them.  Equal texts share all this (they are told apart by MD5 only).

A gram with over GROUP_LIMIT different contexts is not sorted in one task: its
strings are counted by hash with a plain aggregation, exact as well.

Defined results: NULL is the empty text; texts under 400 bytes lose nothing;
matches never cross rows; repeated rows remove each other; NULL keys are
ordinary; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.llm import textcols as X
from strata.llm.shared import written

LENGTH = 400
GRAM = 32
BEFORE = LENGTH - GRAM
HALF = BEFORE // 2
SHALLOW = 64
GROUP_LIMIT = 32_768
_OFFSETS = 32
_SEGMENT = 1 << 20
_BATCH = 1 << 20
#: Rows of a side that may be broadcast here; anchors come by the million.
_SMALL = 100_000
_TASK_CONTEXTS = 10_000
_POS = np.uint64((1 << 23) - 1)


def _select(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Anchors of every window of LENGTH bytes inside one row of a buffer of at most 2^23 bytes."""
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    eight = np.ndarray((n + 1,), "<u8", padded.data, 0, (1,))
    grams = n - GRAM + 1
    h = np.full(grams, GRAM, np.uint64)
    for k in range(0, GRAM, 8):
        h = X.mix(h, eight[k:k + grams])
    key = (h & ~_POS) | (_POS - np.arange(grams, dtype=np.uint64))
    width = BEFORE + 1
    blocks = -(-grams // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:grams] = key
    grid = full.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    low = np.minimum(tail[:starts], head[width - 1:width - 1 + starts])
    row_end = np.repeat(off[1:], np.diff(off))[:starts]
    inside = np.arange(starts) + LENGTH <= row_end
    at = (_POS - (low[inside] & _POS)).astype(np.int64)
    return np.unique(at)


def anchors_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of all anchors; a longer buffer is taken in overlapping segments."""
    out, a = [], 0
    while True:
        z = min(len(buf), a + _SEGMENT + LENGTH - 1)
        out.append(_select(buf[a:z], np.clip(off - a, 0, z - a)) + a)
        if z == len(buf):
            return np.unique(np.concatenate(out))
        a += _SEGMENT


def anchors(docs: DataFrame) -> DataFrame:
    """(tkey, doc_id, pos, gram, ctx, hashes of the near bytes before and after) of rows (doc_id, text, tkey)."""
    def run(batches):
        for b in X.batches_of(batches, "text", _BATCH):
            buf, off = X.text_buffer(b.column("text"))
            at = anchors_of(buf, off)
            row = np.searchsorted(off, at, side="right") - 1
            lo, hi = np.maximum(at - BEFORE, off[row]), np.minimum(at + LENGTH, off[row + 1])
            raw = buf.tobytes()
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:z], seed=p - a) for a, z, p in zip(lo.tolist(), hi.tolist(), at.tolist())),
                              np.uint64, len(at))
            # any string of LENGTH bytes around the anchor reaches HALF bytes before it or as far beyond the gram
            left = [xxhash.xxh32_intdigest(raw[p - HALF:p]) if p - a >= HALF else None for a, p in zip(lo.tolist(), at.tolist())]
            right = [xxhash.xxh32_intdigest(raw[p:p + GRAM + HALF]) if z - p >= GRAM + HALF else None for z, p in zip(hi.tolist(), at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("tkey").take(pa.array(row)), b.column("doc_id").take(pa.array(row)), pa.array(at - off[row]),
                 pa.array(X.fingerprints(buf, at, at + GRAM).view(np.int64)), pa.array(ctx.view(np.int64)),
                 pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                ["tkey", "doc_id", "pos", "gram", "ctx", "before_h", "after_h"])

    return docs.select("tkey", "doc_id", "text").mapInArrow(
        run, "tkey binary, doc_id long, pos long, gram long, ctx long, before_h long, after_h long")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while n - k > 1:  # a[:k] == b[:k], a[:n] != b[:n]
        m = (k + n) // 2
        if a[k:m] == b[k:m]:
            k = m
        else:
            n = m
    return k


class _Branch:
    __slots__ = ("depth", "children", "some")

    def __init__(self, depth: int, some: int):
        self.depth, self.children, self.some = depth, {}, some


def blind_trie(strings: list[bytes], rows: list[int]) -> list[int]:
    """``rows`` in the order of their strings: a Patricia trie that keeps branching bytes only."""
    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    root = None
    same: dict[int, list[int]] = {}
    for r in rows:
        s = strings[r]
        if root is None:
            root = r
            continue
        # blind search to some leaf, one comparison for the true common prefix, then the place to branch
        node = root
        while isinstance(node, _Branch):
            node = node.children.get(byte(s, node.depth), node.some)
        leaf = node
        d = common(s, strings[leaf])
        if d == len(s) == len(strings[leaf]):
            same.setdefault(leaf, []).append(r)
            continue
        up, node = None, root
        while isinstance(node, _Branch) and node.depth < d:
            up, node = node, node.children[byte(s, node.depth)]
        if isinstance(node, _Branch) and node.depth == d:
            node.children[byte(s, d)] = r
            continue
        split = _Branch(d, leaf)
        split.children = {byte(strings[leaf], d): node, byte(s, d): r}
        if up is None:
            root = split
        else:
            up.children[byte(s, up.depth)] = split
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, _Branch):
            todo += [node.children[k] for k in sorted(node.children, reverse=True)]
        else:
            out += [node, *same.get(node, [])]
    return out


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, common prefix of each string in the order with the one before; -1 at first).

    Strings are known to agree in their first ``depth`` bytes.
    """
    out: list[int] = []
    todo = [(list(range(len(strings))), depth)]
    while todo:
        rows, d = todo.pop()
        if len(rows) < 2:
            out += rows
        elif d >= depth + shallow:
            out += blind_trie(strings, rows)
        else:
            # eight bytes are one character; a string that ends is padded below every byte
            key = {r: (int.from_bytes(strings[r][d:d + 8].ljust(8, b"\0"), "big"), min(8, max(0, len(strings[r]) - d))) for r in rows}
            pivot = key[rows[len(rows) // 2]]
            less, even, more = [], [], []
            for r in rows:
                (even if key[r] == pivot else less if key[r] < pivot else more).append(r)
            todo.append((more, d))
            todo.append((even, d + 8) if pivot[1] == 8 else (even, depth + shallow))
            todo.append((less, d))
    return out, [-1] + [common(strings[a], strings[b]) for a, b in zip(out, out[1:])]


def repeated_offsets(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Contexts x offsets 0..BEFORE: is the string that starts that far before the anchor in another context too?

    ``left`` holds the bytes before each anchor reversed, ``right`` those from the anchor on.
    """
    m = len(left)
    sides = []
    for strings, depth in ((right, GRAM), (left, 0)):
        order, lcp = deep_shallow(strings, depth)
        sides.append((np.asarray(order), np.asarray(lcp), np.fromiter(map(len, strings), np.int64, m)))
    out = np.zeros((m, BEFORE + 1), dtype=bool)
    for first in range(0, BEFORE + 1, _OFFSETS):  # some offsets at a time: memory stays a small multiple of the contexts
        d = np.arange(first, min(first + _OFFSETS, BEFORE + 1))
        key, valid = np.zeros((m, len(d)), np.int64), np.ones((m, len(d)), dtype=bool)
        for (order, lcp, size), need in zip(sides, (LENGTH - d, d)):
            ids = np.empty_like(key)
            ids[order] = np.cumsum(lcp[:, None] < need[None, :], axis=0)
            key = key * (m + 1) + ids
            valid &= size[:, None] >= need[None, :]
        key = np.where(valid, key, -1 - np.arange(m)[:, None])
        by = np.argsort(key, axis=0, kind="stable")
        ordered = np.take_along_axis(key, by, axis=0)
        equal = ordered[1:] == ordered[:-1]
        hit = np.zeros(key.shape, dtype=bool)
        hit[1:] |= equal
        hit[:-1] |= equal
        part = np.zeros_like(hit)
        np.put_along_axis(part, by, hit, axis=0)
        out[:, first:first + len(d)] = part
    return out


def _spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Covered spans, relative to the anchor, of the marked offsets."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(-int(z - 1), LENGTH - int(a)) for a, z in zip(edge[::2], edge[1::2])]


def _sort_groups(t: pa.Table) -> pa.Table:
    """Covered spans (gram, ctx, lo, hi) of the contexts in a task."""
    gram, ctx, copies, before = (t[c].to_numpy() for c in ("gram", "ctx", "copies", "before"))
    data = t["bytes"].to_pylist()
    order = np.lexsort((ctx, gram))
    edges = np.flatnonzero(np.concatenate(([True], gram[order][1:] != gram[order][:-1], [True]))) if len(order) else np.zeros(1, np.int64)
    out: list[tuple] = []
    for a, z in zip(edges[:-1], edges[1:]):
        rows = order[a:z]
        rows = rows[np.concatenate(([True], ctx[rows][1:] != ctx[rows][:-1]))]  # one of equal contexts
        if len(rows) < 2:
            continue
        left = [data[r][:before[r]][::-1] for r in rows]
        right = [data[r][before[r]:] for r in rows]
        hit = repeated_offsets(left, right)
        for r, mask in zip(rows, hit):
            if copies[r] == 1 and mask.any():
                out += [(int(gram[r]), int(ctx[r]), lo, hi) for lo, hi in _spans_of(mask)]
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("gram", "ctx", "lo", "hi"), cols)})


_CONTEXT = "gram long, ctx long, copies long, contexts long, before int, bytes binary"


def _fetch(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The context bytes of the anchors in ``need`` (gram, ctx, copies, contexts, tkey, doc_id, pos)."""
    need = written(need, "needed")
    n = need.count()
    per = need.groupBy(F.col("tkey").alias("k"), F.col("doc_id").alias("d")).agg(
        F.collect_list(F.struct("pos", "gram", "ctx", "copies", "contexts")).alias("want"))
    per = written(per, "wanted")
    found = join_small(docs.select("tkey", "doc_id", "text"), per, (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), limit=_SMALL, rows=n)

    def run(batches):
        for b in X.batches_of(batches, "text", _BATCH):
            buf, off = X.text_buffer(b.column("text"))
            raw, out = buf.tobytes(), []
            for i, want in enumerate(b.column("want").to_pylist()):
                s, e = int(off[i]), int(off[i + 1])
                for w in want:
                    p = s + w["pos"]
                    lo = max(s, p - BEFORE)
                    out.append((w["gram"], w["ctx"], w["copies"], w["contexts"], p - lo, raw[lo:min(e, p + LENGTH)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(
                zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["gram", "ctx", "copies", "contexts", "before", "bytes"])

    return found.select("text", "want").mapInArrow(run, _CONTEXT)


def _by_hash(large: DataFrame) -> DataFrame:
    """``_sort_groups`` for grams of very many contexts: each string's hash is counted, no group meets in one task."""
    names = ["gram", "ctx", "copies", "d", "h"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches):
        for b in batches:
            out = []
            for g, c, n, before, raw in zip(*(b.column(k).to_pylist() for k in ("gram", "ctx", "copies", "before", "bytes"))):
                out += [(g, c, n, d, xxhash.xxh3_128_digest(raw[before - d:before - d + LENGTH]))
                        for d in range(before + 1) if before - d + LENGTH <= len(raw)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), kinds)], names)

    rows = large.dropDuplicates(["gram", "ctx"]).select("gram", "ctx", "copies", "before", "bytes").mapInArrow(
        run, "gram long, ctx long, copies long, d int, h binary")
    twice = rows.groupBy("gram", "d", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return (rows.where("copies = 1").join(twice, ["gram", "d", "h"])
            .select("gram", "ctx", (-F.col("d")).cast("long").alias("lo"), (LENGTH - F.col("d")).cast("long").alias("hi")))


def covered(docs: DataFrame) -> DataFrame:
    """(k: text key, spans: array of (start, end)) of every text that loses bytes; ``docs`` has doc_id, text, tkey."""
    found = written(anchors(docs), "anchors")
    often = written(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    hits = written(join_small(found, often, "gram", "left_semi", _SMALL), "hits")
    ctx = hits.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("tkey", "doc_id", "pos")).alias("at"),
                                          F.first("before_h").alias("before_h"), F.first("after_h").alias("after_h"))
    ctx = written(ctx, "contexts")
    # contexts that agree with another one as far as a repeated string must on one side; a class of copies alone is settled
    sides = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("before_h").alias("h")), F.struct(F.lit(1).alias("side"), F.col("after_h").alias("h"))),
                     lambda x: x["h"].isNotNull())
    each = ctx.select("gram", "ctx", "copies", "at", F.explode(sides).alias("x")).select("gram", "ctx", "copies", "at", "x.side", "x.h")
    open_ = each.groupBy("gram", "side", "h").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least")).where("n > 1 and least = 1")
    rows = each.join(open_.select("gram", "side", "h"), ["gram", "side", "h"]).groupBy("gram", "ctx").agg(
        F.first("copies").alias("copies"), F.first("at").alias("at"))
    rows = written(rows, "open-contexts")
    several = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"))
    need = rows.join(several, "gram").select("gram", "ctx", "copies", "contexts", "at.tkey", "at.doc_id", "at.pos")
    fetched = written(_fetch(docs, need), "fetched")
    tasks = 4 + fetched.count() // _TASK_CONTEXTS
    small = (fetched.where(F.col("contexts") <= GROUP_LIMIT).withColumn("task", F.pmod(F.col("gram"), F.lit(tasks)))
             .groupBy("task").applyInArrow(_sort_groups, "gram long, ctx long, lo long, hi long"))
    partial = small.unionByName(_by_hash(fetched.where(F.col("contexts") > GROUP_LIMIT)))
    whole = ctx.where("copies > 1").select("gram", "ctx", F.lit(-BEFORE).cast("long").alias("lo"), F.lit(LENGTH).cast("long").alias("hi"))
    cover = written(whole.unionByName(partial), "cover")
    spans = hits.join(cover, ["gram", "ctx"]).select("tkey", (F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end")).distinct()
    return spans.groupBy(F.col("tkey").alias("k")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: remaining bytes) of every row."""
    df = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("tkey", F.unhex(F.md5(F.col("text").cast("binary"))))
    cover = written(covered(df), "covered")
    both = join_small(df, cover, F.col("tkey") == F.col("k"), "left", _SMALL).select("doc_id", "text", "spans")

    def run(batches):
        for b in X.batches_of(batches, "text", _BATCH):
            buf, off = X.text_buffer(b.column("text"))
            raw, kept, removed, runs = buf.tobytes(), [], [], []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                s, e = int(off[i]), int(off[i + 1])
                n, at, parts, last = e - s, 0, [], -1
                count = gone = 0
                for a, z in sorted((max(0, x["start"]), min(n, x["end"])) for x in spans or ()):
                    if a > last or last < 0:
                        parts.append(raw[s + at:s + a])
                        count += 1
                        at = last = a
                    if z > last:
                        gone += z - last
                        at = last = z
                kept.append(b"".join([*parts, raw[s + at:e]]))
                removed.append(gone)
                runs.append(count)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
