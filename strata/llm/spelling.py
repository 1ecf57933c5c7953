"""Spelling variants by k-d trees over letter-count vectors (operator 11).

A word is a point whose coordinates count its letters.  A replaced letter
moves it by an L1 distance of two, an inserted or deleted one by one, so the
near words of a word of length L lie within distance two among the words of
length L and within distance one among those of length L + 1.  For each such
pair of lengths a k-d tree over the words of the greater length is searched
with the words of the lesser one: a subtree is visited only while the box of
its points can hold one within the distance, and the pairs that are left are
verified letter by letter.

The upper part of each length's tree is fitted on a bounded sample and cuts
the points into cells of about CELL_WORDS words; it decides only how even the
cells are.  Every word goes as a point to its own cell and as a query to every
cell whose box it can reach, a task builds the lower part of the tree over the
points of its cell, and what it found is aggregated per word before the
shuffle, so pairs never leave a task.

Defined results: NULL and empty texts have no words; a NULL key counts as an
empty string before the colon; a deleted letter can leave an empty run, which
is no word; rows are not told apart, so a repeated row counts again; no words
give no rows; extra columns are ignored.  Words whose letters are permutations
of each other are one point, which no tree can cut: they share a cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.joins import join_small
from strata.llm.shared import written

MIN_LENGTH, MIN_COUNT, FORM_RATIO, TYPO_EVERY = 6, 5, 5, 199
#: Points of a cell, about; sample words for each cell, and sample words in all.
CELL_WORDS, SAMPLE_A_CELL, SAMPLE_WORDS = 8_192, 64, 1_000_000
#: Points of a leaf of the lower trees.
LEAF_WORDS = 24
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Coordinate of a code point: a-z, then U+00C0 to U+00FF.
_DIMS = 26 + 64
_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[0xC0:0x100] = 26 + np.arange(64)


# words --------------------------------------------------------------------------------------------

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return out

    for b in batches:
        for key, text in zip(b.column(0), b.column(1)):
            text, key = text.as_py(), key.as_py()
            head = zlib.crc32(f"{'' if key is None else key}:".encode())
            own: Counter[str] = Counter()
            for run, k in Counter(_RUN.findall(text or "")).items():
                own[run.translate(_LOWER)] += k
            for run, k in own.items():
                h = zlib.crc32(run.encode(), head)
                if h % TYPO_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= MIN_LENGTH:
                    counts[run] += k
            if len(counts) >= HELD_WORDS:
                yield flushed()
    yield flushed()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of every word with enough letters and occurrences."""
    part = docs.select(key, text).mapInArrow(_counted, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# vectors and trees --------------------------------------------------------------------------------

def vectors(texts: list[str]) -> np.ndarray:
    """Letter counts of every word; the 90 coordinates are exact."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), sizes)
    flat = np.bincount(row * _DIMS + _DIM[codes], minlength=len(texts) * _DIMS)
    return np.minimum(flat, 32_000).astype(np.int16).reshape(-1, _DIMS)


def _cut(v: np.ndarray) -> tuple[int, int] | None:
    """Coordinate and value that divide the points most evenly (points below the value go left), None for equal points."""
    best, n = None, len(v)
    for d in np.argsort(-v.std(axis=0), kind="stable")[:8]:
        col = np.sort(v[:, d])
        if col[0] == col[-1]:
            continue
        mid = col[n // 2]
        for t in (mid, col[np.searchsorted(col, mid, "right")] if mid < col[-1] else mid):
            left = int(np.searchsorted(col, t, "left"))
            if left and (best is None or abs(2 * left - n) < best[0]):
                best = (abs(2 * left - n), int(d), int(t))
    return best and best[1:]


def upper_tree(v: np.ndarray, cells: int, first: int = 0):
    """Nested (dim, value, left, right) over sample vectors with about ``cells`` leaves, which are cell numbers; (tree, next number)."""
    cut = _cut(v) if cells > 1 and len(v) > 1 else None
    if cut is None:
        return first, first + 1
    d, t = cut
    low = v[:, d] < t
    left, k = upper_tree(v[low], cells // 2, first)
    right, k = upper_tree(v[~low], cells - cells // 2, k)
    return (d, t, left, right), k


def reached(tree, v: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows): every cell with the rows of ``v`` whose distance to the cell's box is at most ``radius``."""
    lo, hi = np.zeros(_DIMS, np.int32), np.full(_DIMS, 1 << 20, np.int32)

    def walk(node, rows: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if not len(rows):
            return
        if not isinstance(node, tuple):
            yield node, rows
            return
        d, t, left, right = node
        col = v[rows, d].astype(np.int32)
        out = lambda: np.maximum(lo[d] - col, 0) + np.maximum(col - hi[d], 0)
        before = out()
        for child, bound, value in ((left, hi, t - 1), (right, lo, t)):
            kept, bound[d] = bound[d], value
            now = far - before + out()
            near = now <= radius
            yield from walk(child, rows[near], now[near])
            bound[d] = kept

    yield from walk(tree, np.arange(len(v)), np.zeros(len(v), np.int32))


def near_in(points: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (rows of ``asked``, rows of ``points``) within ``radius``, leaf by leaf of a k-d tree over ``points``."""
    dims = np.flatnonzero(points.any(axis=0) | asked.any(axis=0))
    points, asked = points[:, dims], asked[:, dims]

    def walk(rows: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        box = points[rows]
        lo, hi, q = box.min(axis=0), box.max(axis=0), asked[who]
        who = who[(np.maximum(lo - q, 0) + np.maximum(q - hi, 0)).sum(axis=1) <= radius]
        if not len(who):
            return
        cut = _cut(box) if len(rows) > LEAF_WORDS else None
        if cut is not None:
            low = box[:, cut[0]] < cut[1]
            yield from walk(rows[low], who)
            yield from walk(rows[~low], who)
            return
        for k in range(0, len(rows), 256):
            part = points[rows[k:k + 256]]
            for i in range(0, len(who), 512):
                some = who[i:i + 512]
                a, b = np.nonzero(np.abs(asked[some][:, None, :] - part[None]).sum(axis=2) <= radius)
                if len(a):
                    yield some[a], rows[k:k + 256][b]

    if len(points) and len(asked):
        yield from walk(np.arange(len(points)), np.arange(len(asked)))


def _letters(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint8).reshape(len(texts), length)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b``, one letter longer, is ``a`` with one letter inserted."""
    n = a.shape[1]
    head, tail = a != b[:, :-1], a != b[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), n)
    last = np.where(tail.any(axis=1), n - 1 - tail[:, ::-1].argmax(axis=1), -1)
    return last < first


# search -------------------------------------------------------------------------------------------

#: A cell's points, queries of its length from other cells, queries that are one letter shorter.
_POINT, _SAME, _SHORTER = 0, 1, 2
_LINKS = "word string, n_near long, best struct<neg:long,word:string>"


def _routed(trees: dict[int, object]) -> Callable:
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[int]] = {}
            texts, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
            for i, w in enumerate(texts):
                by.setdefault(len(w), []).append(i)
            for length, rows in by.items():
                mine = [texts[i] for i in rows]
                v = vectors(mine)
                out = []
                own = {i: c for c, at in reached(trees.get(length, 0), v, 0) for i in at}
                for c, at in reached(trees.get(length, 0), v, 2):
                    out += [(length, c, _POINT if own[i] == c else _SAME, i) for i in at]
                for c, at in reached(trees.get(length + 1, 0), v, 1):
                    out += [(length + 1, c, _SHORTER, i) for i in at]
                for k in range(0, len(out), 50_000):
                    tree, cell, role, at = zip(*out[k:k + 50_000])
                    yield pa.record_batch({"length": pa.array(tree, pa.int32()), "cell": pa.array(cell, pa.int32()), "role": pa.array(role, pa.int32()),
                                           "word": pa.array([mine[i] for i in at], pa.string()), "n": pa.array([counts[rows[i]] for i in at], pa.int64())})
    return routed


def _searched(key: tuple, rows: pa.Table) -> pa.Table:
    """Near words inside one cell, aggregated per word."""
    length = key[0].as_py()
    role, texts, n = rows["role"].to_numpy(), np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy()
    at = {r: np.flatnonzero(role == r) for r in (_POINT, _SAME, _SHORTER)}
    owner, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def look(asked: np.ndarray, radius: int, size: int, verify: Callable, both: bool) -> None:
        if not len(asked) or not len(at[_POINT]):
            return
        mine, theirs = list(texts[asked]), list(texts[at[_POINT]])
        a, b = _letters(mine, size), _letters(theirs, length)
        for i, j in near_in(vectors(theirs), vectors(mine), radius):
            ok = verify(a[i], b[j])
            x, y = asked[i[ok]], at[_POINT][j[ok]]
            owner.append(x)
            other.append(y)
            if both:
                owner.append(y)
                other.append(x)

    look(np.concatenate([at[_POINT], at[_SAME]]), 2, length, one_replaced, False)
    look(at[_SHORTER], 1, length - 1, one_inserted, True)
    x, y = np.concatenate(owner), np.concatenate(other)
    rank = np.empty(len(texts), np.int64)
    rank[np.argsort(texts, kind="stable")] = np.arange(len(texts))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    who, first, count = np.unique(x, return_index=True, return_counts=True)
    best = pa.StructArray.from_arrays([pa.array(-n[y[first]], pa.int64()), pa.array(texts[y[first]], pa.string())], ["neg", "word"])
    return pa.table({"word": pa.array(texts[who], pa.string()), "n_near": pa.array(count, pa.int64()), "best": best})


def fitted(vocabulary: DataFrame, cell_words: int) -> dict[int, object]:
    """Upper tree of every length with more than one cell of words, from a sample chosen by hash."""
    sizes = {r["length"]: r["k"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("k"))
             .where(F.col("k") > cell_words).collect()}
    if not sizes:
        return {}
    share = min(SAMPLE_A_CELL / cell_words, SAMPLE_WORDS / sum(sizes.values()))
    sample = vocabulary.where(F.length("word").isin(list(sizes))).where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    by: dict[int, list[str]] = {}
    for r in sample.select("word").collect():
        by.setdefault(len(r["word"]), []).append(r["word"])
    return {k: upper_tree(vectors(sorted(v)), -(-sizes[k] // cell_words))[0] for k, v in by.items()}


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of the chain, by doubling; a form has FORM_RATIO times the word's count, so chains are short and have no cycle."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        up = now.select(F.col("word").alias("at"), F.col("root").alias("up"))
        step = written(join_small(now, up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    vocabulary = written(words(docs, key, text), "words")
    routed = vocabulary.mapInArrow(_routed(fitted(vocabulary, cell_words)), "length int, cell int, role int, word string, n long")
    links = routed.groupBy("length", "cell").applyInArrow(_searched, _LINKS)
    none = F.lit(None).cast("struct<neg:long,word:string>")
    both = links.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best").unionByName(
        vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.neg") >= FORM_RATIO * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.neg")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null")).withColumnRenamed("word", "of")
    return found.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
