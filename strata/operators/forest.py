"""Random forests of unlimited depth in two phases (survey G2, G13).

While a node holds more than SMALL_ROWS training rows it is split by
histograms, all trees of all folds in the same passes (the passes of
``boost``).  What is left are nodes of bounded size: their rows are shuffled
to one task each, which ends the subtree exactly, over the values themselves.
A view of at most SMALL_ROWS training rows needs no first phase; its rows go
to one task for every group of trees, and the held-out rows go along and are
scored there, so no tree leaves the task that grew it.  A larger view of classes
whose rows of equal features and label make at most SMALL_ROWS sets needs none
either: its trees are grown over the sets, and a set's draws are those of its rows.
For a regression the sets are of equal features only.  No cut parts such rows, so a
tree needs no more of a set than the sums over its drawn rows: weights, labels, their
squares and the number of rows.  One pass adds them up for many trees, and the tree is
the one that the rows themselves would give.

A row's weight in a tree is a Poisson(1) draw from a hash of the row's number
and the tree, the features of a node are drawn from a hash of the tree and the
node's path, so a repeated task grows the same trees.  Values are single
precision, as in the exact splits' thresholds.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import boost
from strata.operators.cells import CELLS_MOST, WEIGHT, merged, weight
from strata.operators.persist import Saved
from strata.operators.trees import SplitRule, Tree
from strata.session import checkpoint_dir

#: Training rows that a task may hold of one node, and bytes of trees that a scoring pass carries.
SMALL_ROWS, PASS_BYTES = 100_000, 64 << 20
BLOCK_ROWS = 8_192


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    depth: int = 0              # 0: no limit
    min_split: int = 2
    min_leaf: int = 1
    features: str = "all"       # or "sqrt"
    seed: int = 42

    def width(self, p: int) -> int:
        return max(1, int(p ** 0.5)) if self.features == "sqrt" else p


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))


def weights(number: np.ndarray, model: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    salt = _mixed(_mixed(np.uint64(seed * 1_000_003 + model)) ^ np.uint64(tree))
    u = (_mixed(number.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    return np.searchsorted(_POISSON, u, "right").astype(np.float64)


def drawn(n: np.ndarray, model: int, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of ``n`` equal rows: the sum of their rows' draws, and how many rows are drawn at all."""
    share = np.diff(np.concatenate([[0.0], _POISSON, [1.0]]))
    times = np.random.default_rng([seed, model, tree]).multinomial(n.astype(np.int64), share)
    return times @ np.arange(len(share), dtype=np.float64), n - times[:, 0]


def allowed(path: np.ndarray, p: int, k: int, model: int, tree: int, seed: int) -> np.ndarray:
    """(nodes, features): the k features that each node may split by, drawn from its path."""
    if k >= p:
        return np.ones((len(path), p), bool)
    salt = _mixed(np.uint64(seed * 7_368_787 + model * 131 + 17) ^ _mixed(np.uint64(tree)))
    draw = _mixed(_mixed(path.astype(np.uint64) ^ salt)[:, None] ^ np.arange(p, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
    return draw.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < k


def child_path(path: np.ndarray, right) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(path * np.uint64(2) + np.asarray(right, np.uint64))


# exact growth -------------------------------------------------------------------------------------

def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: ForestParams, model: int, tree: int, path: int = 1, depth: int = 0,
         rows_of: np.ndarray | None = None, squares: np.ndarray | None = None) -> Tree:
    """The whole tree over values: best split of every node of a level at once, until nodes are pure or too small.

    Sizes count distinct drawn rows, sums their weights.  Of equal gains the
    first feature wins, then the lowest threshold.  ``rows_of``: drawn rows that
    each row of ``x`` stands for, if they are sets of equal rows; ``squares``: weighted
    sums of their squared labels, if ``y`` is their mean.
    """
    keep = np.flatnonzero(w > 0)
    x, y, w = x[keep], y[keep], w[keep]
    rows_of = np.ones(len(w), np.int64) if rows_of is None else rows_of[keep]
    n, width = x.shape
    rank = [np.argsort(x[:, f], kind="stable") for f in range(width)]
    node = np.zeros(n, np.int64)                # node of every row
    feature, threshold, left, right, gains = [-1], [np.nan], [-1], [-1], [0.0]
    sums = [np.append((w[:, None] * y).sum(axis=0), w.sum())]
    level, paths = np.array([0]), np.array([path], np.uint64)
    wy, ww = np.concatenate([w[:, None] * y, w[:, None]], axis=1), w[:, None] * y * y if squares is None else squares[keep]
    while len(level) and (not p.depth or depth < p.depth):
        slot = np.full(len(feature), -1)
        slot[level] = np.arange(len(level))
        of = slot[node]
        k = len(level)
        total = np.stack([np.bincount(of[of >= 0], weights=wy[of >= 0, c], minlength=k) for c in range(wy.shape[1])], 1)
        size = np.bincount(of[of >= 0], weights=rows_of[of >= 0], minlength=k)
        square = np.bincount(of[of >= 0], weights=ww[of >= 0].sum(axis=1), minlength=k)
        score = (total[:, :-1] ** 2).sum(axis=1) / np.maximum(total[:, -1], 1e-300)
        impure = square - score > 1e-9 * np.maximum(square, 1e-300)
        can = impure & (size >= max(p.min_split, 2 * p.min_leaf))
        may = allowed(paths, width, p.width(width), model, tree, p.seed)
        best = np.zeros(k)
        pick, cut = np.full(k, -1), np.zeros(k)
        live = of >= 0
        live[live] = can[of[live]]
        for f in range(width):
            use = rank[f][live[rank[f]]]
            use = use[may[of[use], f]]
            if not len(use):
                continue
            at = of[use]
            order = np.argsort(at.astype(np.uint16) if k < 1 << 16 else at, kind="stable")
            use, at = use[order], at[order]
            v, mine = x[use, f], wy[use]
            run = np.cumsum(mine, axis=0)
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            # only where the value changes inside a node is there a cut
            cuts = np.flatnonzero((at[1:] == at[:-1]) & (v[1:] > v[:-1]))
            if not len(cuts):
                continue
            first = start[np.searchsorted(start, cuts, "right") - 1]
            each = rows_of[use]
            so_far = np.cumsum(each)
            seen, of_cut = so_far[cuts] - (so_far[first] - each[first]), at[cuts]
            cuts, first, of_cut = (a[(seen >= p.min_leaf) & (size[of_cut] - seen >= p.min_leaf)] for a in (cuts, first, of_cut))
            if not len(cuts):
                continue
            below = run[cuts] - (run[first] - mine[first])
            rest = total[of_cut] - below
            gain = (below[:, :-1] ** 2).sum(axis=1) / below[:, -1] + (rest[:, :-1] ** 2).sum(axis=1) / rest[:, -1] - score[of_cut]
            head = np.flatnonzero(np.append(True, of_cut[1:] != of_cut[:-1]))
            top = np.maximum.reduceat(gain, head)
            where = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(head, len(of_cut)))))
            lead = where[np.append(True, of_cut[where][1:] != of_cut[where][:-1])]
            win = lead[gain[lead] > np.maximum(best[of_cut[lead]] * (1 + 1e-9), 1e-12)]
            g, at_cut = of_cut[win], cuts[win]
            best[g], pick[g] = gain[win], f
            mid = v[at_cut].astype(np.float64) / 2 + v[at_cut + 1].astype(np.float64) / 2
            cut[g] = np.where(mid < v[at_cut + 1], mid, v[at_cut])
        split = np.flatnonzero(pick >= 0)
        if not len(split):
            break
        born = len(feature) + 2 * np.arange(len(split))
        for i, b in zip(split, born):
            feature[level[i]], threshold[level[i]], left[level[i]], right[level[i]], gains[level[i]] = int(pick[i]), float(cut[i]), int(b), int(b + 1), float(best[i])
        feature += [-1] * (2 * len(split))
        threshold += [np.nan] * (2 * len(split))
        left += [-1] * (2 * len(split))
        right += [-1] * (2 * len(split))
        gains += [0.0] * (2 * len(split))
        rows = np.flatnonzero(of >= 0)
        rows = rows[pick[of[rows]] >= 0]
        i = of[rows]
        low = x[rows, pick[i]] <= cut[i]
        base = np.zeros(k, np.int64)
        base[split] = born
        node[rows] = base[i] + ~low
        new = node[rows] - born[0]
        part = np.stack([np.bincount(new, weights=wy[rows, c], minlength=2 * len(split)) for c in range(wy.shape[1])], 1)
        sums += list(part)
        level = np.arange(born[0], born[0] + 2 * len(split))
        paths = child_path(np.repeat(paths[split], 2), np.tile([0, 1], len(split)))
        depth += 1
        if len(rows) < 0.75 * len(x):  # rows in finished leaves are done with
            stays = np.zeros(len(x), bool)
            stays[rows] = True
            new_number = np.cumsum(stays) - 1
            rank = [new_number[r[stays[r]]] for r in rank]
            x, wy, ww, node, rows_of = x[rows], wy[rows], ww[rows], node[rows], rows_of[rows]
    total = np.array(sums)
    value = total[:, :-1] / np.maximum(total[:, -1:], 1e-300)
    return Tree(np.array(feature), np.array(threshold), np.zeros(len(feature), bool), np.array(left), np.array(right), value, total[:, -1], np.array(gains))


def joined(top: Tree, parts: dict[int, Tree]) -> Tree:
    """``top`` with leaves replaced by the subtrees grown from them."""
    out = {c: list(getattr(top, c)) for c in ("feature", "threshold", "missing_left", "left", "right", "value", "cover", "gain")}
    for leaf, t in parts.items():
        shift = len(out["feature"]) - 1
        move = lambda v: np.where(v > 0, v + shift, v)
        cols = {c: getattr(t, c) for c in out} | {"left": move(t.left), "right": move(t.right)}
        for c, v in cols.items():
            out[c][leaf] = v[0]
            out[c].extend(v[1:])
    return Tree(**{c: np.array(v) for c, v in out.items()})


# blocks -------------------------------------------------------------------------------------------

_BLOCK = "model int, block long, n int, held boolean, keys array<string>, number long, y binary, x binary, bins binary, margin binary"


def _packed(cut: dict[int, list[np.ndarray]]) -> Callable:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40, BLOCK_ROWS)
        for b in batches:
            model, held = b.column("model").to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            x, y, key = boost._values(b.column("x")).astype(np.float32), b.column("y").to_numpy(), b.column("key")
            for m in np.unique(model):
                for side in (False, True):
                    rows = np.flatnonzero((model == m) & (held == side))
                    for k in range(0, len(rows), BLOCK_ROWS):
                        at, first = rows[k:k + BLOCK_ROWS], next(number)
                        bins = boost.binned(x[at].astype(np.float64), cut[int(m)]).tobytes() if int(m) in cut else b""
                        yield pa.record_batch([
                            pa.array([m], pa.int32()), pa.array([first], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([side]),
                            pa.array([key.take(pa.array(at)).to_pylist() if side else []], pa.list_(pa.string())), pa.array([first], pa.int64()),
                            pa.array([y[at].astype(np.float64).tobytes()]), pa.array([x[at].tobytes()]), pa.array([bins]), pa.array([np.zeros(len(at)).tobytes()])],
                            names=["model", "block", "n", "held", "keys", "number", "y", "x", "bins", "margin"])
    return packed


def _goal(y: np.ndarray, classes: int) -> np.ndarray:
    """What the leaves average: the label, or an indicator of every class."""
    return (y[:, None] == np.arange(classes)).astype(np.float64) if classes else y[:, None]


# small views: groups of trees ---------------------------------------------------------------------

_UNIT = "model int, unit long, number long, n int, held boolean, keys array<string>, y binary, x binary"
_GROWN = "model int, tree int, blob binary, key string, y double, votes array<double>"


def _grown(p: ForestParams, classes: int, groups: list[list[int]], keep: bool) -> Callable:
    def grown(key: tuple, t: pa.Table) -> pa.Table:
        m, unit = key[0].as_py(), key[1].as_py()
        blocks = t.sort_by("number").to_pylist()
        train, held = [b for b in blocks if not b["held"]], [b for b in blocks if b["held"]]
        width = len(blocks[0]["x"]) // (4 * blocks[0]["n"])
        x, z = (np.concatenate([np.zeros((0, width), np.float32), *[np.frombuffer(b["x"], np.float32).reshape(b["n"], -1) for b in bs]]) for bs in (train, held))
        y = np.concatenate([np.zeros(0), *[np.frombuffer(b["y"]) for b in train]])
        number = np.concatenate([np.zeros(0, np.int64), *[b["number"] + np.arange(b["n"]) for b in train]])
        goal, votes, blobs = _goal(y, classes), np.zeros((len(z), classes or 1)), []
        for tree in groups[unit]:
            made = grow(x, goal, weights(number, m, tree, p.seed), p, m, tree)
            votes += made.predict(z)
            blobs.append((m, tree, pickle.dumps(made)) if keep else (m, tree, None))
        keys = [k for b in held for k in b["keys"]]
        truth = np.concatenate([np.zeros(0), *[np.frombuffer(b["y"]) for b in held]])
        a = [v for v in blobs if keep]
        return pa.table([
            pa.array([v[0] for v in a] + [m] * len(keys), pa.int32()), pa.array([v[1] for v in a] + [None] * len(keys), pa.int32()),
            pa.array([v[2] for v in a] + [None] * len(keys), pa.binary()), pa.array([None] * len(a) + keys, pa.string()),
            pa.array([None] * len(a) + truth.tolist(), pa.float64()), pa.array([None] * len(a) + list(votes), pa.list_(pa.float64()))],
            names=["model", "tree", "blob", "key", "y", "votes"])
    return grown


# large views of few different rows: groups of trees over sets of equal rows --------------------------

_SETS = "model int, n int, y binary, x binary, w binary"
_TREES = "model int, tree int, blob binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        model, x = b.column("model").to_numpy(), boost._values(b.column("x")).astype(np.float32)
        y, w = b.column("y").to_numpy(), b.column("w").to_numpy()
        for m in np.unique(model):
            at = np.flatnonzero(model == m)
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([y[at].tobytes()]), pa.array([x[at].tobytes()]), pa.array([w[at].tobytes()])],
                                  names=["model", "n", "y", "x", "w"])


def _grown_of_sets(p: ForestParams, classes: int, groups: list[list[int]]) -> Callable:
    def grown(key: tuple, t: pa.Table) -> pa.Table:
        m, unit = key[0].as_py(), key[1].as_py()
        blocks = t.to_pylist()
        x = np.concatenate([np.frombuffer(b["x"], np.float32).reshape(b["n"], -1) for b in blocks])
        y, n = (np.concatenate([np.frombuffer(b[c]) for b in blocks]) for c in ("y", "w"))
        order = np.lexsort([n, y, *x.T])            # the draws go by a set's place
        x, goal, n, blobs = x[order], _goal(y[order], classes), n[order], []
        for tree in groups[unit]:
            w, rows_of = drawn(n, m, tree, p.seed)
            blobs.append(pickle.dumps(grow(x, goal, w, p, m, tree, rows_of=rows_of)))
        return pa.table({"model": pa.array([m] * len(blobs), pa.int32()), "tree": pa.array(groups[unit], pa.int32()), "blob": pa.array(blobs, pa.binary())})
    return grown


def _of_sets(few: DataFrame, folder: str, p: ForestParams, classes: int, models: int, tasks: int) -> tuple[DataFrame, int]:
    """(model, tree, blob) of the views in ``few``, whose sets of equal rows fit a task, and the number of features."""
    few.mapInArrow(_sets, _SETS).write.parquet(f"{folder}/sets")
    blocks = few.sparkSession.read.schema(_SETS).parquet(f"{folder}/sets")
    each = max(1, -(-p.trees * models // (3 * tasks)))
    groups = [list(range(k, min(k + each, p.trees))) for k in range(0, p.trees, each)]
    units = blocks.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(groups) - 1).cast("long"))))
    units = units.repartition(models * len(groups), "model", "unit").groupBy("model", "unit")
    return units.applyInArrow(_grown_of_sets(p, classes, groups), _TREES), int(blocks.select((F.octet_length("x") / F.col("n") / 4).alias("p")).first()["p"])


# large views of a regression with few different rows: sums of the draws over sets of equal rows --------

_DRAWN = "model int, number long, n int, ids binary, y binary"
_SUMS = "model int, tree int, first long, sums binary"
#: Bytes of sums that a task holds in one pass, rows that it adds up at least, and values of all sets at most.
SUM_BYTES, SUM_ROWS, SET_VALUES = 96 << 20, 4_000_000, 4_000_000


@dataclass
class _Sets:
    """The different rows of a view, in ascending order, and the place of a row among them."""
    x: np.ndarray
    values: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "_Sets | None":
        values = [np.unique(x[:, f]) for f in range(x.shape[1])]
        if sum(np.log2(max(len(v), 1)) for v in values) > 62:
            return None
        codes, first = np.unique(cls._coded(x, values), return_index=True)
        return cls(x[first], values, codes)

    @staticmethod
    def _coded(x: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        code = np.zeros(len(x), np.int64)
        for f, v in enumerate(values):
            code = code * len(v) + np.searchsorted(v, x[:, f])
        return code

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, self._coded(x, self.values))


def _sets_of_features(train: DataFrame, width_most: int, small_rows: int) -> dict[int, _Sets] | None:
    """The sets of equal features of every view, if they are few."""
    few = merged(train, False)
    if few is None:
        return None
    counts = few.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).collect()
    out = None
    if all(r["n"] <= small_rows for r in counts) and sum(r["n"] * r["p"] for r in counts) <= width_most:
        t = few.select("model", "x").toArrow()
        model, x = t["model"].to_numpy(), boost._values(t["x"]).astype(np.float32)
        out = {int(m): _Sets.of(x[model == m]) for m in np.unique(model)}
    few.unpersist()
    return None if out is None or any(v is None for v in out.values()) else out


def _drawn_rows(sets: dict[int, _Sets]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 40, BLOCK_ROWS)
        for b in batches:
            model, x, y = b.column("model").to_numpy(), boost._values(b.column("x")).astype(np.float32), b.column("y").to_numpy()
            for m in np.unique(model):
                mine = np.flatnonzero(model == m)
                for k in range(0, len(mine), BLOCK_ROWS):
                    at = mine[k:k + BLOCK_ROWS]
                    yield pa.record_batch([pa.array([m], pa.int32()), pa.array([next(number)], pa.int64()), pa.array([len(at)], pa.int32()),
                                           pa.array([sets[int(m)].at(x[at]).astype(np.int32).tobytes()]), pa.array([y[at].astype(np.float64).tobytes()])],
                                          names=["model", "number", "n", "ids", "y"])
    return rows


def _summed(p: ForestParams, trees: list[int], sizes: dict[int, int]) -> Callable:
    """A task's sums of every set for each tree: weights, labels, squared labels, rows drawn."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        first = None
        for b in batches:
            for r in b.to_pylist():
                m, ids, y, number = r["model"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["y"]), r["number"] + np.arange(r["n"])
                first = r["number"] if first is None else min(first, r["number"])
                for t in trees:
                    w = weights(number, m, t, p.seed)
                    own = total.setdefault((m, t), np.zeros((4, sizes[m])))
                    for i, v in enumerate((w, w * y, w * y * y, w > 0)):
                        own[i] += np.bincount(ids, weights=v, minlength=sizes[m])
        for (m, t), v in total.items():
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "tree": pa.array([t], pa.int32()), "first": pa.array([first], pa.int64()), "sums": pa.array([v.tobytes()], pa.binary())})
    return summed


def _grown_of_sums(p: ForestParams, sets) -> Callable:
    def grown(key: tuple, t: pa.Table) -> pa.Table:
        m, tree = key[0].as_py(), key[1].as_py()
        w, wy, squares, n = sum(np.frombuffer(v) for v in t.sort_by("first")["sums"].to_pylist()).reshape(4, -1)
        made = grow(sets.value[m].x, (wy / np.maximum(w, 1))[:, None], w, p, m, tree, rows_of=n, squares=squares[:, None])
        return pa.table({"model": pa.array([m], pa.int32()), "tree": pa.array([tree], pa.int32()), "blob": [pickle.dumps(made)]})
    return grown


def _of_sums(train: DataFrame, sets: dict[int, _Sets], folder: str, p: ForestParams, tasks: int, n_rows: int) -> DataFrame:
    """(model, tree, blob) of all views in ``sets``; a pass adds up as many trees as SUM_BYTES hold."""
    spark, sizes = train.sparkSession, {m: len(s.x) for m, s in sets.items()}
    train.select("model", "x", "y").mapInArrow(_drawn_rows(sets), _DRAWN).write.parquet(f"{folder}/drawn")
    # a task's sums are as large for few rows as for many: no more of them than run at once
    blocks = spark.read.schema(_DRAWN).parquet(f"{folder}/drawn").coalesce(min(spark.sparkContext.defaultParallelism, -(-n_rows // SUM_ROWS)))
    carried = spark.sparkContext.broadcast(sets)
    each = max(1, SUM_BYTES // (32 * sum(sizes.values())))
    for k in range(0, p.trees, each):
        parts = blocks.mapInArrow(_summed(p, list(range(k, min(k + each, p.trees))), sizes), _SUMS)
        grown = parts.repartition(tasks, "model", "tree").groupBy("model", "tree").applyInArrow(_grown_of_sums(p, carried), _TREES)
        grown.write.parquet(f"{folder}/of_sums/{k}")
    return spark.read.schema(_TREES).parquet(*[f"{folder}/of_sums/{k}" for k in range(0, p.trees, each)])


def _by_features(models: dict[int, "ForestModel"], held: DataFrame, folder: str) -> DataFrame | None:
    """Held-out predictions (model, key, y, prediction) through the different rows of ``held``; None if they are many."""
    seen = held.select("model", "x").distinct()
    seen.write.parquet(f"{folder}/seen")
    seen = held.sparkSession.read.schema(seen.schema).parquet(f"{folder}/seen")
    if seen.count() > CELLS_MOST:
        return None
    parts = [models[m].transform(seen.where(F.col("model") == m).withColumn("features", array_to_vector("x"))).select("model", "x", "prediction") for m in models]
    boost._union(parts).write.parquet(f"{folder}/predicted")
    known = held.sparkSession.read.parquet(f"{folder}/predicted")
    return held.join(F.broadcast(known), ["model", "x"]).select("model", "key", "y", "prediction")


# large views: histograms first --------------------------------------------------------------------

class _Weighted(boost._Pass):
    """Sums for forests: an output is a tree, its rows are weighted by their draws."""
    params: ForestParams
    classes: int

    def columns(self, r: dict, outputs: list[int]) -> dict[int, list[np.ndarray]]:
        goal, number = _goal(r["y"], self.classes), r["number"] + np.arange(r["n"])
        out = {}
        for t in outputs:
            w = weights(number, r["model"], t, self.params.seed)
            out[t] = [*(-w[:, None] * goal).T, w, (w > 0).astype(np.float64)]
        return out


class _Tops(boost.Booster):
    """Upper parts of all trees: nodes of more than ``small`` drawn rows are split by histograms."""

    def __init__(self, blocks, cut, p: ForestParams, classes: int, small: int, tasks: int, driver_bytes: int):
        rule = SplitRule("newton", l2=0.0, scale=1.0, min_gain=1e-12, min_hessian=0.0, min_rows=p.min_leaf)
        params = boost.BoostParams(1, 1.0, p.depth, rule=rule)
        super().__init__(blocks, cut, "regression", p.trees, params, {}, tasks, driver_bytes)
        self.forest, self.classes, self.small, self.sums = p, classes, small, (classes or 1) + 2

    def _state(self, recent, growing=None, wanted=None):
        s = _Weighted(**vars(super()._state(recent, growing, wanted)))
        s.params, s.classes = self.forest, self.classes
        return s

    def _allowed(self, k: tuple[int, int], t: boost.Growing, nodes: list[int]) -> np.ndarray:
        p = len(self.cut[k[0]])
        return allowed(np.array([self.path(t, i) for i in nodes], np.uint64), p, self.forest.width(p), k[0], k[1], self.forest.seed)

    @staticmethod
    def path(t: boost.Growing, i: int) -> int:
        way = []
        while i:
            way.append(int(t.right[t.parent[i]] == i))
            i = t.parent[i]
        at = np.array([1], np.uint64)
        for side in reversed(way):
            at = child_path(at, side)
        return int(at[0])

    def _open(self, t, i):
        return super()._open(t, i) and t.sums[i][-1] > self.small

    def grown(self) -> dict[tuple[int, int], boost.Growing]:
        return self._round({m: [] for m in self.cut})


_CHUNK = "model int, tree int, node int, number long, n int, y binary, x binary, w binary"


def _dealt(p: ForestParams, arrays: dict, last: dict) -> Callable:
    """Every block's rows by the leaf of the upper tree that they fall into, for each tree that draws them."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["held"]:
                    continue
                bins = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], -1)
                x, y = np.frombuffer(r["x"], np.float32).reshape(r["n"], -1), np.frombuffer(r["y"])
                number = r["number"] + np.arange(r["n"])
                for (m, tree), a in arrays.items():
                    if m != r["model"]:
                        continue
                    w = weights(number, m, tree, p.seed)
                    leaf = boost._route(bins, *a, last[m])
                    nodes = np.unique(leaf[w > 0])
                    parts = [np.flatnonzero((leaf == i) & (w > 0)) for i in nodes]
                    yield pa.record_batch({"model": pa.array([m] * len(nodes), pa.int32()), "tree": pa.array([tree] * len(nodes), pa.int32()),
                                           "node": pa.array(nodes, pa.int32()), "number": pa.array([r["number"]] * len(nodes), pa.int64()),
                                           "n": pa.array([len(q) for q in parts], pa.int32()), "y": pa.array([y[q].tobytes() for q in parts], pa.binary()),
                                           "x": pa.array([x[q].tobytes() for q in parts], pa.binary()), "w": pa.array([w[q].tobytes() for q in parts], pa.binary())})
    return dealt


def _ended(p: ForestParams, classes: int, places: dict[tuple[int, int, int], tuple[int, int]]) -> Callable:
    def ended(key: tuple, t: pa.Table) -> pa.Table:
        m, tree, node = (k.as_py() for k in key)
        rows = t.sort_by("number").to_pylist()
        x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(r["n"], -1) for r in rows])
        y, w = (np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("y", "w"))
        path, depth = places[m, tree, node]
        return pa.table({"model": pa.array([m], pa.int32()), "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "blob": [pickle.dumps(grow(x, _goal(y, classes), w, p, m, tree, path, depth))]})
    return ended


def _whole(tops: dict[tuple[int, int], tuple[Tree, dict[int, int]]]) -> Callable:
    def whole(key: tuple, t: pa.Table) -> pa.Table:
        k = (key[0].as_py(), key[1].as_py())
        top, at = tops[k]
        parts = {at[r["node"]]: pickle.loads(r["blob"]) for r in t.to_pylist()}
        return pa.table({"model": pa.array([k[0]], pa.int32()), "tree": pa.array([k[1]], pa.int32()), "blob": [pickle.dumps(joined(top, parts))]})
    return whole


def _large(blocks: DataFrame, cut: dict, p: ForestParams, classes: int, small: int, tasks: int, driver_bytes: int) -> DataFrame:
    """(model, tree, blob) of the views in ``cut``, by both phases."""
    tops = _Tops(blocks.drop("x", "keys").where(F.col("model").isin(list(cut))), cut, p, classes, small, tasks, driver_bytes)
    grown = tops.grown()
    places, upper = {}, {}
    for k, t in grown.items():
        inside = [0]
        for i in inside:
            if t.accepted[i]:
                inside += [t.left[i], t.right[i]]
            else:
                places[(*k, i)] = (tops.path(t, i), t.depth[i])
                t.feature[i] = -1
        tree, _ = t.finished(cut[k[0]], tops.params.rule, 1.0)
        upper[k] = (tree, {i: j for j, i in enumerate(inside)})
    arrays = {k: t.arrays() for k, t in grown.items()}
    chunks = blocks.where(F.col("model").isin(list(cut))).mapInArrow(_dealt(p, arrays, tops.last), _CHUNK)
    ends = chunks.groupBy("model", "tree", "node").applyInArrow(_ended(p, classes, places), "model int, tree int, node int, blob binary")
    return ends.groupBy("model", "tree").applyInArrow(_whole(upper), "model int, tree int, blob binary")


# training -----------------------------------------------------------------------------------------

def fit_views(views: list[tuple[int, DataFrame, DataFrame | None]], task: str, n_classes: int, p: ForestParams, keep: bool = True,
              small_rows: int = SMALL_ROWS, driver_bytes: int = boost.DRIVER_BYTES) -> tuple[dict[int, "ForestModel"], DataFrame | None]:
    """A forest for every (model, training rows, held-out rows), and the held-out predictions (model, key, y, prediction).

    ``keep=False`` does not store the trees of views that need no first phase.
    """
    spark, classes = views[0][1].sparkSession, max(n_classes, 2) if task == "classification" else 0

    def rows(m: int, df: DataFrame, held: bool) -> DataFrame:
        key = F.col("__key").cast("string") if held else F.lit(None).cast("string")
        return df.select(F.lit(m).cast("int").alias("model"), F.lit(held).alias("held"), key.alias("key"),
                         F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"))

    sizes = {m: t.count() for m, t, _ in views}
    if not all(sizes.values()):
        raise ValueError("a model has no training rows")
    weighted = any(WEIGHT in t.columns for _, t, _ in views)
    # rows that stand for several are drawn as sets, however few they are
    large = [(m, t) for m, t, _ in views if sizes[m] > small_rows or weighted]
    # classes: rows of equal features and label are drawn and split as sets; these fit a task if they are few
    few, of_sets, width = None, [], None
    if large and classes and (few := merged(boost._union([t.select(F.lit(m).cast("int").alias("model"), F.col("label").cast("double").alias("y"),
                                                                  vector_to_array("features").alias("x"), weight(t).alias("w")) for m, t in large]), True, weighted)) is not None:
        of_sets = [r["model"] for r in few.groupBy("model").count().collect() if r["count"] <= small_rows]
        large = [(m, t) for m, t in large if m not in of_sets]
    if weighted and large:
        raise ValueError("weighted rows of a forest must make few sets of equal rows and labels")
    # a regression: sums over sets of equal features
    sets = _sets_of_features(boost._union([rows(m, t, False) for m, t in large]), SET_VALUES, small_rows) if large and not classes else None
    in_sets = large if sets else []
    large = [] if sets else large
    cut = boost.bin_cuts(boost._union([rows(m, t, False) for m, t in large]), boost.MAX_BINS) if large else {}
    folder = f"{checkpoint_dir(spark).rstrip('/')}/strata-forest-{uuid.uuid4().hex}"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grown = []
    if of_sets:
        whole, width = _of_sets(few.where(F.col("model").isin(of_sets)), folder, p, classes, len(of_sets), tasks)
        whole.write.parquet(f"{folder}/of_sets")
        grown.append(_only_trees(spark.read.schema(_TREES).parquet(f"{folder}/of_sets")))
    if few is not None:
        few.unpersist()
    if sets:
        grown.append(_only_trees(_of_sums(boost._union([rows(m, t, False) for m, t in in_sets]), sets, folder, p, tasks,
                                           sum(sizes[m] for m, _ in in_sets))))
        width = len(next(iter(sets.values())).values)
        of_sets = [*of_sets, *(m for m, _ in in_sets)]
    small = [m for m, _, _ in views if sizes[m] <= small_rows and not weighted]
    parts = [rows(m, t, False) for m, t, _ in views if m not in of_sets] + [rows(m, h, True) for m, _, h in views if h is not None and m in small]
    if parts:
        boost._union(parts).mapInArrow(_packed(cut), _BLOCK).write.parquet(f"{folder}/blocks")
        blocks = spark.read.parquet(f"{folder}/blocks")
        width = int(blocks.select((F.octet_length("x") / F.col("n") / 4).alias("p")).first()["p"])
    if small:
        each = max(1, -(-p.trees * len(small) // (3 * tasks)))
        groups = [list(range(k, min(k + each, p.trees))) for k in range(0, p.trees, each)]
        units = blocks.where(~F.col("model").isin(list(cut))) if cut else blocks
        units = units.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(groups) - 1).cast("long"))))
        n = len(small) * len(groups)
        units = units.select("model", "unit", "number", "n", "held", "keys", "y", "x").repartition(n, "model", "unit")
        units.groupBy("model", "unit").applyInArrow(_grown(p, classes, groups, keep), _GROWN).write.parquet(f"{folder}/small")
        grown.append(spark.read.schema(_GROWN).parquet(f"{folder}/small"))
    if large:
        whole = _large(blocks, cut, p, classes, small_rows, tasks, driver_bytes)
        _only_trees(whole).write.parquet(f"{folder}/large")
        grown.append(spark.read.schema(_GROWN).parquet(f"{folder}/large"))
    found = boost._union(grown)
    trees = found.where("blob is not null").select("model", "tree", "blob")
    models = {m: ForestModel(task, classes, p.trees, width, trees.where(F.col("model") == m)) for m, _, _ in views}
    if all(h is None for _, _, h in views):
        return models, None
    k = classes or 1
    votes = found.where("key is not null").groupBy("model", "key").agg(F.first("y").alias("y"), *[F.sum(F.col("votes")[c]).alias(f"v{c}") for c in range(k)])
    held = [votes.select("model", "key", "y", _decided(F.array(*[F.col(f"v{c}") / p.trees for c in range(k)]), classes).alias("prediction"))] if small else []
    by_features = [m for m, _, h in views if h is not None and sets and m in sets]
    if by_features and (known := _by_features({m: models[m] for m in by_features}, boost._union([rows(m, h, True) for m, _, h in views if m in by_features]), folder)) is not None:
        held.append(known)
    else:
        by_features = []
    held += [models[m].transform(h).select(F.lit(m).alias("model"), F.col("__key").alias("key"), F.col("label").cast("double").alias("y"), "prediction")
             for m, _, h in views if h is not None and m not in small and m not in by_features]
    return models, boost._union(held)


def _only_trees(trees: DataFrame) -> DataFrame:
    return trees.select("model", "tree", "blob", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("y"),
                        F.lit(None).cast("array<double>").alias("votes"))


def _decided(mean: F.Column, classes: int) -> F.Column:
    return (F.array_position(mean, F.array_max(mean)) - 1).cast("double") if classes else mean[0]


class Forest(Estimator):
    """A forest over a single table; many folds at once go through ``fit_views``."""

    def __init__(self, params: ForestParams, task: str, n_classes: int = 2):
        super().__init__()
        self.forest, self.task, self.n_classes = params, task, n_classes

    def _fit(self, df: DataFrame) -> "ForestModel":
        return fit_views([(0, df, None)], self.task, self.n_classes, self.forest)[0][0]


class ForestModel(Model, Saved):
    """Trees as a table; scoring carries PASS_BYTES of them at a time through the rows."""

    def __init__(self, task: str, classes: int, n_trees: int, width: int, trees: DataFrame):
        super().__init__()
        self.task, self.classes, self.n_trees, self.width, self.trees = task, classes, n_trees, width, trees

    def parts(self):
        return (self.task, self.classes, self.n_trees, self.width), {"trees": self.trees}, []

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(*state, tables["trees"])

    def chunks(self) -> Iterator[list[Tree]]:
        """The trees, some at a time."""
        held, size = [], 0
        for r in self.trees.select("tree", "blob").orderBy("tree").toLocalIterator():
            held.append(pickle.loads(r["blob"]))
            size += len(r["blob"])
            if size > PASS_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def _transform(self, df: DataFrame) -> DataFrame:
        k, out = self.classes or 1, df.withColumn("__votes", F.array(*[F.lit(0.0)] * (self.classes or 1)))
        sc = df.sparkSession.sparkContext
        for trees in self.chunks():
            carried = sc.broadcast(trees)

            out = out.withColumn("__more", _votes(carried)(vector_to_array("features"))).withColumn(
                "__votes", F.zip_with("__votes", "__more", lambda a, b: a + b)).drop("__more")
        mean = F.transform("__votes", lambda v: v / self.n_trees)
        out = out.withColumn("__mean", mean).withColumn("prediction", _decided(F.col("__mean"), self.classes))
        if self.classes:
            out = out.withColumn("probability", array_to_vector("__mean"))
        return out.drop("__votes", "__mean")

    @property
    def featureImportances(self) -> np.ndarray:
        total = np.zeros(self.width)
        for ts in self.chunks():
            for t in ts:
                one = t.importance(self.width)
                total += one / one.sum() if one.sum() > 0 else one
        return total / total.sum() if total.sum() > 0 else total


def _votes(carried):
    """Sum of the carried trees' outputs for every row."""
    def votes(x: pa.Array) -> pa.Array:
        v = boost._values(x).astype(np.float32)
        return pa.array(list(sum(t.predict(v) for t in carried.value)), pa.list_(pa.float64()))
    return F.arrow_udf(votes, "array<double>")
