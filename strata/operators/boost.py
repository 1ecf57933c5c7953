"""Gradient boosting on histograms, all folds in the same passes (survey G3, G8, G9, G14, G17, G18).

The rows of every fold's view (the features as that fold's stages make them)
are binned once by quantiles of its training rows and packed into blocks, a
table in the shared folder.  Each pass is one job over the blocks of all folds: a
task replays the trees since the last refresh of the margins, routes its rows
through the trees under construction and adds gradients, Hessians and row
counts into one histogram for every open node; of two siblings only the
smaller is counted, the other is the parent's histogram minus it.  Partial
histograms are as large as (open nodes x bins), whatever the rows; when those
of all tasks exceed DRIVER_BYTES they are added up, and the best splits
found, by a shuffle over (tree, node) instead.

Depth-wise trees (second-order gains, a learned side for missing values) and
leaf-wise trees share the passes.  The latter grow best-first: a pass opens
the children of as many leaves as can still be split, in order of their gain,
before it is known which will be, so a tree takes about as many passes as it
is deep and is the same as one grown leaf by leaf.

Rows of equal features (for classes: and label) are one weighted row when that
leaves far fewer (``cells``): they fall into the same leaf of every tree.

A view of at most INSIDE_BYTES of blocks (checked) needs no passes over the
cluster: the same rounds run inside a task, the folds side by side.

A block's margins are written again every REFRESH rounds; between, they follow
from the blocks and the trees in the closure, so a lost executor costs its
tasks only.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.cells import merged, weight
from strata.operators.persist import Saved
from strata.operators.trees import Split, SplitRule, Tree, best_splits
from strata.session import checkpoint_dir

#: Rows of a block, bins of a feature, points of a partition's quantile summary.
BLOCK_ROWS, MAX_BINS, SUMMARY = 8_192, 255, 2_048
#: Rounds between two refreshes of the margins.
REFRESH = 10
#: Partial histograms that may meet in the driver at once.
DRIVER_BYTES = 64 << 20
#: Bytes of blocks in one task, about, and of a view whose rounds run inside one.
TASK_BYTES, INSIDE_BYTES = 64 << 20, 16 << 20


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    rate: float = 0.1
    depth: int = 6              # 0: no limit
    leaves: int = 0             # 0: depth-wise
    bins: int = MAX_BINS
    rule: SplitRule = field(default_factory=SplitRule)
    hessian: str = "softmax"    # of several classes: factor of p (1 - p)


def depth_wise(p: dict) -> BoostParams:
    """Second-order boosting: L2 penalty 1, Hessian sum of a child at least 1."""
    return BoostParams(p["n_estimators"], p["learning_rate"], p["max_depth"], hessian="double")


def leaf_wise(p: dict) -> BoostParams:
    """Best-first boosting of at most ``num_leaves`` leaves, 20 rows in a leaf at least."""
    rule = SplitRule(l2=0.0, scale=1.0, min_gain=1e-12, min_hessian=1e-3, min_rows=20)
    return BoostParams(p["n_estimators"], p["learning_rate"], max(p["max_depth"], 0), p["num_leaves"], rule=rule, hessian="share")


def first_order(p: dict) -> BoostParams:
    """Boosting of trees that split by the difference of gradient means, Newton steps in the leaves."""
    rule = SplitRule("friedman", l2=0.0, min_gain=1e-12, min_hessian=0.0)
    return BoostParams(p["n_estimators"], p["learning_rate"], p["max_depth"], rule=rule, hessian="newton")


# quantile bins ------------------------------------------------------------------------------------

def _values(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _summary(v: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` values with weights that stand for the weighted values ``v``; exact while there are so few distinct ones."""
    values, at = np.unique(v, return_inverse=True)
    w = np.bincount(at, weights=weight, minlength=len(values))
    if len(values) <= size:
        return values, w
    cell = np.minimum(((np.cumsum(w) - w / 2) * (size / w.sum())).astype(np.int64), size - 1)
    last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
    return values[last], np.add.reduceat(w, np.append(0, last[:-1] + 1))


def cuts(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Ascending thresholds between bins: midpoints of neighbouring values, or of those next to the quantiles."""
    if len(values) < 2:
        return np.zeros(0)
    mid = (values[:-1] + values[1:]) / 2
    mid = np.where(mid < values[1:], mid, values[:-1])
    if len(values) <= bins:
        return mid
    rank = np.cumsum(weight)
    want = np.searchsorted(rank, rank[-1] * np.arange(1, bins) / bins, "left")
    return mid[np.unique(np.minimum(want, len(mid) - 1))]


_SUMMARY = "model int, feature int, value array<double>, weight array<double>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        model = b.column("model").to_numpy()
        x = _values(b.column("x"))
        weight = b.column("w").to_numpy() if "w" in b.schema.names else np.ones(len(x))
        for m in np.unique(model):
            for f in range(x.shape[1]):
                v, w = x[model == m, f], weight[model == m]
                v, w = v[~np.isnan(v)], w[~np.isnan(v)]
                old = held.get((int(m), f), (np.zeros(0), np.zeros(0)))
                held[int(m), f] = _summary(np.concatenate([old[0], v]), np.concatenate([old[1], w]), SUMMARY)
    if held:
        keys = list(held)
        yield pa.record_batch({"model": pa.array([k[0] for k in keys], pa.int32()), "feature": pa.array([k[1] for k in keys], pa.int32()),
                               "value": pa.array([held[k][0] for k in keys], pa.list_(pa.float64())),
                               "weight": pa.array([held[k][1] for k in keys], pa.list_(pa.float64()))})


def _merge(bins: int) -> Callable:
    def merge(key: tuple, t: pa.Table) -> pa.Table:
        v, w = np.concatenate([np.zeros(0), *[np.asarray(x) for x in t["value"].to_pylist()]]), np.concatenate([np.zeros(0), *[np.asarray(x) for x in t["weight"].to_pylist()]])
        out = cuts(*_summary(v, w, max(len(v), 1)), bins)
        return pa.table({"model": [key[0].as_py()], "feature": [key[1].as_py()], "cuts": pa.array([out], pa.list_(pa.float64()))},
                        pa.schema([("model", pa.int32()), ("feature", pa.int32()), ("cuts", pa.list_(pa.float64()))]))
    return merge


def bin_cuts(train: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """Thresholds of every (model, feature): at most ``bins`` numbers each reach the driver."""
    got = train.select("model", "x", *[c for c in train.columns if c == "w"]).mapInArrow(_summaries, _SUMMARY).groupBy("model", "feature").applyInArrow(
        _merge(bins), "model int, feature int, cuts array<double>").collect()
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in got:
        out.setdefault(r["model"], {})[r["feature"]] = np.asarray(r["cuts"])
    return {m: [fs[f] for f in sorted(fs)] for m, fs in out.items()}


# blocks -------------------------------------------------------------------------------------------

_BLOCK = "model int, block long, n int, held boolean, keys array<string>, y binary, w binary, bins binary, margin binary"


def binned(x: np.ndarray, cut: list[np.ndarray]) -> np.ndarray:
    """Bin of every value; a missing one gets the number past the last bin."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cut):
        out[:, f] = np.where(np.isnan(x[:, f]), len(c) + 1, np.searchsorted(c, x[:, f], "left"))
    return out


def _packed(cut: dict[int, list[np.ndarray]], outputs: int) -> Callable:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for b in batches:
            model, held = b.column("model").to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            x, y, w, key = _values(b.column("x")), b.column("y").to_numpy(), b.column("w").to_numpy(), b.column("key")
            for m in np.unique(model):
                for side in (False, True):
                    rows = np.flatnonzero((model == m) & (held == side))
                    for k in range(0, len(rows), BLOCK_ROWS):
                        at = rows[k:k + BLOCK_ROWS]
                        yield pa.record_batch([
                            pa.array([m], pa.int32()), pa.array([next(number)], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([side]),
                            pa.array([key.take(pa.array(at)).to_pylist() if side else []], pa.list_(pa.string())),
                            pa.array([y[at].astype(np.float64).tobytes()]), pa.array([w[at].astype(np.float64).tobytes()]),
                            pa.array([binned(x[at], cut[int(m)]).tobytes()]),
                            pa.array([np.zeros((len(at), outputs)).tobytes()])], names=["model", "block", "n", "held", "keys", "y", "w", "bins", "margin"])
    return packed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for r in b.to_pylist():
            r["y"] = np.frombuffer(r["y"])
            r["w"] = np.frombuffer(r["w"]) if "w" in r else np.ones(r["n"])
            r["bins"] = np.frombuffer(r["bins"], np.uint8).reshape(r["n"], -1)
            r["margin"] = np.frombuffer(r["margin"]).reshape(r["n"], -1)
            yield r


# trees under construction -------------------------------------------------------------------------

class Growing:
    """One tree over bins while it grows; splits may be tried before they are accepted."""

    def __init__(self) -> None:
        self.feature, self.bin, self.missing, self.left, self.right, self.parent = [-1], [0], [False], [-1], [-1], [-1]
        self.sums, self.depth, self.split, self.known, self.accepted = [None], [0], [None], [False], [False]

    def children(self, i: int) -> tuple[int, int]:
        """Nodes of the best split of node i, made on first use."""
        if self.left[i] < 0:
            s: Split = self.split[i]
            for sums in (s.left, s.right):
                for column, v in ((self.feature, -1), (self.bin, 0), (self.missing, False), (self.left, -1), (self.right, -1), (self.parent, i), (self.sums, sums),
                                  (self.depth, self.depth[i] + 1), (self.split, None), (self.known, False), (self.accepted, False)):
                    column.append(v)
            n = len(self.feature)
            self.feature[i], self.bin[i], self.missing[i], self.left[i], self.right[i] = s.feature, s.bin, s.missing_left, n - 2, n - 1
        return self.left[i], self.right[i]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.feature, self.bin, self.missing, self.left, self.right))

    def finished(self, cut: list[np.ndarray], rule: SplitRule, rate: float) -> tuple[Tree, tuple]:
        """The tree of accepted splits over values, and the same over bins."""
        order, at = [0], {0: 0}
        for i in order:
            if self.accepted[i]:
                for c in (self.left[i], self.right[i]):
                    at[c] = len(order)
                    order.append(c)
        inner = np.array([self.accepted[i] for i in order])
        feature = np.array([self.feature[i] if self.accepted[i] else -1 for i in order])
        bins = np.array([self.bin[i] for i in order])
        left = np.array([at[self.left[i]] if self.accepted[i] else -1 for i in order])
        right = np.array([at[self.right[i]] if self.accepted[i] else -1 for i in order])
        missing = np.array([bool(self.missing[i]) for i in order])
        sums = np.array([self.sums[i] for i in order])
        value = rate * rule.leaf(sums)
        threshold = np.array([np.nan if not k else cut[f][b] if b < len(cut[f]) else np.inf for f, b, k in zip(feature, bins, inner)])
        gain = np.array([self.split[i].gain if self.accepted[i] else 0.0 for i in order])
        return (Tree(feature, threshold, missing, left, right, value, sums[:, -1], gain),
                (feature, bins, missing, left, right, value[:, 0]))


def _route(bins: np.ndarray, feature, cut, missing, left, right, last: np.ndarray) -> np.ndarray:
    """Leaf of every row; ``last`` is each feature's bin of missing values."""
    node = np.zeros(len(bins), np.int64)
    if feature[0] < 0:
        return node
    # a leaf leads to itself, so every row takes as many steps as the tree is deep
    own = np.arange(len(feature))
    inner = feature >= 0
    f, child = np.where(inner, feature, 0), np.stack([np.where(inner, right, own), np.where(inner, left, own)], 1).ravel()
    flat, row, level = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.array([0])
    none = (bins == last).any()
    while len(level := np.concatenate([left[level[inner[level]]], right[level[inner[level]]]])):
        at = f[node]
        v = flat[row + at]
        go = v <= cut[node]
        if none:
            go = np.where(v == last[at], missing[node], go)
        node = child[2 * node + go]
    return node


def gradients(margin: np.ndarray, y: np.ndarray, task: str, hessian: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, (rows, outputs) each."""
    if task == "regression":
        return margin - y[:, None], np.ones_like(margin)
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p, k = e / e.sum(axis=1, keepdims=True), margin.shape[1]
    hit = y[:, None] == np.arange(k)
    factor = {"double": 2.0, "share": k / (k - 1), "newton": k / (k - 1), "softmax": 1.0}[hessian]
    return p - hit, np.maximum(factor * p * (1 - p), 1e-16)


# passes -------------------------------------------------------------------------------------------

@dataclass
class _Pass:
    """What a task needs to know: shapes, the trees since the refresh, and the open nodes."""
    task: str
    hessian: str
    last: dict[int, np.ndarray]                      # model -> bin of missing values per feature
    offsets: dict[int, np.ndarray]                   # model -> first histogram cell per feature
    recent: dict[int, list[list[tuple]]]             # model -> rounds -> one tree per output
    growing: dict[tuple[int, int], tuple]            # (model, output) -> arrays of the tree
    wanted: dict[tuple[int, int], np.ndarray]        # (model, output) -> nodes to count

    def columns(self, r: dict, outputs: list[int]) -> dict[int, list[np.ndarray]]:
        """What is added up for every output: gradient, Hessian, rows."""
        g, h = gradients(self.margins(r), r["y"], self.task, self.hessian)
        w = r["w"]
        return {c: [g[:, c] * w, h[:, c] * w, w] for c in outputs}

    def margins(self, r: dict) -> np.ndarray:
        m, out = r["model"], r["margin"].copy()
        for trees in self.recent.get(m, []):
            for c, t in enumerate(trees):
                out[:, c] += t[5][_route(r["bins"], *t[:5], self.last[m])]
        return out


def _counted(p: _Pass, spread: bool) -> Callable:
    """Partial histograms of a task: one row a tree, or one a (tree, node) when they are to be shuffled."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        first = None
        for r in _blocks(batches):
            m = r["model"]
            mine = [c for (k, c), w in p.wanted.items() if k == m and len(w)]
            if r["held"] or not mine:
                continue
            first = r["block"] if first is None else min(first, r["block"])
            columns = p.columns(r, mine)
            size = int(p.offsets[m][-1])
            for c in mine:
                nodes = p.wanted[m, c]
                leaf = _route(r["bins"], *p.growing[m, c], p.last[m])
                slot = np.full(len(p.growing[m, c][0]), -1)
                slot[nodes] = np.arange(len(nodes))
                rows = np.flatnonzero(slot[leaf] >= 0)
                at = (slot[leaf[rows]][:, None] * size + p.offsets[m][:-1] + r["bins"][rows]).ravel()
                width, n = r["bins"].shape[1], len(nodes) * size
                sums = np.stack([np.bincount(at, weights=np.repeat(v[rows], width), minlength=n) for v in columns[c]], axis=-1)
                total[m, c] = total[m, c] + sums if (m, c) in total else sums
        keys, nodes, values = [], [], []
        for k, v in total.items():
            parts = v.reshape(len(p.wanted[k]), -1, v.shape[-1]) if spread else [v]
            for i, x in enumerate(parts):
                keys.append(k)
                nodes.append(int(p.wanted[k][i]) if spread else -1)
                values.append(x.tobytes())
        if keys:
            yield pa.record_batch({"model": pa.array([k[0] for k in keys], pa.int32()), "output": pa.array([k[1] for k in keys], pa.int32()),
                                   "node": pa.array(nodes, pa.int32()), "first": pa.array([first] * len(keys), pa.int64()), "sums": pa.array(values, pa.binary())})
    return counted


_PART = "model int, output int, node int, first long, sums binary"
_SPLIT = "model int, output int, node int, total array<double>, gain double, feature int, bin int, missing_left boolean, left array<double>"


def _added(offsets: dict[int, np.ndarray], rule: SplitRule, may: dict) -> Callable:
    def added(key: tuple, t: pa.Table) -> pa.Table:
        m = key[0].as_py()
        hist = sum(np.frombuffer(s).reshape(1, int(offsets[m][-1]), -1) for s in t.sort_by("first")["sums"].to_pylist())
        allowed = may.get((m, key[1].as_py(), key[2].as_py()))
        s = best_splits(hist, offsets[m], rule, None if allowed is None else allowed[None])[0]
        total = hist[0, offsets[m][0]:offsets[m][1]].sum(axis=0)
        return pa.table({"model": [m], "output": [key[1].as_py()], "node": [key[2].as_py()], "total": [total.tolist()], "gain": [s and s.gain],
                         "feature": [s and s.feature], "bin": [s and s.bin], "missing_left": [s and s.missing_left], "left": [s and s.left.tolist()]},
                        pa.schema([("model", pa.int32()), ("output", pa.int32()), ("node", pa.int32()), ("total", pa.list_(pa.float64())), ("gain", pa.float64()),
                                   ("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("left", pa.list_(pa.float64()))]))
    return added


class Booster:
    """The rounds of all models; ``fit`` returns {model: (base margins, rounds of trees)}."""

    refresh = REFRESH

    def __init__(self, blocks, cut: dict[int, list[np.ndarray]], task: str, outputs: int, params: BoostParams,
                 base: dict[int, np.ndarray], tasks: int, driver_bytes: int = DRIVER_BYTES):
        self.blocks, self.cut, self.task, self.outputs, self.params, self.base = blocks, cut, task, outputs, params, base
        self.tasks, self.driver_bytes = tasks, driver_bytes
        self.last = {m: np.array([len(c) + 1 for c in cs]) for m, cs in cut.items()}
        self.offsets = {m: np.concatenate([[0], np.cumsum(v + 1)]) for m, v in self.last.items()}
        self.passes, self.sums = 0, 3

    def _state(self, recent, growing=None, wanted=None) -> _Pass:
        return _Pass(self.task, self.params.hessian, self.last, self.offsets, recent,
                     {k: t.arrays() for k, t in (growing or {}).items()}, wanted or {})

    def _measure(self, recent, trees: dict, wave: dict[tuple[int, int], list[int]], hist: dict) -> None:
        """Histograms and best splits of the nodes in ``wave``."""
        self.passes += 1
        rule = self.params.rule
        counted, derived = {}, {}
        for k, nodes in wave.items():
            t, open_ = trees[k], set(nodes)
            own, pair = [], []
            for i in nodes:
                parent = t.parent[i]
                if (k, parent) in hist:
                    a, b = t.left[parent], t.right[parent]
                    small, large = (a, b) if t.sums[a][-1] <= t.sums[b][-1] else (b, a)
                    if i == large and small in open_:
                        pair.append((large, small, parent))
                        continue
                own.append(i)
            counted[k], derived[k] = np.array(own), pair
        cells = sum(len(v) * int(self.offsets[m][-1]) for (m, _), v in counted.items())
        if cells * 8 * self.sums * self.tasks > self.driver_bytes:
            self._measure_spread(recent, trees, {k: np.array(v) for k, v in wave.items()})
            return
        parts = self._partials(_counted(self._state(recent, trees, counted), False))
        total = {}
        for r in sorted(parts, key=lambda r: r["first"]):
            k = (r["model"], r["output"])
            v = np.frombuffer(r["sums"]).reshape(len(counted[k]), int(self.offsets[k[0]][-1]), -1)
            total[k] = total[k] + v if k in total else v
        for k, nodes in wave.items():
            t, m = trees[k], k[0]
            if k not in total:
                total[k] = np.zeros((len(counted[k]), int(self.offsets[m][-1]), self.sums))
            got = dict(zip(counted[k].tolist(), total[k]))
            for large, small, parent in derived[k]:
                got[large] = hist[k, parent] - got[small]
            for large, small, parent in derived[k]:
                hist.pop((k, parent), None)
            for i, s in zip(nodes, best_splits(np.stack([got[i] for i in nodes]), self.offsets[m], rule, self._allowed(k, t, nodes))):
                hist[k, i] = got[i]
                self._learn(t, i, got[i][self.offsets[m][0]:self.offsets[m][1]].sum(axis=0), s)

    def _partials(self, counted: Callable) -> list:
        """What the tasks of one pass have added up."""
        return self.blocks.mapInArrow(counted, _PART).collect()

    def _measure_spread(self, recent, trees, wanted) -> None:
        part = self.blocks.mapInArrow(_counted(self._state(recent, trees, wanted), True), _PART)
        may = {(*k, int(i)): a for k, nodes in wanted.items() if (each := self._allowed(k, trees[k], nodes.tolist())) is not None for i, a in zip(nodes, each)}
        for r in part.groupBy("model", "output", "node").applyInArrow(_added(self.offsets, self.params.rule, may), _SPLIT).collect():
            total = np.array(r["total"])
            left = None if r["gain"] is None else np.array(r["left"])
            s = None if left is None else Split(r["gain"], r["feature"], r["bin"], r["missing_left"], left, total - left)
            self._learn(trees[r["model"], r["output"]], r["node"], total, s)

    def _learn(self, t: Growing, i: int, total: np.ndarray, s: Split | None) -> None:
        t.known[i], t.split[i] = True, s
        if t.sums[i] is None:
            t.sums[i] = total

    def _allowed(self, k: tuple[int, int], t: Growing, nodes: list[int]) -> np.ndarray | None:
        """Features that each node may split by; None for all."""
        return None

    def _open(self, t: Growing, i: int) -> bool:
        return not self.params.depth or t.depth[i] < self.params.depth

    def _depth_step(self, t: Growing, nodes: list[int]) -> list[int]:
        out = []
        for i in nodes:
            if t.split[i] is not None:
                t.accepted[i] = True
                out += [c for c in t.children(i) if self._open(t, c)]
        return out

    def _leaf_step(self, t: Growing) -> list[int]:
        """Accept splits best-first while what they open is known; nodes that the next pass must measure."""
        while True:
            inside = [0]
            for i in inside:
                if t.accepted[i]:
                    inside += [t.left[i], t.right[i]]
            leaves = [i for i in inside if not t.accepted[i]]
            can = sorted((i for i in leaves if t.split[i] is not None and self._open(t, i)), key=lambda i: (-t.split[i].gain, i))
            left = self.params.leaves - len(leaves)
            if not can or left <= 0:
                return []
            ahead = can[:left]
            missing = [c for i in ahead for c in t.children(i) if not t.known[c] and self._open(t, c)]
            if left > 1 and any(not t.known[c] and self._open(t, c) for c in t.children(can[0])):
                return missing
            t.accepted[can[0]] = True

    def _round(self, recent) -> dict[tuple[int, int], Growing]:
        trees = {(m, c): Growing() for m in self.cut for c in range(self.outputs)}
        hist: dict = {}
        wave = {k: [0] for k in trees}
        while wave:
            self._measure(recent, trees, wave, hist)
            wave = {k: nodes for k, t in trees.items() if k in wave and (nodes := self._leaf_step(t) if self.params.leaves else self._depth_step(t, wave[k]))}
        return trees

    def fit(self, refreshed: Callable[[_Pass], object]) -> dict[int, tuple[np.ndarray, list[list[Tree]]]]:
        recent: dict[int, list[list[tuple]]] = {m: [] for m in self.cut}
        out: dict[int, list[list[Tree]]] = {m: [] for m in self.cut}
        for r in range(self.params.rounds):
            trees = self._round(recent)
            for m in self.cut:
                made = [trees[m, c].finished(self.cut[m], self.params.rule, self.params.rate) for c in range(self.outputs)]
                out[m].append([t for t, _ in made])
                recent[m].append([b for _, b in made])
            if (r + 1) % self.refresh == 0 and r + 1 < self.params.rounds:
                self.blocks = refreshed(self._state(recent))
                recent = {m: [] for m in self.cut}
        return {m: (self.base[m], out[m]) for m in self.cut}


class _Inside(Booster):
    """The same rounds over Arrow batches held by one task; margins are kept up with every round."""
    refresh = 1

    def _partials(self, counted: Callable) -> list:
        return [r for b in counted(iter(self.blocks)) for r in b.to_pylist()]


def _joined(t: pa.Table) -> pa.RecordBatch:
    """The blocks of one model as one."""
    one = lambda c: pa.array([b"".join(t[c].to_pylist())], pa.binary())
    facts = {"model": pa.array([t["model"][0].as_py()], pa.int32()), "block": pa.array([0], pa.int64()), "n": pa.array([sum(t["n"].to_pylist())], pa.int32()),
             "held": pa.array([False]), "keys": pa.array([[]], pa.list_(pa.string()))}
    return pa.record_batch({**facts, **{c: one(c) for c in ("y", "w", "bins", "margin")}})


def _fitted(cut, task: str, outputs: int, params: BoostParams, base) -> Callable:
    def fitted(key: tuple, t: pa.Table) -> pa.Table:
        m = key[0].as_py()
        b = _Inside([_joined(t.sort_by("block"))], {m: cut[m]}, task, outputs, params, {m: base[m]}, 1, 1 << 62)
        _, rounds = b.fit(lambda state: list(_replayed(state)(iter(b.blocks))))[m]
        return pa.table({"model": pa.array([m], pa.int32()), "rounds": [pickle.dumps(rounds)]})
    return fitted


def _replayed(p: _Pass) -> Callable:
    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = [p.margins(r).tobytes() for r in _blocks(iter([b]))]
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin, pa.binary()))
    return replayed


def _started(base: dict[int, np.ndarray]) -> Callable:
    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = [np.tile(base[m], (n, 1)).tobytes() for m, n in zip(b.column("model").to_pylist(), b.column("n").to_pylist())]
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin, pa.binary()))
    return started


def base_margin(counts: dict[float, int], mean: float, task: str, outputs: int) -> np.ndarray:
    """Margin before the first tree: the mean, or the log odds of the training rows (NULL classes count as one row in a million)."""
    if task == "regression":
        return np.array([mean or 0.0])
    n = max(sum(counts.values()), 1)
    share = np.clip([counts.get(float(c), 0) / n for c in range(max(outputs, 2))], 1e-6, 1 - 1e-6)
    return np.array([np.log(share[1] / share[0])]) if outputs == 1 else np.log(share)


def fit_views(views: list[tuple[int, DataFrame, DataFrame | None]], task: str, n_classes: int, params: BoostParams,
              driver_bytes: int = DRIVER_BYTES, task_bytes: int = INSIDE_BYTES) -> tuple[dict[int, "HistBoostModel"], DataFrame | None, Booster | None]:
    """One model for every (model, training rows, held-out rows); rows have ``features``, ``label`` and, if held out, ``__key``.

    Returns the models, the held-out predictions (model, key, y, prediction) and the booster
    of the views that take passes over the cluster, those above ``task_bytes``.
    """
    outputs = 1 if task == "regression" or n_classes <= 2 else n_classes
    spark = views[0][1].sparkSession

    train = _union([t.select(F.lit(m).cast("int").alias("model"), F.lit(False).alias("held"), F.lit(None).cast("string").alias("key"),
                             F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"), weight(t).alias("w")) for m, t, _ in views])
    kept: list[DataFrame] = []
    # a loss's sums over rows of equal features (and class) follow from their number and mean label
    if (few := merged(train, task == "classification")) is not None:
        kept.append(few)
        train = few.select("model", F.lit(False).alias("held"), F.lit(None).cast("string").alias("key"), "y", "x", "w")
    cut = bin_cuts(train, params.bins)
    facts = train.groupBy("model").agg((F.sum(F.col("y") * F.col("w")) / F.sum(F.when(F.col("y").isNotNull(), F.col("w")))).alias("mean"),
                                       F.count(F.lit(1)).alias("n")).collect()
    if len(facts) < len(views) or len(cut) < len(views):
        raise ValueError("a model has no training rows or no features")
    counts: dict[int, dict[float, int]] = {r["model"]: {} for r in facts}
    if task == "classification":
        for r in train.groupBy("model", "y").agg(F.sum("w").alias("w")).collect():
            counts[r["model"]][r["y"]] = r["w"]
    base = {r["model"]: base_margin(counts[r["model"]], r["mean"], task, outputs) for r in facts}
    width = max(len(c) for c in cut.values())
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(r["n"] for r in facts) * (width + 25) // TASK_BYTES))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/strata-boost-{uuid.uuid4().hex}"

    def stored(df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{folder}/{len(kept)}")
        for old in kept:
            old.unpersist()
        now = spark.read.schema(df.schema).parquet(path).coalesce(tasks).persist()
        now.count()
        kept.append(now)
        return now

    packed = train.mapInArrow(_packed(cut, outputs), _BLOCK).mapInArrow(_started(base), _BLOCK)
    size = {r["model"]: r["n"] * (len(cut[r["model"]]) + 16 + 8 * outputs) for r in facts}
    inside, spread = [m for m in cut if size[m] <= task_bytes], [m for m in cut if size[m] > task_bytes]
    rounds: dict[int, list[list[Tree]]] = {}
    booster = None
    if inside:
        # a partition for each model: small ones would be put together and fitted one after the other
        mine = packed.where(F.col("model").isin(inside)).repartitionByRange(len(inside), "model").groupBy("model")
        for r in mine.applyInArrow(_fitted(cut, task, outputs, params, base), "model int, rounds binary").collect():
            rounds[r["model"]] = pickle.loads(r["rounds"])
    if spread:
        booster = Booster(stored(packed.where(F.col("model").isin(spread))), {m: cut[m] for m in spread}, task, outputs, params, base, tasks, driver_bytes)
        rounds |= {m: v for m, (_, v) in booster.fit(lambda state: stored(booster.blocks.mapInArrow(_replayed(state), _BLOCK))).items()}
    for old in kept:
        old.unpersist()
    models = {m: HistBoostModel(task, max(n_classes, 2), base[m], rounds[m], len(cut[m])) for m in cut}
    held = None
    if any(h is not None for _, _, h in views):
        held = _union([models[m].transform(h).select(F.lit(m).alias("model"), F.col("__key").alias("key"), F.col("label").cast("double").alias("y"), "prediction")
                       for m, _, h in views if h is not None])
    return models, held, booster


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# estimators ---------------------------------------------------------------------------------------

class HistBooster(Estimator):
    """Boosting of a single table; many folds at once go through ``fit_views``."""

    def __init__(self, params: BoostParams, task: str, n_classes: int = 2):
        super().__init__()
        self.boost, self.task, self.n_classes = params, task, n_classes

    def _fit(self, df: DataFrame) -> "HistBoostModel":
        return fit_views([(0, df, None)], self.task, self.n_classes, self.boost)[0][0]


class HistBoostModel(Model, Saved):
    """Trees over feature values; adds ``prediction`` and, for classes, ``probability``."""

    def __init__(self, task: str, n_classes: int, base: np.ndarray, rounds: list[list[Tree]], width: int):
        super().__init__()
        self.task, self.n_classes, self.base, self.rounds, self.width = task, n_classes, base, rounds, width

    def parts(self):
        return (self.task, self.n_classes, self.base, self.rounds, self.width), {}, []

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(*state)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for trees in self.rounds:
            for c, t in enumerate(trees):
                out[:, c] += t.predict(x)[:, 0]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        base, rounds = self.base, self.rounds

        @F.arrow_udf("array<double>")
        def margin(x: pa.Array) -> pa.Array:
            v = _values(x)
            out = np.tile(base, (len(x), 1))
            for trees in rounds:
                for c, t in enumerate(trees):
                    out[:, c] += t.predict(v)[:, 0]
            return pa.array(list(out), pa.list_(pa.float64()))

        out = df.withColumn("__margin", margin(vector_to_array("features")))
        at = F.col("__margin")
        if self.task == "regression":
            return out.withColumn("prediction", at[0]).drop("__margin")
        if len(self.base) == 1:
            p = 1 / (1 + F.exp(-at[0]))
            probability = F.array(1 - p, p)
        else:
            e = F.transform(at, lambda v: F.exp(v - F.array_max(at)))
            probability = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("__p", probability)
        return out.withColumn("probability", array_to_vector("__p")).withColumn(
            "prediction", (F.array_position("__p", F.array_max("__p")) - 1).cast("double")).drop("__margin", "__p")

    @property
    def featureImportances(self) -> np.ndarray:
        total = sum((t.importance(self.width) for trees in self.rounds for t in trees), np.zeros(self.width))
        return total / total.sum() if total.sum() > 0 else total
