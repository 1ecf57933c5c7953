"""AdaBoost of all folds in the same passes: SAMME for classes, R2 for a regression (survey G7, G16).

The training rows of every view are binned and packed into blocks once, as for
the boosters.  A level of the weighted trees of one round is one job
over the blocks of all views: a task finds the rows' weights from those written last and
the rounds since, routes its rows and adds their weights up by node, bin and class
(for a regression: weight, weighted label and its square).  The error of a
classification round follows from its tree's leaves; a regression takes one more
job for the largest and the mean loss.  Partial sums are as large as (open nodes x
bins), whatever the rows, and are added up by a shuffle above DRIVER_BYTES.

A node is split at one of at most SPLITS + 1 weighted quantiles of a feature under the
round's weights (at every value where there are fewer), by Gini impurity or variance.
A view of at most INSIDE_BYTES of blocks runs its rounds inside a task.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.boost import (DRIVER_BYTES, INSIDE_BYTES, MAX_BINS, REFRESH, TASK_BYTES, Growing, _BLOCK, _blocks, _joined, _packed, _route,
                                    _union, _values, bin_cuts)
from strata.operators.cells import weight
from strata.operators.persist import Saved
from strata.operators.trees import Split, Tree
from strata.session import checkpoint_dir

#: Thresholds tried of a feature, and the impurity below which a node is pure.
SPLITS, PURE = 31, 2.220446049250313e-16


@dataclass(frozen=True)
class AdaParams:
    rounds: int = 50
    rate: float = 1.0
    depth: int = 1


# weighted trees -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Rule:
    """Sums of a node are the weights by class, or weighted labels and their squares; the weight comes last."""
    classes: int                # 0: regression

    def impurity(self, sums: np.ndarray) -> np.ndarray:
        w = sums[..., -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.classes:
                return 1 - ((sums[..., :-1] / w[..., None]) ** 2).sum(axis=-1)
            return sums[..., 1] / w - (sums[..., 0] / w) ** 2

    def leaf(self, sums: np.ndarray) -> np.ndarray:
        """Class shares, or the mean."""
        return sums[..., :self.classes or 1] / np.maximum(sums[..., -1:], 1e-300)

    def best(self, hist: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> Split | None:
        """Best split of a node over the allowed cells, missing values on the right; of equal gains the first."""
        out, top = None, 0.0
        for f in range(len(offsets) - 1):
            seg = hist[offsets[f]:offsets[f + 1]]
            # either side is added up by itself, so that no rest of a difference stays where nothing is
            left, right = np.cumsum(seg[:-2], axis=0), np.cumsum(seg[::-1], axis=0)[::-1][1:-1]
            if not len(left):
                continue
            total = left[-1] + right[-1]
            gain = self.impurity(total) - (left[:, -1] * self.impurity(left) + right[:, -1] * self.impurity(right)) / total[-1]
            ok = allowed[offsets[f]:offsets[f] + len(left)] & (left[:, -1] > 0) & (right[:, -1] > 0)
            gain = np.where(ok, gain, -np.inf)
            b = int(gain.argmax())
            if gain[b] > top:
                top = gain[b]
                out = Split(float(gain[b] * total[-1]), f, b, False, left[b].copy(), right[b].copy())
        return out


def candidates(weight: np.ndarray, offsets: np.ndarray, splits: int = SPLITS) -> np.ndarray:
    """Cells after which a node may be split: all, or those nearest to equal shares of the feature's weight."""
    out = np.zeros(len(weight), bool)
    for f in range(len(offsets) - 1):
        w = weight[offsets[f]:offsets[f + 1] - 1]
        if len(w) - 1 <= splits:
            out[offsets[f]:offsets[f] + len(w) - 1] = True
            continue
        stride, upto = w.sum() / (splits + 1), w[0]
        target = stride
        for i in range(1, len(w)):
            before, upto = upto, upto + w[i]
            if abs(before - target) < abs(upto - target):
                out[offsets[f] + i - 1] = True
                target += stride
    return out


# passes -------------------------------------------------------------------------------------------

@dataclass
class _State:
    """What a task needs to know: the changes of the weights since they were written, and what to add up."""
    classes: int
    last: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    recent: dict[int, list[tuple]]
    growing: dict[int, tuple] = field(default_factory=dict)
    wanted: dict[int, np.ndarray] = field(default_factory=dict)

    def leaf_values(self, r: dict, arrays: tuple, value: np.ndarray) -> np.ndarray:
        return value[_route(r["bins"], *arrays, self.last[r["model"]])]

    def weights(self, r: dict) -> np.ndarray:
        w = r["margin"][:, 0].copy()
        for arrays, value, how in self.recent.get(r["model"], []):
            got = self.leaf_values(r, arrays, value)
            if self.classes:
                alpha, scale = how
                w *= np.where(got != r["y"], math.exp(alpha), 1.0) * scale
            else:
                largest, beta, rate = how
                w *= beta ** ((1 - np.abs(got - r["y"]) / largest) * rate)
        return w


_PART = "model int, first long, sums binary"


def _part(first: int | None, total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.record_batch({"model": pa.array(list(total), pa.int32()), "first": pa.array([first] * len(total), pa.int64()),
                               "sums": pa.array([np.ascontiguousarray(v).tobytes() for v in total.values()], pa.binary())})


def _counted(s: _State) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        first = None
        for r in _blocks(batches):
            m = r["model"]
            if m not in s.wanted:
                continue
            first = r["block"] if first is None else min(first, r["block"])
            nodes, size, bins, y, w = s.wanted[m], int(s.offsets[m][-1]), r["bins"], r["y"], s.weights(r)
            cell = s.offsets[m][:-1] + bins
            if len(s.growing[m][0]) > 1:
                slot = np.full(len(s.growing[m][0]), -1)
                slot[nodes] = np.arange(len(nodes))
                mine = slot[_route(bins, *s.growing[m], s.last[m])]
                rows = np.flatnonzero(mine >= 0)
                cell, y, w = cell[rows] + mine[rows][:, None] * size, y[rows], w[rows]
            n, width = len(nodes) * size, bins.shape[1]
            if s.classes:
                at = cell * s.classes + y.astype(np.int64)[:, None]
                sums = np.bincount(at.ravel(), weights=np.repeat(w, width), minlength=n * s.classes).reshape(n, -1)
            else:
                at = cell.ravel()
                sums = np.stack([np.bincount(at, weights=np.repeat(v, width), minlength=n) for v in (w * y, w * y * y, w)], axis=-1)
            total[m] = total[m] + sums if m in total else sums
        yield from _part(first, total)
    return counted


def _lost(s: _State, trees: dict[int, tuple]) -> Callable:
    """Largest loss, weighted loss and weight of every view's newest tree."""
    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        first = None
        for r in _blocks(batches):
            m = r["model"]
            if m not in trees:
                continue
            first = r["block"] if first is None else min(first, r["block"])
            e, w = np.abs(s.leaf_values(r, *trees[m]) - r["y"]), s.weights(r)
            old = total.get(m, np.zeros(3))
            total[m] = np.array([max(old[0], e.max(initial=0.0)), old[1] + w @ e, old[2] + w.sum()])
        yield from _part(first, total)
    return lost


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights at the start: how many rows each row stands for."""
    for b in batches:
        yield b.set_column(b.schema.get_field_index("margin"), "margin", b.column("w"))


def _written(s: _State) -> Callable:
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [s.weights(r).tobytes() for r in _blocks(iter([b]))]
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(w, pa.binary()))
    return written


def _summed(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("first")
    total = sum(np.frombuffer(v) for v in t["sums"].to_pylist())
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "first": t["first"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


class _Rounds:
    """The rounds of all views; ``fit`` returns {model: (trees, factors)}."""
    refresh = REFRESH

    def __init__(self, blocks, cut: dict[int, list[np.ndarray]], classes: int, params: AdaParams, votes: int, tasks: int, driver_bytes: int = DRIVER_BYTES):
        self.blocks, self.cut, self.classes, self.params, self.votes = blocks, cut, classes, params, votes
        self.tasks, self.driver_bytes, self.rule, self.passes = tasks, driver_bytes, _Rule(classes), 0
        self.last = {m: np.array([len(c) + 1 for c in cs]) for m, cs in cut.items()}
        self.offsets = {m: np.concatenate([[0], np.cumsum(v + 1)]) for m, v in self.last.items()}

    def _state(self, recent, growing=None, wanted=None) -> _State:
        return _State(self.classes, self.last, self.offsets, recent, growing or {}, wanted or {})

    def _partials(self, work: Callable, large: int) -> list:
        parts = self.blocks.mapInArrow(work, _PART)
        if large * self.tasks > self.driver_bytes:
            parts = parts.groupBy("model").applyInArrow(_summed, _PART)
        return parts.collect()

    def _trees(self, recent, live: list[int]) -> dict[int, Growing]:
        trees, wave, allowed = {m: Growing() for m in live}, {m: [0] for m in live}, {}
        while wave:
            self.passes += 1
            state = self._state(recent, {m: trees[m].arrays() for m in wave}, {m: np.array(v) for m, v in wave.items()})
            large = sum(len(v) * int(self.offsets[m][-1]) for m, v in wave.items()) * 8 * (self.classes or 3)
            total: dict[int, np.ndarray] = {}
            for r in sorted(self._partials(_counted(state), large), key=lambda r: r["first"]):
                v = np.frombuffer(r["sums"])
                total[r["model"]] = total[r["model"]] + v if r["model"] in total else v
            ahead: dict[int, list[int]] = {}
            for m, nodes in wave.items():
                t, offsets = trees[m], self.offsets[m]
                hist = total[m].reshape(len(nodes), int(offsets[-1]), -1)
                if self.classes:
                    hist = np.concatenate([hist, hist.sum(axis=-1, keepdims=True)], axis=-1)
                for i, h in zip(nodes, hist):
                    if i == 0:
                        t.sums[0], allowed[m] = h[offsets[0]:offsets[1]].sum(axis=0), candidates(h[:, -1], offsets)
                    t.split[i] = self.rule.best(h, offsets, allowed[m])
                    if t.split[i] is not None:
                        t.accepted[i] = True
                        more = [c for c in t.children(i) if t.depth[c] < self.params.depth and self.rule.impurity(t.sums[c]) >= PURE]
                        ahead.setdefault(m, []).extend(more)
            wave = {m: v for m, v in ahead.items() if v}
        return trees

    def fit(self, refreshed: Callable[[_State], object]) -> dict[int, tuple[list[Tree], list[float]]]:
        out: dict[int, tuple[list[Tree], list[float]]] = {m: ([], []) for m in self.cut}
        recent: dict[int, list[tuple]] = {m: [] for m in self.cut}
        live = sorted(self.cut)
        for n in range(self.params.rounds):
            made = {}
            for m, t in self._trees(recent, live).items():
                tree, arrays = t.finished(self.cut[m], self.rule, 1.0)
                value = tree.value.argmax(axis=1).astype(float) if self.classes else tree.value[:, 0]
                made[m] = (tree, arrays[:5], value)
            step = self._classified(made, out) if self.classes else self._regressed(made, out, recent)
            for m, how in step.items():
                recent[m].append((*made[m][1:], how))
            live = sorted(step)
            if not live:
                break
            if (n + 1) % self.refresh == 0 and n + 1 < self.params.rounds:
                self.blocks = refreshed(self._state(recent))
                recent = {m: [] for m in self.cut}
        return out

    def _classified(self, made: dict, out: dict) -> dict[int, tuple]:
        """SAMME: how the weights of the views that go on change, kept at mean 1."""
        step = {}
        for m, (tree, _, _) in made.items():
            trees, alphas = out[m]
            leaf = tree.feature < 0
            tot = tree.cover[leaf].sum()
            bad = (tree.cover[leaf] * (1 - tree.value[leaf].max(axis=1))).sum()
            err = bad / (tot or 1.0)
            if err <= 0.0 or err >= 1.0 - 1.0 / self.votes:
                if err <= 0.0 or not trees:
                    trees.append(tree)
                    alphas.append(1.0)
                continue
            alpha = self.params.rate * (math.log((1.0 - err) / err) + math.log(self.votes - 1.0))
            trees.append(tree)
            alphas.append(alpha)
            step[m] = (alpha, tot / ((tot - bad) + bad * math.exp(alpha)))
        return step

    def _regressed(self, made: dict, out: dict, recent) -> dict[int, tuple]:
        """R2 with the linear loss."""
        total: dict[int, np.ndarray] = {}
        self.passes += 1
        for r in sorted(self._partials(_lost(self._state(recent), {m: v[1:] for m, v in made.items()}), 0), key=lambda r: r["first"]):
            v, old = np.frombuffer(r["sums"]), total.get(r["model"], np.zeros(3))
            total[r["model"]] = np.array([max(old[0], v[0]), old[1] + v[1], old[2] + v[2]])
        step = {}
        for m, (tree, _, _) in made.items():
            trees, alphas = out[m]
            largest, loss, weight = total[m]
            mean = loss / (largest * (weight or 1.0)) if largest > 0 else 0.0
            if largest <= 0 or mean >= 0.5:
                if largest <= 0 or not trees:
                    trees.append(tree)
                    alphas.append(1.0)
                continue
            beta = max(mean / (1.0 - mean), 1e-300)
            trees.append(tree)
            alphas.append(self.params.rate * math.log(1.0 / beta))
            step[m] = (float(largest), beta, self.params.rate)
        return step


class _Inside(_Rounds):
    """The same rounds over Arrow batches held by one task; weights are kept up with every round."""
    refresh = 1

    def _partials(self, work: Callable, large: int) -> list:
        return [r for b in work(iter(self.blocks)) for r in b.to_pylist()]


def _fitted(cut, classes: int, params: AdaParams, votes: int) -> Callable:
    def fitted(key: tuple, t: pa.Table) -> pa.Table:
        m = key[0].as_py()
        b = _Inside([_joined(t.sort_by("block"))], {m: cut[m]}, classes, params, votes, 1)
        got = b.fit(lambda state: list(_written(state)(iter(b.blocks))))[m]
        return pa.table({"model": pa.array([m], pa.int32()), "rounds": [pickle.dumps(got)]})
    return fitted


def fit_views(views: list[tuple[int, DataFrame, DataFrame | None]], task: str, n_classes: int, params: AdaParams,
              task_bytes: int = INSIDE_BYTES, driver_bytes: int = DRIVER_BYTES) -> tuple[dict[int, Model], DataFrame | None]:
    """One model for every (model, training rows, held-out rows), and the held-out predictions (model, key, y, prediction)."""
    spark = views[0][1].sparkSession
    train = _union([t.select(F.lit(m).cast("int").alias("model"), F.lit(False).alias("held"), F.lit(None).cast("string").alias("key"),
                             F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"), weight(t).alias("w")) for m, t, _ in views])
    cut = bin_cuts(train, MAX_BINS)
    facts = train.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top")).collect()
    if len(facts) < len(views) or len(cut) < len(views):
        raise ValueError("a model has no training rows or no features")
    votes = max(n_classes, 2)
    classes = 0 if task == "regression" else max(votes, *[int(r["top"] or 0) + 1 for r in facts])
    size = {r["model"]: r["n"] * (len(cut[r["model"]]) + 24) for r in facts}
    inside, spread = [m for m in cut if size[m] <= task_bytes], [m for m in cut if size[m] > task_bytes]
    packed = train.mapInArrow(_packed(cut, 1), _BLOCK).mapInArrow(_weighed, _BLOCK)
    got: dict[int, tuple[list[Tree], list[float]]] = {}
    if inside:
        mine = packed.where(F.col("model").isin(inside)).repartitionByRange(len(inside), "model").groupBy("model")
        for r in mine.applyInArrow(_fitted(cut, classes, params, votes), "model int, rounds binary").collect():
            got[r["model"]] = pickle.loads(r["rounds"])
    if spread:
        tasks = max(spark.sparkContext.defaultParallelism, -(-sum(size[m] for m in spread) // TASK_BYTES))
        folder = f"{checkpoint_dir(spark).rstrip('/')}/strata-adaboost-{uuid.uuid4().hex}"
        kept: list[DataFrame] = []

        def stored(df: DataFrame) -> DataFrame:
            df.write.parquet(path := f"{folder}/{len(kept)}")
            for old in kept:
                old.unpersist()
            now = spark.read.schema(df.schema).parquet(path).coalesce(tasks).persist()
            now.count()
            kept.append(now)
            return now

        rounds = _Rounds(stored(packed.where(F.col("model").isin(spread))), {m: cut[m] for m in spread}, classes, params, votes, tasks, driver_bytes)
        got |= rounds.fit(lambda state: stored(rounds.blocks.mapInArrow(_written(state), _BLOCK)))
        for old in kept:
            old.unpersist()
    models = {m: AdaBoostClassificationModel(*v, votes) if classes else AdaBoostRegressionModel(*v) for m, v in got.items()}
    held = None
    if any(h is not None for _, _, h in views):
        held = _union([models[m].transform(h).select(F.lit(m).alias("model"), F.col("__key").alias("key"), F.col("label").cast("double").alias("y"), "prediction")
                       for m, _, h in views if h is not None])
    return models, held


# estimators ---------------------------------------------------------------------------------------

class AdaBoostClassifier(Estimator):
    """SAMME boosting of weighted stumps (G7); many folds at once go through ``fit_views``."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 1, n_classes: int = 2):
        super().__init__()
        self.ada, self.n_classes = AdaParams(n_estimators, learning_rate, max_depth), n_classes

    def _fit(self, df: DataFrame) -> "AdaBoostClassificationModel":
        return fit_views([(0, df, None)], "classification", self.n_classes, self.ada)[0][0]


class AdaBoostRegressor(Estimator):
    """AdaBoost.R2 with linear loss and weighted depth-3 trees."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, max_depth: int = 3):
        super().__init__()
        self.ada = AdaParams(n_estimators, learning_rate, max_depth)

    def _fit(self, df: DataFrame) -> "AdaBoostRegressionModel":
        return fit_views([(0, df, None)], "regression", 0, self.ada)[0][0]


class _Weighted(Model, Saved):
    """Trees over feature values and the factor of each."""

    def __init__(self, trees: list[Tree], alphas: list[float]):
        super().__init__()
        self.trees, self.alphas = trees, alphas

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(*state)

    @property
    def featureImportances(self):
        total = sum(self.alphas) or 1.0
        width = max((int(t.feature.max()) + 1 for t in self.trees), default=0)
        out = np.zeros(width)
        for t, a in zip(self.trees, self.alphas):
            v = t.importance(width)
            out += v / v.sum() * (a / total) if v.sum() > 0 else 0.0
        return out


class AdaBoostClassificationModel(_Weighted):
    def __init__(self, trees: list[Tree], alphas: list[float], n_classes: int):
        super().__init__(trees, alphas)
        self.n_classes = n_classes

    def parts(self):
        return (self.trees, self.alphas, self.n_classes), {}, []

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, alphas, k = self.trees, self.alphas, self.n_classes

        @F.arrow_udf("double")
        def voted(x: pa.Array) -> pa.Array:
            v = _values(x)
            votes = np.zeros((len(v), k))
            for t, a in zip(trees, alphas):
                chosen = t.value.argmax(axis=1)[t.leaf_of(v)]
                votes += a * (chosen[:, None] == np.arange(k))
            return pa.array(votes.argmax(axis=1).astype(float))

        return df.withColumn("prediction", voted(vector_to_array("features")))


class AdaBoostRegressionModel(_Weighted):
    """Prediction = weighted median of the trees' predictions."""

    def parts(self):
        return (self.trees, self.alphas), {}, []

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, alphas = self.trees, np.array(self.alphas)

        @F.arrow_udf("double")
        def median(x: pa.Array) -> pa.Array:
            v = _values(x)
            p = np.stack([t.predict(v)[:, 0] for t in trees], axis=1)
            order = np.argsort(p, axis=1, kind="stable")
            upto = np.cumsum(alphas[order], axis=1)
            at = (upto >= alphas.sum() / 2).argmax(axis=1)
            return pa.array(np.take_along_axis(p, np.take_along_axis(order, at[:, None], 1), 1)[:, 0])

        return df.withColumn("prediction", median(vector_to_array("features")))
