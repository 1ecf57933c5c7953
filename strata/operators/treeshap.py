"""Exact Shapley values of trees (survey I4).

The value of a feature set S at a row is the tree's expectation when only the
features in S are known: an inner node on a feature outside S passes on the
average of its children by training weight.  A leaf's share of it is a product
over the distinct features on its path: an indicator that the row meets all of
the path's conditions on the feature if it is in S, else the product of the
child shares.  The Shapley values of such a product over m features are found
in m * m steps: dividing one factor out of the polynomial whose k-th
coefficient adds up the products with k features known, and weighting it with
k! (m - k - 1)! / m!.  Leaves and trees add up.

Every task takes a bounded set of (row block, trees) and works over whole
columns; the trees are carried in a broadcast of checked size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.boost import HistBoostModel, _values
from strata.operators.forest import ForestModel
from strata.operators.models import AdaBoostClassificationModel, AdaBoostRegressionModel
from strata.operators.trees import Tree

#: Nodes that one broadcast carries, and rows that a task explains at once, about.
CARRIED_NODES, CELL_ROWS = 4_000_000, 512


def paths(t: Tree) -> dict[tuple[int, ...], list[tuple[int, list[tuple[float, float, bool, float]]]]]:
    """Leaves by the features on their paths: (leaf, for each feature the interval (low, high] that leads there, whether a missing value does, share of the rows)."""
    out: dict[tuple[int, ...], list] = {}
    todo = [(0, {})]
    while todo:
        i, at = todo.pop()
        f = int(t.feature[i])
        if f < 0:
            feats = tuple(sorted(at))
            out.setdefault(feats, []).append((i, [at[g] for g in feats]))
            continue
        low, high, missing, share = at.get(f, (-np.inf, np.inf, True, 1.0))
        cut, goes_left = t.threshold[i], bool(t.missing_left[i])
        for child, step in ((t.left[i], (low, min(high, cut), missing and goes_left)), (t.right[i], (max(low, cut), high, missing and not goes_left))):
            if t.cover[child] > 0:
                todo.append((child, {**at, f: (*step, share * t.cover[child] / t.cover[i])}))
    return out


def _weights(m: int) -> np.ndarray:
    return np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])


#: Numbers that one step over (leaves, rows) holds, about.
STEP_CELLS = 1 << 18


def tree_shap(t: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features, outputs) Shapley values and the expectation (outputs) of one tree."""
    n, width = x.shape
    out, mean = np.zeros((n, width, t.value.shape[1])), np.zeros(t.value.shape[1])
    for feats, leaves in paths(t).items():
        m = len(feats)
        step = max(1, STEP_CELLS // max(n * (m + 1), 1))
        for first in range(0, len(leaves), step):
            some = leaves[first:first + step]
            value = t.value[[i for i, _ in some]]
            if not m:
                mean += value.sum(axis=0)
                continue
            at = np.array([c for _, c in some], np.float64)                   # (leaves, features, 4)
            zero = at[:, :, 3]
            mean += value.T @ zero.prod(axis=1)
            one = np.empty((m, len(some), n))
            for j, f in enumerate(feats):
                with np.errstate(invalid="ignore"):
                    inside = (x[:, f] > at[:, j, :1]) & (x[:, f] <= at[:, j, 1:2])
                # an infinite low end has no row below it, and minus infinity itself is inside
                inside |= (x[:, f] == -np.inf) & np.isneginf(at[:, j, :1])
                one[j] = np.where(np.isnan(x[:, f]), at[:, j, 2:3] > 0, inside)
            # coefficient k: products of `one` over k features and of `zero` over the others
            poly = np.zeros((m + 1, len(some), n))
            poly[0] = 1.0
            for j in range(m):
                z = zero[:, j, None]
                poly[1:j + 2] = poly[1:j + 2] * z + poly[:j + 1] * one[j]
                poly[0] *= z
            w = _weights(m)
            low = np.tensordot(w, poly[:m], 1)
            for j, f in enumerate(feats):
                z = zero[:, j, None]
                # divide by (zero + one * z): from the top where the row meets the conditions, from below where not
                top, carry = np.zeros((len(some), n)), np.zeros((len(some), n))
                for k in range(m - 1, -1, -1):
                    carry = poly[k + 1] - z * carry
                    top += w[k] * carry
                part = np.where(one[j] > 0, top * (1 - z), -low)
                out[:, f] += part.T @ value
    return out, mean


# models as trees ----------------------------------------------------------------------------------

def _mllib_tree(model, outputs: int, scale: float) -> Tree:
    """A fitted single MLlib tree as arrays; its leaves hold class shares or a mean."""
    cols: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "value", "cover", "gain")}
    todo = [(model._call_java("rootNode"), None, "")]
    while todo:
        node, parent, side = todo.pop(0)
        i = len(cols["feature"])
        if parent is not None:
            cols[side][parent] = i
        stats = node.impurityStats()
        inner = node.subtreeDepth() > 0
        if outputs > 1:
            v = np.array([stats.stats()[k] for k in range(outputs)])
            v = v / max(v.sum(), 1e-300)
        else:
            v = np.array([node.prediction()])
        cols["feature"].append(node.split().featureIndex() if inner else -1)
        cols["threshold"].append(node.split().threshold() if inner else np.nan)
        cols["left"].append(-1)
        cols["right"].append(-1)
        cols["value"].append(v * scale)
        cols["cover"].append(float(stats.count()))
        cols["gain"].append(node.gain() * stats.count() if inner else 0.0)
        if inner:
            todo += [(node.leftChild(), i, "left"), (node.rightChild(), i, "right")]
    n = len(cols["feature"])
    return Tree(missing_left=np.zeros(n, bool), **{c: np.array(v) for c, v in cols.items()})


def trees_of(model) -> Iterator[list[tuple[Tree, int, float]]] | None:
    """Lists of (tree, output of its first value, factor) that add up to the model's scores; None if it is no sum of trees.

    Scores are class probabilities for a tree and a forest, margins for boosters.
    """
    if isinstance(model, ForestModel):
        return ([(t, 0, 1.0 / model.n_trees) for t in ts] for ts in model.chunks())
    if isinstance(model, HistBoostModel):
        return iter([[(t, c, 1.0) for trees in model.rounds for c, t in enumerate(trees)]])
    if isinstance(model, (AdaBoostClassificationModel, AdaBoostRegressionModel)):
        return None
    if type(model).__name__ == "DecisionTreeClassificationModel":
        return iter([[(_mllib_tree(model, model.numClasses, 1.0), 0, 1.0)]])
    if type(model).__name__ == "DecisionTreeRegressionModel":
        return iter([[(_mllib_tree(model, 1, 1.0), 0, 1.0)]])
    return None


def _explained(carried, outputs: int, width: int) -> Callable:
    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _values(b.column("x"))
            total = np.zeros((len(x), width, outputs))
            for t, first, factor in carried.value[b.column("part")[0].as_py()]:
                v, _ = tree_shap(t, x)
                total[:, :, first:first + v.shape[2]] += factor * v
            for i, r in enumerate(b.column("row").to_pylist()):
                yield pa.record_batch({"row": pa.array([r] * (width * outputs), pa.int64()),
                                       "feature": pa.array(np.repeat(np.arange(width), outputs), pa.int32()),
                                       "output": pa.array(np.tile(np.arange(outputs), width), pa.int32()), "phi": total[i].ravel()})
    return explained


def shap_values(model, vectors: DataFrame, width: int, features_col: str = "features") -> DataFrame | None:
    """(row, feature, output, phi) of every row of ``vectors``, which gets a number as its ``row``; None if the model is no sum of trees.

    Rows and groups of trees are spread over the tasks; the values of a row are added up over the groups.
    """
    lists = trees_of(model)
    if lists is None:
        return None
    spark, out = vectors.sparkSession, None
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), vector_to_array(features_col).alias("x"))
    spread = 2 * spark.sparkContext.defaultParallelism
    cells = -(-max(rows.count(), 1) // CELL_ROWS)   # a tree's paths are found once for each cell of rows
    for trees in lists:
        held: list[list] = [[]]
        nodes = 0
        for t in trees:
            if nodes > CARRIED_NODES:
                held.append([])
                nodes = 0
            held[-1].append(t)
            nodes += len(t[0].feature)
        for group in held:
            outputs = max(f + t.value.shape[1] for t, f, _ in group)
            parts = [group[i::spread] for i in range(min(spread, len(group)))]
            asked = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(parts) - 1)))).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
            one = asked.repartition(max(spread, len(parts)) * 2, "part", "cell").groupBy("part", "cell").applyInArrow(
                _grouped(spark.sparkContext.broadcast(parts), outputs, width), "row long, feature int, output int, phi double")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("row", "feature", "output").agg(F.sum("phi").alias("phi"))


def _grouped(carried, outputs: int, width: int) -> Callable:
    each = _explained(carried, outputs, width)

    def grouped(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(each(iter(t.combine_chunks().to_batches()))))
    return grouped


def shap_importance(model, vectors: DataFrame, names: list[str], features_col: str = "features") -> DataFrame | None:
    """Mean absolute Shapley value of every feature, averaged over outputs."""
    values = shap_values(model, vectors, len(names), features_col)
    if values is None:
        return None
    name = F.element_at(F.array(*[F.lit(v) for v in names]), F.col("feature") + 1)
    mean = values.groupBy("feature", "output").agg(F.avg(F.abs("phi")).alias("v")).groupBy("feature").agg(F.avg("v").alias("importance"))
    return mean.select(name.alias("feature"), "importance")
