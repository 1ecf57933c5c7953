"""Histogram boosting against a plain learner that tries every threshold on every node's rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from strata.operators import boost, cells


def table(n=260, seed=1, missing=0.1, classes=0):
    rnd = np.random.default_rng(seed)
    x = np.stack([rnd.integers(0, 12, n), rnd.integers(0, 5, n), rnd.normal(size=n).round(1), rnd.integers(0, 2, n)], 1).astype(float)
    x[rnd.random(x.shape) < missing] = np.nan
    z = np.nan_to_num(x)
    score = z[:, 0] * 0.3 - z[:, 1] + 2 * z[:, 2] * z[:, 3] + rnd.normal(size=n) * 0.3
    y = score if not classes else np.searchsorted(np.quantile(score, np.arange(1, classes) / classes), score).astype(float)
    return x, y


def plain(x, y, task, outputs, p):
    """Rounds of trees, as nested (feature, threshold, missing_left, left, right) or leaf values, and final margins."""
    rule = p.rule
    if task == "regression":
        base = np.array([y.mean()])
    else:
        share = np.array([(y == c).mean() for c in range(max(outputs, 2))])
        base = np.array([np.log(share[1] / share[0])]) if outputs == 1 else np.log(share)
    margin, rounds = np.tile(base, (len(y), 1)), []
    marks = []
    for f in range(x.shape[1]):
        v = np.unique(x[~np.isnan(x[:, f]), f])
        marks.append(np.append((v[1:] + v[:-1]) / 2, np.inf))  # infinity: missing values alone on the right

    def gain(a, b, g, h):
        if min(a.sum(), b.sum()) < rule.min_rows or min(h[a].sum(), h[b].sum()) < rule.min_hessian:
            return -np.inf
        if rule.kind == "friedman":
            return a.sum() * b.sum() / (a.sum() + b.sum()) * (g[a].mean() - g[b].mean()) ** 2
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + rule.l2)
        return rule.scale * (part(a) + part(b) - part(a | b))

    def best(rows, g, h):
        out = (1e-9, None)
        for f in range(x.shape[1]):
            none = rows & np.isnan(x[:, f])
            for side in (False, True) if none.any() else (False,):
                for t in marks[f]:
                    with np.errstate(invalid="ignore"):
                        a = rows & ((x[:, f] <= t) | (none if side else False))
                    b = rows & ~a
                    if (v := gain(a, b, g, h)) > out[0] * (1 + 1e-9):
                        out = (v, (f, t, side, a, b))
        return out

    for _ in range(p.rounds):
        g, h = boost.gradients(margin, y, task, p.hessian)
        made = []
        for c in range(outputs):
            leaves = [(np.ones(len(y), bool), 0)]
            done = []
            while leaves:
                if p.leaves:
                    if len(leaves) + len(done) >= p.leaves:
                        break
                    found = [(best(rows, g[:, c], h[:, c]) if not p.depth or d < p.depth else (0, None)) for rows, d in leaves]
                    i = int(np.argmax([v if s else -1 for v, s in found]))
                    v, s = found[i]
                    if s is None:
                        break
                    _, d = leaves.pop(i)
                    leaves += [(s[3], d + 1), (s[4], d + 1)]
                else:
                    rows, d = leaves.pop(0)
                    v, s = best(rows, g[:, c], h[:, c]) if d < p.depth else (0, None)
                    if s is None:
                        done.append((rows, d))
                    else:
                        leaves += [(s[3], d + 1), (s[4], d + 1)]
            value = np.zeros(len(y))
            for rows, _ in leaves + done:
                value[rows] = -p.rate * g[rows, c].sum() / (h[rows, c].sum() + rule.l2)
            made.append((len(leaves + done), value))
        for c, (_, value) in enumerate(made):
            margin[:, c] += value
        rounds.append([k for k, _ in made])
    return rounds, margin


CASES = {"depth": lambda: boost.depth_wise({"n_estimators": 5, "learning_rate": 0.3, "max_depth": 4}),
         "leaf": lambda: boost.leaf_wise({"n_estimators": 5, "learning_rate": 0.3, "max_depth": 7, "num_leaves": 9}),
         "first": lambda: boost.first_order({"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3})}


def frame(spark, x, y, parts=3):
    df = spark.createDataFrame([(str(i), Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["__key", "features", "label"])
    return df.repartition(parts) if parts else df


@pytest.mark.parametrize("kind,classes,driver_bytes,task_bytes", [
    ("depth", 0, 1 << 26, 0), ("depth", 2, 0, 0), ("depth", 3, 1 << 26, 1 << 26), ("leaf", 0, 1 << 26, 1 << 26), ("leaf", 2, 1 << 26, 0), ("first", 2, 1 << 26, 1 << 26)])
def test_equals_plain_learner(spark, kind, classes, driver_bytes, task_bytes):
    x, y = table(classes=classes)
    p, task, outputs = CASES[kind](), "classification" if classes else "regression", classes if classes > 2 else 1
    models, _, _ = boost.fit_views([(0, frame(spark, x, y), None)], task, classes or 2, p, driver_bytes, task_bytes)
    leaves, margin = plain(x, y, task, outputs, p)
    got = models[0]
    assert [[int((t.feature < 0).sum()) for t in ts] for ts in got.rounds] == leaves
    assert np.allclose(got.margins(x), margin, atol=1e-6)
    if kind == "leaf":
        assert max(k for ks in leaves for k in ks) <= 9


def test_folds_equal_single_fits(spark):
    x, y = table(classes=2, missing=0)
    fold = np.arange(len(y)) % 3
    p = CASES["depth"]()
    views = [(f, frame(spark, x[fold != f], y[fold != f]), frame(spark, x[fold == f], y[fold == f])) for f in range(3)]
    models, held, b = boost.fit_views(views, "classification", 2, p, task_bytes=0)
    assert b.passes <= 5 * 4
    assert held.count() == len(y)
    for f in range(3):
        one = boost.HistBooster(p, "classification").fit(views[f][1])
        assert np.allclose(one.margins(x), models[f].margins(x), atol=1e-9)
        out = one.transform(views[f][2]).collect()
        assert all(abs(r.probability[1] - 1 / (1 + np.exp(-m))) < 1e-9 for r, m in zip(out, one.margins(np.array([r.features.toArray() for r in out]))[:, 0]))


def test_bins_follow_quantiles(spark):
    rnd = np.random.default_rng(4)
    x = rnd.exponential(size=(20_000, 1))
    cut = boost.bin_cuts(frame(spark, x, x[:, 0], 5).selectExpr("0 as model", "label", "features").select("model", boost.vector_to_array("features").alias("x")), 32)[0][0]
    share = np.diff(np.concatenate([[0], np.searchsorted(np.sort(x[:, 0]), cut), [len(x)]])) / len(x)
    assert len(cut) == 31 and share.max() < 1.3 / 32 and share.min() > 0.7 / 32


@pytest.mark.parametrize("classes", [0, 2])
@pytest.mark.parametrize("task_bytes", [0, 1 << 26])
def test_equal_rows_are_one_weighted_row(spark, monkeypatch, classes, task_bytes):
    monkeypatch.setattr(cells, "MERGE_FROM", 0)
    x, y = table(n=60, classes=classes)
    x = np.repeat(x, 7, axis=0)
    y = np.repeat(y, 7) if classes else np.repeat(y, 7) + np.tile(np.arange(7.0), 60)
    p, task = CASES["depth"](), "classification" if classes else "regression"
    models, _, b = boost.fit_views([(0, frame(spark, x, y), None)], task, 2, p, task_bytes=task_bytes)
    leaves, margin = plain(x, y, task, 1, p)
    assert [[int((t.feature < 0).sum()) for t in ts] for ts in models[0].rounds] == leaves
    assert np.allclose(models[0].margins(x), margin, atol=1e-6)
    rows = cells.merged(frame(spark, x, y).select(boost.F.lit(0).alias("model"), boost.F.col("label").alias("y"), boost.vector_to_array("features").alias("x")), bool(classes))
    distinct = len(np.unique(np.nan_to_num(x, nan=-99), axis=0))
    assert rows.count() == distinct and rows.agg({"w": "sum"}).first()[0] == len(x)
    if b is not None:
        assert b.passes <= 5 * 4


def test_distinct_rows_are_not_merged(spark, monkeypatch):
    monkeypatch.setattr(cells, "MERGE_FROM", 0)
    x = np.arange(400.0).reshape(-1, 1)
    assert cells.merged(frame(spark, x, x[:, 0]).selectExpr("0 as model", "label as y", "features").select("model", "y", boost.vector_to_array("features").alias("x")), True) is None
