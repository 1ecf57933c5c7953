"""Pruned exact k-nearest neighbours against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators.knn import knn_predict, neighbours


def brute(tx, tkeys, q, k):
    d = np.sqrt(((tx - q) ** 2).sum(axis=1))
    return [(tkeys[j], d[j]) for j in sorted(range(len(tx)), key=lambda j: (d[j], tkeys[j]))[:k]]


def frames(spark, tx, qx, label=None):
    label = np.zeros(len(tx)) if label is None else label
    t = spark.createDataFrame(pd.DataFrame({"__key": [f"{i:05d}" for i in range(len(tx))], "features": list(tx.tolist()),
                                            "label": label.astype(float)}))
    q = spark.createDataFrame(pd.DataFrame({"__key": [f"q{i}" for i in range(len(qx))], "features": list(qx.tolist())}))
    return t, q


def check(found, tx, qx, k):
    got = {}
    for r in found.rows.collect():
        got.setdefault(r["key"], []).append((r["rank"], r["neighbour"], r["d"]))
    keys = [f"{i:05d}" for i in range(len(tx))]
    for i, x in enumerate(qx):
        want = brute(tx, keys, x, k)
        have = sorted(got[f"q{i}"])
        assert [h[1] for h in have] == [w[0] for w in want]
        assert [h[2] for h in have] == pytest.approx([w[1] for w in want], abs=1e-12)


def clusters(rng, n, dim=6, centres=12):
    at = rng.normal(size=(centres, dim)) * 40
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))


def test_clusters_are_pruned_and_exact(spark):
    rng = np.random.default_rng(0)
    tx, qx = clusters(rng, 3000), clusters(rng, 200)
    tx[:30] = tx[30:60]                       # copies: ties
    qx[:10] = tx[:10]                         # distance zero
    t, q = frames(spark, tx, qx)
    found = neighbours(t, q, 5, cell_rows=60, block_rows=500)
    check(found, tx, qx, 5)
    seen = found.visits.agg(F.sum("rows_visited").alias("v"), F.sum("rows").alias("a"), F.count(F.lit(1)).alias("n"),
                            F.max("cells").alias("c")).first()
    assert seen["n"] == 200 and seen["c"] > 40 and seen["v"] < 0.6 * seen["a"]


def test_copies_of_one_row_are_dealt_into_parts(spark):
    rng = np.random.default_rng(1)
    tx = np.concatenate([np.tile([[1.0, 2.0]], (900, 1)), rng.normal(size=(600, 2)) * 5])
    qx = np.concatenate([[[1.0, 2.0]], rng.normal(size=(60, 2)) * 5])
    t, q = frames(spark, tx, qx)
    check(neighbours(t, q, 7, cell_rows=50, block_rows=40), tx, qx, 7)


def test_all_distances_alike_and_few_rows(spark):
    tx, qx = np.eye(40), np.zeros((3, 40))
    t, q = frames(spark, tx, qx)
    check(neighbours(t, q, 4, cell_rows=5, block_rows=8), tx, qx, 4)
    check(neighbours(t, q, 50, cell_rows=5, block_rows=8), tx, qx, 50)
    assert neighbours(t.limit(0), q, 3).rows.count() == 0
    assert neighbours(t, q.limit(0), 3, cell_rows=5).rows.count() == 0


def test_groups_and_votes(spark):
    rng = np.random.default_rng(2)
    tx, qx = clusters(rng, 600, 3, 5), clusters(rng, 50, 3, 5)
    label = rng.integers(0, 3, 600)
    t, q = frames(spark, tx, qx, label)
    number = F.regexp_extract("__key", r"(\d+)", 1).cast("int")
    t, q = t.withColumn("g", number % 2), q.withColumn("g", number % 2)
    got = {r["key"]: r["prediction"] for r in knn_predict(t, q, 5, group_col="g", cell_rows=30, block_rows=20).collect()}
    keys = [f"{i:05d}" for i in range(600)]
    for i in range(50):
        mine = [j for j in range(600) if j % 2 == i % 2]
        near = brute(tx[mine], [keys[j] for j in mine], qx[i], 5)
        assert got[f"q{i}"] == float(np.argmax(np.bincount([label[int(k)] for k, _ in near], minlength=3)))
