"""Exact k-nearest neighbours and k-NN classification (survey G5).

Training rows are cut into cells and a query row visits only the cells that
can hold one of its k nearest rows:

* at most ``MAX_PIVOTS`` training rows (those of smallest key hash, within
  ``PIVOT_BYTES``) are pivots; every training row goes to its nearest pivot,
  and the rows of a pivot to rings of equal width by their distance to it.
  A cell is a (group, pivot, ring) with its row count, smallest and largest
  distance; at most ``MAX_CELLS`` cells per table, so their facts may travel
  with the tasks.  A cell of more than ``block_rows`` rows (copies of one row,
  a dense region) is dealt into parts by key hash;
* each query first visits the nearest cells that hold k rows (one part of
  each).  The k-th distance found there bounds its answer;
* by the triangle inequality no row of a cell is nearer than
  ``max(d(q, pivot) - largest, smallest - d(q, pivot))``; cells beyond the
  query's bound are skipped, every other part is visited;
* a cogroup on (cell, part, query block) hands at most ``block_rows`` rows of
  each side to one task, which emits the k closest training rows per query
  row that lie within its bound; a ranked window (cut to k before the
  shuffle) keeps the k best of all visited parts.

No pair list is materialised and no group is unbounded.  Pruning never
changes the result, only the number of cells visited (``Neighbours.visits``);
data without near rows (every distance alike) visits all cells, which is the
plain quadratic search.

Ties: equal distances order by training key; an even vote goes to the
smallest class index (scikit-learn's behaviour).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.persist import Saved
from strata.session import cut_lineage

BLOCK_ROWS = 20_000
CELL_ROWS = 4_000
MAX_PIVOTS = 1_024
PIVOT_BYTES = 32 << 20
MAX_CELLS = 65_536
QUERY_CHUNK = 256
BOUND_CHUNK = 64
PAIR_CHUNK = 65_536

_CAND_SCHEMA = "qkey string, tkey string, label double, d double"


@dataclass
class Neighbours:
    """``rows``: key, rank (from 1), neighbour, label, d.  ``visits``: key, cells_visited, rows_visited, cells, rows."""
    rows: DataFrame
    visits: DataFrame


def _cell_topk(k: int):
    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qkey": pd.Series([], dtype=object), "tkey": pd.Series([], dtype=object),
                                 "label": pd.Series([], dtype="float64"), "d": pd.Series([], dtype="float64")})
        tx = np.stack(t["x"].to_numpy()).astype(np.float64)
        tkeys = np.asarray(t["key"].astype(object).to_numpy(), dtype=object)
        order_keys = np.argsort(tkeys.astype(str), kind="stable")
        tx, tkeys = tx[order_keys], tkeys[order_keys]
        tlab = t["label"].to_numpy(dtype=np.float64)[order_keys]
        qkeys_all = np.asarray(q["key"].astype(object).to_numpy(), dtype=object)
        qx_all = np.stack(q["x"].to_numpy()).astype(np.float64)
        limit = q["tau"].to_numpy(dtype=np.float64) if "tau" in q else np.full(len(q), np.inf)
        kk = min(k, len(t))
        norms = (tx * tx).sum(axis=1)
        qk, tk, lab, dist = [], [], [], []
        for start in range(0, len(q), QUERY_CHUNK):
            qx = qx_all[start:start + QUERY_CHUNK]
            # norms and one matrix product find the candidates; the k best and all within
            # rounding of them get their exact distance, so ties order by training key
            near = np.maximum((qx * qx).sum(axis=1)[:, None] + norms[None, :] - 2.0 * (qx @ tx.T), 0.0)
            slack = 1e-9 * (1.0 + (qx * qx).sum(axis=1) + norms.max())
            kth = np.partition(near, kk - 1, axis=1)[:, kk - 1]
            d = np.full(near.shape, np.inf)
            r, c = np.nonzero(near <= (kth + slack)[:, None])
            for a in range(0, len(r), PAIR_CHUNK):
                diff = qx[r[a:a + PAIR_CHUNK]] - tx[c[a:a + PAIR_CHUNK]]
                d[r[a:a + PAIR_CHUNK], c[a:a + PAIR_CHUNK]] = np.sqrt((diff * diff).sum(axis=1))
            # stable sort keeps the training-key order among equal distances
            idx = np.argsort(d, axis=1, kind="stable")[:, :kk]
            best = d[np.arange(len(qx))[:, None], idx]
            # a row beyond the query's k-th distance so far cannot be among its k nearest
            rr, cc = np.nonzero(best <= limit[start:start + QUERY_CHUNK, None])
            qk.append(qkeys_all[start + rr])
            tk.append(tkeys[idx[rr, cc]])
            lab.append(tlab[idx[rr, cc]])
            dist.append(best[rr, cc])
        return pd.DataFrame({"qkey": pd.Series(np.concatenate(qk), dtype=object),
                             "tkey": pd.Series(np.concatenate(tk), dtype=object),
                             "label": np.concatenate(lab), "d": np.concatenate(dist)})
    return fn


def _to_pivot(pivots: np.ndarray):
    """Rows with their nearest pivot ``p`` and the distance ``r`` to it."""
    norms = (pivots * pivots).sum(axis=1)

    def fn(batches):
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["x"].to_numpy()).astype(np.float64)
            p = np.concatenate([(norms - 2.0 * (x[i:i + QUERY_CHUNK] @ pivots.T)).argmin(axis=1)
                                for i in range(0, len(x), QUERY_CHUNK)])
            diff = x - pivots[p]
            yield b.assign(p=p.astype("int32"), r=np.sqrt((diff * diff).sum(axis=1)))
    return fn


def _visits(pivots: np.ndarray, cells: dict, k: int, mode: str):
    """The cells a query row goes to.

    ``home``: the nearest cells that together hold k rows.  ``rest``: every
    part within the bound ``tau`` not yet visited.  ``report``: a row of
    figures per query.  ``cells``: group -> arrays (cell, p, smallest, largest, n).
    """
    norms = (pivots * pivots).sum(axis=1)
    # rounding of a distance taken by a matrix product: root of the error of its square
    unit = 1e-7 * math.sqrt(pivots.shape[1])
    reach = math.sqrt(norms.max())

    def one_group(b, facts):
        cid, p, lo, hi, n = facts
        x = np.stack(b["x"].to_numpy()).astype(np.float64)
        tau = b["tau"].to_numpy(dtype=np.float64)
        for i in range(0, len(b), BOUND_CHUNK):
            qx = x[i:i + BOUND_CHUNK]
            qn = (qx * qx).sum(axis=1)
            to_pivot = np.sqrt(np.maximum(qn[:, None] + norms[None, :] - 2.0 * (qx @ pivots.T), 0.0))[:, p]
            bound = np.maximum(np.maximum(to_pivot - hi, lo - to_pivot), 0.0)
            order = np.lexsort((to_pivot, bound), axis=1)
            held = np.cumsum(n[order], axis=1)
            home = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(home, order, held - n[order] < k, axis=1)
            part = b.iloc[i:i + BOUND_CHUNK]
            if mode == "home":
                r, c = np.nonzero(home)
                yield part[["key", "x", "tau"]].iloc[r].assign(cell=cid[c].astype("int32"), first=np.int32(0))
                continue
            open_ = home | (bound <= (tau[i:i + BOUND_CHUNK] + unit * (np.sqrt(qn) + reach))[:, None])
            if mode == "rest":
                r, c = np.nonzero(open_)
                yield part[["key", "x", "tau"]].iloc[r].assign(cell=cid[c].astype("int32"),
                                                              first=home[r, c].astype("int32"))
            else:
                yield pd.DataFrame({"key": part["key"].to_numpy(), "cells_visited": open_.sum(axis=1),
                                    "rows_visited": open_ @ n, "cells": len(cid), "rows": int(n.sum())})

    def fn(batches):
        for b in batches:
            for g, rows in b.groupby("g", sort=False):
                if g in cells:
                    yield from one_group(rows, cells[g])
    return fn


def neighbours(train: DataFrame, query: DataFrame, k: int = 5, features_col: str = "features",
               label_col: str = "label", key_col: str = "__key", group_col: str | None = None,
               block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> Neighbours:
    """The k nearest training rows of every query row, exactly.

    ``group_col`` (e.g. the fold, at most ``MAX_CELLS`` values) restricts
    neighbours to training rows of the same group value.  Keys are unique per
    query row.  Fewer than k training rows: all of them; none: no rows.
    """
    spark = train.sparkSession

    def side(df, label):
        kind = df.schema[features_col].dataType.simpleString()
        x = vector_to_array(features_col) if kind == "vector" else F.col(features_col).cast("array<double>")
        g = F.col(group_col).cast("string") if group_col else F.lit("")
        return df.select(g.alias("g"), F.col(key_col).cast("string").alias("key"), x.alias("x"), label)

    t = side(train, F.col(label_col).cast("double").alias("label"))
    q = side(query, F.lit(float("inf")).alias("tau"))
    facts = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    if not facts["n"]:
        return Neighbours(spark.createDataFrame([], "key string, rank int, neighbour string, label double, d double"),
                          spark.createDataFrame([], "key string, cells_visited long, rows_visited long, cells long, rows long"))
    n_pivots = min(MAX_PIVOTS, math.ceil(facts["n"] / cell_rows), max(1, PIVOT_BYTES // (8 * max(1, facts["dim"]))))
    few = t.orderBy(F.xxhash64("key"), "key").limit(n_pivots).select("x").collect()
    pivots = np.unique(np.array([r["x"] for r in few], dtype=np.float64), axis=0)

    # cells: rows to pivots, then to rings by their distance; the facts of all cells are bounded by MAX_CELLS
    t = t.mapInPandas(_to_pivot(pivots), "g string, key string, x array<double>, label double, p int, r double")
    if len(pivots) > 1:
        t = cut_lineage(t)
    by_pivot = t.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")) \
        .limit(MAX_CELLS + 1).collect()
    if len(by_pivot) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} groups and pivots: use fewer groups")
    most = max(1, MAX_CELLS // len(by_pivot))
    rings = {(r["g"], r["p"]): 1 if r["hi"] == r["lo"] else min(most, math.ceil(r["n"] / cell_rows)) for r in by_pivot}
    if len(pivots) == 1 or max(rings.values()) == 1:
        # one cell a pivot
        t = t.withColumn("ring", F.lit(0))
        found = [(r["g"], r["p"], 0, r["n"], r["lo"], r["hi"]) for r in by_pivot]
    else:
        cuts = spark.createDataFrame([(r["g"], r["p"], r["lo"], r["hi"], rings[r["g"], r["p"]]) for r in by_pivot],
                                     "g string, p int, lo double, hi double, rings int")
        ring = F.when(F.col("rings") == 1, 0).otherwise(F.least(
            F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("rings")).cast("int"),
            F.col("rings") - 1))
        t = t.join(F.broadcast(cuts), ["g", "p"]).withColumn("ring", ring).drop("lo", "hi", "rings")
        found = [tuple(r) for r in t.groupBy("g", "p", "ring").agg(
            F.count(F.lit(1)), F.min("r"), F.max("r")).collect()]
    cells: dict = {}
    for g in {c[0] for c in found}:
        mine = [(i, c) for i, c in enumerate(found) if c[0] == g]
        cells[g] = (np.array([i for i, _ in mine]), np.array([c[1] for _, c in mine]),
                    np.array([c[4] for _, c in mine]), np.array([c[5] for _, c in mine]),
                    np.array([c[3] for _, c in mine], dtype=np.int64))
    ids = spark.createDataFrame([(c[0], c[1], c[2], i, math.ceil(c[3] / block_rows)) for i, c in enumerate(found)],
                                "g string, p int, ring int, cell int, parts int")
    t = t.join(F.broadcast(ids), ["g", "p", "ring"]).select(
        "key", "x", "label", "cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    parts = ids.select("cell", "parts")
    n_query = q.count()

    def visit(rows: DataFrame, mode: str) -> DataFrame:
        goes = rows.mapInPandas(_visits(pivots, cells, k, mode), "key string, x array<double>, tau double, cell int, first int")
        goes = goes.join(F.broadcast(parts), "cell")
        last = F.lit(0) if mode == "home" else F.col("parts") - 1
        goes = goes.where(F.col("first") <= last).withColumn("part", F.explode(F.sequence("first", last)))
        side = t
        if n_query <= block_rows:
            goes, side = goes.withColumn("qb", F.lit(0)), side.withColumn("qb", F.lit(0))
        else:
            # a cell's training rows are repeated once per block of the queries that visit it
            asked = goes.groupBy("cell").agg(F.ceil(F.countDistinct("key") / block_rows).cast("int").alias("blocks"))
            asked = cut_lineage(asked)   # at most one row a cell
            goes = goes.join(F.broadcast(asked), "cell").withColumn(
                "qb", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
            side = side.join(F.broadcast(asked), "cell").withColumn(
                "qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        on = ["cell", "part", "qb"]
        return (goes.select(*on, "key", "x", "tau").groupBy(*on)
                .cogroup(side.select(*on, "key", "x", "label").groupBy(*on))
                .applyInPandas(_cell_topk(k), _CAND_SCHEMA))

    by_distance = Window.partitionBy("qkey").orderBy("d", "tkey")
    cands = visit(q, "home")
    bounded = q
    if len(found) > len(cells) or max(c[3] for c in found) > block_rows:
        cands = cut_lineage(cands)
        kth = cands.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k) \
            .groupBy("qkey").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("kth"))
        bounded = q.join(kth, q["key"] == kth["qkey"], "left").select(
            "g", "key", "x", F.coalesce("kth", "tau").alias("tau"))
        cands = cands.unionByName(visit(bounded, "rest"))
    rows = cands.withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k) \
        .select(F.col("qkey").alias("key"), "rank", F.col("tkey").alias("neighbour"), "label", "d")
    return Neighbours(rows, bounded.mapInPandas(
        _visits(pivots, cells, k, "report"),
        "key string, cells_visited long, rows_visited long, cells long, rows long"))


def knn_predict(train: DataFrame, query: DataFrame, k: int = 5, features_col: str = "features",
                label_col: str = "label", key_col: str = "__key", group_col: str | None = None,
                block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Predicted label per query row: majority of its k nearest training rows (see :func:`neighbours`).

    Output: key, prediction.
    """
    near = neighbours(train, query, k, features_col, label_col, key_col, group_col, block_rows, cell_rows).rows
    votes = near.groupBy("key", "label").count()
    w = F.row_number().over(Window.partitionBy("key").orderBy(F.col("count").desc(), F.col("label")))
    return votes.withColumn("r", w).where("r = 1").select("key", F.col("label").alias("prediction"))


class KNNClassifier(Estimator):
    """k-NN (G5) as a pipeline estimator; the model keeps the training rows."""

    def __init__(self, k: int = 5, key_col: str = "__key"):
        super().__init__()
        self.k, self.key_col = k, key_col

    def _fit(self, df: DataFrame) -> "KNNModel":
        return KNNModel(df.select(self.key_col, "features", "label"), self.k, self.key_col)


class KNNModel(Model, Saved):
    def __init__(self, train: DataFrame, k: int, key_col: str):
        super().__init__()
        self.train, self.k, self.key_col = train, k, key_col

    def parts(self):
        return (self.k, self.key_col), {"train": self.train}, []

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(tables["train"], *state)

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.key_col not in df.columns:
            # new rows carry no key: number them once, written down so that both reads agree
            keyed = cut_lineage(df.withColumn(self.key_col, F.monotonically_increasing_id().cast("string")))
            return self._transform(keyed).drop(self.key_col)
        pred = knn_predict(self.train, df, self.k, key_col=self.key_col)
        return df.join(pred.withColumnRenamed("key", "__knn_key"),
                       F.col(self.key_col).cast("string") == F.col("__knn_key"), "left").drop("__knn_key")
