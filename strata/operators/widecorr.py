"""Pearson matrix of very many columns, pairwise complete (survey D6, D7).

Columns go to Arrow as one array a row; a task adds up matrix products of the
values (less each column's mean) and of their presence masks, which give count,
sums, squares and cross products of every pair over the rows where both are
present.  The sums leave the task as pairs of column blocks, are added up by a
shuffle over block pairs, and become one row a pair there: neither an
expression nor a number in the driver for every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.boost import _values

#: Columns of a block; more columns than ABOVE take this way.
BLOCK, ABOVE = 256, 50
#: Deviations below this share of a column's size count as none.
FLAT = 1e-12


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = most = None
    for b in batches:
        x = _values(b.column("x"))
        if not len(x):
            continue
        here, v = ~np.isnan(x), np.nan_to_num(x)
        new = here.sum(axis=0), v.sum(axis=0), np.abs(v).max(axis=0)
        n, total, most = new if n is None else (n + new[0], total + new[1], np.maximum(most, new[2]))
    if n is not None:
        yield pa.record_batch({"col": pa.array(range(len(n)), pa.int32()), "n": pa.array(n, pa.int64()), "total": pa.array(total), "most": pa.array(most)})


def _sums(mean: np.ndarray, block: int) -> Callable:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = len(mean), {}
        starts = range(0, p, block)
        for b in batches:
            x = _values(b.column("x"))
            if not len(x):
                continue
            here = (~np.isnan(x)).astype(np.float64)
            v = np.where(np.isnan(x), 0.0, x - mean)
            for i in starts:
                for j in starts:
                    if j < i:
                        continue
                    a, c = slice(i, i + block), slice(j, j + block)
                    new = np.stack([here[:, a].T @ here[:, c], v[:, a].T @ here[:, c], here[:, a].T @ v[:, c], (v[:, a] ** 2).T @ here[:, c],
                                    here[:, a].T @ v[:, c] ** 2, v[:, a].T @ v[:, c]])
                    held[i, j] = held[i, j] + new if (i, j) in held else new
        for (i, j), v in held.items():
            yield pa.record_batch({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "sums": pa.array([v.tobytes()], pa.binary())})
    return sums


def _pairs(size: np.ndarray, block: int) -> Callable:
    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        a, c = np.arange(i, min(i + block, len(size))), np.arange(j, min(j + block, len(size)))
        n, sx, sy, sxx, syy, sxy = sum(np.frombuffer(s).reshape(6, len(a), len(c)) for s in sorted(t["sums"].to_pylist()))
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            flat = (n < 2) | (vx <= n * (FLAT * size[a])[:, None] ** 2) | (vy <= n * (FLAT * size[c])[None] ** 2)
            r = np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1, 1)
        keep = a[:, None] <= c[None]
        x, y = np.nonzero(keep)
        return pa.table({"a": pa.array(a[x], pa.int32()), "b": pa.array(c[y], pa.int32()), "r": pa.array(r[keep], pa.float64(), mask=flat[keep])})
    return pairs


def wide_correlation(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """(col_a, col_b, r) of every ordered pair; r is NULL where a side is constant in the pair's complete rows."""
    x = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    facts = {r["col"]: r for r in x.mapInArrow(_facts, "col int, n long, total double, most double").groupBy("col").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).collect()}
    mean = np.array([facts[i]["total"] / facts[i]["n"] if i in facts and facts[i]["n"] else 0.0 for i in range(len(cols))])
    size = np.array([facts[i]["most"] if i in facts else 0.0 for i in range(len(cols))])
    parts = x.mapInArrow(_sums(mean, block), "i int, j int, sums binary")
    found = parts.groupBy("i", "j").applyInArrow(_pairs(size, block), "a int, b int, r double")
    both = found.unionByName(found.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.element_at(names, F.col("a") + 1).alias("col_a"), F.element_at(names, F.col("b") + 1).alias("col_b"), "r")
