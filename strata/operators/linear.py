"""Linear models of all folds from the same passes (survey G1, G10-G12, H5).

Least squares, ridge and lasso need only counts, means and centred products of
the features and the label: one job gives them for every fold's view, partial
matrices of tasks being merged by the pairwise formula, so nothing is lost to
cancellation.  Cholesky factors solve the first two, coordinate descent on the
product matrix the third; any number of such models share the pass.  Where all
folds have the same features (``by_fold``), the statistics of each fold's rows
are taken once and a fold's training statistics are those of the others merged.

Logistic models of all folds take one job an iteration: it returns every
fold's loss, gradient and curvature, and the driver makes a Newton step for
each fold that has not converged.  Matrices are as wide as the features, not
as long as the rows; above MAX_WIDTH columns the built-in estimators are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.boost import _union, _values
from strata.operators.cells import WEIGHT, merged, weight
from strata.operators.persist import Saved

MAX_WIDTH = 2_048
#: Newton steps at most, and the gradient (per row) at which a fold is done.
MAX_STEPS, TOLERANCE = 100, 1e-8
#: Rows of one product of all pairs of classes.
PIECE_ROWS = 1_024


# products -----------------------------------------------------------------------------------------

@dataclass
class Products:
    """Count, means and centred products of the columns (features, then the label)."""
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def merge(self, o: "Products") -> "Products":
        if not self.n or not o.n:
            return self if self.n else o
        n, d = self.n + o.n, o.mean - self.mean
        return Products(n, self.mean + d * (o.n / n), self.scatter + o.scatter + np.outer(d, d) * (self.n * o.n / n))

    @classmethod
    def of(cls, z: np.ndarray, w: np.ndarray | None = None) -> "Products":
        """Products of the rows of ``z``, each of which stands for ``w`` rows."""
        if w is None:
            mean = z.mean(axis=0)
            c = z - mean
            return cls(float(len(z)), mean, c.T @ c)
        mean = w @ z / w.sum()
        c = z - mean
        return cls(float(w.sum()), mean, (w[:, None] * c).T @ c)


_PRODUCTS = "model int, n double, mean binary, scatter binary"


def _row(m: int, p: Products) -> dict:
    return {"model": m, "n": p.n, "mean": p.mean.tobytes(), "scatter": p.scatter.tobytes()}


def _read(r) -> Products:
    mean = np.frombuffer(r["mean"])
    return Products(r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1))


_ARROW = pa.schema([("model", pa.int32()), ("n", pa.float64()), ("mean", pa.binary()), ("scatter", pa.binary())])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Products] = {}
    for b in batches:
        model = b.column("model").to_numpy()
        z = np.concatenate([_values(b.column("x")), b.column("y").to_numpy()[:, None]], axis=1) if len(model) else np.zeros((0, 0))
        w = b.column("w").to_numpy() if "w" in b.schema.names else None
        for m in np.unique(model):
            p = Products.of(z[model == m], None if w is None else w[model == m])
            held[int(m)] = held[int(m)].merge(p) if int(m) in held else p
    yield pa.RecordBatch.from_pylist([_row(m, p) for m, p in held.items()], _ARROW)


def _merged(key: tuple, t: pa.Table) -> pa.Table:
    out = None
    for r in sorted(t.to_pylist(), key=lambda r: (r["n"], r["mean"])):
        out = _read(r) if out is None else out.merge(_read(r))
    return pa.Table.from_pylist([_row(key[0].as_py(), out)], _ARROW)


def products(rows: DataFrame) -> dict[int, Products]:
    """Products of every model's rows (model, x, y and, if they stand for several, w)."""
    got = rows.select("model", "x", "y", *[c for c in rows.columns if c == "w"]).mapInArrow(_partial, _PRODUCTS).groupBy("model").applyInArrow(_merged, _PRODUCTS).collect()
    return {r["model"]: _read(r) for r in got}


def by_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int] | None = None) -> dict[int, Products]:
    """Training products of every fold (or of ``folds``), from one pass over all rows."""
    own = products(df.select(F.col(fold).cast("int").alias("model"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                             F.col(label).cast("double").alias("y")))
    out = {}
    for f in own if folds is None else folds:
        rest = Products(0.0, np.zeros(len(features) + 1), np.zeros((len(features) + 1,) * 2))
        for g in sorted(own):
            rest = rest if g == f else rest.merge(own[g])
        out[f] = rest
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cholesky where the matrix is safely positive, else the least-norm solution (constant or dependent columns)."""
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    if len(b) and scale.min() > 0 and np.linalg.cond(a / np.outer(scale, scale)) < 1e12:
        c = np.linalg.cholesky(a)
        return np.linalg.solve(c.T, np.linalg.solve(c, b))
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def ridge(p: Products, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ||y - Xw||^2 + alpha ||w||^2; alpha 0 is least squares."""
    s, c = p.scatter[:-1, :-1], p.scatter[:-1, -1]
    w = _solve(s + alpha * np.eye(len(c)), c)
    return w, float(p.mean[-1] - w @ p.mean[:-1])


def lasso(p: Products, alpha: float, max_iter: int = 1000, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of ||y - Xw||^2 / 2n + alpha |w|, by coordinate descent."""
    s, c = p.scatter[:-1, :-1] / p.n, p.scatter[:-1, -1] / p.n
    w, d = np.zeros(len(c)), np.diag(s)
    for _ in range(max_iter):
        most = 0.0
        for j in np.flatnonzero(d > 0):
            old = w[j]
            rest = c[j] - s[j] @ w + d[j] * old
            w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / d[j]
            most = max(most, abs(w[j] - old) * np.sqrt(d[j]))
        if most <= tolerance * np.sqrt(max(p.scatter[-1, -1] / p.n, 1e-300)):
            break
    return w, float(p.mean[-1] - w @ p.mean[:-1])


def _view_rows(views: list[tuple[int, DataFrame, DataFrame | None]]) -> DataFrame:
    return _union([t.select(F.lit(m).cast("int").alias("model"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"),
                            *([weight(t).alias("w")] if WEIGHT in t.columns else [])) for m, t, _ in views])


def _width(df: DataFrame) -> int:
    r = df.select("features").first()
    if r is None:
        raise ValueError("a model has no training rows")
    return r["features"].size


def _predicted(models: dict[int, Model], views) -> DataFrame:
    return _union([models[m].transform(h).select(F.lit(m).alias("model"), F.col("__key").alias("key"), F.col("label").cast("double").alias("y"), "prediction")
                   for m, _, h in views if h is not None])


def fit_least_squares(views, kind: str, alpha: float, max_iter: int, memo: dict) -> dict[int, "LinearModel"]:
    """Models of all views; ``memo`` keeps the products for further models of the same views."""
    if "products" not in memo:
        memo["products"] = products(_view_rows(views))
    solve = {"lasso": lambda p: lasso(p, alpha, max_iter), "ridge": lambda p: ridge(p, alpha), "ols": lambda p: ridge(p, 0.0)}[kind]
    return {m: LinearModel(*solve(p)) for m, p in memo["products"].items()}


class LeastSquares(Estimator):
    """Least squares (``ols``), ``ridge`` or ``lasso`` of a single table."""

    def __init__(self, kind: str, alpha: float = 0.0, max_iter: int = 1000):
        super().__init__()
        self.kind, self.alpha, self.max_iter = kind, alpha, max_iter

    def _fit(self, df: DataFrame) -> Model:
        if _width(df) > MAX_WIDTH:
            return self._built_in(df)
        return fit_least_squares([(0, df, None)], self.kind, self.alpha, self.max_iter, {})[0]

    def _built_in(self, df: DataFrame) -> Model:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
        net = {"ols": (0.0, 0.0), "ridge": (self.alpha * (r["s"] or 1.0) / max(r["n"], 1), 0.0), "lasso": (self.alpha, 1.0)}[self.kind]
        return LinearRegression(regParam=net[0], elasticNetParam=net[1], standardization=False, maxIter=self.max_iter).fit(df)

    def fit_views(self, views, memo: dict) -> DataFrame:
        """Held-out predictions of all views."""
        if "products" not in memo and any(_width(t) > MAX_WIDTH for _, t, _ in views):
            return _predicted({m: self._built_in(t) for m, t, _ in views}, views)
        return _predicted(fit_least_squares(views, self.kind, self.alpha, self.max_iter, memo), views)


class LinearModel(Model, Saved):
    def __init__(self, w: np.ndarray, intercept: float):
        super().__init__()
        self.coefficients, self.intercept = DenseVector(w), intercept

    def parts(self):
        return (self.coefficients.toArray(), self.intercept), {}, []

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(*state)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _dot(self.coefficients.toArray()) + float(self.intercept))


#: Up to this many features a product is written out, which is compiled.
DOT_WIDTH = 64


def _dot(w: np.ndarray) -> F.Column:
    x = vector_to_array("features")
    if len(w) <= DOT_WIDTH:
        return reduce(lambda a, i: a + x[i] * F.lit(float(w[i])), range(len(w)), F.lit(0.0))
    terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


# logistic -----------------------------------------------------------------------------------------

def _curvature(z: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Second derivatives of the log losses of several classes, weights ``r``: outputs i and j meet in
    z' diag(r p_i ((i == j) - p_j)) z, so all pairs are one symmetric product of rows of p_i * z, a piece of rows at a time."""
    k, d = p.shape[1], z.shape[1]
    h = np.zeros((k * d, k * d))
    for a in range(0, len(z), PIECE_ROWS):
        x, q, u = z[a:a + PIECE_ROWS], p[a:a + PIECE_ROWS], r[a:a + PIECE_ROWS, None]
        wide = ((np.sqrt(u) * q)[:, :, None] * x[:, None, :]).reshape(len(x), k * d)
        h -= wide.T @ wide
        for i in range(k):
            h[i * d:(i + 1) * d, i * d:(i + 1) * d] += (x * (u * q[:, i:i + 1])).T @ x
    return h


def _curves(points: dict[int, np.ndarray], shift: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Loss, gradient and curvature of every model at its point (outputs, features + 1), over features brought to mean 0 and deviation 1."""
    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            model = b.column("model").to_numpy()
            x, y = _values(b.column("x")), b.column("y").to_numpy()
            weight = b.column("w").to_numpy() if "w" in b.schema.names else np.ones(len(x))
            for m in np.unique(model):
                if int(m) not in points:
                    continue
                w, (mean, scale) = points[int(m)], shift[int(m)]
                z = np.concatenate([(x[model == m] - mean) / scale, np.ones(((model == m).sum(), 1))], axis=1)
                t, k, r = y[model == m].astype(int), len(w), weight[model == m]
                a = z @ w.T
                if k == 1:
                    p = 1 / (1 + np.exp(-a))
                    loss = np.logaddexp(0, a[:, 0]) @ r - a[t == 1, 0] @ r[t == 1]
                    g, h = (r[:, None] * (p - t[:, None])).T @ z, (z * (r[:, None] * p * (1 - p))).T @ z
                else:
                    a -= a.max(axis=1, keepdims=True)
                    e = np.exp(a)
                    p = e / e.sum(axis=1, keepdims=True)
                    loss = (np.log(e.sum(axis=1)) - a[np.arange(len(t)), t]) @ r
                    hit = np.zeros_like(p)
                    hit[np.arange(len(t)), t] = 1
                    g = (r[:, None] * (p - hit)).T @ z
                    h = _curvature(z, p, r)
                new = [loss, g.ravel(), h]
                held[int(m)] = [u + v for u, v in zip(held[int(m)], new)] if int(m) in held else new
        yield pa.RecordBatch.from_pylist([{"model": m, "n": float(v[0]), "mean": v[1].tobytes(), "scatter": np.ascontiguousarray(v[2]).tobytes()} for m, v in held.items()], _ARROW)
    return curves


def _added(key: tuple, t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: (r["n"], r["mean"]))
    return pa.Table.from_pylist([{"model": key[0].as_py(), "n": sum(r["n"] for r in rows), "mean": sum(np.frombuffer(r["mean"]) for r in rows).tobytes(),
                                  "scatter": sum(np.frombuffer(r["scatter"]) for r in rows).tobytes()}], _ARROW)


def fit_logistic(views, n_classes: int, c: float, tolerance: float = TOLERANCE, memo: dict | None = None) -> tuple[dict[int, "LogisticModel"], int]:
    """Models of all views at the optimum of c * (sum of log losses) + ||w||^2 / 2, and the number of passes."""
    k, memo = (1 if n_classes <= 2 else n_classes), {} if memo is None else memo
    rows = _view_rows(views)
    if "products" not in memo:
        memo["products"] = products(rows)
    stats = memo["products"]
    shift, penalty, points = {}, {}, {}
    for m, p in stats.items():
        scale = np.sqrt(np.maximum(np.diag(p.scatter)[:-1] / p.n, 0))
        scale = np.where(scale > 0, scale, 1.0)
        shift[m] = (p.mean[:-1], scale)
        # w = v / scale: the penalty is on the coefficients of the features as given, the intercept is free
        penalty[m] = np.tile(np.append(1 / scale ** 2, 0.0), k) / c
        points[m] = np.zeros((k, len(scale) + 1))
    done: dict[int, np.ndarray] = {}
    best: dict[int, tuple] = {}                     # model -> (point, loss, direction, step)
    passes = 0
    few = merged(rows, True)                        # rows of equal features and class add the same terms
    rows = rows.persist() if few is None else few
    while points and passes < MAX_STEPS:
        passes += 1
        got = rows.mapInArrow(_curves(points, shift), _PRODUCTS).groupBy("model").applyInArrow(_added, _PRODUCTS).collect()
        for r in got:
            m = r["model"]
            v = points[m].ravel()
            loss = r["n"] + (penalty[m] * v * v).sum() / 2
            g = np.frombuffer(r["mean"]) + penalty[m] * v
            h = np.frombuffer(r["scatter"]).reshape(len(v), -1) + np.diag(penalty[m])
            if np.abs(g).max() <= tolerance * stats[m].n:
                done[m] = points.pop(m)
                continue
            if m in best and loss > best[m][1] + 1e-12 * abs(best[m][1]) and best[m][3] > 1e-10:
                at, was, direction, step = best[m]   # the step was too long
                best[m] = (at, was, direction, step / 2)
                points[m] = (at + direction * step / 2).reshape(k, -1)
                continue
            # several classes: adding the same to all intercepts changes nothing, a little weight makes the matrix regular
            direction = -np.linalg.solve(h + 1e-10 * np.trace(h) / len(h) * np.eye(len(h)), g)
            best[m] = (v, loss, direction, 1.0)
            points[m] = (v + direction).reshape(k, -1)
    rows.unpersist()
    done |= points
    out = {}
    for m, v in done.items():
        w = v[:, :-1] / shift[m][1]
        out[m] = LogisticModel(w, v[:, -1] - w @ shift[m][0])
    return out, passes


class Logistic(Estimator):
    """Logistic regression with an L2 penalty, the optimum of a single table."""

    def __init__(self, n_classes: int, c: float = 1.0, max_iter: int = 1000):
        super().__init__()
        self.n_classes, self.c, self.max_iter = n_classes, c, max_iter

    def _wide(self, df: DataFrame) -> bool:
        return _width(df) * (1 if self.n_classes <= 2 else self.n_classes) > MAX_WIDTH

    def _built_in(self, df: DataFrame) -> Model:
        n = df.agg(F.sum(weight(df))).first()[0] or 1.0
        lr = LogisticRegression(maxIter=self.max_iter, regParam=1.0 / (self.c * n), elasticNetParam=0.0, standardization=False, tol=1e-4)
        return (lr.setWeightCol(WEIGHT) if WEIGHT in df.columns else lr).fit(df)

    def _fit(self, df: DataFrame) -> Model:
        return self._built_in(df) if self._wide(df) else fit_logistic([(0, df, None)], self.n_classes, self.c)[0][0]

    def fit_views(self, views, memo: dict) -> DataFrame:
        if any(self._wide(t) for _, t, _ in views):
            return _predicted({m: self._built_in(t) for m, t, _ in views}, views)
        return _predicted(fit_logistic(views, self.n_classes, self.c, memo=memo)[0], views)


class LogisticModel(Model, Saved):
    def __init__(self, w: np.ndarray, intercept: np.ndarray):
        super().__init__()
        self.w, self.intercept = w, intercept

    def parts(self):
        return (self.w, self.intercept), {}, []

    @classmethod
    def from_parts(cls, state, tables, models):
        return cls(*state)

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        return DenseMatrix(*self.w.shape, self.w.ravel(order="F"))

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = [_dot(w) + float(b) for w, b in zip(self.w, self.intercept)]
        out = df.withColumn("__margin", F.array(*margin))
        if len(margin) == 1:
            p = 1 / (1 + F.exp(-F.col("__margin")[0]))
            out = out.withColumn("__p", F.array(1 - p, p))
        else:
            e = F.transform("__margin", lambda v: F.exp(v - F.array_max("__margin")))
            out = out.withColumn("__e", e).withColumn("__p", F.transform("__e", lambda v: v / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))).drop("__e")
        return out.withColumn("probability", array_to_vector("__p")).withColumn(
            "prediction", (F.array_position("__p", F.array_max("__p")) - 1).cast("double")).drop("__margin", "__p")
