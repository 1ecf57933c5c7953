"""Training: stratified CV of a model list, leaderboard, refit of the winner (2.H).

Per fold the cleaning, feature and preprocessing stages are fitted once on
the training rows and the assembled vectors are cached; every model of the
list then fits on those cached vectors (k preprocessing fits instead of
k x m); boosters, forests and linear models fit all folds in the same jobs.  Held-out rows only pass through fitted stages, so no statistic
sees them.  Out-of-fold predictions of all models form one table that is
scored in one set of jobs.

Above STORE_FROM rows nothing of the size of the rows is cached: the folded rows
are a Parquet table in the shared folder, which holds them in a tenth of a cache's
space, the folds' vectors are made when they are read, and predictions are tallied
without being kept.  Where the feature columns take few different values and the
models allow it (``models.OF_CELLS``), a row with a weight stands for all rows that
are equal in them, the label and the fold (``cells``): statistics, training, held-out
predictions and scores go over these cells, and only the out-of-fold table, if it is
read, joins their predictions to the rows.
"""

from __future__ import annotations

import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import PythonException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import types as TY
from strata.functions.features import FeatureStep
from strata.operators import cv as CV
from strata.operators import forest
from strata.operators import models as M
from strata.operators import prep as PR
from strata.operators.cells import WEIGHT, cells
from strata.operators.clean import ColumnCleaner, ColumnCleanerModel
from strata.operators.profile import detect_task
from strata.session import checkpoint_dir
from strata.sources.readers import require_column

#: Rows above which the folded rows are stored instead of cached.
STORE_FROM = 500_000


@dataclass
class TrainResult:
    status: str
    task_type: str
    best_model_name: str
    cv_score: float
    cv_loss: float
    leaderboard: DataFrame | None = None
    oof: DataFrame | None = None
    fold_losses: DataFrame | None = None
    pipeline: PipelineModel | None = None
    feature_names: list[str] = field(default_factory=list)
    importance: DataFrame | None = None
    errors: dict = field(default_factory=dict)
    fe_error: str | None = None
    labels: list[str] | None = None
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Drop the cached out-of-fold predictions (the leaderboard then recomputes)."""
        for df in self.cached:
            df.unpersist()
        self.cached = []


class TrainingFailed(RuntimeError):
    """A training that lacks a model which was asked for."""


def whole(result: TrainResult) -> TrainResult:
    """``result`` if every model was trained in every fold; a missing one is an error, not a shorter or empty board."""
    if result.status != "complete" or result.errors:
        raise TrainingFailed("; ".join(f"{m}: {e}" for m, e in sorted(result.errors.items())) or result.status)
    return result


def _skipped(e: Exception) -> str:
    """Text of an error for which a model is left out.

    That is one of the model and its rows: a lost job, executor, worker or disk says
    nothing about them and ends the run.
    """
    lost = isinstance(e, PythonException) and any(t in str(e) for t in ("MemoryError", "No space left on device"))
    if lost or isinstance(e, (Py4JError, OSError, MemoryError)):
        raise e
    return f"{type(e).__name__}: {e}"


def _label(df: DataFrame, target: str, task: str):
    if task == "classification":
        idx = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df)
        return idx.transform(df), list(idx.labels)
    return df.withColumn("label", F.col(target).cast("double")), None


def _prepare_fold(train: DataFrame, val: DataFrame, target: str, passthrough: list[str],
                  fe_step: FeatureStep | None, scaler: str, cleaning: dict | None, mode: str = "auto",
                  val_rows: bool = True):
    """Fit cleaning -> features -> preprocessing on ``train``; vectors for both sides."""
    opts = {"distinctMode": "exact", **(cleaning or {})}
    cleaner = ColumnCleaner(excludeCols=passthrough, **opts).fit(train)
    stages = [cleaner]
    tr, va = cleaner.transform(train), cleaner.transform(val)
    fe_error = None
    if fe_step is not None:
        # the step sees feature columns only; valid on both sides, or the identity on both (K1, K3)
        fem = fe_step.over([c for c in passthrough if c in tr.columns], "__key").fit(tr)
        fe_error = fem.error or (fem.problem(va) if val_rows else None)
        if fe_error is None:
            tr, va = fem.transform(tr), fem.transform(va)
            stages.append(fem)
    feats = [c for c in tr.columns if c not in passthrough]
    num = [c for c in feats if TY.is_real_numeric(tr.schema[c].dataType)]
    cat = [c for c in feats if c not in num]
    prep = PR.fit_preprocessor(tr, num, cat, scaler, mode)
    stages.append(prep)
    keep = [c for c in passthrough if c in tr.columns] + ["features"]
    return (prep.transform(tr).select(*keep), prep.transform(va).select(*keep), stages,
            PR.feature_names(prep), fe_error)


@dataclass
class Prepared:
    """Labelled rows with their fold, cached or stored once and shared by several trainings."""
    data: DataFrame
    task: str
    labels: list[str] | None
    n_rows: int
    k: int
    stored: bool = False
    cells: DataFrame | None = None      # rows of equal features, fold and (for classes) label, as one

    def release(self) -> None:
        self.data.unpersist()


def prepare(df: DataFrame, target: str, task: str, key_cols: list[str] | None = None, k: int = 5,
            seed: int = 42) -> Prepared:
    """Label, assign stratified folds and keep the rows (H1-H4); reused across search rounds."""
    data = df.where(F.col(target).isNotNull())
    n = data.count()
    labels = None
    if n <= STORE_FROM:
        data, labels = _label(data, target, task)
    if task == "classification":
        data = CV.assign_folds(data, k, strata_col=target, key_cols=key_cols, seed=seed)
    else:
        data = CV.regression_strata(data, target, k, out_col="__stratum", key_cols=key_cols, seed=seed)
        data = CV.assign_folds(data, k, strata_col="__stratum", key_cols=key_cols, seed=seed).drop("__stratum")
    key = CV.key_string(df, key_cols)
    if n > STORE_FROM and key_cols:     # what follows from a row's columns is not stored with it
        data = _written(data)
    data = data.withColumn("__key", key)
    if not key_cols:  # equal rows get a number each, so that keys are unique
        copy = F.row_number().over(Window.partitionBy("__key").orderBy("fold"))
        data = data.withColumn("__key", F.concat_ws("#", "__key", copy.cast("string")))
    if n <= STORE_FROM:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        return Prepared(data, task, labels, data.count(), k)
    data = data if key_cols else _written(data)
    features = [c for c in data.columns if c not in (target, "fold", "__key", *(key_cols or []))]
    few = cells(data, [*features, *([target] if task == "classification" else []), "fold"], None if task == "classification" else target)
    if few is not None:
        few = _written(few.withColumn("__key", F.monotonically_increasing_id().cast("string")))
    data, labels = _label(data, target, task)
    if few is not None:
        few = _label(few, target, task)[0]
    return Prepared(data, task, labels, n, k, True, few)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/strata-rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _of_cells(prep_rows: Prepared, task: str, models: list[str], target: str) -> bool:
    """Whether all the models may be trained on the cells."""
    if prep_rows.cells is None or any(m not in M.OF_CELLS[task] for m in models):
        return False
    if "Random Forest" not in models:
        return True
    sets = prep_rows.cells.drop("fold", "label", "__key", WEIGHT).distinct().count()
    return sets <= forest.SMALL_ROWS


def _of_rows(held: DataFrame, few: DataFrame, data: DataFrame, columns: list[str], classes: bool) -> DataFrame:
    """Out-of-fold rows (model, key, fold, y, prediction) from those of the cells, which agree with their rows in ``columns``."""
    at = few.select("__key", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)]).join(
        held.select("key", F.col("model").alias("__model"), F.col("y").alias("__y"), F.col("prediction").alias("__prediction")),
        F.col("__key") == F.col("key")).drop("__key", "key")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(columns)])
    return data.join(F.broadcast(at), same).select(F.col("__model").alias("model"), F.col("__key").alias("key"), "fold",
                                                   F.col("__y" if classes else "label").alias("y"), F.col("__prediction").alias("prediction"))


@dataclass
class Recipe:
    """What a fold's stages do to the feature columns: fills, centres and scales of the numbers, values of the categories."""
    kept: list[str]
    fills: dict[str, float]
    affine: dict[str, tuple[float, float]]
    values: dict[str, list[str]]


def _recipe(rows: DataFrame, fs, f: int, scaler: str, cleaning: dict | None, feature_cols: list[str]) -> Recipe:
    """A fold's cleaning and preprocessing from the shared fold statistics."""
    from strata.operators.clean import cleaning_report_rows

    fields = {x.name: x.dataType for x in rows.schema.fields}
    n = fs.n_rows[f]
    kept = cleaning_report_rows(
        [(c, n, fs.n_unique[f].get(c, 0), (fs.nulls[f][c] / n) if n else 0.0,
          fs.moments[f][c].var_samp() if c in fs.moments[f] else None,
          TY.is_float(fields[c]), TY.is_numeric(fields[c]), TY.is_real_numeric(fields[c]))
         for c in feature_cols], **dict(cleaning or {}))
    num = [c for c in kept if TY.is_real_numeric(fields[c])]
    fills = {c: fs.fills[f][c] if fs.nulls[f][c] else 0.0 for c in num}
    affine: dict[str, tuple[float, float]] = {}
    if scaler == "standard":
        from strata.operators.foldstats import Moments
        # the scaler sees imputed values: add the NULLs back as copies of the fill value
        mom = {c: fs.moments[f][c].merge(Moments(float(fs.nulls[f][c]), fills[c], 0.0)) for c in num}
        affine = {c: (mom[c].mean if mom[c].n else 0.0, mom[c].std_pop() or 1.0) for c in num}
    elif num and scaler != "robust":
        raise ValueError(f"unknown scaling method {scaler!r}")
    elif num:
        quartiles = {c: fs.quartiles[f][c] for c in num}
        affine = {c: (q[1] if q[1] is not None else 0.0, (q[2] - q[0] if q[0] is not None else 0.0) or 1.0) for c, q in quartiles.items()}
    return Recipe(kept, fills, affine, {c: sorted(fs.vocab[f][c]) for c in kept if c not in fills})


def _prepare_fold_shared(train_rows: DataFrame, val_rows: DataFrame, passthrough: list[str], fs, f: int,
                         scaler: str, cleaning: dict | None, mode: str, feature_cols: list[str]):
    """Fold stages built from the shared fold statistics (no feature step)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler

    recipe = _recipe(train_rows, fs, f, scaler, cleaning, feature_cols)
    kept, num, cat = recipe.kept, list(recipe.fills), list(recipe.values)
    cleaner = ColumnCleanerModel(keptCols=kept, droppedCols=[c for c in feature_cols if c not in kept],
                                 excludeCols=passthrough)
    stages: list = [cleaner]
    if num:
        stages.append(PR.FillModel(inputCols=num, values=[recipe.fills[c] for c in num]))
        stages.append(PR.AffineModel(inputCols=num, centers=[recipe.affine[c][0] for c in num], scales=[recipe.affine[c][1] for c in num]))
    ohe = []
    if cat:
        stages.append(PR.CategoricalFill(inputCols=cat))
        for c in cat:
            stages.append(StringIndexerModel.from_labels(recipe.values[c], inputCol=c,
                                                         outputCol=f"{c}__idx", handleInvalid="keep"))
        ohe = [f"{c}__ohe" for c in cat]
        enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=ohe, dropLast=True)
        stages.append(enc.fit(PipelineModel(stages=list(stages)).transform(train_rows.limit(0))))
    stages.append(VectorAssembler(inputCols=num + ohe, outputCol="features", handleInvalid="keep"))
    model = PipelineModel(stages=stages)
    keep = [c for c in passthrough if c in train_rows.columns] + ["features"]
    return (model.transform(train_rows).select(*keep), model.transform(val_rows).select(*keep), [model],
            PR.feature_names(model), None)


def _shared_products(data: DataFrame, recipes: dict[int, Recipe], gaps: set[str]):
    """Training products of every fold's features, from one pass over the rows; None where they would be too wide.

    A fold's features are sums of columns that all folds share: the numbers
    with NULLs at a common value, marks of the NULLs (columns ``gaps``), and
    a 0/1 column for each category.
    """
    from strata.operators import linear as L

    refs: dict[str, float] = {}
    values: dict[str, list[str]] = {}
    for r in recipes.values():
        for c, v in r.fills.items():
            refs.setdefault(c, v)
        for c, v in r.values.items():
            values[c] = sorted({*values.get(c, []), *v})
    slots = [*((c, None) for c in refs), *((c, True) for c in refs if c in gaps), *((c, v) for c in values for v in values[c])]
    if not slots or len(slots) > L.MAX_WIDTH:
        return None

    def column(c, v):
        if v is None:
            return F.coalesce(F.col(c).cast("double"), F.lit(float(refs[c])))
        if v is True:
            return F.col(c).isNull().cast("double")
        return (F.coalesce(F.col(c).cast("string"), F.lit(PR.MISSING_TOKEN)) == F.lit(v)).cast("double")

    at = {slot: i for i, slot in enumerate(slots)}
    names = [f"u{i}" for i in range(len(slots))]
    own = data.select(*[column(c, v).alias(u) for u, (c, v) in zip(names, slots)], "label", "fold")
    training = L.by_fold(own, names, "label", "fold", list(recipes))
    out = {}
    for f, r in recipes.items():
        p = training[f]
        if not p.n:
            continue
        rows = [(c, None) for c in r.fills] + [(c, v) for c in r.values for v in r.values[c]]
        a, shift = np.zeros((len(rows) + 1, len(slots) + 1)), np.zeros(len(rows) + 1)
        for i, (c, v) in enumerate(rows):
            center, scale = r.affine[c] if v is None else (0.0, 1.0)
            a[i, at[c, v]], shift[i] = 1 / scale, -center / scale
            if v is None and c in gaps:
                a[i, at[c, True]] = (r.fills[c] - refs[c]) / scale
        a[-1, -1] = 1.0
        out[f] = L.Products(p.n, a @ p.mean + shift, a @ p.scatter @ a.T)
    return out


def train(df: DataFrame, target: str, task_type: str | None = None, key_cols: list[str] | None = None,
          models: list[str] | str | None = None, model_params: dict | None = None, k: int = 5, seed: int = 42,
          fe_step: FeatureStep | None = None, scaler: str = "standard", cleaning: dict | None = None,
          refit: bool = True, explain: bool = True, explain_rows: int = 300,
          parallelism: int = 4, prepared: Prepared | None = None) -> TrainResult:
    """Cross-validate the models, rank them, refit the best on all rows.

    ``models="configured"`` takes the task's configured list (G20).
    ``prepared`` (from :func:`prepare`) reuses an already folded and cached
    table; otherwise one is built and released at the end.
    """
    require_column(df, target)
    task = (prepared.task if prepared is not None else None) or task_type or \
        detect_task(df, target).first()["task_type"]
    models = M.CONFIGURED_MODELS[task] if models == "configured" else models or M.DEFAULT_MODELS[task]
    model_params = model_params or {}
    own = prepared is None
    prep_rows = prepare(df, target, task, key_cols, k, seed) if own else prepared
    data, labels, n_rows, k = prep_rows.data, prep_rows.labels, prep_rows.n_rows, prep_rows.k
    mode = "exact" if n_rows <= PR.EXACT_ROW_LIMIT else "bracket"   # exact quantiles either way
    passthrough = [target, "label", "fold", "__key", WEIGHT] + list(key_cols or [])

    feature_cols = [c for c in data.columns if c not in passthrough]
    rows, lean = data, prep_rows.stored and fe_step is None
    if few := lean and _of_cells(prep_rows, task, models, target):
        data = prep_rows.cells
    shared = None
    if fe_step is None:
        # every fold's training statistics from two jobs (see operators/foldstats.py)
        from strata.operators.foldstats import fold_statistics
        shared = fold_statistics(data, feature_cols, "label", k, PR.MAX_CATEGORIES, scaler=scaler, rows=rows)
    # a table of rows is tallied as it is predicted, one of cells is kept
    hold = _materialize if few or not lean else (lambda pred: pred)

    # models that train all folds in the same passes, after the folds are prepared
    joint = {m: fit for m in models if (task, m) in M.REGISTRY and (fit := M.joint_fit(m, task, model_params.get(m))) is not None}
    views: dict[int, tuple[DataFrame, DataFrame]] = {}
    recipes: dict[int, Recipe] = {}

    def run_fold(f: int):
        """A fold whose preparation fails counts against every model, not against the run."""
        try:
            return fit_fold(f)
        except Exception as e:
            error = f"fold {f}: {_skipped(e)}"
            return [], {m: 0.0 for m in models}, {m: error for m in models}, None

    def fit_fold(f: int):
        """Fit the fold's stages once, then every model on the cached vectors."""
        parts, timings, errors = [], {m: 0.0 for m in models}, {}
        train_rows, val_rows = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        if shared is not None:
            tr, va, _, _, fe_err = _prepare_fold_shared(train_rows, val_rows, passthrough, shared, f, scaler,
                                                        cleaning, mode, feature_cols)
            recipes[f] = _recipe(data, shared, f, scaler, cleaning, feature_cols)
            lm = shared.moments[f]["label"]
            ctx = M.FitContext(int(shared.n_rows[f]), (lm.std_pop() or 1.0) if lm.n else 1.0,
                               len(labels or []) if task == "classification" else 0)
        else:
            tr, va, _, _, fe_err = _prepare_fold(train_rows, val_rows, target, passthrough, fe_step, scaler,
                                                  cleaning, mode)
            ctx = None
        if few or not lean:
            tr, va = tr.persist(StorageLevel.MEMORY_AND_DISK), va.persist(StorageLevel.MEMORY_AND_DISK)
        if ctx is None:
            ctx = M.fit_context(tr, task)
        if task == "classification":
            ctx.n_classes = max(ctx.n_classes, len(labels or []))
        for name in models:
            if name in joint:
                continue
            t0 = time.time()
            try:
                est = M.get_model(name, task, ctx, model_params.get(name))
                pred = M.fitted(est, tr).transform(va).select(
                    F.lit(name).alias("model"), F.col("__key").alias("key"), "fold",
                    F.col("label").alias("y"), F.col("prediction").cast("double").alias("prediction"))
                parts.append((name, hold(pred)))
            except Exception as e:  # a failing model is skipped (H19)
                errors[name] = _skipped(e)
            timings[name] += time.time() - t0
        if joint:
            views[f] = (tr, va)
        else:
            tr.unpersist()
            va.unpersist()
        return parts, timings, errors, fe_err

    # folds are independent Spark jobs: a few run concurrently from driver threads, large ones one by one, since what they cache adds up
    workers = max(1, min(parallelism, k)) if few or not lean else 1
    if workers > 1:
        with ThreadPoolExecutor(max_workers=workers) as pool:
            fold_results = list(pool.map(run_fold, range(k)))
    else:
        fold_results = [run_fold(f) for f in range(k)]
    timings, errors, fe_error = {m: 0.0 for m in models}, {}, None
    for _, tm, er, fe_err in fold_results:
        for m, v in tm.items():
            timings[m] += v
        errors.update(er)
        fe_error = fe_error or fe_err
    # a model that failed in any fold has an incomplete OOF table: drop it everywhere
    parts = [p for fr in fold_results for name, p in fr[0] if name not in errors]
    memo: dict = {}
    for name, fit in joint.items():
        t0 = time.time()
        try:
            if name not in errors:
                if name in M.LEAST_SQUARES and shared is not None and "products" not in memo:
                    found = _shared_products(data, dict(sorted(recipes.items())), {c for r in shared.nulls.values() for c, n in r.items() if n})
                    memo |= {} if found is None else {"products": found}
                held = fit([(f, *views[f]) for f in sorted(views)], len(labels or []), memo)
                parts.append(hold(held.select(F.lit(name).alias("model"), "key", F.col("model").alias("fold"), "y", "prediction")))
        except Exception as e:  # a failing model is skipped (H19)
            errors[name] = _skipped(e)
        timings[name] += time.time() - t0
    for tr, va in views.values():
        tr.unpersist()
        va.unpersist()

    ok_models = [m for m in models if m not in errors]
    if not ok_models:
        for fr in fold_results:
            for _, p in fr[0]:
                p.unpersist()
        if own:
            prep_rows.release()
        return TrainResult("failed", task, "", float("inf"), float("inf"), errors=errors, fe_error=fe_error,
                           labels=labels)
    oof = reduce(lambda a, b: a.unionByName(b), parts)
    spark = df.sparkSession
    times = spark.createDataFrame([(m, round(timings[m], 3)) for m in ok_models], "model string, time_s double")
    metrics = None
    if lean:
        scored, by_cell = oof, few and task == "classification"
        if few:
            oof = _of_rows(oof, data, rows, [*feature_cols, *([target] if by_cell else []), "fold"], by_cell)
        scored = scored.join(data.select(F.col("__key").alias("key"), WEIGHT), "key") if by_cell else oof
        tallies = CV.tally(scored, task, ["model"], WEIGHT if by_cell else None).persist(StorageLevel.MEMORY_AND_DISK)
        losses, metrics = CV.tallied_losses(tallies, task, ["model"]), CV.tallied_metrics(tallies, task, ["model"])
    else:
        losses = CV.fold_losses(oof, task, by=["model"])   # one row per model and fold: taken once, for the board, the winner and the result
    losses = spark.createDataFrame(losses.collect(), losses.schema)
    board = CV.rank_board(CV.leaderboard(oof, task, losses=losses, metrics=metrics).join(times, "model"))
    ranked = board.collect()   # one row per model; the board is given out as it was scored, not to be scored anew by every reader
    board = spark.createDataFrame(ranked, board.schema)
    if lean:
        tallies.unpersist()
    # the board shows rounded losses; the winner is decided on the full ones (one row per model and fold)
    exact: dict[str, list[float]] = {m: [] for m in ok_models}
    for r in losses.collect():
        exact[r["model"]].append(r["loss"])
    best = min(ranked, key=lambda r: (math.fsum(exact[r["model"]]) / max(1, len(exact[r["model"]])), r["model"]))
    primary = "accuracy" if task == "classification" else "rmse"
    result = TrainResult("complete", task, best["model"], float(best[primary]), float(best["cv_loss_mean"]),
                         leaderboard=board, oof=oof, fold_losses=losses,
                         errors=errors, fe_error=fe_error, labels=labels, cached=parts)
    if refit:
        result.pipeline, result.feature_names = refit_best(rows, target, task, best["model"], passthrough,
                                                            fe_step, scaler, cleaning, model_params.get(best["model"]),
                                                            labels, mode, data)
        if explain:
            from strata.operators.explain import explain_model
            result.importance = explain_model(result.pipeline, rows, result.feature_names, key_cols, seed,
                                              explain_rows)
    if own:
        prep_rows.release()
    return result


def _materialize(pred: DataFrame) -> DataFrame:
    """Persist a fold's predictions so later unions do not refit the model."""
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)
    pred.count()
    return pred


def refit_best(data: DataFrame, target: str, task: str, name: str, passthrough: list[str],
               fe_step, scaler, cleaning, params, labels, mode="auto", train_rows: DataFrame | None = None):
    """Refit cleaning, features, preprocessing and the model on every row (H18); ``train_rows``, if given, stand for the rows in the model."""
    _, _, stages, names, _ = _prepare_fold(data, data.limit(0), target, passthrough, fe_step, scaler,
                                           cleaning, mode, val_rows=False)
    prepared = data if train_rows is None else train_rows
    for st in stages:
        prepared = st.transform(prepared)
    ctx = M.fit_context(prepared, task)
    if task == "classification":
        ctx.n_classes = max(ctx.n_classes, len(labels or []))
    model = M.fitted(M.get_model(name, task, ctx, params), prepared)
    return PipelineModel(stages=stages + [model]), names


def predict(pipeline: PipelineModel, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Batch scoring with a fitted pipeline; class indices decoded to labels (F10), and where the
    model gives them, the probability of every label as a map (F8)."""
    out = pipeline.transform(df)
    if labels:
        names = F.array(*[F.lit(v) for v in labels])
        out = out.withColumn("predicted_label", F.element_at(names, F.col("prediction").cast("int") + 1))
        if "probability" in out.columns:
            out = out.withColumn("label_probability", F.map_from_arrays(names, F.slice(vector_to_array("probability"), 1, len(labels))))
    return out
