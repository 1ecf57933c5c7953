"""Model registry (survey 2.G): MLlib estimators, and boosters and forests of our own.

Models read a ``features`` vector and a numeric ``label`` and write
``prediction`` (label index for classification).  Parameters that depend on
the training rows (the LR penalty scales with 1/n, the ridge penalty with
the label std) are resolved from a small :class:`FitContext` computed by one
aggregate over the training fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import adaboost, boost, forest, linear
from strata.operators.adaboost import AdaBoostClassificationModel, AdaBoostClassifier, AdaBoostRegressionModel, AdaBoostRegressor  # noqa: F401
from strata.operators.cells import WEIGHT

SEED = 42


@dataclass
class FitContext:
    """Facts about the training rows that some model parameters depend on."""
    n_train: int
    label_std: float = 1.0       # population std of the label (regression)
    n_classes: int = 2


def fit_context(train: DataFrame, task: str, label_col: str = "label") -> FitContext:
    y = F.col(label_col).cast("double")
    n = F.sum(WEIGHT) if WEIGHT in train.columns else F.count(F.lit(1))
    r = train.agg(n.alias("n"), F.stddev_pop(y).alias("s"),
                  F.count_distinct(y).alias("k"), F.max(y).alias("mx")).first()
    k = int(max(r["k"] or 0, (r["mx"] or 0) + 1)) if task == "classification" else 0
    return FitContext(int(r["n"] or 0), float(r["s"] or 0.0) or 1.0, k)


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

@dataclass
class ModelSpec:
    name: str
    task: str
    defaults: dict
    info: dict = field(default_factory=dict)

    def build(self, ctx: FitContext, overrides: dict | None = None) -> Estimator:
        p = {**self.defaults, **(overrides or {})}
        return _BUILDERS[(self.task, self.name)](p, ctx)


def _knn(p):
    from strata.operators.knn import KNNClassifier
    return KNNClassifier(k=p["n_neighbors"])


#: Boosters by name.
_BOOSTERS = {"Gradient Boosting": boost.first_order, "XGBoost": boost.depth_wise, "LightGBM": boost.leaf_wise}


def _forest(p: dict, features: str) -> forest.ForestParams:
    return forest.ForestParams(p["n_estimators"], p["max_depth"] or 0, p["min_samples_split"], p["min_samples_leaf"], features, SEED)


def joint_fit(name: str, task: str, params: dict | None = None):
    """For models that train all folds at once: a function of (views, number of classes, memo) that gives the held-out
    predictions, ``memo`` holding what several models of the same views share; None for other models."""
    p = {**REGISTRY[task, name].defaults, **(params or {})}
    if name in _BOOSTERS:
        return lambda views, k, memo: boost.fit_views(views, task, k, _BOOSTERS[name](p))[1]
    if name == "AdaBoost":
        ada = adaboost.AdaParams(p["n_estimators"], p["learning_rate"], 1 if task == "classification" else 3)
        return lambda views, k, memo: adaboost.fit_views(views, task, k, ada)[1]
    if name == "Random Forest":
        features = "sqrt" if task == "classification" else "all"
        return lambda views, k, memo: forest.fit_views(views, task, k, _forest(p, features), keep=False)[1]
    if name == "Logistic Regression":
        return lambda views, k, memo: linear.Logistic(k, p["C"], p["max_iter"]).fit_views(views, memo)
    if name in LEAST_SQUARES:
        return lambda views, k, memo: _least_squares(name, p).fit_views(views, memo)
    return None


#: Models whose training sums rows of equal features (and, for classes, label), so that one weighted row may stand for them.
OF_CELLS = {"classification": {"Logistic Regression", "Random Forest", "Decision Tree", "Naive Bayes", "AdaBoost", *_BOOSTERS}, "regression": {*_BOOSTERS}}

#: Least-squares models by name.
LEAST_SQUARES = {"Linear Regression": "ols", "Ridge": "ridge", "Lasso": "lasso"}


def _least_squares(name: str, p: dict) -> linear.LeastSquares:
    return linear.LeastSquares(LEAST_SQUARES[name], p.get("alpha", 0.0), p.get("max_iter", 1000))


def _booster(name):
    return lambda p, c: boost.HistBooster(_BOOSTERS[name](p), "classification" if c.n_classes else "regression", c.n_classes)


_BUILDERS = {
    ("classification", "Logistic Regression"): lambda p, c: linear.Logistic(c.n_classes, p["C"], p["max_iter"]),
    ("classification", "Random Forest"): lambda p, c: forest.Forest(_forest(p, "sqrt"), "classification", c.n_classes),
    ("classification", "Decision Tree"): lambda p, c: DecisionTreeClassifier(maxDepth=p["max_depth"], seed=SEED),
    ("classification", "Naive Bayes"): lambda p, c: NaiveBayes(modelType="gaussian"),
    ("classification", "K-Nearest Neighbors"): lambda p, c: _knn(p),
    ("classification", "AdaBoost"): lambda p, c: AdaBoostClassifier(
        n_estimators=p["n_estimators"], learning_rate=p["learning_rate"], n_classes=c.n_classes),
    ("regression", "Linear Regression"): lambda p, c: _least_squares("Linear Regression", p),
    ("regression", "Ridge"): lambda p, c: _least_squares("Ridge", p),
    ("regression", "Lasso"): lambda p, c: _least_squares("Lasso", p),
    ("regression", "Random Forest"): lambda p, c: forest.Forest(_forest(p, "all"), "regression"),
    ("regression", "Decision Tree"): lambda p, c: DecisionTreeRegressor(maxDepth=p["max_depth"], seed=SEED),
    ("regression", "AdaBoost"): lambda p, c: AdaBoostRegressor(
        n_estimators=p["n_estimators"], learning_rate=p["learning_rate"]),
    **{(task, name): _booster(name) for task in ("classification", "regression") for name in _BOOSTERS},
}


def _info(strengths, weaknesses, complexity, scaling, missing, categorical, interpretable):
    return {"strengths": strengths, "weaknesses": weaknesses, "complexity": complexity,
            "requires_scaling": scaling, "handles_missing": missing,
            "handles_categorical": categorical, "interpretable": interpretable}


# Model names, default parameters and catalogue metadata.
_CATALOGUE = [
    ModelSpec("Logistic Regression", "classification", {"max_iter": 1000, "C": 1.0, "tol": 1e-4},
              _info(["Fast", "Interpretable", "Probabilistic"], ["Linear boundary only", "Requires scaling"],
                    "fast", True, False, False, True)),
    ModelSpec("Random Forest", "classification",
              {"n_estimators": 100, "max_depth": 10, "min_samples_split": 10, "min_samples_leaf": 4},
              _info(["Excellent OOB performance", "Feature importance", "No scaling"],
                    ["Slow on large data", "High memory"], "medium", False, False, False, False)),
    ModelSpec("Gradient Boosting", "classification", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
              _info(["Often best accuracy", "Handles complex patterns"], ["Slow training", "Prone to overfit"],
                    "slow", False, False, False, False)),
    ModelSpec("Decision Tree", "classification", {"max_depth": 10},
              _info(["Interpretable", "Fast"], ["Prone to overfit"], "fast", False, False, False, True)),
    ModelSpec("K-Nearest Neighbors", "classification", {"n_neighbors": 5},
              _info(["Simple", "No training"], ["Slow prediction", "Requires scaling"],
                    "medium", True, False, False, False)),
    ModelSpec("Naive Bayes", "classification", {},
              _info(["Extremely fast", "Works with small datasets"], ["Assumes feature independence"],
                    "fast", False, False, False, True)),
    ModelSpec("AdaBoost", "classification", {"n_estimators": 50, "learning_rate": 1.0},
              _info(["Less prone to overfit than single trees"], ["Sensitive to noise"],
                    "medium", False, False, False, False)),
    ModelSpec("XGBoost", "classification", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
              _info(["Competition winner", "Handles missing values"], ["Many hyperparams"],
                    "medium", False, True, False, False)),
    ModelSpec("LightGBM", "classification",
              {"n_estimators": 100, "learning_rate": 0.05, "num_leaves": 31, "max_depth": 7},
              _info(["Extremely fast", "Low memory", "Handles categoricals"], ["Can overfit on small data"],
                    "fast", False, True, True, False)),
    ModelSpec("Linear Regression", "regression", {},
              _info(["Extremely fast", "Interpretable"], ["Linear only", "Sensitive to outliers"],
                    "fast", True, False, False, True)),
    ModelSpec("Ridge", "regression", {"alpha": 1.0},
              _info(["L2 regularization", "Handles multicollinearity"], ["Linear only"],
                    "fast", True, False, False, True)),
    ModelSpec("Lasso", "regression", {"alpha": 1.0, "max_iter": 1000},
              _info(["Feature selection via L1"], ["Unstable with correlated features"],
                    "fast", True, False, False, True)),
    ModelSpec("Random Forest", "regression",
              {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
              _info(["Excellent OOB performance", "Feature importance"], ["Slow on large data", "High memory"],
                    "medium", False, False, False, False)),
    ModelSpec("Gradient Boosting", "regression", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
              _info(["Often best accuracy"], ["Slow training", "Prone to overfit"], "slow", False, False, False, False)),
    ModelSpec("Decision Tree", "regression", {"max_depth": 10},
              _info(["Interpretable", "Fast"], ["Prone to overfit"], "fast", False, False, False, True)),
    ModelSpec("AdaBoost", "regression", {"n_estimators": 50, "learning_rate": 1.0},
              _info(["Less prone to overfit"], ["Sensitive to noise"], "medium", False, False, False, False)),
    ModelSpec("XGBoost", "regression", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6},
              _info(["Excellent accuracy", "Handles missing values"], ["Many hyperparams"],
                    "medium", False, True, False, False)),
    ModelSpec("LightGBM", "regression",
              {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1},
              _info(["Very fast", "Low memory"], ["Can overfit on small data"], "fast", False, True, True, False)),
]

REGISTRY: dict[tuple[str, str], ModelSpec] = {(m.task, m.name): m for m in _CATALOGUE}

# Default candidate lists (library defaults and the configured run list).
DEFAULT_MODELS = {"classification": ["Random Forest", "Logistic Regression", "Decision Tree"],
                  "regression": ["Random Forest", "Ridge", "Decision Tree"]}
CONFIGURED_MODELS = {
    "classification": ["XGBoost", "LightGBM", "Random Forest", "Logistic Regression", "Gradient Boosting"],
    "regression": ["XGBoost", "LightGBM", "Random Forest", "Ridge", "Gradient Boosting"]}


def models_for_task(task: str) -> list[str]:
    return [m.name for m in _CATALOGUE if m.task == task]


def get_model(name: str, task: str, ctx: FitContext, params: dict | None = None) -> Estimator:
    """Build an estimator; unknown name or task -> ValueError; params override defaults."""
    if task not in ("classification", "regression"):
        raise ValueError(f"Unknown task type: {task}")
    spec = REGISTRY.get((task, name))
    if spec is None:
        raise ValueError(f"Unknown model '{name}' for task '{task}'. Available: {models_for_task(task)}")
    return spec.build(ctx, params)


def fitted(est: Estimator, train: DataFrame):
    """``est`` fitted to rows that may stand for several each."""
    if WEIGHT in train.columns and est.hasParam("weightCol"):
        est = est.copy({est.getParam("weightCol"): WEIGHT})
    return est.fit(train)


def catalogue(spark, task: str | None = None) -> DataFrame:
    """Model metadata as a small DataFrame, optionally filtered by task."""
    rows = [(m.name, m.task, m.info.get("complexity"), m.info.get("requires_scaling"),
             m.info.get("handles_missing"), m.info.get("handles_categorical"), m.info.get("interpretable"),
             m.info.get("strengths"), m.info.get("weaknesses")) for m in _CATALOGUE]
    df = spark.createDataFrame(rows, "model string, task string, complexity string, requires_scaling boolean, "
                                     "handles_missing boolean, handles_categorical boolean, interpretable boolean, "
                                     "strengths array<string>, weaknesses array<string>")
    return df.where(F.col("task") == task) if task else df


def importance_vector(model) -> list[float] | None:
    """Model-native feature importances or |coefficients| (None when unavailable)."""
    fi = getattr(model, "featureImportances", None)
    if fi is not None:
        return [float(v) for v in (fi.toArray() if hasattr(fi, "toArray") else fi)]
    return None

