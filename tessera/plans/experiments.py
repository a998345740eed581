"""The reference's three experiment phases as data, runnable on Spark.

Each phase is a list of cells (balancer, classifier, grid). Grids are
written with the reference's parameter names and translated to our
estimators by ``translate``; parameters with no Spark counterpart
(solver, MLP alpha / activation / learning-rate schedule) are dropped and the grid is de-duplicated, so the
number of fits can be smaller than the reference's static count
(``static_grid_points`` gives that count).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import balance as B
from ..operators import models as ML
from ..operators.naive_bayes import GaussianNB
from ..operators.sampling import undersample
from .tune import Cell, run_matrix

# --- fixed values: classifier settings and grids of the three phases -----------------------

PHASE1_BALANCERS = ["B1_RUS", "B2_SMOTE", "B3_ADASYN", "B4_SMOTETomek"]
PHASE1_GRIDS = {
    "C1_LogisticRegression": {"C": [0.01, 0.1, 1, 10], "solver": ["liblinear", "lbfgs"]},
    "C2_KNN": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "C3_DecisionTree": {"max_depth": [5, 10, 15, None], "min_samples_split": [2, 5, 10],
                        "criterion": ["gini", "entropy"]},
    "C4_RandomForest": {"n_estimators": [100, 200], "max_depth": [10, 20], "min_samples_split": [2, 5]},
    "C5_GradientBoosting": {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.05, 0.1]},
    "C6_SVM": {"estimator__C": [0.01, 0.1, 1, 10]},
    "C7_NaiveBayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "C8_XGBoost": {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.05, 0.1]},
    "C9_MLP": {"hidden_layer_sizes": [(100,), (50,)], "alpha": [0.001, 0.01], "learning_rate": ["adaptive"]},
}
PHASE1_ITER = {"C1_LogisticRegression": 1000, "C6_SVM": 2000, "C9_MLP": 500}

PHASE2_BALANCERS = ["B1_RUS", "B2_NearMiss", "B3_SMOTE75", "B4_RUS123"]
PHASE2_WIDE = {        # B1_RUS cells
    "C1_LogisticRegression": {"C": [0.001, 0.01, 0.05, 0.1, 0.5, 1, 5, 10], "solver": ["liblinear", "lbfgs"],
                              "penalty": ["l1", "l2"]},
    "C2_KNN": {"n_neighbors": [1, 3, 5, 7, 9, 11, 15, 21], "weights": ["uniform", "distance"],
               "metric": ["euclidean", "manhattan"]},
    "C3_DecisionTree": {"max_depth": [3, 5, 7, 10, 15, 20, None], "min_samples_split": [2, 5, 10, 20],
                        "min_samples_leaf": [1, 2, 5], "criterion": ["gini", "entropy"]},
    "C4_RandomForest": {"n_estimators": [100, 200, 300, 500], "max_depth": [10, 15, 20, 30, None],
                        "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    "C5_GradientBoosting": {"n_estimators": [100, 200, 300], "max_depth": [3, 4, 5, 7],
                            "learning_rate": [0.01, 0.05, 0.1, 0.2], "subsample": [0.8, 1.0]},
    "C6_SVM": {"estimator__C": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10]},
    "C7_NaiveBayes": {"var_smoothing": [1e-11, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6, 1e-5]},
    "C8_XGBoost": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, 9], "learning_rate": [0.01, 0.05, 0.1],
                   "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "C9_MLP": {"hidden_layer_sizes": [(50,), (100,), (200,), (100, 50), (100, 100)], "alpha": [0.0001, 0.001, 0.01],
               "learning_rate": ["adaptive"], "activation": ["relu", "tanh"]},
}
PHASE2_NARROW = {      # B2_NearMiss, B3_SMOTE75, B4_RUS123 cells
    "C1_LogisticRegression": {"C": [0.001, 0.01, 0.1, 1, 10], "solver": ["liblinear", "lbfgs"]},
    "C2_KNN": {"n_neighbors": [3, 5, 7, 11, 15], "weights": ["uniform", "distance"]},
    "C3_DecisionTree": {"max_depth": [5, 10, 15, None], "min_samples_split": [2, 5, 10],
                        "criterion": ["gini", "entropy"]},
    "C4_RandomForest": {"n_estimators": [100, 200, 300], "max_depth": [10, 20, None], "min_samples_split": [2, 5]},
    "C5_GradientBoosting": {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1]},
    "C6_SVM": {"estimator__C": [0.001, 0.01, 0.1, 1, 10]},
    "C7_NaiveBayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6, 1e-5]},
    "C8_XGBoost": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1]},
    "C9_MLP": {"hidden_layer_sizes": [(50,), (100,), (100, 50)], "alpha": [0.0001, 0.001, 0.01],
               "learning_rate": ["adaptive"]},
}
PHASE2_RUS123_GB = {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1]}
PHASE2_ITER = {"C1_LogisticRegression": 2000, "C6_SVM": 3000, "C9_MLP": 1000}

PHASE3_DEEP = {
    "GradientBoosting_deep": {"n_estimators": [50, 100, 150, 200, 300], "max_depth": [2, 3, 4, 5, 6],
                              "learning_rate": [0.005, 0.01, 0.02, 0.05, 0.1], "subsample": [0.7, 0.8, 0.9, 1.0],
                              "min_samples_split": [2, 5, 10]},
    "RandomForest_deep": {"n_estimators": [200, 300, 500, 700], "max_depth": [5, 10, 15, 20, 30, None],
                          "min_samples_split": [2, 3, 5, 10], "min_samples_leaf": [1, 2, 3],
                          "max_features": ["sqrt", "log2", None]},
    "XGBoost_deep": {"n_estimators": [50, 100, 200, 300], "max_depth": [3, 4, 5, 6, 7, 9],
                     "learning_rate": [0.005, 0.01, 0.05, 0.1], "subsample": [0.7, 0.8, 1.0],
                     "colsample_bytree": [0.6, 0.8, 1.0], "reg_alpha": [0, 0.1, 1], "reg_lambda": [1, 2, 5]},
    "DecisionTree_deep": {"max_depth": [2, 3, 4, 5, 6, 7, 8, 10, 15], "min_samples_split": [2, 3, 5, 10, 20, 50],
                          "min_samples_leaf": [1, 2, 5, 10], "criterion": ["gini", "entropy"]},
    "ExtraTrees": {"n_estimators": [200, 300, 500], "max_depth": [10, 15, 20, None], "min_samples_split": [2, 5, 10],
                   "max_features": ["sqrt", "log2", None]},
}
PHASE3_SEEDED = {
    "GradientBoosting": {"n_estimators": [100, 200, 300], "max_depth": [3, 4, 5],
                         "learning_rate": [0.01, 0.02, 0.05, 0.1], "subsample": [0.8, 0.9, 1.0]},
    "RandomForest": {"n_estimators": [200, 500], "max_depth": [10, 20, None], "min_samples_split": [2, 5],
                     "min_samples_leaf": [1, 2], "max_features": ["sqrt", "log2"]},
    "XGBoost": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1],
                "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    "ExtraTrees": {"n_estimators": [200, 500], "max_depth": [15, 20, None], "min_samples_split": [2, 5],
                   "max_features": ["sqrt", "log2"]},
}
PHASE3_PARTIAL = {
    "GradientBoosting": {"n_estimators": [100, 200, 300], "max_depth": [3, 4, 5], "learning_rate": [0.01, 0.05, 0.1],
                         "subsample": [0.8, 1.0]},
    "XGBoost": PHASE3_SEEDED["XGBoost"],
    "RandomForest": {"n_estimators": [200, 500], "max_depth": [10, 20, None], "min_samples_split": [2, 5],
                     "max_features": ["sqrt", "log2"]},
    "ExtraTrees": PHASE3_SEEDED["ExtraTrees"],
}

# --- translation to our estimators ---------------------------------------------------------

FAMILY = {
    "C1_LogisticRegression": "lr", "C2_KNN": "knn", "C3_DecisionTree": "dt", "C4_RandomForest": "rf",
    "C5_GradientBoosting": "gb", "C6_SVM": "svm", "C7_NaiveBayes": "nb", "C8_XGBoost": "xgb", "C9_MLP": "mlp",
    "GradientBoosting_deep": "gb", "RandomForest_deep": "rf", "XGBoost_deep": "xgb", "DecisionTree_deep": "dt",
    "ExtraTrees": "et", "GradientBoosting": "gb", "RandomForest": "rf", "XGBoost": "xgb",
}
RENAME = {
    "lr": {"C": "C", "penalty": "penalty"},
    "knn": {"n_neighbors": "k", "weights": "weights", "metric": "metric"},
    "dt": {"max_depth": "maxDepth", "min_samples_split": "minSamplesSplit", "min_samples_leaf": "minSamplesLeaf", "criterion": "criterion"},
    "rf": {"n_estimators": "nEstimators", "max_depth": "maxDepth", "min_samples_split": "minSamplesSplit", "min_samples_leaf": "minSamplesLeaf",
           "max_features": "maxFeatures"},
    "et": {"n_estimators": "nEstimators", "max_depth": "maxDepth", "min_samples_split": "minSamplesSplit",
           "max_features": "maxFeatures"},
    "gb": {"n_estimators": "nEstimators", "max_depth": "maxDepth", "learning_rate": "learningRate",
           "subsample": "subsample", "min_samples_split": "minSamplesSplit"},
    "xgb": {"n_estimators": "nEstimators", "max_depth": "maxDepth", "learning_rate": "learningRate", "subsample": "subsample",
            "colsample_bytree": "colsample", "reg_alpha": "regAlpha", "reg_lambda": "regLambda"},
    "svm": {"estimator__C": "C"},
    "nb": {"var_smoothing": "varSmoothing"},
    "mlp": {"hidden_layer_sizes": "hidden"},
}


def estimator_factory(family: str, max_iter: int | None = None) -> Callable:
    if family == "lr":
        return lambda: ML.SkLogisticRegression(maxIter=max_iter or 100)
    if family == "svm":
        return lambda: ML.CalibratedLinearSVC(maxIter=max_iter or 100)
    if family == "mlp":
        return lambda: ML.SkMLP(maxIter=max_iter or 200)
    return {"knn": ML.KNNClassifier, "dt": ML.SkDecisionTree, "rf": ML.SkRandomForest, "et": ML.ExtraTrees,
            "gb": ML.SkGradientBoosting, "xgb": ML.RegularisedBoosting, "nb": GaussianNB}[family]


def translate(classifier: str, grid: dict) -> dict:
    """Reference grid -> our estimator's grid (unsupported parameters dropped, values de-duplicated)."""
    names = RENAME[FAMILY[classifier]]
    out = {}
    for k, values in grid.items():
        if k in names:
            vals = [list(v) if isinstance(v, tuple) else v for v in values]
            uniq = []
            for v in vals:
                if v not in uniq:
                    uniq.append(v)
            out[names[k]] = uniq
    return out


def static_grid_points(grid: dict) -> int:
    """Grid points as the reference counts them (before translation)."""
    n = 1
    for v in grid.values():
        n *= len(v)
    return n


def balancers(seed_fallback: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Balancers by cell name; a failed precondition falls back as the phase does."""
    rus = lambda s, r=None: (lambda d: undersample(d, "label", "id", seed=s, ratio=r))
    cols = ("id", "features", "label")
    base = {
        "B1_RUS": rus(42), "B4_RUS123": rus(123), "RUS42": rus(42), "RUS123": rus(123), "RUS7": rus(7),
        "RUS99": rus(99), "RUS_partial": rus(42, 0.5),
        "B2_SMOTE": lambda d: B.smote(d, seed=42).select(*cols),
        "B3_SMOTE75": lambda d: B.smote(d, seed=42, sampling_strategy=0.75).select(*cols),
        "B3_ADASYN": lambda d: B.adasyn(d, seed=42).select(*cols),
        "B4_SMOTETomek": lambda d: B.smote_tomek(d, seed=42).select(*cols),
        "B2_NearMiss": lambda d: B.near_miss(d).select(*cols),
    }
    fallback = base[seed_fallback]
    return {name: (lambda d, f=f, name=name: B.with_fallback(d, (name, f), (seed_fallback, fallback))[0])
            for name, f in base.items()}


def phase_cells(phase: int) -> list[tuple[str, str, dict, int | None]]:
    """(balancer, classifier, reference grid, max_iter) for every cell of a phase (36 / 36 / 21)."""
    if phase == 1:
        return [(b, c, g, PHASE1_ITER.get(c)) for b in PHASE1_BALANCERS for c, g in PHASE1_GRIDS.items()]
    if phase == 2:
        out = []
        for b in PHASE2_BALANCERS:
            grids = PHASE2_WIDE if b == "B1_RUS" else dict(PHASE2_NARROW)
            if b == "B4_RUS123":
                grids["C5_GradientBoosting"] = PHASE2_RUS123_GB
            out += [(b, c, g, PHASE2_ITER.get(c)) for c, g in grids.items()]
        return out
    if phase == 3:
        out = [("RUS42", c, g, None) for c, g in PHASE3_DEEP.items()]
        out += [("RUS123", c, g, None) for c, g in PHASE3_DEEP.items() if c != "DecisionTree_deep"]
        out += [(f"RUS{s}", c, g, None) for s in (7, 99) for c, g in PHASE3_SEEDED.items()]
        out += [("RUS_partial", c, g, None) for c, g in PHASE3_PARTIAL.items()]
        return out
    raise ValueError(f"unknown phase {phase}")


def run_phase(train: DataFrame, test: DataFrame, phase: int, cells: list[str] | None = None,
              parallelism: int = 4) -> DataFrame:
    """Run a phase's cells (or the named subset) and return its leaderboard.

    ``train`` / ``test`` are (id, features, label) tables. Folds: 3 in phases
    1-2, 5 in phase 3; fallback balancer SMOTE in phase 1, RUS (seed 42) after.
    """
    spec = phase_cells(phase)
    chosen = [Cell(b, c, estimator_factory(FAMILY[c], it), translate(c, g)) for b, c, g, it in spec
              if cells is None or f"{b} + {c}" in cells]
    return run_matrix(train, test, balancers("B2_SMOTE" if phase == 1 else "B1_RUS"), chosen,
                      folds=5 if phase == 3 else 3, decorate=(phase == 3), parallelism=parallelism)
