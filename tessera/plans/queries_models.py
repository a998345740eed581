"""Registered queries of the model family (M1, M3-M7, M9-M11, G1-G6) on the survey table.

Each runs cells of the reference's phases with the grids, folds and
iterations of ``experiments``: prepare -> balance the training rows -> grid
search with stratified folds (F1 of class 1) -> refit -> score the test rows
-> result record, ranked. SQL expresses the searches through naive Bayes and
the first splits of trees and forests and linear SVMs of one column (``oracle_tune``); tests check the other fits
on separable fixtures.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators import linear_svm
from ..operators import models as ML
from ..operators.metrics import band_counts
from ..operators.naive_bayes import GaussianNB
from ..operators.sampling import undersample
from ..sources.adapter import SURVEY_ROLES
from ..session import cut_lineage
from .common import rounded, survey_prepared
from .experiments import PHASE1_BALANCERS, PHASE1_GRIDS, run_phase, translate
from .tune import grid_search


def survey_arrays(spark: SparkSession, sf_dir: str):
    """(id, features array<double>, label) for the train and test rows of the survey split."""
    model, prepared = survey_prepared(spark, sf_dir)
    feats = model.feature_columns()
    arr = prepared.select(F.col(SURVEY_ROLES.key).cast("long").alias("id"),
                          F.array(*[F.col(c).cast("double") for c in feats]).alias("features"), "label", "split")
    arr = cut_lineage(arr, "survey-arrays")
    return arr.filter(F.col("split") == "train").drop("split"), arr.filter(F.col("split") == "test").drop("split")


BALANCERS = {
    "B1_RUS": lambda d: undersample(d, "label", "id", seed=42),
    "B4_RUS123": lambda d: undersample(d, "label", "id", seed=123),
    "RUS_partial": lambda d: undersample(d, "label", "id", seed=42, ratio=0.5),
    "B2_SMOTE": lambda d: B.smote(d, seed=42).select("id", "features", "label"),
    "B3_SMOTE75": lambda d: B.smote(d, seed=42, sampling_strategy=0.75).select("id", "features", "label"),
    "B3_ADASYN": lambda d: B.adasyn(d, seed=42).select("id", "features", "label"),
    "B4_SMOTETomek": lambda d: B.smote_tomek(d, seed=42).select("id", "features", "label"),
    "B2_NearMiss": lambda d: B.near_miss(d).select("id", "features", "label"),
}


def _phase(spark, sf_dir, phase: int, cells: list[str] | None = None) -> DataFrame:
    """Leaderboard of a phase's cells (all, or those named) with the reference's grids, folds and iterations."""
    train, test = survey_arrays(spark, sf_dir)
    return rounded(run_phase(train, test, phase, cells=cells))


def q_logistic_regression_cell(spark, sf_dir):
    """M1 + G2: phase-1 cell of RUS and logistic regression, 4 values of C, 1,000 iterations."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C1_LogisticRegression"])


def q_knn_cell(spark, sf_dir):
    """M2 + G2: phase-1 cell of RUS and k nearest neighbours, 4 k x 2 weights."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C2_KNN"])


def q_decision_tree_cell(spark, sf_dir):
    """M3 + G2: phase-1 cell of RUS and a decision tree, 4 depths x 3 split sizes x 2 criteria."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C3_DecisionTree"])


def q_random_forest_cell(spark, sf_dir):
    """M4 + G2: phase-1 cell of RUS and a random forest, 100 and 200 trees x 2 depths x 2 split sizes."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C4_RandomForest"])


def q_gradient_boosting_cell(spark, sf_dir):
    """M5 + G2: phase-1 cell of RUS and gradient boosting, 100 and 200 rounds x 2 depths x 2 learning rates."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C5_GradientBoosting"])


def q_linear_svm_cell(spark, sf_dir):
    """M6 + M7 + G2: phase-1 cell of RUS and a linear SVM with 3-fold sigmoid calibration, 4 values of C."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C6_SVM"])


def q_naive_bayes_grid_cell(spark, sf_dir):
    """M8 + G2: phase-1 cell of RUS and Gaussian NB, 4 values of var_smoothing."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C7_NaiveBayes"])


def q_boosted_colsample_cell(spark, sf_dir):
    """M9 + G2: phase-2 cell of RUS and boosted trees, 3 rounds x 4 depths x 3 learning rates x row and feature sampling."""
    return _phase(spark, sf_dir, 2, ["B1_RUS + C8_XGBoost"])


def q_extra_trees_cell(spark, sf_dir):
    """M10 + G2: phase-3 cell of partial RUS and extra trees, 200 and 500 trees x 3 depths x 2 split sizes x 2 feature counts, 5 folds."""
    return _phase(spark, sf_dir, 3, ["RUS_partial + ExtraTrees"])


def q_mlp_cell(spark, sf_dir):
    """M11 + G2: phase-1 cell of RUS and a multilayer perceptron, hidden layers of 100 and 50, 500 iterations."""
    return _phase(spark, sf_dir, 1, ["B1_RUS + C9_MLP"])


def q_smote_logistic_cell(spark, sf_dir):
    """B3 on the survey table + M1 + G2: phase-1 cell of SMOTE and logistic regression."""
    return _phase(spark, sf_dir, 1, ["B2_SMOTE + C1_LogisticRegression"])


def q_grid_search_scores(spark, sf_dir):
    """Mean F1 of class 1 over 3 folds for every grid point, and the chosen one."""
    train, _ = survey_arrays(spark, sf_dir)
    bal = BALANCERS["B1_RUS"](train)
    res = grid_search(ML.SkLogisticRegression(maxIter=100), {"C": [0.01, 0.1, 1.0, 10.0]}, bal)
    rows = [(str(sorted(p.items())), float(s), p == res.best) for p, s in res.scores]
    return rounded(spark.createDataFrame(rows, "params string, mean_f1 double, chosen boolean"))


def q_naive_bayes_grid_scores(spark, sf_dir):
    """The phase-1 grid of naive Bayes, mean F1 of class 1 over 3 folds for every point, and the chosen one."""
    train, _ = survey_arrays(spark, sf_dir)
    grid = translate("C7_NaiveBayes", PHASE1_GRIDS["C7_NaiveBayes"])
    res = grid_search(GaussianNB(), grid, BALANCERS["B1_RUS"](train), folds=3)
    best = max(range(len(res.scores)), key=lambda i: (res.scores[i][1], -i))
    rows = [(round(math.log10(p["varSmoothing"])), float(s), i == best) for i, (p, s) in enumerate(res.scores)]
    return rounded(spark.createDataFrame(rows, "log10_smoothing long, mean_f1 double, chosen boolean"))


def q_phase2_naive_bayes_cells(spark, sf_dir):
    """The phase-2 cells of naive Bayes on the two undersampled tables, 7 and 5 points, ranked by avg TPR."""
    return _phase(spark, sf_dir, 2, ["B1_RUS + C7_NaiveBayes", "B4_RUS123 + C7_NaiveBayes"])


def _splits(spark, sf_dir, balancer: str, estimator) -> DataFrame:
    """Nodes of an estimator's trees on the balanced training rows (numbered from the root, 1)."""
    model, prepared = survey_prepared(spark, sf_dir)
    names = model.feature_columns()
    rows = prepared.filter("split = 'train'").select(F.col(SURVEY_ROLES.key).cast("long").alias("id"),
                                                     F.array(*[F.col(c).cast("double") for c in names]).alias("features"), "label")
    balanced = BALANCERS[balancer](cut_lineage(rows, "survey-arrays"))
    found = [(tree, node, None if feature < 0 else names[feature], None if feature < 0 else cut, share)
             for tree, node, feature, cut, share in estimator.fit(balanced).grown.nodes()]
    return rounded(spark.createDataFrame(found, "tree long, node long, feature string, cut double, share double"))


def q_extra_trees_splits(spark, sf_dir):
    """The first two levels of 16 extra trees on the partly undersampled training rows."""
    return _splits(spark, sf_dir, "RUS_partial", ML.ExtraTrees(nEstimators=16, maxDepth=2))


def q_decision_tree_splits(spark, sf_dir):
    """M3: the first three levels of a decision tree on the undersampled training rows, every cut of every column tried."""
    return _splits(spark, sf_dir, "B1_RUS", ML.SkDecisionTree(maxDepth=3))


def q_random_forest_splits(spark, sf_dir):
    """M4: the first two levels of 12 bootstrapped trees on the undersampled training rows, 5 rows or more in a leaf."""
    return _splits(spark, sf_dir, "B1_RUS", ML.SkRandomForest(nEstimators=12, maxDepth=2, minSamplesLeaf=5))


def q_linear_svm_weights(spark, sf_dir):
    """M6: weights of squared-hinge SVMs of one scaled column each on the undersampled training rows, for the phase-1 values of C."""
    train, _ = survey_arrays(spark, sf_dir)
    bal = cut_lineage(BALANCERS["B1_RUS"](train), "balanced")
    cs = PHASE1_GRIDS["C6_SVM"]["estimator__C"]
    found = []
    for i in (0, 1):
        rows = bal.select(F.array(F.col("features")[i]).alias("features"), F.col("label").cast("int").alias("label"), F.lit(0).alias("fold"), F.lit(0).alias("turn"))
        weights = linear_svm.fit_margins(rows, [linear_svm.Margin(float(c), -1, -1) for c in cs], linear_svm.Layout(1, 1), 2, 100)
        found += [(i, float(c), float(w), float(b)) for c, (w, b) in zip(cs, weights)]
    return rounded(spark.createDataFrame(found, "place long, c double, weight double, intercept double"))


def q_experiment_matrix(spark, sf_dir):
    """All 36 cells of phase 1 (4 balancers x 9 classifiers), balanced tables shared, ranked by avg TPR."""
    return _phase(spark, sf_dir, 1)


def q_phase2_matrix(spark, sf_dir):
    """All 36 cells of phase 2 (4 balancers x 9 classifiers), ranked by avg TPR."""
    return _phase(spark, sf_dir, 2)


def q_phase3_band_counts(spark, sf_dir):
    """G6, E7 decorated + E12: all 21 cells of phase 3 (5 folds), decorated bands, cells per band."""
    train, test = survey_arrays(spark, sf_dir)
    return band_counts(run_phase(train, test, 3))


def q_phase1_naive_bayes_matrix(spark, sf_dir):
    """The reference's phase-1 cells for naive Bayes - RUS, SMOTE, ADASYN, SMOTE+Tomek (fallback
    SMOTE) x the phase-1 var_smoothing grid, 3 folds - ranked by avg TPR."""
    return _phase(spark, sf_dir, 1, [f"{b} + C7_NaiveBayes" for b in PHASE1_BALANCERS])


QUERIES = {
    "logistic_regression_cell": q_logistic_regression_cell,
    "knn_cell": q_knn_cell,
    "decision_tree_cell": q_decision_tree_cell,
    "random_forest_cell": q_random_forest_cell,
    "gradient_boosting_cell": q_gradient_boosting_cell,
    "linear_svm_cell": q_linear_svm_cell,
    "naive_bayes_grid_cell": q_naive_bayes_grid_cell,
    "boosted_colsample_cell": q_boosted_colsample_cell,
    "extra_trees_cell": q_extra_trees_cell,
    "mlp_cell": q_mlp_cell,
    "smote_logistic_cell": q_smote_logistic_cell,
    "grid_search_scores": q_grid_search_scores,
    "naive_bayes_grid_scores": q_naive_bayes_grid_scores,
    "phase2_naive_bayes_cells": q_phase2_naive_bayes_cells,
    "extra_trees_splits": q_extra_trees_splits,
    "decision_tree_splits": q_decision_tree_splits,
    "random_forest_splits": q_random_forest_splits,
    "linear_svm_weights": q_linear_svm_weights,
    "experiment_matrix": q_experiment_matrix,
    "phase2_matrix": q_phase2_matrix,
    "phase3_band_counts": q_phase3_band_counts,
    "phase1_naive_bayes_matrix": q_phase1_naive_bayes_matrix,
}
