"""The reference's phases as data: cell counts, static grid sizes, translation, one small run."""

import numpy as np
import pandas as pd
import pytest

from tessera.plans import experiments as X
from tessera.plans import queries_models
from tessera.plans.tune import expand_grid


def test_phase_cell_counts():
    assert [len(X.phase_cells(p)) for p in (1, 2, 3)] == [36, 36, 21]


def test_static_grid_points():
    per_balancer = sum(X.static_grid_points(g) for _, _, g, _ in X.phase_cells(1)) // 4
    assert per_balancer == 80
    assert max(X.static_grid_points(g) for _, _, g, _ in X.phase_cells(3)) == 7776


def test_translate_drops_unsupported_and_dedupes():
    g = X.translate("C3_DecisionTree", X.PHASE1_GRIDS["C3_DecisionTree"])
    assert g == {"maxDepth": [5, 10, 15, None], "minSamplesSplit": [2, 5, 10], "criterion": ["gini", "entropy"]}
    assert X.translate("C4_RandomForest", X.PHASE1_GRIDS["C4_RandomForest"])["minSamplesSplit"] == [2, 5]
    assert X.translate("C9_MLP", X.PHASE1_GRIDS["C9_MLP"]) == {"hidden": [[100], [50]]}
    assert X.translate("XGBoost_deep", X.PHASE3_DEEP["XGBoost_deep"]).keys() >= {"regAlpha", "regLambda", "colsample"}
    assert X.translate("GradientBoosting_deep", X.PHASE3_DEEP["GradientBoosting_deep"])["minSamplesSplit"] == [2, 5, 10]
    assert X.translate("C1_LogisticRegression", X.PHASE1_GRIDS["C1_LogisticRegression"]) == {"C": [0.01, 0.1, 1, 10]}


def test_run_two_cells_of_phase1(spark):
    rng = np.random.default_rng(3)
    n = 160
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64),
                        "features": [list(r) for r in rng.normal(size=(n, 3)) + y[:, None] * 1.5], "label": y})
    df = spark.createDataFrame(pdf, "id long, features array<double>, label int")
    board = X.run_phase(df.filter("id % 4 <> 0"), df.filter("id % 4 = 0"), 1,
                        cells=["B1_RUS + C7_NaiveBayes", "B2_SMOTE + C7_NaiveBayes"]).collect()
    assert sorted(r.model for r in board) == ["B1_RUS + C7_NaiveBayes", "B2_SMOTE + C7_NaiveBayes"]


CELLS = {
    "logistic_regression_cell": (1, ["B1_RUS + C1_LogisticRegression"]), "knn_cell": (1, ["B1_RUS + C2_KNN"]),
    "decision_tree_cell": (1, ["B1_RUS + C3_DecisionTree"]), "random_forest_cell": (1, ["B1_RUS + C4_RandomForest"]),
    "gradient_boosting_cell": (1, ["B1_RUS + C5_GradientBoosting"]), "linear_svm_cell": (1, ["B1_RUS + C6_SVM"]),
    "naive_bayes_grid_cell": (1, ["B1_RUS + C7_NaiveBayes"]), "boosted_colsample_cell": (2, ["B1_RUS + C8_XGBoost"]),
    "extra_trees_cell": (3, ["RUS_partial + ExtraTrees"]), "mlp_cell": (1, ["B1_RUS + C9_MLP"]),
    "smote_logistic_cell": (1, ["B2_SMOTE + C1_LogisticRegression"]), "experiment_matrix": (1, None),
    "phase2_matrix": (2, None), "phase3_band_counts": (3, None),
}


@pytest.mark.parametrize("name", CELLS)
def test_queries_run_the_reference_grids(monkeypatch, name):
    """Every cell that a query hands to the matrix has the reference's grid, folds and iterations."""
    class Handed(Exception):
        pass

    def take(train, test, balancers, cells, folds=3, **options):
        raise Handed(cells, folds)

    monkeypatch.setattr(X, "run_matrix", take)
    monkeypatch.setattr(queries_models, "survey_arrays", lambda spark, sf_dir: (None, None))
    with pytest.raises(Handed) as caught:
        queries_models.QUERIES[name](None, None)
    cells, folds = caught.value.args
    phase, wanted = CELLS[name]
    spec = {f"{b} + {c}": (X.translate(c, g), it) for b, c, g, it in X.phase_cells(phase)}
    assert [c.name for c in cells] == (wanted or list(spec)) and folds == (5 if phase == 3 else 3)
    for c in cells:
        grid, iterations = spec[c.name]
        assert c.grid == grid and len(expand_grid(grid)) > 1
        assert iterations is None or c.estimator().getOrDefault("maxIter") == iterations
