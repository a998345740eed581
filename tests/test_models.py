"""Every classifier beats AUC 0.5 on a separable fixture; grid search picks a point."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import models as ML
from tessera.operators.naive_bayes import GaussianNB
from tessera.plans.tune import expand_grid, grid_search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 4)) + y[:, None] * 1.5
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(r) for r in x], "label": y})
    df = spark.createDataFrame(pdf, "id long, features array<double>, label int")
    return df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")


@pytest.mark.parametrize("est", [
    lambda: ML.SkLogisticRegression(C=1.0, maxIter=50),
    lambda: ML.SkLogisticRegression(C=1.0, penalty="l1", maxIter=50),
    lambda: ML.KNNClassifier(k=5, weights="distance"),
    lambda: ML.SkDecisionTree(maxDepth=4),
    lambda: ML.SkRandomForest(nEstimators=5, maxDepth=4),
    lambda: ML.SkGradientBoosting(nEstimators=5, maxDepth=2, subsample=0.8, colsample=0.5),
    lambda: ML.CalibratedLinearSVC(C=1.0, maxIter=50),
    lambda: GaussianNB(),
    lambda: ML.SkMLP(hidden=(4,), maxIter=30),
    lambda: ML.ExtraTrees(nEstimators=12, maxDepth=4),
])
def test_beats_chance(data, est):
    train, test = data
    scored = est().fit(train).transform(test)
    assert {"prediction", "score"} <= set(scored.columns)
    assert M.roc_auc(scored).first().roc_auc > 0.7


def test_expand_grid():
    assert expand_grid({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_grid_search_first_best_wins(data):
    train, _ = data
    res = grid_search(GaussianNB(), {"varSmoothing": [1e-9, 1e-9 * 1.000001]}, train)
    assert res.best == {"varSmoothing": 1e-9}
    assert len(res.scores) == 2


def test_naive_bayes_grid_equals_a_fit_per_fold_and_point(spark):
    rng = np.random.default_rng(4)
    n = 700
    y = rng.integers(0, 2, n)
    x = np.column_stack([rng.normal(size=n) + y, rng.normal(size=n) * 50, np.full(n, 2.5), rng.integers(0, 2, n)])
    rows = [(i, [float(v) for v in x[i]], float(y[i]), int(i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, fold int")
    points = [{"varSmoothing": v} for v in (1e-9, 1e-2, 0.5)]
    best, means, model = GaussianNB().fit_grid(df, points, 3, "id", "fold")
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    for p, mean in zip(points, means):
        each = [f1.evaluate(GaussianNB(**p).fit(df.filter(df.fold != f)).transform(df.filter(df.fold == f))) for f in range(3)]
        assert abs(sum(each) / 3 - mean) < 1e-12
    assert best == max(range(3), key=lambda i: (means[i], -i))
    whole = GaussianNB(**points[best]).fit(df)
    assert (model.theta, model.var, model.priors) == (whole.theta, whole.var, whole.priors)
    assert GaussianNB().fit_grid(df.filter("label = 0 or fold = 0"), points, 3, "id", "fold")[1][0] >= 0.0
    with pytest.raises(ValueError, match="validation data at fold 2 is empty"):
        GaussianNB().fit_grid(df.filter("fold < 2"), points, 3, "id", "fold")
