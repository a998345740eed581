"""Linear SVM: closed form while every row is inside the margin, stationary points, folds of a search against separate fits."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import linear_svm as S
from tessera.operators import models as ML
from tessera.operators.sampling import stratified_folds
from tessera.plans.tune import grid_search

COLUMNS = "id long, features array<double>, label int"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 240
    y = (rng.random(n) < 0.4).astype(int)
    x = rng.normal(size=(n, 3)) + y[:, None]
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(map(float, r)) for r in x], "label": y})
    return spark.createDataFrame(pdf, COLUMNS), x, y


def laid_out(df, folds, parts, seed=42):
    turned = stratified_folds(df, "label", "id", k=folds * parts, seed=seed, fold_col="turn")
    return turned.selectExpr("*", f"turn % {folds} AS fold")


def test_closed_form_inside_the_margin(data):
    df, x, y = data
    rows = laid_out(df.selectExpr("id", "array(features[0]) AS features", "label"), 1, 2)
    c = 1e-4
    [classifier] = S.search(rows, [c], 1, 2, 100)[1]
    parts = np.array([r.turn % 2 for r in rows.orderBy("id").select("turn").collect()])
    for part, (w, _) in enumerate(classifier):
        a, t = S._with_ones(x[parts != part][:, :1]), 2.0 * y[parts != part] - 1
        assert np.allclose(w, np.linalg.solve(np.eye(2) + 2 * c * a.T @ a, 2 * c * a.T @ t), atol=1e-12)
        assert (t * (a @ w) < 1).all()


def test_stationary(data):
    df, x, y = data
    rows = laid_out(df, 3, 2)
    turn = np.array([r.turn for r in rows.orderBy("id").select("turn").collect()])
    layout, a = S.Layout(3, 2), S._with_ones(x)
    models = [S.Margin(c, f, p) for c in (0.01, 10.0) for f in (-1, 1) for p in (0, 1)]
    cut = rows.select("features", "label", "fold", "turn")
    weights = S.fit_margins(cut, models, layout, 4, 100)
    for model, w, ab in zip(models, weights, S.fit_sigmoids(cut, models, weights, layout)):
        used, held = layout.roles(turn, turn % 3, model)
        sign = 2.0 * y[used] - 1
        slack = np.maximum(0, 1 - sign * (a[used] @ w))
        assert np.abs(w - 2 * model.c * a[used].T @ (sign * slack)).max() < 1e-5
        pos = y[held].sum()
        target = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (held.sum() - pos + 2))
        margin = a[held] @ w
        off = 1 / (1 + np.exp(-(ab[0] * margin + ab[1]))) - target
        assert abs(off.sum()) < 1e-4 and abs(off @ margin) < 1e-4


def test_parts_are_those_of_the_rows_outside_the_fold(data):
    df, _, _ = data
    rows = laid_out(df, 3, 2)
    own = stratified_folds(rows.filter("fold <> 1"), "label", "id", k=2, seed=42, fold_col="part")
    for r in own.collect():
        assert S.Layout(3, 2).part(np.array([r.turn]), np.array([r.fold]), 1)[0] == r.part


def test_search_scores_equal_separate_fits(data):
    df, x, y = data
    found = grid_search(ML.CalibratedLinearSVC(), {"C": [0.001, 1.0]}, df, folds=3)
    fold = np.array([r.fold for r in stratified_folds(df, "label", "id", k=3, seed=42).orderBy("id").select("fold").collect()])
    by_id = {f: df.sparkSession.createDataFrame([(int(i),) for i in np.flatnonzero(fold == f)], "id long") for f in range(3)}
    for point, score in found.scores:
        f1 = []
        for f in range(3):
            model = ML.CalibratedLinearSVC(C=point["C"]).fit(df.join(by_id[f], "id", "left_anti"))
            said = np.array([r.prediction for r in model.transform(df.join(by_id[f], "id")).orderBy("id").collect()]) > 0
            true = y[fold == f] > 0
            f1.append(2 * (said & true).sum() / (said.sum() + true.sum()) if (said & true).any() else 0.0)
        assert score == pytest.approx(np.mean(f1))
    assert max(s for _, s in found.scores) > 0.6


def test_edges(spark):
    def fit(rows):
        return ML.CalibratedLinearSVC(folds=2).fit(spark.createDataFrame(rows, COLUMNS))

    one = fit([(i, [float(i)], 1) for i in range(6)])
    assert all(r.score > 0.5 for r in one.transform(spark.createDataFrame([(9, [3.0], 1)], COLUMNS)).collect())
    same = fit([(i, [2.0], i % 2) for i in range(8)])
    assert same.transform(spark.createDataFrame([(9, [2.0], 1)], COLUMNS)).first().score == pytest.approx(0.5, abs=1e-3)
    for bad in ([(1, [float("nan")], 0), (2, [1.0], 1)], []):
        with pytest.raises(ValueError):
            fit(bad)
