"""Decision trees and random forests: a plain recursive grower, top levels by prefix sums, grid points against separate fits."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import exact_trees as E
from tessera.operators import extra_trees as X
from tessera.operators import models as ML
from tessera.plans.tune import grid_search

from test_extra_trees import mixed


def impurity(criterion, weights, labels):
    share = (weights * labels).sum() / weights.sum()
    if criterion == "gini":
        return weights.sum() * 2 * share * (1 - share)
    return weights.sum() * -sum(q * math.log(q) for q in (share, 1 - share) if q > 0)


def plain_tree(x, y, w, key, depth, spec):
    """P(1) function of one tree, row by row and node by node."""
    n, pos = int(w.sum()), int((w * y).sum())
    leaf = (lambda row: pos / n)
    varying = [c for c in range(x.shape[1]) if x[:, c].min() < x[:, c].max()]
    if not 0 < pos < n or len(y) < spec.limit[1] or depth >= spec.limit[0] or not varying:
        return leaf
    best = None
    for c in sorted(sorted(varying, key=lambda c: (mixed(key ^ 4 * (c + 1)) >> 1, c))[:spec.features]):
        values = np.unique(x[:, c])
        for a, b in zip(values, values[1:]):
            below = x[:, c] <= a
            if min(below.sum(), (~below).sum()) < spec.min_leaf:
                continue
            cost = sum(impurity(spec.criterion, w[s], y[s]) for s in (below, ~below))
            if best is None or cost < best[0] - 1e-9:
                best = cost, c, (a + b) / 2
    if best is None:
        return leaf
    _, c, cut = best
    below = x[:, c] <= cut
    left = plain_tree(x[below], y[below], w[below], mixed(key ^ 1), depth + 1, spec)
    right = plain_tree(x[~below], y[~below], w[~below], mixed(key ^ 2), depth + 1, spec)
    return lambda row: left(row) if row[c] <= cut else right(row)


def drawn_times(key, row_id):
    draw, times, reached = (mixed(mixed(row_id) ^ key) >> 11) / 2 ** 53, 0, math.exp(-1)
    while draw >= reached:
        times += 1
        reached += math.exp(-1) / math.factorial(times)
    return times


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 300
    y = (rng.random(n) < 0.4).astype(int)
    x = np.column_stack([np.round(rng.normal(size=(n, 2)) + y[:, None], 2), rng.integers(0, 2, n), np.round(rng.normal(size=n) * 3), np.full(n, 7.0)])
    x[100:130] = x[100]  # equal rows of both classes
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(map(float, r)) for r in x], "label": y, "fold": np.arange(n) % 3})
    return spark.createDataFrame(pdf, "id long, features array<double>, label int, fold int"), x, y


SPECS = [E.ExactForest(1, None, 2, 5), E.ExactForest(1, 4, 20, 5, 7, "entropy"), E.ExactForest(4, None, 2, 2, 1, "gini", True),
         E.ExactForest(3, 5, 30, 2, 4, "entropy", True)]


@pytest.mark.parametrize("spec", SPECS)
def test_equals_plain_trees(data, spec):
    df, x, y = data
    want = np.zeros(len(x))
    for t in range(spec.trees):
        key = mixed((9 << 32) + t)
        w = np.array([drawn_times(key, i) if spec.bootstrap else 1 for i in range(len(x))])
        tree = plain_tree(x[w > 0], y[w > 0], w[w > 0], key, 0, spec)
        want += np.array([tree(row) for row in x]) / spec.trees
    assert np.allclose(X.fit(df, spec, seed=9).scores(x), want, atol=1e-12)


@pytest.mark.parametrize("spec", SPECS)
def test_prefix_sums_equal_whole_trees(data, monkeypatch, spec):
    df, x, _ = data
    points = [spec, E.ExactForest(spec.trees, 2, 60, spec.features, spec.min_leaf, spec.criterion, spec.bootstrap)]
    whole, whole_search = X.fit(df, spec), X.search(df, points, 3)
    monkeypatch.setattr(X, "LOCAL_ROWS", 80)
    parts, parts_search = X.fit(df, spec), X.search(df, points, 3)
    assert np.allclose(whole.scores(x), parts.scores(x), atol=1e-12)
    assert whole_search[0] == parts_search[0] and np.allclose(whole_search[1], parts_search[1])


def test_grid_scores_equal_separate_fits(data):
    df, x, y = data
    points = [E.ExactForest(t, d, s, 2, leaf, "gini", True) for t in (2, 5) for d in (3, None) for s in (2, 40) for leaf in (1, 6)]
    _, scores, _ = X.search(df, points, 3)
    fold = np.arange(len(y)) % 3
    for point, got in zip(points, scores):
        f1 = []
        for f in range(3):
            p = X.fit(df.filter(f"fold != {f}"), point).scores(x[fold == f]).round(9) > 0.5
            t = y[fold == f] > 0
            f1.append(2 * (p & t).sum() / (p.sum() + t.sum()) if (p & t).any() else 0.0)
        assert got == pytest.approx(np.mean(f1))


def test_edges(spark):
    rows = [(1, [1.0, float("nan")], 0), (2, [2.0, 1.0], 1), (3, [float("inf"), 2.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, features array<double>, label int, fold int")
    grown = X.fit(df, E.ExactForest(1, None, 2, 2))
    assert set(grown.feature) == {-1} and np.allclose(grown.value, 2 / 3)  # no column with finite values that vary
    one = X.fit(df.filter("label = 1"), E.ExactForest(2, None, 2, 1))
    assert np.allclose(one.scores(np.zeros((4, 2))), 1.0)
    assert set(X.fit(df, E.ExactForest(1, None, 2, 2, 2)).feature) == {-1}
    for call in (lambda: X.fit(df.limit(0), E.ExactForest()), lambda: X.fit(df, E.ExactForest(criterion="none"))):
        with pytest.raises(ValueError):
            call()


def test_grid_search_reaches_all_points(data):
    df, _, _ = data
    tree = grid_search(ML.SkDecisionTree(), {"maxDepth": [2, None], "minSamplesSplit": [2, 30], "minSamplesLeaf": [1, 5], "criterion": ["gini", "entropy"]},
                       df.drop("fold"), folds=3)
    forest = grid_search(ML.SkRandomForest(), {"nEstimators": [4, 9], "maxDepth": [4, None], "minSamplesSplit": [2, 30], "maxFeatures": ["sqrt", None]},
                         df.drop("fold"), folds=3)
    for found in (tree, forest):
        assert len(found.scores) == 16 and max(s for _, s in found.scores) > 0.6
        out = found.model.transform(df.drop("fold"))
        assert out.columns == ["id", "features", "label", "score", "prediction"] and out.count() == 300


def test_values_of_a_batch_are_counted_once():
    found, rows, n, pos = E.by_value(np.array([2.0, 1.0, 2.0, -0.0, 0.0]), np.array([1, 2, 3, 1, 1]), np.array([0, 2, 3, 1, 0]))
    assert found.tolist() == [0, 1, 2] and (rows.tolist(), n.tolist(), pos.tolist()) == ([2, 1, 2], [2, 2, 4], [1, 2, 3])


def test_folds_grow_in_the_same_passes(data, monkeypatch):
    monkeypatch.setattr(X, "LOCAL_ROWS", 80)
    grown, one = [], X._grow_tops
    monkeypatch.setattr(X, "_grow_tops", lambda df, tops, *rest: (grown.append([t.fold for t in tops]), one(df, tops, *rest)))
    X.search(data[0], [E.ExactForest(1, 3, 2, 1)], 3)
    assert grown == [[0, 1, 2], [-1]]
