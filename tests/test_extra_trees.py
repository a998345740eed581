"""Extra trees: a plain recursive grower, whole tables against top levels and local parts, grid points against separate fits."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import extra_trees as X
from tessera.operators import models as ML
from tessera.plans.tune import grid_search

MASK = (1 << 64) - 1


def mixed(v):
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & MASK
    v = (v ^ v >> 27) * 0x94D049BB133111EB & MASK
    return v ^ v >> 31


def plain_tree(x, y, key, depth, k, limit):
    """P(1) function of one tree, row by row and node by node."""
    n, pos = len(y), int(sum(y))
    varying = [c for c in range(x.shape[1]) if x[:, c].min() < x[:, c].max()] if n else []
    if not 0 < pos < n or n < limit[1] or depth >= limit[0] or not varying:
        return lambda row: pos / n
    best = None
    for c in sorted(varying, key=lambda c: (mixed(key ^ 4 * (c + 1)) >> 1, c))[:k]:
        lo, hi = float(x[:, c].min()), float(x[:, c].max())
        cut = lo + (mixed(key ^ 4 * (c + 1) + 1) >> 11) / 2 ** 53 * (hi - lo)
        cut = cut if cut < hi else lo
        sides = [y[x[:, c] <= cut], y[x[:, c] > cut]]
        score = sum((s.sum() ** 2 + (len(s) - s.sum()) ** 2) / len(s) for s in sides)
        if best is None or score > best[0]:
            best = score, c, cut
    _, c, cut = best
    below = x[:, c] <= cut
    left = plain_tree(x[below], y[below], mixed(key ^ 1), depth + 1, k, limit)
    right = plain_tree(x[~below], y[~below], mixed(key ^ 2), depth + 1, k, limit)
    return lambda row: left(row) if row[c] <= cut else right(row)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = (rng.random(n) < 0.4).astype(int)
    x = np.column_stack([rng.normal(size=(n, 2)) + y[:, None], rng.integers(0, 2, n), np.round(rng.normal(size=n) * 3), np.full(n, 7.0)])
    x[100:140] = x[100]  # equal rows of both classes
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(map(float, r)) for r in x], "label": y, "fold": np.arange(n) % 3})
    return spark.createDataFrame(pdf, "id long, features array<double>, label int, fold int"), x, y


@pytest.mark.parametrize("spec", [X.Forest(6, None, 2, 2), X.Forest(4, 3, 2, 1), X.Forest(4, None, 60, 5)])
def test_equals_plain_trees(data, spec):
    df, x, y = data
    grown = X.fit(df, spec, seed=9)
    trees = [plain_tree(x, y, mixed((9 << 32) + t), 0, spec.features, spec.limit) for t in range(spec.trees)]
    want = np.array([np.mean([t(row) for t in trees]) for row in x])
    assert np.allclose(grown.scores(x), want, atol=1e-12)


def test_top_levels_and_local_parts_equal_whole_trees(data, monkeypatch):
    df, x, _ = data
    points = [X.Forest(t, d, s, 2) for t in (3, 7) for d in (1, 4, None) for s in (2, 90)]
    whole, whole_search = X.fit(df, points[-2]), X.search(df, points, 3)
    monkeypatch.setattr(X, "LOCAL_ROWS", 50)
    monkeypatch.setattr(X, "TREES_TOGETHER", 4)
    parts, parts_search = X.fit(df, points[-2]), X.search(df, points, 3)
    assert np.allclose(whole.scores(x), parts.scores(x), atol=1e-12)
    assert whole_search[0] == parts_search[0] and np.allclose(whole_search[1], parts_search[1])


def test_grid_scores_equal_separate_fits(data):
    df, x, y = data
    points = [X.Forest(t, d, s, k) for t in (3, 7) for d in (2, None) for s in (2, 40) for k in (1, 2)]
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
    grown = X.fit(df, X.Forest(3, None, 2, 2))
    assert set(grown.feature) == {-1} and np.allclose(grown.value, 2 / 3)  # no column with finite values that vary
    one = X.fit(df.filter("label = 1"), X.Forest(2, None, 2, 1))
    assert np.allclose(one.scores(np.zeros((4, 2))), 1.0)
    with pytest.raises(ValueError):
        X.fit(df.limit(0), X.Forest())


def test_grid_search_reaches_all_points(data):
    df, _, _ = data
    grid = {"nEstimators": [4, 9], "maxDepth": [2, None], "minSamplesSplit": [2, 30], "maxFeatures": ["sqrt", "log2", None]}
    found = grid_search(ML.ExtraTrees(), grid, df.drop("fold"), folds=3)
    assert len(found.scores) == 24 and max(s for _, s in found.scores) > 0.6
    out = found.model.transform(df.drop("fold"))
    assert out.columns == ["id", "features", "label", "score", "prediction"] and out.count() == 400


def test_ranges_of_bits_numbers_and_odd_values():
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 2, 400), rng.choice([-3.0, 7.5], 400), np.full(400, 2.0), rng.integers(0, 3, 400), rng.integers(0, 2, 400)])
    x[5, 4], x[7, 5], x[11, 2] = np.nan, np.inf, np.nan
    rows, start = np.sort(rng.choice(400, 300, replace=False)), np.array([0, 1, 40, 41, 200])
    ranges = X._Ranges(x, rows)
    lo, hi = ranges.of(rows, start)
    assert np.array_equal(lo, np.minimum.reduceat(x[rows], start, 0), equal_nan=True)
    assert np.array_equal(hi, np.maximum.reduceat(x[rows], start, 0), equal_nan=True)
    assert set(X._Ranges(x[20:], np.arange(380)).bits) == {1, 2, 5} and 0 in ranges.columns and 3 not in ranges.columns
    assert len(X._Ranges(x, rows[:0]).columns) == 0
