"""Blocked, pruned kNN join == brute force, with ties, duplicates and a hot point."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessera.operators import knn
from tessera.operators.knn import brute_force_knn, knn_join


def _frame(spark, pts):
    pdf = pd.DataFrame({"id": np.arange(len(pts), dtype=np.int64), "features": [list(map(float, p)) for p in pts]})
    return spark.createDataFrame(pdf, "id long, features array<double>"), pdf


def _check(spark, pts, k, metric, block_rows, queries=None, projection="pca"):
    df, pdf = _frame(spark, pts)
    qdf, qpdf = (df, pdf) if queries is None else _frame(spark, queries)
    self_join = queries is None
    got = knn_join(qdf, df, k, metric=metric, exclude_self=self_join, block_rows=block_rows,
                   projection=projection).toPandas()
    want = brute_force_knn(qpdf, pdf, k, metric, exclude_self=self_join)
    got = got.sort_values(["qid", "rank"]).reset_index(drop=True)
    want = want.sort_values(["qid", "rank"]).reset_index(drop=True)
    assert (got[["qid", "rank", "rid"]].to_numpy() == want[["qid", "rank", "rid"]].to_numpy()).all()
    assert np.allclose(got.distance, want.distance)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block_rows", [7, 10000])
@pytest.mark.parametrize("projection", ["pca", "random"])
def test_random_points(spark, metric, block_rows, projection):
    pts = np.random.default_rng(1).normal(size=(150, 5)) * np.array([5.0, 1.0, 1.0, 0.5, 0.1])
    _check(spark, pts, 4, metric, block_rows, projection=projection)


def test_square_corners_ties_by_id(spark):
    pts = [(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0.5)]
    _check(spark, pts, 3, "euclidean", 2)


def test_hot_duplicate_point(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([np.tile([[1.0, 1.0, 1.0]], (60, 1)), rng.normal(size=(120, 3))])
    _check(spark, pts, 5, "euclidean", 8)


def test_queries_against_other_table(spark):
    rng = np.random.default_rng(4)
    _check(spark, rng.normal(size=(80, 4)), 3, "euclidean", 9, queries=rng.normal(size=(30, 4)))


def test_pass_b_returns_only_candidates_within_the_bound(spark, monkeypatch):
    """Two far clusters and ties at the bound: equal to brute force, with few candidates beyond k."""
    from tessera.operators import knn
    rng = np.random.default_rng(4)
    pts = np.vstack([np.round(rng.normal(size=(120, 3)) * 2), np.round(rng.normal(size=(60, 3))) + 500])
    seen, block_topk = [], knn._block_topk
    monkeypatch.setattr(knn, "_block_topk", lambda *a, **k: seen.append(block_topk(*a, **k)) or seen[-1])
    _check(spark, pts, 4, "euclidean", 16)
    own, others = (c.count() for c in seen)
    assert own <= 180 * 4 * 2 and others < 180 * 4 * 4


def test_small_blocks_ship_a_vector_to_few_cells(spark, monkeypatch):
    """with blocks of 4 rows and no pruning (12 dimensions) a query still visits a bounded number of cells."""
    from tessera.operators import knn
    pts = np.random.default_rng(8).normal(size=(400, 12))
    visits, block_topk = [], knn._block_topk
    monkeypatch.setattr(knn, "_block_topk", lambda v, *a, **k: visits.append(v.count()) or block_topk(v, *a, **k))
    _check(spark, pts, 3, "manhattan", 4)
    assert sum(visits) <= 400 * 16


def test_equal_vectors_and_far_values(spark):
    """Copies beyond k + 1, values too large for float32 and cells of one value."""
    rng = np.random.default_rng(9)
    pts = np.vstack([np.tile([[2.0, 0.0]], (40, 1)), np.round(rng.normal(size=(60, 2))), rng.normal(size=(20, 2)) * 1e32])
    for metric in ("euclidean", "manhattan"):
        _check(spark, pts, 3, metric, 16)


def test_grid_of_neighbours_equals_cross_validation(spark, monkeypatch):
    """one join per fold and metric for all points, scores and choice as by CrossValidator."""
    from tessera.operators import models
    from tessera.plans import tune
    rng = np.random.default_rng(5)
    label = np.arange(90) % 3 == 0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(90), "features": [list(map(float, p)) for p in np.round(
        rng.normal(size=(90, 2)) + label[:, None], 1)], "label": label.astype(int)}), "id long, features array<double>, label int")
    grid = {"k": [3, 1, 5], "weights": ["uniform", "distance"]}
    joins, join = [], models.knn_join
    monkeypatch.setattr(models, "knn_join", lambda *a, **k: joins.append(1) or join(*a, **k))
    got = tune.grid_search(models.KNNClassifier(), grid, df, folds=2)
    assert len(joins) == 2
    monkeypatch.delattr(models.KNNClassifier, "fit_grid")
    want = tune.grid_search(models.KNNClassifier(), grid, df, folds=2)
    assert [p for p, _ in got.scores] == [p for p, _ in want.scores]
    assert np.allclose([s for _, s in got.scores], [s for _, s in want.scores]) and got.best == want.best
    assert got.model.transform(df).filter("prediction = 1").count() == want.model.transform(df).filter("prediction = 1").count()


def test_groups_grow_with_the_table(spark, monkeypatch):
    """Beyond 16 full groups the groups grow, so a vector is still shuffled 16 times, until they are at their limit."""
    from tessera.operators import knn
    pts = np.random.default_rng(8).normal(size=(400, 12))
    visits, block_topk = [], knn._block_topk
    monkeypatch.setattr(knn, "_block_topk", lambda v, *a, **k: visits.append(v.count()) or block_topk(v, *a, **k))
    monkeypatch.setattr(knn, "GROUP_ROWS", 8)
    for metric in ("euclidean", "manhattan"):
        _check(spark, pts, 3, metric, 4)
        assert sum(visits) <= 400 * 16
        visits.clear()
    monkeypatch.setattr(knn, "MAX_GROUP_ROWS", 16)
    _check(spark, pts, 3, "euclidean", 4)


def test_coarse_bounds_are_screened_in_single_precision_and_stay_exact():
    """Unit vectors with bounds far above float32 steps; pairs closer to each other than those steps keep their exact order."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=(600, 16))
    r /= np.linalg.norm(r, axis=1)[:, None]
    r = np.concatenate([r, r * (1 + 1e-9)])
    q = r[:300] + 0.01 * rng.normal(size=(300, 16))
    qid, rid = np.arange(10_000, 10_300), np.arange(len(r))
    exact = knn._pairwise(q, r, "euclidean")
    bound = np.sort(exact, axis=1)[:, 39]
    assert knn._Screen(r, "euclidean", q, bound).cols.dtype == np.float32
    tables = pa.table({"_qid": qid, "_qv": list(q), "_bound": bound}), pa.table({"_rid": rid, "_rv": list(r)})
    got = knn._local_topk(4, "euclidean", True)(*tables).to_pandas().sort_values(["_qid", "_d", "_rid"])
    order = np.stack([np.lexsort((rid, d))[:4] for d in exact])
    assert got["_rid"].to_numpy().reshape(300, 4).tolist() == order.tolist()
    assert (got["_d"].to_numpy().reshape(300, 4) == np.take_along_axis(exact, order, axis=1)).all()


def test_single_precision_is_not_used_where_its_steps_are_coarse():
    r = 1e6 + np.random.default_rng(4).normal(size=(200, 3))
    assert knn._Screen(r, "euclidean", r, np.full(200, 1e-3)).cols.dtype == np.float64
    assert knn._Screen(r, "euclidean", r, np.full(200, np.inf)).cols.dtype == np.float64


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_visits_measure_one_axis_per_node(metric, monkeypatch):
    """Visited cells are those whose box lies within the bound; no gap to a whole box is computed on the way."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    cells = knn._Cells(x, 32, "pca", 7)
    bound = rng.uniform(0, 3, len(x))
    leaves = np.flatnonzero(cells.axis < 0)
    wanted = {(i, int(cells.cell[n])) for i in range(len(x)) for n in leaves
              if knn._box_gap(x[i:i + 1], x[i:i + 1], cells.lo[n:n + 1], cells.hi[n:n + 1], metric)[0] <= bound[i]}
    monkeypatch.setattr(knn, "_box_gap", None)
    assert set(zip(*(a.tolist() for a in cells.within(x, bound, metric)))) == wanted


def test_groups_take_null_ids_and_nulls_inside_vectors():
    q = pa.table({"_qid": pa.array([2 ** 60 + 1, None], pa.int64()), "_qv": [[0.0, 0.0], [5.0, 5.0]], "_bound": [np.inf, np.inf]})
    r = pa.table({"_rid": pa.array([2 ** 60 + 3, None], pa.int64()), "_rv": [[0.0, 1.0], [5.0, 6.0]]})
    got = knn._local_topk(1, "euclidean", True)(q, r).to_pylist()
    assert {(x["_qid"], x["_rid"], x["_d"]) for x in got} == {(2 ** 60 + 1, 2 ** 60 + 3, 1.0), (-2 ** 63, 2 ** 60 + 3, 41.0)}
    holed = r.set_column(1, "_rv", pa.array([[0.0, None], [5.0, 6.0]], pa.list_(pa.float64())))
    assert knn._local_topk(1, "manhattan", True)(q, holed).num_rows == 0
    with pytest.raises(ValueError, match="a vector is null"):
        knn._local_topk(1, "euclidean", True)(q, r.set_column(1, "_rv", pa.array([None, [5.0, 6.0]], pa.list_(pa.float64()))))
