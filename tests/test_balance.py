"""Balancers: target counts, SMOTE rows on the segment, preconditions and fallback, Tomek links."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import balance as B


def _table(spark, n_maj=60, n_min=12, seed=0, sep=3.0):
    rng = np.random.default_rng(seed)
    rows = [(i, list(rng.normal(size=3)), 0) for i in range(n_maj)]
    rows += [(n_maj + i, list(rng.normal(size=3) + sep), 1) for i in range(n_min)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "features", "label"]),
                                 "id long, features array<double>, label int")


def test_smote_counts_and_segment(spark):
    df = _table(spark)
    out = B.smote(df, k=5, seed=42).toPandas()
    assert (out.label == 1).sum() == (out.label == 0).sum() == 60
    orig = {r.id: np.array(r.features) for r in df.collect()}
    syn = out[out.is_synthetic]
    assert len(syn) == 48 and syn.id.is_unique and (syn.id < 0).all()
    for r in syn.itertuples():
        x, y = orig[r.base_id], orig[r.neighbor_id]
        assert np.allclose(np.array(r.features), x + r.gap * (y - x))
        assert 0 <= r.gap < 1


def test_smote_partial(spark):
    out = B.smote(_table(spark), sampling_strategy=0.75).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {0: 60, 1: 45}


def test_tiny_minority_falls_back(spark):
    df = _table(spark, n_min=3)
    with pytest.raises(B.BalanceError):
        B.smote(df, k=5)
    out, name = B.with_fallback(df, ("SMOTE", lambda d: B.smote(d)), ("RUS", lambda d: d.limit(6)))
    assert name == "RUS"


def test_adasyn_clean_classes_fall_back(spark):
    df = _table(spark, sep=100.0)
    with pytest.raises(B.BalanceError):
        B.adasyn(df)


def test_adasyn_generates_near_balance(spark):
    df = _table(spark, sep=1.0, n_min=15)
    out = B.adasyn(df).groupBy("label").count().collect()
    got = {r.label: r["count"] for r in out}
    assert abs(got[1] - got[0]) <= 15


def test_tomek_pair_removed(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.1, 0.0], 1), (2, [5.0, 5.0], 0), (3, [5.0, 6.0], 0), (4, [9.0, 9.0], 1),
            (5, [9.0, 10.0], 1)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    links = [(r.id_a, r.id_b) for r in B.tomek_links(df).collect()]
    assert links == [(0, 1)]
    left = sorted(r.id for r in B.remove_tomek(df).collect())
    assert left == [2, 3, 4, 5]


def test_near_miss_keeps_closest(spark):
    df = _table(spark, n_maj=30, n_min=6)
    out = B.near_miss(df, k=3).toPandas()
    assert (out.label == 0).sum() == 6 and (out.label == 1).sum() == 6
