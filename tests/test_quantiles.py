"""Exact distributed quantiles against numpy, including a hot value holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.profile import exact_quantiles, order_statistic


@pytest.mark.parametrize("collect_limit", [8, 100000])
def test_quantiles_match_numpy(spark, collect_limit):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.lognormal(2, 3, 3000), np.full(1500, 7.25), -rng.exponential(5, 500)])
    b = rng.integers(0, 4, a.size).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs, buckets=16, collect_limit=collect_limit)
    for p in probs:
        assert got[("a", p)] == pytest.approx(np.quantile(a, p), rel=1e-12, abs=1e-12)
        assert got[("b", p)] == pytest.approx(np.quantile(b, p))


def test_order_statistic(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 2.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ordered = sorted(v for v in vals if v is not None)
    for r in range(len(ordered)):
        assert order_statistic(df, F.col("x"), r, buckets=2, collect_limit=1) == ordered[r]


def test_median_and_imputed_quantiles(spark):
    from tessera.operators.profile import median_and_imputed_quantiles
    rng = np.random.default_rng(7)
    x = rng.lognormal(1, 1, 400)
    vals = [float(v) if i % 5 else None for i, v in enumerate(x)]
    vals += [None] * 150
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    raw = np.array([v for v in vals if v is not None])
    med, qs = median_and_imputed_quantiles(df, {"x": F.col("x")}, [0.1, 0.25, 0.75, 0.9], buckets=4, collect_limit=5)
    assert med["x"] == pytest.approx(np.median(raw))
    imp = np.array([v if v is not None else np.median(raw) for v in vals])
    for p in (0.1, 0.25, 0.75, 0.9):
        assert qs[("x", p)] == pytest.approx(np.quantile(imp, p), rel=1e-12)
