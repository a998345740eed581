"""Edge cases of exact statistics and samplers."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile
from tessera.operators.balance import near_miss
from tessera.operators.models import depth
from tessera.operators.prep import Preprocessor
from tessera.operators.roles import Roles


def test_order_statistic_with_infinite_values(spark):
    df = spark.range(6000).select(F.col("id").cast("double").alias("x")).union(
        spark.createDataFrame([(math.inf,), (math.inf,), (-math.inf,)], "x double"))
    got = [profile.order_statistic(df, F.col("x"), r) for r in (0, 1, 3000, 6000, 6001, 6002)]
    assert got == [-math.inf, 0.0, 2999.0, 5999.0, math.inf, math.inf]


def test_near_miss_keeps_ties_by_large_ids(spark):
    top = 1 << 60
    rows = [(top + k, [1.0, 0.0], 0) for k in range(12)] + [(k, [0.0, float(k)], 1) for k in range(4)]
    out = near_miss(spark.createDataFrame(rows, "id long, features array<double>, label int"))
    assert sorted(r.id for r in out.filter("label = 0").collect()) == [top + k for k in range(4)]


def test_mode_tie_takes_the_smallest_number(spark):
    df = spark.createDataFrame([(1, 9, "Yes"), (2, 10, "No"), (3, 9, "No"), (4, 10, "Yes"), (5, None, "No")], "k long, c int, t string")
    assert Preprocessor(Roles(key="k", target="t", binary=(), categorical=("c",), numeric=())).fit(df).modes["c"] == "9"


def test_depth_above_the_limit_is_refused():
    assert depth(None) == 30 and depth(7) == 7
    with pytest.raises(ValueError):
        depth(31)


def test_unseen_binary_level_gets_its_own_code(spark):
    roles = Roles(key="k", target="t", binary=("b",), categorical=(), numeric=())
    model = Preprocessor(roles).fit(spark.createDataFrame([(1, "x", "Yes"), (2, "y", "No")], "k long, b string, t string"))
    out = model.transform(spark.createDataFrame([(3, "z", "No"), (4, "y", "No"), (5, None, "Yes")], "k long, b string, t string"))
    assert {r.k: r.b for r in out.collect()} == {3: -1, 4: 1, 5: 0}
