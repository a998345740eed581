"""Hash-rank sampling: equal to the plain window, exact per class, partition-independent."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_text
from tessera.operators.sampling import (exact_rank, flag_top_per_class, largest_remainder, split_quota,
                                        stratified_folds, stratified_split, undersample)


def _table(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label"))


def _window_rank(df, seed):
    w = Window.partitionBy("label").orderBy(hash_text(F.col("key"), seed), "key")
    return {r.key: r.rk for r in df.select("key", F.row_number().over(w).alias("rk")).collect()}


def test_exact_rank_equals_window(spark):
    df = _table(spark)
    want = _window_rank(df, 42)
    got = {r.key: r.rank for r in exact_rank(df, "label", "key", 42).collect()}
    assert got == want


@pytest.mark.parametrize("edge_rows", [1 << 21, 0])
def test_top_per_class_equals_window(spark, monkeypatch, edge_rows):
    import tessera.operators.sampling as S
    monkeypatch.setattr(S, "EDGE_ROWS", edge_rows)       # 0 forces refinement to the full hash
    df = _table(spark)
    want = _window_rank(df, 9)
    quotas = {0: 1000, 1: 17}
    got = {r.key for r in flag_top_per_class(df, "label", "key", quotas, 9).filter("selected").collect()}
    lab = {r.key: r.label for r in df.collect()}
    assert got == {k for k, rk in want.items() if rk <= quotas[lab[k]]}


def test_split_exact_and_partition_independent(spark):
    df = _table(spark, 2000)
    a = {(r.key, r.split) for r in stratified_split(df, "label", "key").collect()}
    b = {(r.key, r.split) for r in stratified_split(df.repartition(7), "label", "key").collect()}
    assert a == b
    counts = {0: 2000 - 286, 1: 286}
    quota = split_quota(counts, 0.3)
    assert sum(quota.values()) == 600
    test = [k for k, s in a if s == "test"]
    assert len(test) == 600
    assert sum(1 for k in test if k % 7 == 0) == quota[1]


def test_largest_remainder():
    assert largest_remainder({"No": 10022, "Yes": 3103}, 3938) == {"No": 3007, "Yes": 931}
    assert sum(largest_remainder({0: 3, 1: 3, 2: 3}, 4).values()) == 4


def test_folds_balanced(spark):
    df = _table(spark, 1000)
    f = stratified_folds(df, "label", "key", k=3).groupBy("label", "fold").count().collect()
    per = {}
    for r in f:
        per.setdefault(r.label, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 3 for v in per.values())


def test_undersample_counts(spark):
    df = _table(spark, 1000)
    n_min = df.filter("label = 1").count()
    got = {r.label: r["count"] for r in undersample(df, "label", "key").groupBy("label").count().collect()}
    assert got == {0: n_min, 1: n_min}
    got = {r.label: r["count"] for r in undersample(df, "label", "key", ratio=0.5).groupBy("label").count().collect()}
    assert got == {0: int(n_min / 0.5), 1: n_min}
