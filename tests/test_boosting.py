"""Boosting of many models together: equal to separate fits, to many blocks, to SQL at one split, and to its own staged scores."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting as B
from tessera.operators import models as ML
from tessera.plans.tune import grid_search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 600
    y = (rng.random(n) < 0.4).astype(int)
    x = np.column_stack([rng.normal(size=(n, 2)) + y[:, None], rng.integers(0, 2, n), np.round(rng.normal(size=n) * 3)])
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(map(float, r)) for r in x], "label": y, "fold": np.arange(n) % 3})
    return spark.createDataFrame(pdf, "id long, features array<double>, label int, fold int"), x, y


def same(a, b):
    assert len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees):
        assert (s.feature, s.cut, s.left) == (t.feature, t.cut, t.left) and np.allclose(s.value, t.value)


SPECS = [B.Boosting(6, 3, 0.1), B.Boosting(4, 2, 0.3, 0.7, 0.5, "newton", 0.1, 2.0, min_hessian=1.0, fold=1), B.Boosting(2, 4, 0.1, min_split=60, fold=0)]


def test_blocks_stages_and_company_do_not_matter(data, monkeypatch):
    df, x, y = data
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 3)
    together, counts = B.fit_together(df, SPECS, {2, 4, 6})
    for m, spec in enumerate(SPECS):
        same(together[m], B.fit_together(df, [spec])[0][0])
    short = B.fit_together(df, [B.Boosting(2, 3, 0.1)])[0][0]  # a prefix of the first
    same(short, B.replace(together[0], trees=together[0].trees[:2]))
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)
    several, again = B.fit_together(df, SPECS, {2, 4, 6})
    for a, b in zip(together, several):
        same(a, b)
    fold = np.arange(len(y)) % 3
    for (m, stage), c in counts.items():
        assert c.tolist() == again[m, stage].tolist()
        if SPECS[m].fold >= 0 and stage <= SPECS[m].rounds:
            held = fold == SPECS[m].fold
            said = B.replace(together[m], trees=together[m].trees[:stage]).margins(x[held]) > 0
            assert c.tolist() == [(said & (y[held] == 1)).sum(), (said & (y[held] == 0)).sum(), (~said & (y[held] == 1)).sum()]


def test_first_split_equals_sql(spark, data):
    df, _, y = data
    p = y.mean()
    for split, l1, l2 in (("friedman", 0.0, 0.0), ("newton", 0.5, 3.0)):
        tree = B.fit_together(df, [B.Boosting(1, 1, 1.0, split=split, l1=l1, l2=l2)])[0][0]
        cuts = B.column_cuts(df, "features")
        rows = [(f, float(c)) for f, cs in enumerate(cuts) for c in cs]
        spark.createDataFrame(rows, "f int, cut double").createOrReplaceTempView("cuts")
        df.createOrReplaceTempView("boosted_rows")
        pull = lambda g: f"(sign({g}) * greatest(abs({g}) - {l1}, 0.0))"
        gain = ("nl * nr / (nl + nr) * power(gl / nl - gr / nr, 2)" if split == "friedman" else
                f"power({pull('gl')}, 2) / (hl + {l2}) + power({pull('gr')}, 2) / (hr + {l2})")
        best = spark.sql(f"""
            with sums as (select f, cut, sum(if(features[f] <= cut, 1, 0)) nl, sum(if(features[f] > cut, 1, 0)) nr,
                sum(if(features[f] <= cut, label - {p}, 0)) gl, sum(if(features[f] > cut, label - {p}, 0)) gr,
                sum(if(features[f] <= cut, {p * (1 - p)}, 0)) hl, sum(if(features[f] > cut, {p * (1 - p)}, 0)) hr
              from boosted_rows cross join cuts group by f, cut)
            select f, cut, {pull('gl')} / (hl + {l2}) vl, {pull('gr')} / (hr + {l2}) vr from sums where nl > 0 and nr > 0
            order by round({gain}, 9) desc, f, cut limit 1""").first()
        t = tree.trees[0]
        assert (t.feature[0], cuts[t.feature[0]][t.cut[0]]) == (best.f, best.cut)
        assert np.allclose(t.value[1:], [best.vl, best.vr]) and math.isclose(tree.prior, math.log(p / (1 - p)))


def test_grid_search_scores_points_by_their_own_folds(data):
    df, _, _ = data
    grid = {"nEstimators": [3, 5], "maxDepth": [2], "learningRate": [0.1, 0.5]}
    found = grid_search(ML.SkGradientBoosting(), grid, df.drop("fold"))
    assert [p for p, _ in found.scores][0] == {"nEstimators": 3, "maxDepth": 2, "learningRate": 0.1} and len(found.scores) == 4
    assert found.best == max(found.scores, key=lambda s: s[1])[0]
    alone = ML.SkGradientBoosting(**found.best).fit(df.drop("fold"))
    a, b = (m.transform(df).select("id", F.round("score", 9)).orderBy("id").collect() for m in (alone, found.model))
    assert a == b


def test_penalties_shrink_leaves(data):
    df, x, _ = data
    loose, tight = (ML.RegularisedBoosting(nEstimators=3, maxDepth=3, regLambda=v, regAlpha=v).fit(df).ensemble for v in (0.0, 50.0))
    assert np.ptp(tight.margins(x)) < 0.5 * np.ptp(loose.margins(x))


def test_columns_of_few_bins_are_summed_jointly():
    rng = np.random.default_rng(5)
    level, rows = rng.integers(0, 6, 4000), 4000
    bins = np.vstack([rng.integers(0, 40, rows), *[level == v for v in range(6)], rng.integers(0, 3, (4, rows))]).astype(np.uint8)
    offsets = np.concatenate(([0], np.cumsum(bins.max(1).astype(int) + 1)))
    for most in (512, 4):     # 4: no joint value of two columns fits
        B.MAX_JOINT, was = most, B.MAX_JOINT
        codes = B.coded(bins, offsets)
        B.MAX_JOINT = was
        assert sorted(p for c in codes for p in c.places) == list(range(offsets[-1]))
        assert len(codes) == 2 or most == 4
        block = B._Block(np.arange(rows), bins, codes, rng.integers(0, 2, rows).astype(float), np.arange(rows) % 3, [0], rng.normal(size=(rows, 1)))
        tree = B.Tree()
        tree.split(0, 0, 17, 0.0, 0.0)
        (_, sums), = B._sums((0, block), {0: (tree, [1, 2])}, [B.Boosting(1, 2, fold=1)], offsets, 1, 0, 42)
        p = 1 / (1 + np.exp(-block.margin[:, 0]))
        for node, mine in enumerate((bins[0] <= 17, bins[0] > 17)):
            for c, first in enumerate(offsets[:-1]):
                for v in range(offsets[c + 1] - first):
                    at = mine & (bins[c] == v) & (block.fold != 1)
                    assert np.allclose(sums[:, node, first + v], [at.sum(), (block.label - p)[at].sum(), (p * (1 - p))[at].sum()])


def test_one_block_up_to_its_bound_and_margins_dealt(data, monkeypatch):
    df, x, _ = data
    monkeypatch.setattr(B, "PASS_ROWS", 150)
    cuts = B.column_cuts(df, "features")
    rows = df.withColumn("label", F.col("label").cast("double"))
    assert B._blocks(rows, cuts, len(x))[1] == 1
    whole = B.fit_together(df, SPECS, {2})
    monkeypatch.setattr(B, "LOCAL_MARGINS", 600)     # a model to a task
    for a, b in zip(whole[0], B.fit_together(df, SPECS, {2})[0]):
        same(a, b)
    monkeypatch.setattr(B, "LOCAL_CELLS", 600)       # 600 rows of 4 columns are too wide
    assert B._blocks(rows, cuts, len(x))[1] == 4
    for a, b in zip(whole[0], B.fit_together(df, SPECS, {2})[0]):
        same(a, b)


def test_rows_of_equal_bins_are_one_cell(data, monkeypatch):
    df, x, y = data
    n, rng = 900, np.random.default_rng(8)
    few = pd.DataFrame({"id": np.arange(n), "features": [list(map(float, r)) for r in rng.integers(0, (5, 4, 2), (n, 3))],
                        "label": rng.integers(0, 2, n).astype(float), "fold": (np.arange(n) % 3).astype(np.int32)})
    rows = df.sparkSession.createDataFrame(few, "id long, features array<double>, label double, fold int")
    cuts, specs = B.column_cuts(rows, "features"), [B.Boosting(4, 3, 0.3), B.Boosting(3, 2, 0.1, fold=1), B.Boosting(2, 5, 0.2, split="newton", l2=1.0, min_hessian=1.0, fold=2)]
    whole, counts = B.fit_together(rows, specs, {2, 3, 4})
    monkeypatch.setattr(B, "BLOCK_ROWS", 150)        # at most 40 cells x 3 folds
    monkeypatch.setattr(B, "PASS_ROWS", 150)
    monkeypatch.setattr(B, "LOCAL_CELLS", 150)
    blocks, n_blocks = B._blocks(rows, cuts, n, sampled=False)
    assert n_blocks == 1 and B._blocks(rows, cuts, n)[1] == 6
    (_, (ids, bins, label, fold, count)), = blocks.collect()
    assert len(ids) <= 120 and count.sum() == n and label.sum() == few.label.sum()
    cells, again = B.fit_together(rows, specs, {2, 3, 4})
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)         # cells in several blocks
    several, passes = B.fit_together(rows, specs, {2, 3, 4})
    for a, b, c in zip(whole, cells, several):
        same(a, b)
        same(a, c)
    for (m, stage), c in counts.items():
        assert c.tolist() == again[m, stage].tolist()
        if stage <= specs[m].rounds:
            held = few.fold.to_numpy() == specs[m].fold
            said = B.replace(whole[m], trees=whole[m].trees[:stage]).margins(np.stack(few.features))[held] > 0
            true = few.label.to_numpy()[held] > 0
            assert c.tolist() == passes[m, stage].tolist() == [(said & true).sum(), (said & ~true).sum(), (~said & true).sum()]


def test_larger_children_are_what_the_smaller_ones_leave():
    rng = np.random.default_rng(6)
    n = 3000
    bins = np.vstack([rng.integers(0, 40, n), rng.integers(0, 3, n)]).astype(np.uint8)
    offsets = np.array([0, 40, 43])
    codes, node = B.coded(bins, offsets), 1 + (bins[0] > 9) + 2 * (bins[1] > 0)     # nodes 1 and 2, 3 and 4
    weights = np.ones(n), rng.normal(size=n), rng.random(n)
    above = B._summed(codes, (node - 1) // 2, 2, weights, 43)
    children, at = np.array([[1, 2], [3, 4]]), node - 1
    sums = B._below(above, np.array([False, True]), children, node, codes, weights)
    direct = B._summed(codes, at, 4, weights, 43)
    assert np.allclose(sums, direct) and (sums[:, direct[0] == 0] == 0).all()
