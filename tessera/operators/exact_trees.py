"""Decision trees (M3) and random forests (M4) whose nodes take the best cut of all their values.

A node considers every cut half way between neighbouring distinct values of
its columns (``features`` of those that vary, drawn by a hash of the node) that
leaves ``min_leaf`` rows on either side, and takes the one with the least Gini
impurity or entropy; the smallest column, then the smallest value, among
equals (scores are compared to 12 decimals). ``depth``, ``min_split`` and the
number of trees only cut trees off, so a grid search grows one forest per fold
for all their values (see ``extra_trees``, which this shares its passes with).

A forest's trees see bootstrapped rows: a row's count in a tree is the Poisson(1)
quantile of a hash of (tree, id), so it does not depend on partitions and no
draw goes through the driver. Rows count once for ``min_split`` and
``min_leaf`` and with their count in the impurity.

Beyond ``extra_trees.LOCAL_ROWS`` rows a node's best cut comes from prefix sums:
counts by (node, column, value) as a grouped aggregate, range-partitioned by the
same columns, summed inside each range, with the ranges before added from a
table of one row for each (range, node, column). No column of a node is in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .boosting import _mixed
from .extra_trees import Forest, Nodes, _matrix, _table, _Top, children_keys, drawn_cuts

#: Scores are compared as whole numbers of this part of a row's impurity.
SCORE_STEPS = 1e12
#: Distribution of the number of times that a row is drawn (Poisson with mean 1; beyond, 2^-53 is not reached).
BOOTSTRAP = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


@dataclass(frozen=True)
class ExactForest(Forest):
    """Settings of one forest; a decision tree is one tree of all columns without bootstrap."""

    min_leaf: int = 1
    criterion: str = "gini"
    bootstrap: bool = False

    @property
    def rule(self) -> BestCuts:
        if self.criterion not in ("gini", "entropy"):
            raise ValueError(f"criterion {self.criterion!r} is neither gini nor entropy")
        return BestCuts(self.features, max(1, self.min_leaf), self.criterion, self.bootstrap)


def _x_log_x(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1))


def purity(criterion: str, n: np.ndarray, pos: np.ndarray, nl: np.ndarray, pl: np.ndarray) -> np.ndarray:
    """Purity of the two sides in whole steps; the larger, the better."""
    n, pos, nl, pl = (v.astype(np.float64) for v in (n, pos, nl, pl))
    nr, pr = n - nl, pos - pl
    if criterion == "gini":
        raw = (pl * pl + (nl - pl) * (nl - pl)) / nl + (pr * pr + (nr - pr) * (nr - pr)) / nr
    else:
        raw = (_x_log_x(pl) + _x_log_x(nl - pl) - _x_log_x(nl)) + (_x_log_x(pr) + _x_log_x(nr - pr) - _x_log_x(nr))
    return np.floor(raw / n * SCORE_STEPS + 0.5)


def _purity_column(criterion: str) -> Column:
    """``purity`` of the columns n, pos, nl and pl."""
    n, pos, nl, pl = (F.col(c).cast("double") for c in ("n", "pos", "nl", "pl"))
    nr, pr = n - nl, pos - pl
    if criterion == "gini":
        raw = (pl * pl + (nl - pl) * (nl - pl)) / nl + (pr * pr + (nr - pr) * (nr - pr)) / nr
    else:
        terms = [v * F.log(F.greatest(v, F.lit(1.0))) for v in (pl, nl - pl, nl, pr, nr - pr, nr)]
        raw = (terms[0] + terms[1] - terms[2]) + (terms[3] + terms[4] - terms[5])
    return F.floor(raw / n * SCORE_STEPS + 0.5)


def by_value(values: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of one batch, the rows of each and its sums of ``weights``."""
    found, of = np.unique(values, return_inverse=True)
    return found, np.bincount(of, minlength=len(found)), *(np.bincount(of, w, len(found)).astype(np.int64) for w in weights)


@dataclass(frozen=True)
class BestCuts:
    """How the trees of an ``ExactForest`` split."""

    features: int
    min_leaf: int
    criterion: str
    bootstrap: bool

    def weights(self, key: np.uint64, ids: np.ndarray) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(ids), np.int64)
        draw = (_mixed(_mixed(ids.astype(np.uint64)) ^ np.uint64(key)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        return np.searchsorted(BOOTSTRAP, draw, side="right")

    def grow(self, x, y, weights, rows, at, keys, depths, limit) -> Nodes:
        """Trees below some roots: row ``rows[i]`` of ``x`` belongs to root ``at[i]``."""
        x, w, at = x[rows], weights[rows].astype(np.int64), at.copy()
        p = w * (y[rows] > 0)
        # rows in the order of each column; sorting by node keeps it
        orders = [np.argsort(c, kind="stable") for c in x.T]
        levels, base = [], 0
        while len(keys):
            m, live = len(keys), at >= 0
            size = np.bincount(at[live], minlength=m)
            n, pos = (np.bincount(at[live], v[live], m).astype(np.int64) for v in (w, p))
            feature, cut, left = np.full(m, -1, np.int32), np.zeros(m), np.zeros(m, np.int32)
            opened = (pos > 0) & (pos < n) & (size >= limit[1]) & (depths < limit[0])
            at = np.where(live & opened[at], (np.cumsum(opened) - 1)[at], -1)
            nodes = np.flatnonzero(opened)
            ahead, ahead_depths = keys[:0], depths[:0]
            if len(nodes):
                orders = [self._by_node(o, at) for o in orders]
                column, place = self._best(x, w, p, orders, keys[nodes], size[nodes], n[nodes], pos[nodes])
                made = column >= 0
                split = nodes[made]
                feature[split], cut[split] = column[made], place[made]
                left[split] = base + m + 2 * np.arange(len(split))
                entries = orders[0]
                of = at[entries]
                above = ~(x[entries, column[of]] <= place[of])
                at[entries] = np.where(made[of], 2 * (np.cumsum(made) - 1)[of] + above, -1)
                ahead, ahead_depths = children_keys(keys[split]), np.repeat(depths[split] + 1, 2)
            levels.append((feature, cut, left, size, n, pos, depths, keys))
            base, keys, depths = base + m, ahead, ahead_depths
        return Nodes(*(np.concatenate(c) for c in zip(*levels)))

    @staticmethod
    def _by_node(order: np.ndarray, at: np.ndarray) -> np.ndarray:
        order = order[at[order] >= 0]
        return order[np.argsort(at[order], kind="stable")]

    def _best(self, x, w, p, orders, keys, size, n, pos) -> tuple[np.ndarray, np.ndarray]:
        """Column (-1: no split) and cut of each node; ``orders`` hold the rows of each column by (node, value)."""
        m, starts = len(keys), np.cumsum(size) - size
        lo, hi = (np.stack([x[o[ends], c] for c, o in enumerate(orders)], 1) for ends in (starts, starts + size - 1))
        columns = drawn_cuts(keys, lo, hi, self.features)[0]
        drawn = np.zeros((m, x.shape[1] + 1), bool)
        np.put_along_axis(drawn, np.where(columns >= 0, columns, x.shape[1]), True, 1)
        node = np.repeat(np.arange(m), size)
        rows_left = np.arange(1, len(node) + 1) - starts[node]
        enough = (rows_left >= self.min_leaf) & (size[node] - rows_left >= self.min_leaf)
        best, column, cut = np.full(m, -np.inf), np.full(m, -1, np.int32), np.zeros(m)
        for c, o in enumerate(orders):
            v = x[o, c]
            ends = np.flatnonzero((v[:-1] < v[1:]) & (node[:-1] == node[1:]) & enough[:-1] & drawn[node[:-1], c])
            if not len(ends):
                continue
            of = node[ends]
            nl, pl = (np.concatenate([[0], np.cumsum(u[o])]) for u in (w, p))
            score = purity(self.criterion, n[of], pos[of], nl[ends + 1] - nl[starts[of]], pl[ends + 1] - pl[starts[of]])
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            top = np.maximum.reduceat(score, first)
            hits = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(of)))))
            own, at = np.unique(of[hits], return_index=True)
            end = ends[hits[at]]
            better = top > best[own]
            own, end = own[better], end[better]
            best[own], column[own] = top[better], c
            middle = np.maximum(v[end] / 2 + v[end + 1] / 2, v[end])
            cut[own] = np.where(middle < v[end + 1], middle, v[end])
        return column, cut

    def splits(self, data: DataFrame, tops: list[_Top], opened: dict) -> dict:
        """(top, node) -> (column, cut, rows, weight and positive weight up to the cut) of the nodes that find a split."""
        drawn = {}
        for (m, node), (*_, lo, hi) in opened.items():
            columns = drawn_cuts(np.array([tops[m].key[node]], np.uint64), lo[None], hi[None], self.features)[0][0]
            if columns[0] >= 0:
                drawn[m, node] = np.sort(columns[columns >= 0]).astype(np.int32)
        if not drawn:
            return {}

        def values(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, fold, ids = _matrix(b), b.column("label").to_numpy(), b.column("fold").to_numpy(), b.column("id").to_numpy()
                for m, top in enumerate(tops):
                    mine = [node for node in top.open if (m, node) in drawn]
                    if not mine:
                        continue
                    at, weights = top.reached(x), self.weights(top.key[0], ids)
                    for node in mine:
                        use = np.flatnonzero((at == node) & (fold != top.fold) & (weights > 0))
                        w = weights[use].astype(np.int64)
                        counts = [by_value(x[use, c], w, w * (y[use] > 0)) for c in drawn[m, node]]
                        value, size, n, pos = (np.concatenate(c) for c in zip(*counts))
                        yield _table({"top": np.full(len(value), m, np.int32), "node": np.full(len(value), node, np.int32),
                                      "col": np.repeat(drawn[m, node], [len(c[0]) for c in counts]), "value": value, "size": size, "n": n, "pos": pos})

        group = ["top", "node", "col"]
        sums = ("size", "n", "pos")
        counts = data.mapInArrow(values, "top int, node int, col int, value double, size long, n long, pos long") \
            .groupBy(*group, "value").agg(*[F.sum(c).alias(c) for c in sums])
        parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = cut_lineage(counts.repartitionByRange(parts, *group, "value").withColumn("part", F.spark_partition_id()), "exact-trees-values")
        whole, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("part")
        ranges = ranged.groupBy(*group, "part").agg(*[F.sum(c).alias(c) for c in sums], F.min("value").alias("least"))
        ranges = ranges.select(*group, "part", *[F.sum(c).over(whole).alias(c) for c in sums],
                               *[F.coalesce(F.sum(c).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before") for c in sums],
                               F.lead("least").over(before).alias("following"))
        inside = Window.partitionBy(*group, "part").orderBy("value")
        running = ranged.select(*group, "part", "value", F.lead("value").over(inside).alias("next"),
                                *[F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c}_inside") for c in sums])
        cuts = running.join(ranges, [*group, "part"]).select(
            *group, "value", F.coalesce("next", "following").alias("next"), *sums,
            *[(F.col(f"{c}_inside") + F.col(f"{c}_before")).alias(name) for c, name in (("size", "rows"), ("n", "nl"), ("pos", "pl"))])
        cuts = cuts.filter(F.col("next").isNotNull() & (F.col("rows") >= self.min_leaf) & (F.col("size") - F.col("rows") >= self.min_leaf))
        middle = F.greatest(F.col("value") / 2 + F.col("next") / 2, F.col("value"))
        cut = F.when(middle < F.col("next"), middle).otherwise(F.col("value")).alias("cut")
        best = cuts.groupBy("top", "node").agg(F.max(F.struct(_purity_column(self.criterion).alias("score"), (-F.col("col")).alias("turn"),
                                                              (-F.col("value")).alias("place"), "col", cut, "rows", "nl", "pl")).alias("b"))
        return {(r["top"], r["node"]): (r["b"]["col"], r["b"]["cut"], r["b"]["rows"], r["b"]["nl"], r["b"]["pl"]) for r in best.collect()}
