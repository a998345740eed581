"""Extra trees (M10): each node cuts at a random place of its own range; one forest serves a whole grid.

The draws of a node hash (seed, tree, path from the root, column) and nothing
else. A tree of a smaller depth, or one whose nodes need more rows to be
split, is therefore the same tree cut off sooner, and a forest of fewer trees
its first ones. A grid search grows the largest forest once per fold and reads
every point's held-out scores from it.

A node's split: of the columns that vary in the node (all values finite),
``features`` are drawn; each gets a uniform cut in [min, max); the one with
the purest children by Gini wins, the first drawn among equals. Nodes that are
pure, too small, too deep or without such a column are leaves.

Tables up to ``LOCAL_ROWS`` go to the tasks whole (a broadcast of that bound),
and the trees are dealt to tasks. Beyond it, nodes with more rows are split
level by level, ``TREES_TOGETHER`` trees (of any folds) in the same two passes: ranges of the
columns, then counts left of the drawn cuts, both as grouped aggregates. The
rows of smaller nodes then meet in one task each, which grows the rest. Both
ways give the same trees. A fitted forest (17 bytes and a value for each node)
is held by the driver and broadcast to score, as Spark's own forests are.
Ids are unique; a table without rows of both classes gives trees of one leaf.

What a node does is its forest's ``rule``; ``exact_trees`` brings another one
(the best cut of all, on bootstrapped rows) and shares the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .boosting import _mixed, local_rows

#: Rows that one task grows trees on (fewer in wide tables, ``local_rows``), trees dealt to a task, and trees whose top levels grow in the same passes.
LOCAL_ROWS = 524_288
TREES_A_TASK = 10
TREES_TOGETHER = 32
#: Cells of one step of the scoring (rows x trees).
SCORE_CELLS = 1_000_000


@dataclass(frozen=True)
class Forest:
    """Settings of one forest: ``features`` columns are drawn per node, ``depth`` None is unlimited."""

    trees: int = 100
    depth: int | None = None
    min_split: int = 2
    features: int = 1

    @property
    def limit(self) -> tuple[int, int]:
        return (1 << 30 if self.depth is None else self.depth), max(2, self.min_split)

    @property
    def rule(self) -> RandomCuts:
        return RandomCuts(self.features)


@dataclass(frozen=True)
class RandomCuts:
    """How extra trees split: a random cut in each of ``features`` drawn columns; every row counts once."""

    features: int

    def weights(self, key: np.uint64, ids: np.ndarray) -> np.ndarray:
        return np.ones(len(ids), np.int64)

    def grow(self, x, y, weights, rows, at, keys, depths, limit) -> Nodes:
        return grow(x, y, rows, at, keys, depths, self.features, limit)

    def splits(self, data: DataFrame, tops: list[_Top], opened: dict) -> dict:
        """(top, node) -> (column, cut, rows, weight and positive weight up to the cut) of the nodes that find a split."""
        drawn, out = {}, {}
        for (m, node), (_, n, pos, lo, hi) in opened.items():
            columns, cuts = drawn_cuts(np.array([tops[m].key[node]], np.uint64), lo[None], hi[None], self.features)
            if columns[0, 0] >= 0:
                drawn[m, node] = columns[0][columns[0] >= 0], cuts[0][columns[0] >= 0]
        for place, (nl, pl) in (_lefts(data, tops, drawn) if drawn else {}).items():
            columns, cuts = drawn[place]
            best = int(purest(np.array([opened[place][1]]), np.array([opened[place][2]]), nl[None], pl[None], columns[None])[0])
            out[place] = int(columns[best]), float(cuts[best]), int(nl[best]), int(nl[best]), int(pl[best])
        return out


@dataclass
class Nodes:
    """Nodes of some trees, roots first; the children of an inner node (``feature`` not negative) are ``left`` and the one after.

    ``size`` counts rows, ``n`` and ``pos`` their weights."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    size: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    depth: np.ndarray
    key: np.ndarray

    @property
    def value(self) -> np.ndarray:
        return self.pos / np.maximum(self.n, 1)


def tree_key(seed: int, tree: int) -> np.uint64:
    return _mixed(np.array([(seed << 32) + tree], np.uint64))[0]


def children_keys(keys: np.ndarray) -> np.ndarray:
    return np.stack([_mixed(keys ^ np.uint64(side)) for side in (1, 2)], 1).ravel()


def drawn_cuts(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (-1: none left) and cuts that nodes draw among the columns that vary, in drawn order."""
    salt = 4 * np.arange(1, lo.shape[1] + 1, dtype=np.uint64)
    with np.errstate(invalid="ignore"):
        usable = (lo < hi) & np.isfinite(hi - lo)
        share = (_mixed(keys[:, None] ^ (salt + np.uint64(1))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        cut = lo + share * (hi - lo)
    cut = np.where(cut < hi, cut, lo)
    turn = np.where(usable, _mixed(keys[:, None] ^ salt) >> np.uint64(1), np.uint64(1 << 63))
    first = np.argsort(turn, 1, kind="stable")[:, :k]
    return np.where(np.take_along_axis(usable, first, 1), first, -1), np.take_along_axis(cut, first, 1)


def purest(n: np.ndarray, pos: np.ndarray, nl: np.ndarray, pl: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Place of the best drawn column of each node, -1 without any."""
    n, pos, nl, pl = n[:, None].astype(float), pos[:, None].astype(float), nl.astype(float), pl.astype(float)
    nr, pr = n - nl, pos - pl
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (pl * pl + (nl - pl) * (nl - pl)) / nl + (pr * pr + (nr - pr) * (nr - pr)) / nr
    best = np.where(columns >= 0, score, -np.inf).argmax(1)
    return np.where((columns >= 0).any(1), best, -1)


class _Ranges:
    """Minima and maxima of the columns in sets of rows; columns of two values are bits of one number, those of one need no look."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        used = x[rows]
        self.lo, self.hi = (used.min(0), used.max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        with np.errstate(invalid="ignore"):
            varies = ~(self.lo == self.hi)
            two = varies & np.isfinite(self.lo) & np.isfinite(self.hi) & ((used == self.lo) | (used == self.hi)).all(0)
        self.bits = np.flatnonzero(two)[:62]
        self.columns = {c: np.ascontiguousarray(x[:, c]) for c in np.setdiff1d(np.flatnonzero(varies), self.bits)}
        self.code = (x[:, self.bits] == self.hi[self.bits]) @ (1 << np.arange(len(self.bits), dtype=np.int64)) if len(self.bits) else None

    def of(self, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (np.repeat(self.lo[None], len(start), 0) for _ in range(2))
        for c, values in self.columns.items():
            values = values[rows]
            lo[:, c], hi[:, c] = np.minimum.reduceat(values, start), np.maximum.reduceat(values, start)
        if self.code is not None:
            code, shift = self.code[rows], np.arange(len(self.bits))
            for out, found in ((lo, np.bitwise_and.reduceat(code, start)), (hi, np.bitwise_or.reduceat(code, start))):
                out[:, self.bits] = np.where((found[:, None] >> shift) & 1, self.hi[self.bits], self.lo[self.bits])
        return lo, hi


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, at: np.ndarray, keys: np.ndarray, depths: np.ndarray, k: int, limit: tuple[int, int]) -> Nodes:
    """Trees below some roots: row ``rows[i]`` of ``x`` (labels ``y``) belongs to root ``at[i]``."""
    levels, base, flat, ranges = [], 0, np.ascontiguousarray(x).ravel(), _Ranges(x, rows)
    while len(keys):
        m = len(keys)
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        n, pos = np.bincount(at, minlength=m), np.bincount(at, y[rows], m).astype(np.int64)
        feature, cut, left = np.full(m, -1, np.int32), np.zeros(m), np.zeros(m, np.int32)
        opened = (pos > 0) & (pos < n) & (n >= limit[1]) & (depths < limit[0])
        stay = opened[at]
        rows, at, nodes = rows[stay], (np.cumsum(opened) - 1)[at[stay]], np.flatnonzero(opened)
        ahead, ahead_depths = keys[:0], depths[:0]
        if len(nodes):
            start = np.searchsorted(at, np.arange(len(nodes)))
            columns, cuts = drawn_cuts(keys[nodes], *ranges.of(rows, start), k)
            place = np.arange(len(rows))
            below = flat.take(rows[:, None] * x.shape[1] + columns[at]) <= cuts[at]
            # rows in the lower half of a number, positive ones in the upper
            both = np.add.reduceat(below * (1 + ((y[rows] > 0).astype(np.int64) << 32))[:, None], start, 0)
            nl, pl = both & 0xFFFFFFFF, both >> 32
            best = purest(n[nodes], pos[nodes], nl, pl, columns)
            cuts_made = best >= 0
            split, chosen = nodes[cuts_made], best[cuts_made]
            feature[split], cut[split] = columns[cuts_made, chosen], cuts[cuts_made, chosen]
            left[split] = base + m + 2 * np.arange(len(split))
            child = 2 * (np.cumsum(cuts_made) - 1)[at] + ~below[place, best[at]]
            rows, at = rows[cuts_made[at]], child[cuts_made[at]]
            ahead, ahead_depths = children_keys(keys[split]), np.repeat(depths[split] + 1, 2)
        levels.append((feature, cut, left, n, n, pos, depths, keys))
        base, keys, depths = base + m, ahead, ahead_depths
    return Nodes(*(np.concatenate(c) for c in zip(*levels)))


def held_values(nodes: Nodes, x: np.ndarray, at: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """P(1) of the rows of ``x`` that start at nodes ``at``, for trees that stop at each of ``limits``."""
    out = np.full((len(limits), len(x)), np.nan)
    rows, at, value = np.arange(len(x)), at.copy(), nodes.value
    while len(rows):
        inner = nodes.feature[at] >= 0
        for v, (depth, split) in enumerate(limits):
            stop = (~inner | (nodes.depth[at] >= depth) | (nodes.size[at] < split)) & np.isnan(out[v, rows])
            out[v, rows[stop]] = value[at[stop]]
        rows, at = rows[inner], at[inner]
        at = nodes.left[at] + ~(x[rows, nodes.feature[at]] <= nodes.cut[at])
    return out


@dataclass
class Grown:
    """A fitted forest: its nodes one after another, and where the trees start."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean P(1) of the trees."""
        out, step = np.zeros(len(x)), max(1, SCORE_CELLS // max(1, len(self.roots)))
        for s in range(0, len(x), step):
            part = x[s:s + step]
            at = np.repeat(self.roots[None, :], len(part), 0).ravel()
            cells, row = np.arange(len(at)), np.repeat(np.arange(len(part)), len(self.roots))
            while len(cells):
                cells = cells[self.feature[at[cells]] >= 0]
                node = at[cells]
                at[cells] = self.left[node] + ~(part[row[cells], self.feature[node]] <= self.cut[node])
            out[s:s + step] = self.value[at].reshape(len(part), -1).mean(1)
        return out

    def nodes(self) -> Iterator[tuple[int, int, int, float, float]]:
        """(tree, node, column or -1, cut, P(1)); the children of node i are 2i and 2i + 1, the root is 1."""
        for tree, root in enumerate(self.roots.tolist()):
            ahead = [(1, root)]
            while ahead:
                number, at = ahead.pop()
                yield tree, number, int(self.feature[at]), float(self.cut[at]), float(self.value[at])
                if self.feature[at] >= 0:
                    ahead += [(2 * number + side, int(self.left[at]) + side) for side in (0, 1)]

    def scored(self, df: DataFrame, features, score: str, prediction: str) -> DataFrame:
        """``df`` with P(label = 1) and the predicted label (the smaller one at exactly one half)."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def mean(rows: pd.Series) -> pd.Series:
            return pd.Series(shared.value.scores(np.stack(rows.to_numpy())) if len(rows) else np.zeros(0))

        out = df.drop(score, prediction).withColumn(score, mean(features))
        return out.withColumn(prediction, (F.col(score) > 0.5).cast("double"))


def _matrix(batch) -> np.ndarray:
    return np.array(batch.column("features").combine_chunks().flatten() if isinstance(batch, pa.Table) else batch.column("features").flatten(),
                    np.float64).reshape(batch.num_rows, -1)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


_HELD = "fold int, stage int, id long, label int, p array<double>"
_GROWN = "tree int, node int, feature binary, cut binary, left binary, value binary"


def _held_rows(fold: int, stage: int, ids: np.ndarray, label: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(p)), pa.array(p.T.ravel()))
    return _table({"fold": np.full(n, fold, np.int32), "stage": np.full(n, stage, np.int32), "id": ids, "label": label.astype(np.int32), "p": lists})


def _grown_row(tree: int, node: int, nodes: Nodes) -> pa.RecordBatch:
    arrays = {"feature": nodes.feature, "cut": nodes.cut, "left": nodes.left, "value": nodes.value}
    return _table({"tree": np.array([tree], np.int32), "node": np.array([node], np.int32)} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()})


@dataclass(frozen=True)
class _Job:
    """What to grow: trees [first, last) without the rows of ``fold`` (-1: of all rows)."""

    fold: int
    first: int
    last: int
    stage: int


def _tops(folds: Iterable[int], stages: list[int], seed: int) -> list[list[_Top]]:
    """The trees of all folds and stages, in sets that grow in the same passes."""
    tops = [_Top(f, t, stage, tree_key(seed, t)) for stage, (a, b) in enumerate(zip([0] + stages, stages)) for f in folds for t in range(a, b)]
    return [tops[s:s + TREES_TOGETHER] for s in range(0, len(tops), TREES_TOGETHER)]


def _jobs(folds: Iterable[int], stages: list[int], together: int) -> list[_Job]:
    out = []
    for stage, (a, b) in enumerate(zip([0] + stages, stages)):
        out += [_Job(f, s, min(b, s + together), stage) for f in folds for s in range(a, b, together)]
    return out


def _local(data: DataFrame, jobs: list[_Job], rule, limit, limits, seed: int) -> DataFrame:
    """Held-out values (with ``limits``) or trees of the jobs, on a table of at most ``LOCAL_ROWS`` rows."""
    spark = data.sparkSession
    table = data.orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((table.column("id").to_numpy(), _matrix(table), table.column("label").to_numpy(), table.column("fold").to_numpy()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, y, fold = shared.value
        for number in (j for b in batches for j in b.column("id").to_pylist()):
            job = jobs[number]
            held = np.flatnonzero(fold == job.fold)
            for tree in range(job.first, job.last):
                key = tree_key(seed, tree)
                weights = rule.weights(key, ids)
                used = np.flatnonzero((fold != job.fold) & (weights > 0))
                nodes = rule.grow(x, y, weights, used, np.zeros(len(used), np.int64), np.array([key]), np.zeros(1, np.int64), limit)
                if limits is None:
                    yield _grown_row(tree, 0, nodes)
                    continue
                p = held_values(nodes, x[held], np.zeros(len(held), np.int64), limits)
                total = p if tree == job.first else total + p
            if limits is not None and len(held):
                yield _held_rows(job.fold, job.stage, ids[held], y[held], total)

    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, _GROWN if limits is None else _HELD)


class _Top:
    """The upper part of one tree while it grows on the driver; a node with at most ``LOCAL_ROWS`` rows is left to one task."""

    def __init__(self, fold: int, tree: int, stage: int, key: np.uint64):
        self.fold, self.tree, self.stage = fold, tree, stage
        self.feature, self.cut, self.left, self.size, self.n, self.pos, self.depth, self.key, self.above = [-1], [0.0], [0], [-1], [-1], [0], [0], [key], [-1]
        self.open, self.local = [0], []

    def nodes(self) -> Nodes:
        return Nodes(*(np.array(c, t) for c, t in ((self.feature, np.int32), (self.cut, np.float64), (self.left, np.int32), (self.size, np.int64),
                                                    (self.n, np.int64), (self.pos, np.int64), (self.depth, np.int64), (self.key, np.uint64))))

    def reached(self, x: np.ndarray) -> np.ndarray:
        at, feature, cut, left = np.zeros(len(x), np.int64), *(np.array(c) for c in (self.feature, self.cut, self.left))
        rows = np.flatnonzero(feature[at] >= 0)
        while len(rows):
            node = at[rows]
            at[rows] = left[node] + ~(x[rows, feature[node]] <= cut[node])
            rows = rows[feature[at[rows]] >= 0]
        return at

    def split(self, node: int, feature: int, cut: float, rows: int, nl: int, pl: int) -> None:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        keys = children_keys(np.array([self.key[node]], np.uint64))
        for key, size, n, pos in zip(keys, (rows, self.size[node] - rows), (nl, self.n[node] - nl), (pl, self.pos[node] - pl)):
            for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.size, size), (self.n, n), (self.pos, pos), (self.depth, self.depth[node] + 1), (self.key, key),
                              (self.above, node)):
                column.append(v)
            self.open.append(len(self.feature) - 1)


def _ranges(data: DataFrame, tops: list[_Top], rule) -> dict:
    """(top, node) -> (rows, weight, positive weight, minima, maxima) of the open nodes."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold, ids = _matrix(b), b.column("label").to_numpy(), b.column("fold").to_numpy(), b.column("id").to_numpy()
            for m, top in enumerate(tops):
                if not top.open:
                    continue
                at, weights = top.reached(x), rule.weights(top.key[0], ids)
                for node in top.open:
                    mine = (at == node) & (fold != top.fold) & (weights > 0)
                    if mine.any():
                        v, w = x[mine], weights[mine]
                        d = v.shape[1]
                        yield _table({"top": np.full(d, m, np.int32), "node": np.full(d, node, np.int32), "col": np.arange(d, dtype=np.int32), "lo": v.min(0), "hi": v.max(0),
                                      "size": np.full(d, len(v), np.int64), "n": np.full(d, w.sum(), np.int64), "pos": np.full(d, w @ y[mine], np.int64)})

    parts = data.mapInArrow(run, "top int, node int, col int, lo double, hi double, size long, n long, pos long")
    # Spark's min passes NaN over and numpy's does not: such a column is left out of the draw either way
    spoilt = F.max((F.isnan("lo") | F.isnan("hi")).cast("int")).alias("nan")
    sums = [F.sum(c).alias(c) for c in ("size", "n", "pos")]
    found: dict = {}
    for r in parts.groupBy("top", "node", "col").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums, spoilt).collect():
        found.setdefault((r["top"], r["node"]), []).append((r["col"], np.nan if r["nan"] else r["lo"], r["hi"], r["size"], r["n"], r["pos"]))
    out = {}
    for place, columns in found.items():
        columns.sort()
        out[place] = *columns[0][3:], np.array([c[1] for c in columns]), np.array([c[2] for c in columns])
    return out


def _lefts(data: DataFrame, tops: list[_Top], drawn: dict) -> dict:
    """(top, node) -> rows and positives up to each drawn cut."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, fold = _matrix(b), b.column("label").to_numpy() > 0, b.column("fold").to_numpy()
            for m, top in enumerate(tops):
                mine = [node for node in top.open if (m, node) in drawn]
                at = top.reached(x) if mine else None
                for node in mine:
                    columns, cuts = drawn[m, node]
                    use = (at == node) & (fold != top.fold)
                    below = x[use][:, columns] <= cuts
                    yield _table({"top": np.full(len(cuts), m, np.int32), "node": np.full(len(cuts), node, np.int32), "turn": np.arange(len(cuts), dtype=np.int32),
                                  "n": below.sum(0, dtype=np.int64), "pos": (below & y[use][:, None]).sum(0, dtype=np.int64)})

    out = {place: np.zeros((2, len(c[0])), np.int64) for place, c in drawn.items()}
    for r in data.mapInArrow(run, "top int, node int, turn int, n long, pos long").groupBy("top", "node", "turn").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect():
        out[r["top"], r["node"]][:, r["turn"]] = r["n"], r["pos"]
    return out


def _grow_tops(data: DataFrame, tops: list[_Top], rule, limit: tuple[int, int]) -> None:
    while any(t.open for t in tops):
        opened = {}
        for (m, node), found in _ranges(data, tops, rule).items():
            top, (size, n, pos) = tops[m], found[:3]
            most = local_rows(LOCAL_ROWS, len(found[3]))
            top.size[node], top.n[node], top.pos[node] = size, n, pos
            if size <= most:
                top.local.append(node)
            elif 0 < pos < n and size >= limit[1] and top.depth[node] < limit[0]:
                opened[m, node] = found
        splits = rule.splits(data, tops, opened) if opened else {}
        for top in tops:
            top.open = []
        for (m, node), split in splits.items():
            top = tops[m]
            top.split(node, *split)
            top.local += [c for c in top.open[-2:] if top.size[c] <= most]
            top.open[-2:] = [c for c in top.open[-2:] if top.size[c] > most]


def _finished(data: DataFrame, tops: list[_Top], rule, limit, limits) -> DataFrame:
    """Held-out values (with ``limits``) or the parts of trees below the local nodes."""
    def routed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, fold = _matrix(b), b.column("fold").to_numpy()
            for m, top in enumerate(tops):
                at = top.reached(x)
                mine = np.flatnonzero(np.isin(at, top.local) & ((fold != top.fold) | (limits is not None)))
                part = b.take(pa.array(mine))
                yield _table({"top": np.full(len(mine), m, np.int32), "node": at[mine].astype(np.int32), "held": fold[mine] == top.fold, "id": part.column("id"),
                              "features": part.column("features"), "label": part.column("label")})

    def finish(key, table):
        m, node = (v.as_py() for v in key)
        top, x, y = tops[m], _matrix(table), table.column("label").to_numpy()
        held = table.column("held").to_numpy(zero_copy_only=False)
        weights = rule.weights(top.key[0], table.column("id").to_numpy())
        used = np.flatnonzero(~held & (weights > 0))
        nodes = rule.grow(x, y, weights, used, np.zeros(len(used), np.int64), np.array([top.key[node]], np.uint64), np.array([top.depth[node]]), limit)
        if limits is None:
            return pa.Table.from_batches([_grown_row(top.tree, node, nodes)])
        p = held_values(nodes, x[held], np.zeros(int(held.sum()), np.int64), limits)
        _above(top, node, p, limits)
        return pa.Table.from_batches([_held_rows(top.fold, top.stage, table.column("id").to_numpy()[held], y[held], p)])

    def settled(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, fold, ids, y = _matrix(b), b.column("fold").to_numpy(), b.column("id").to_numpy(), b.column("label").to_numpy()
            for top in tops:
                at = top.reached(x)
                mine = np.flatnonzero((fold == top.fold) & ~np.isin(at, top.local))
                if len(mine):
                    yield _held_rows(top.fold, top.stage, ids[mine], y[mine], held_values(top.nodes(), x[mine], np.zeros(len(mine), np.int64), limits))

    rows = data.mapInArrow(routed, "top int, node int, held boolean, id long, features array<double>, label int")
    parts = max(1, sum(len(t.local) for t in tops))
    done = rows.repartition(parts, "top", "node").groupBy("top", "node").applyInArrow(finish, _GROWN if limits is None else _HELD)
    return done if limits is None else done.unionByName(data.mapInArrow(settled, _HELD))


def _above(top: _Top, node: int, p: np.ndarray, limits) -> None:
    """Values of the trees that stop above a local node."""
    path = [node]
    while top.above[path[-1]] >= 0:
        path.append(top.above[path[-1]])
    for v, (depth, split) in enumerate(limits):
        for a in reversed(path[1:]):
            if top.depth[a] >= depth or top.size[a] < split:
                p[v] = top.pos[a] / top.n[a]
                break


def _prepared(data: DataFrame) -> tuple[DataFrame, int]:
    data = cut_lineage(data.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"),
                                   F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold")), "extra-trees")
    rows = data.count()
    if not rows:
        raise ValueError("empty training table")
    return data, rows


def _run(data: DataFrame, rows: int, folds: Iterable[int], stages: list[int], rule, limit, limits, seed: int) -> Iterator[tuple[DataFrame, list[_Top]]]:
    """Held-out values or trees, a table for each set of trees that grows together."""
    if rows <= local_rows(LOCAL_ROWS, len(data.select("features").first()[0])):
        yield _local(data, _jobs(folds, stages, TREES_A_TASK), rule, limit, limits, seed), []
        return
    for tops in _tops(folds, stages, seed):
        _grow_tops(data, tops, rule, limit)
        yield cut_lineage(_finished(data, tops, rule, limit, limits), "extra-trees-part"), tops


def fit(data: DataFrame, spec: Forest, seed: int = 42) -> Grown:
    """The forest of ``spec`` on all rows of ``data`` (id long, features array<double>, label 0/1, fold int)."""
    ship_package(data.sparkSession)
    data, rows = _prepared(data)
    pieces = []
    for part, tops in _run(data, rows, [-1], [spec.trees], spec.rule, spec.limit, None, seed):
        below = {(r["tree"], r["node"]): tuple(np.frombuffer(r[c], t) for c, t in (("feature", np.int32), ("cut", np.float64), ("left", np.int32), ("value", np.float64)))
                 for r in part.collect()}
        pieces += [_joined(top, below) for top in tops] or [below[tree, 0] for tree in range(spec.trees)]
    sizes = np.array([len(p[0]) for p in pieces])
    roots = np.cumsum(sizes) - sizes
    feature, cut, left, value = (np.concatenate(c) for c in zip(*pieces))
    return Grown(feature, cut, left.astype(np.int64) + np.repeat(roots, sizes), value, roots)


def _joined(top: _Top, below: dict) -> tuple:
    """One tree: its upper part with the parts that grew below the local nodes."""
    nodes = top.nodes()
    parts, base = [[nodes.feature.copy(), nodes.cut.copy(), nodes.left.copy(), nodes.value]], len(nodes.feature)
    for node in top.local:
        feature, cut, left, value = below[top.tree, node]
        for column, own in zip(parts[0], (feature, cut, left + base - 1, value)):
            column[node] = own[0]
        parts.append([feature[1:], cut[1:], left[1:] + base - 1, value[1:]])
        base += len(feature) - 1
    return tuple(np.concatenate(c) for c in zip(*parts))


def search(data: DataFrame, points: list[Forest], folds: int, seed: int = 42) -> tuple[int, list[float], Grown]:
    """(index of the best point, mean F1 of class 1 over the folds of every point, the best point fitted on all rows). Ties go to the first."""
    ship_package(data.sparkSession)
    ready, rows = _prepared(data)
    found: dict = {}
    for rule in dict.fromkeys(p.rule for p in points):
        own = [p for p in points if p.rule == rule]
        limits, stages = list(dict.fromkeys(p.limit for p in own)), sorted({p.trees for p in own})
        widest = max(d for d, _ in limits), min(s for _, s in limits)
        values = None
        for part, _ in _run(ready, rows, range(folds), stages, rule, widest, limits, seed):
            values = part if values is None else values.unionByName(part)
        # a set of trees counts in every stage from its own on
        each = values.withColumn("stage", F.explode(F.sequence("stage", F.lit(len(stages) - 1))))
        sums = each.groupBy("fold", "stage", "id", "label").agg(*[F.sum(F.col("p")[v]).alias(f"v{v}") for v in range(len(limits))])
        trees = F.array(*[F.lit(float(s)) for s in stages])[F.col("stage")]
        counts = []
        for v in range(len(limits)):
            said, true = F.round(F.col(f"v{v}") / trees, 9) > 0.5, F.col("label") > 0
            counts += [F.count_if(c).alias(f"{name}{v}") for name, c in (("tp", said & true), ("fp", said & ~true), ("fn", ~said & true))]
        for r in sums.groupBy("fold", "stage").agg(*counts).collect():
            for v, lim in enumerate(limits):
                tp, fp, fn = r[f"tp{v}"], r[f"fp{v}"], r[f"fn{v}"]
                found.setdefault((rule, stages[r["stage"]], lim), {})[r["fold"]] = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    scores = [sum(found[p.rule, p.trees, p.limit].values()) / folds for p in points]
    best = max(range(len(points)), key=lambda i: (scores[i], -i))
    return best, scores, fit(ready, points[best], seed)
