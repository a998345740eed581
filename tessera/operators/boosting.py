"""Boosted trees (M5, M9) for many grid points and folds at once.

All models of a grid search grow together. A level of the current trees of
all models is one pass: every block of rows adds up the count, gradient and
Hessian of each (model, node, column, bin), the sums of a model meet in one
place, and only its best splits return to the driver. Grid points that differ
in the number of rounds are one model, scored at each of these rounds; the
models of the folds and those fitted on all rows share the same passes. The
passes of a search are therefore rounds x depth, however many points it has.
A table of one block (``BLOCK_ROWS``) needs no passes to meet: the models are
dealt to tasks, no more than ``LOCAL_MARGINS`` margins to one, and each goes
through many rounds with the same functions. Larger tables have smaller blocks.

Rows are kept as blocks of bin numbers with the models' margins beside them.
The margins after a round depend on the margins before it, which are
checkpointed to the shared folder every ``CHECKPOINT_ROUNDS`` rounds, so a
lost executor costs a few rounds. These blocks are the state of an iteration
over numpy arrays, which is why they are an RDD and not a DataFrame. Columns of
few bins, such as one-hot ones, are summed by their joint value in a block, of
which there are few, and dealt to the bins of each column afterwards.

Rows whose values share all their bins have the same margin in every model: a
block keeps them as one cell, and the rows only count into the weights of its
cells by fold and sample. If no model samples rows, a large table meets by cell
before it is cut into blocks, and is one block if its cells fit.

Splits: ``friedman`` weighs the squared difference of the children's mean
gradients; ``newton`` is the regularised second-order gain. Leaves are Newton
steps, shrunk by ``l1`` and ``l2``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_root, ship_package

#: Rows of a table that is one block (as long as it has no more cells than this), rows in the blocks of a larger one, and
#: margins (rows x models) of a task that grows whole models.
BLOCK_ROWS = 524_288
LOCAL_CELLS = 8_388_608
PASS_ROWS = 65_536
LOCAL_MARGINS = 16_777_216
#: Bins of a column that is summed jointly with others, and joint values of such columns.
FEW_BINS = 8
MAX_JOINT = 512
#: Candidate cuts of a column, and rounds between checkpoints of the margins.
MAX_CUTS = 63
CHECKPOINT_ROUNDS = 25
CUT_ERROR = 1e-4


@dataclass(frozen=True)
class Boosting:
    """Settings of one boosted model; rows of ``fold`` are left out (-1: none)."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    split: str = "friedman"
    l1: float = 0.0
    l2: float = 0.0
    min_split: int = 2
    min_leaf: int = 1
    min_hessian: float = 0.0
    fold: int = -1


class Tree:
    """A binary tree: inner nodes send values up to ``cut`` of ``feature`` to ``left``, others to the node after it."""

    def __init__(self, value: float = 0.0):
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [value]

    def split(self, node: int, feature: int, cut: int, left: float, right: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for value in (left, right):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
        return at, at + 1

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row (a column of ``bins``) is in."""
        feature, cut, left = (np.array(x, np.int64) for x in (self.feature, self.cut, self.left))
        node, row = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(depth):
            f = feature[node]
            node = np.where(f >= 0, left[node] + (bins[f, row] > cut[node]), node)
        return node


def _mixed(x: np.ndarray) -> np.ndarray:
    """Seeded 64-bit hash (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _drawn(ids: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """Which ids are in the sample of a turn; it depends on the id alone, not on its block."""
    salt = np.uint64((seed * 1_000_003 + turn * 7919 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (_mixed(ids.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def drawn_columns(n: int, share: float, seed: int, turn: int) -> np.ndarray:
    """Mask of the columns that a turn's tree may use: the same number each time, at least one."""
    rank = np.argsort(_mixed(np.arange(n, dtype=np.uint64) + np.uint64((seed * 31 + turn) * 0x9E3779B9 % (1 << 62))), kind="stable")
    mask = np.zeros(n, bool)
    mask[rank[:max(1, int(share * n))]] = True
    return mask


def _pull(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def leaf_value(n, g, h, spec: Boosting):
    return _pull(g, spec.l1) / np.maximum(h + spec.l2, 1e-12)


@dataclass
class _Splits:
    """Best splits of some nodes (``feature`` -1: none); sums are [count, gradient, Hessian; node]."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    own: np.ndarray


def best_splits(sums: np.ndarray, spec: Boosting, offsets: np.ndarray, columns: np.ndarray) -> _Splits:
    """The best splits of the nodes of ``sums`` [count, gradient, Hessian; node; bin]; nothing is split off at a column's last bin."""
    total = sums[:, :, offsets[0]:offsets[1]].sum(2)
    run = np.cumsum(sums, 2)
    usable = np.repeat(columns, np.diff(offsets))
    usable[offsets[1:] - 1] = False
    places = np.flatnonzero(usable)
    if not len(places):
        none = np.full(total.shape[1], -1)
        return _Splits(none, none, total, total, total)
    feature = np.searchsorted(offsets, places, "right") - 1
    start = offsets[feature]
    left = run[:, :, places] - np.where(start > 0, run[:, :, np.maximum(start - 1, 0)], 0.0)
    right = total[:, :, None] - left
    (nl, gl, hl), (nr, gr, hr), (n, g, h) = left, right, total[:, :, None]
    fits = (nl >= spec.min_leaf) & (nr >= spec.min_leaf) & (n >= spec.min_split) & (hl >= spec.min_hessian) & (hr >= spec.min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        if spec.split == "friedman":
            gain = nl * nr / n * (gl / nl - gr / nr) ** 2
        else:
            weight = lambda a, b: _pull(a, spec.l1) ** 2 / (b + spec.l2)
            gain = weight(gl, hl) + weight(gr, hr) - weight(g, h)
    gain = np.where(fits & (gain > 1e-10), gain, -np.inf)
    best, nodes = gain.argmax(1), np.arange(gain.shape[0])
    found = np.isfinite(gain[nodes, best])
    return _Splits(np.where(found, feature[best], -1), places[best] - start[best], left[:, nodes, best], right[:, nodes, best], total)


@dataclass
class _Codes:
    """Numbers of the rows' values in some columns, and the bins they add to: ``places``, in order or by the matrix ``spread``."""

    code: np.ndarray
    size: int
    places: np.ndarray
    spread: np.ndarray | None


def coded(bins: np.ndarray, offsets: np.ndarray) -> list[_Codes]:
    """The columns of a block for summing: each of many bins alone, those of few by their joint values."""
    sizes = np.diff(offsets)
    out = [_Codes(bins[c], int(sizes[c]), np.arange(offsets[c], offsets[c + 1]), None) for c in np.flatnonzero(sizes > FEW_BINS)]
    todo = [np.flatnonzero(sizes <= FEW_BINS)]
    while todo:
        columns = todo.pop()
        if not len(columns):
            continue
        code, values = np.zeros(bins.shape[1], np.int64), np.zeros((1, 0), np.int64)
        for c in columns:       # renumbered after each column, so the numbers stay small
            found, code = np.unique(code * sizes[c] + bins[c], return_inverse=True)
            values = np.column_stack([values[found // sizes[c]], found % sizes[c]])
            if len(found) > MAX_JOINT and len(columns) > 1:
                break
        if len(values) > MAX_JOINT and len(columns) > 1:
            todo += [columns[:len(columns) // 2], columns[len(columns) // 2:]]
            continue
        places = np.concatenate([np.arange(offsets[c], offsets[c + 1]) for c in columns])
        spread = np.column_stack([values[:, [i]] == np.arange(sizes[c]) for i, c in enumerate(columns)]).astype(np.float64)
        out.append(_Codes(code.astype(np.int16), len(values), places, spread))
    return out


@dataclass
class _Block:
    """Rows (``ids``, ``label``, ``fold``) and the cells that they are in (``bins``, ``codes``, ``margin``).

    A row stands for ``count`` rows of one cell and fold, and ``label`` is their sum. Without ``cell`` each row is its own."""

    ids: np.ndarray
    bins: np.ndarray
    codes: list[_Codes]
    label: np.ndarray
    fold: np.ndarray
    models: list[int]
    margin: np.ndarray
    cell: np.ndarray | None = None
    count: np.ndarray | None = None

    def weights(self, spec: Boosting, turn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positive rows of each cell that a model sees in a turn."""
        use = self.fold != spec.fold
        if spec.subsample < 1:
            use &= _drawn(self.ids, spec.subsample, seed, turn)
        cell = np.flatnonzero(use) if self.cell is None else self.cell[use]
        cells = self.bins.shape[1]
        return np.bincount(cell, None if self.count is None else self.count[use], cells).astype(np.float64), np.bincount(cell, self.label[use], cells)

    def held_counts(self, j: int, spec: Boosting) -> np.ndarray:
        """[true positives, false positives, false negatives] of the block's model ``j`` on the rows that it leaves out."""
        held = np.flatnonzero(self.fold == spec.fold)
        said = self.margin[held if self.cell is None else self.cell[held], j] > 0
        pos = self.label[held]
        neg = (1 if self.count is None else self.count[held]) - pos
        return np.array([pos[said].sum(), neg[said].sum(), pos[~said].sum()]).astype(np.int64)


def collapsed(ids: np.ndarray, bins: np.ndarray, label: np.ndarray, fold: np.ndarray, count: np.ndarray, sampled: bool) -> tuple[np.ndarray, ...]:
    """(ids, bins of the cells, label, fold, count, cell) of some rows; those of a cell and fold are one row unless rows are sampled by id."""
    each = np.ascontiguousarray(bins.T)
    _, first, cell = np.unique(each.view(f"V{each.shape[1] * each.itemsize}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)       # as they came: additions to one bin after the other wait for each other
    bins, cell = np.ascontiguousarray(each[first[order]].T), np.argsort(order)[cell.ravel()]
    if not sampled:
        folds, of_fold = np.unique(fold, return_inverse=True)
        found, of = np.unique(cell * len(folds) + of_fold, return_inverse=True)
        label, count = np.bincount(of, label, len(found)), np.bincount(of, count, len(found))
        ids, cell, fold = np.zeros(len(found), np.int64), found // max(1, len(folds)), folds[found % max(1, len(folds))]
    return ids, bins, label, fold, count, cell


def _summed(codes: list[_Codes], at: np.ndarray, nodes: int, weights: tuple, wide: int) -> np.ndarray:
    """[count, gradient, Hessian; node; bin] of the cells that are in a node (``at`` not negative)."""
    rows = np.flatnonzero(at >= 0)
    if every := len(rows) == len(at):
        rows = slice(None)
    sums, at, weights = np.zeros((3, nodes, wide)), at[rows], [w[rows] for w in weights]
    for c in codes:
        key = at * c.size
        key += c.code if every else c.code[rows]
        by_code = np.stack([np.bincount(key, w, nodes * c.size) for w in weights]).reshape(3, nodes, c.size)
        sums[:, :, c.places] = by_code if c.spread is None else by_code @ c.spread
    return sums


def _gradients(margin: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    p = 1 / (1 + np.exp(-margin))
    return n, pos - n * p, n * p * (1 - p)


def _sums(item: tuple, trees: dict, specs: list[Boosting], offsets: np.ndarray, level: int, turn: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """The block's sums for the open nodes of its models."""
    block, out, kept = item[1], [], {}
    for j, m in enumerate(block.models):
        tree, open_nodes = trees[m]
        if not open_nodes:
            continue
        spec = specs[m]
        number = np.full(len(tree.feature), -1)
        number[open_nodes] = np.arange(len(open_nodes))
        at = number[tree.leaves(block.bins, level)]
        if (own := (spec.fold, spec.subsample)) not in kept:
            kept[own] = block.weights(spec, turn, seed)
        out.append((m, _summed(block.codes, at, len(open_nodes), _gradients(block.margin[:, j], *kept[own]), int(offsets[-1]))))
    return out


def _splits(item: tuple, specs: list[Boosting], offsets: np.ndarray, turn: int, seed: int) -> tuple[int, _Splits]:
    m, sums = item
    return m, best_splits(sums, specs[m], offsets, drawn_columns(len(offsets) - 1, specs[m].colsample, seed, turn))


def _advanced(block: _Block, trees: dict[int, Tree], specs: list[Boosting]) -> _Block:
    """The block with the margins after a round."""
    margin = block.margin.copy(order="K")
    for j, m in enumerate(block.models):
        margin[:, j] += specs[m].rate * np.array(trees[m].value)[trees[m].leaves(block.bins, specs[m].depth)]
    return replace(block, margin=margin)


def _able(sums: np.ndarray, spec: Boosting) -> list[bool]:
    """Whether nodes are large enough to be split (with a margin for rounding)."""
    n, _, h = sums
    return ((n >= max(spec.min_split, 2 * spec.min_leaf)) & (h >= spec.min_hessian * (2 - 1e-6))).tolist()


def _extended(tree: Tree, open_nodes: list[int], found: _Splits, spec: Boosting, level: int) -> list[int]:
    """Apply the best splits of a level to a tree; the nodes of the next one that may be split."""
    if level == 0:
        tree.value[0] = float(leaf_value(*found.own[:, 0], spec))
    made, ahead = np.flatnonzero(found.feature >= 0), []
    left, right = found.left[:, made], found.right[:, made]
    columns = found.feature[made].tolist(), found.cut[made].tolist(), leaf_value(*left, spec).tolist(), leaf_value(*right, spec).tolist()
    for i, feature, cut, vl, vr, *able in zip(made.tolist(), *columns, _able(left, spec), _able(right, spec)):
        ahead += [node for node, on in zip(tree.split(open_nodes[i], feature, cut, vl, vr), able) if on]
    return ahead if level + 1 < spec.depth else []


def _grown(block: _Block, codes: list[_Codes], j: int, weights: tuple, spec: Boosting, offsets: np.ndarray, turn: int, seed: int) -> tuple[Tree, np.ndarray]:
    """A model's tree of a turn, from a block that is the whole table, and the node that each cell ends in."""
    cells, wide, columns = block.bins.shape[1], int(offsets[-1]), drawn_columns(len(offsets) - 1, spec.colsample, seed, turn)
    weights, flat = _gradients(block.margin[:, j], *weights), block.bins.ravel()
    tree, node, open_nodes = Tree(), np.zeros(cells, np.int64), [0]
    sums = _summed(codes, node, 1, weights, wide)
    for level in range(spec.depth):
        found = best_splits(sums, spec, offsets, columns)
        made = np.flatnonzero(found.feature >= 0)
        before, open_nodes = np.array(open_nodes), _extended(tree, open_nodes, found, spec, level)
        feature, cut, left = (np.array(x, np.int64) for x in (tree.feature, tree.cut, tree.left))
        # cells of the nodes that were split go one step down
        split = np.zeros(len(feature), bool)
        split[before[made]] = True
        step = np.flatnonzero(split[node])
        of = node[step]
        node[step] = left[of] + (flat[feature[of] * cells + step] > cut[of])
        if not open_nodes:
            break
        ahead = np.zeros(len(feature), bool)
        ahead[open_nodes] = True
        children = left[before[made]][:, None] + np.arange(2)
        some = ahead[children].any(1)
        sums = _below(sums[:, made[some]], found.left[0, made[some]] > found.right[0, made[some]], children[some], node, codes, weights)[:, ahead[children[some]].ravel()]
    return tree, node


def _below(sums: np.ndarray, larger: np.ndarray, children: np.ndarray, node: np.ndarray, codes: list[_Codes], weights: tuple) -> np.ndarray:
    """Sums of the two children of some nodes with ``sums``; only the smaller ones are added up (the right ones where ``larger`` is the left)."""
    pairs, small = np.arange(len(children)), larger.astype(np.int64)
    number = np.full(int(node.max()) + 2, -1)
    number[children[pairs, small]] = pairs
    least = _summed(codes, number[node], len(pairs), weights, sums.shape[2])
    rest = sums - least
    rest[:, rest[0] < 0.5] = 0.0     # no rows, so no rounding left over
    out = np.empty((3, len(pairs), 2, sums.shape[2]))
    out[:, pairs, small], out[:, pairs, 1 - small] = least, rest
    return out.reshape(3, -1, sums.shape[2])


def _rounds(block: _Block, turns: range, specs: list[Boosting], offsets: np.ndarray, stages: set[int], seed: int) -> tuple:
    """A block that is the whole table, after some rounds; the trees of its models by round, and their counts at the stages."""
    trees, counts, always = [], [], {}
    block = replace(block, margin=block.margin.copy(order="K"))
    codes = [replace(c, code=c.code.astype(np.int64)) for c in block.codes]
    for turn in turns:
        trees.append({})
        kept = dict(always)
        for j, m in enumerate(block.models):
            spec = specs[m]
            if turn < spec.rounds:
                own = spec.fold, spec.subsample
                if own not in kept:
                    kept[own] = block.weights(spec, turn, seed)
                    if spec.subsample >= 1:
                        always[own] = kept[own]
                trees[-1][m], node = _grown(block, codes, j, kept[own], spec, offsets, turn, seed)
                block.margin[:, j] += spec.rate * np.array(trees[-1][m].value)[node]
            if turn + 1 in stages:
                counts.append(((m, turn + 1), block.held_counts(j, spec)))
    return block, trees, counts


def _held_counts(item: tuple, specs: list[Boosting]) -> list[tuple[int, np.ndarray]]:
    """(model, [true positives, false positives, false negatives]) on the rows that the model leaves out."""
    return [(m, item[1].held_counts(j, specs[m])) for j, m in enumerate(item[1].models)]


def column_cuts(data: DataFrame, features: str, max_cuts: int = MAX_CUTS) -> list[list[float]]:
    """Candidate cuts of each column: every value of a column with few, else its quantiles (one pass for all columns, ranks
    within ``CUT_ERROR`` of the rows)."""
    n = len(data.select(features).first()[0])
    columns = data.select(*[F.col(features)[k].alias(f"c{k}") for k in range(n)])
    found = columns.approxQuantile(columns.columns, [k / (max_cuts + 1) for k in range(max_cuts + 2)], CUT_ERROR)
    return [sorted(set(q))[:-1] for q in found]


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin numbers, a row for each column of ``x``; bin k holds the values up to cut k."""
    return np.stack([np.searchsorted(np.array(c), x[:, k], "left") for k, c in enumerate(cuts)]).astype(np.int32)


def local_rows(most: int, columns: int) -> int:
    """Rows that one task may hold whole: ``most``, fewer in a wide table."""
    return min(most, max(PASS_ROWS, LOCAL_CELLS // max(1, columns)))


def _blocks(data: DataFrame, cuts: list[list[float]], rows: int, sampled: bool = True):
    """RDD of (number, (ids, bins, label, fold, count)), written once; and how many there are.

    Unless rows are ``sampled``, those of a table of more than one block are summed by their bins and fold first."""
    most, kind = local_rows(BLOCK_ROWS, len(cuts)), np.uint8 if MAX_CUTS < 256 else np.int32

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("features").flatten()).reshape(b.num_rows, -1)
                bins = np.ascontiguousarray(binned(x, cuts).T.astype(kind))
                bins = pa.Array.from_buffers(pa.binary(bins.shape[1] * bins.itemsize), b.num_rows, [None, pa.py_buffer(bins)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), bins, b.column("label"), b.column("fold"), pa.array(np.ones(b.num_rows, np.int64))],
                                                 ["id", "bins", "label", "fold", "count"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, -1) if c == "bins" else b.column(c).to_numpy()
                       for c in ("id", "bins", "label", "fold", "count")) for b in batches if b.num_rows]
        if parts:
            ids, bins, label, fold, count = (np.concatenate(c) for c in zip(*parts))
            arrays = (ids, np.ascontiguousarray(bins.T), label, fold, count)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in arrays], ["ids", "bins", "label", "fold", "count"])

    values, by = data.select("id", "features", "label", "fold").mapInArrow(numbered, "id long, bins binary, label double, fold int, count long"), "id"
    if not sampled and rows > most:
        sums = F.lit(0).cast("long").alias("id"), F.sum("label").alias("label"), F.sum("count").alias("count")
        values, by = cut_lineage(values.groupBy("bins", "fold").agg(*sums).select("id", "bins", "label", "fold", "count"), "boosting-cells"), "bins"
        rows = values.count()
    n_blocks = 1 if rows <= most else math.ceil(rows / min(BLOCK_ROWS, PASS_ROWS))
    packed = cut_lineage(values.repartition(n_blocks, by).mapInArrow(pack, "ids binary, bins binary, label binary, fold binary, count binary"), "boosting-blocks")
    types = (np.int64, kind, np.float64, np.int32, np.int64)
    blocks = packed.rdd.zipWithIndex().map(lambda r: (r[1], tuple(np.frombuffer(c, t) for c, t in zip(r[0], types))))
    return blocks, max(1, packed.count())


@dataclass
class Ensemble:
    """A fitted model: start margin, learning rate, column cuts and trees."""

    prior: float
    rate: float
    depth: int
    cuts: list[list[float]]
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.cuts), np.full(len(x), self.prior)
        for tree in self.trees:
            out += self.rate * np.array(tree.value)[tree.leaves(bins, self.depth)]
        return out

    def scored(self, df: DataFrame, features, score: str, prediction: str) -> DataFrame:
        """``df`` with P(label = 1) and the predicted label."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(rows: pd.Series) -> pd.Series:
            return pd.Series(shared.value.margins(np.stack(rows.to_numpy())) if len(rows) else np.zeros(0))

        out = df.drop(score, prediction).withColumn(score, 1 / (1 + F.exp(-margin(features))))
        return out.withColumn(prediction, (F.col(score) > 0.5).cast("double"))


def fit_together(data: DataFrame, specs: list[Boosting], stages: Iterable[int] = (), seed: int = 42) -> tuple[list[Ensemble], dict]:
    """Fit all ``specs`` in the same passes over ``data`` (id long, features array<double>, label 0/1, fold int).

    Also {(model, round): [true positives, false positives, false negatives]}
    on the rows that a model leaves out, after each round in ``stages``.
    Sampling depends on (seed, round, id) and (seed, round, column) only, so
    a model's first k trees are those of a model of k rounds.
    """
    spark, sc = data.sparkSession, data.sparkSession.sparkContext
    ship_package(spark)
    scratch_root(spark)
    data = data.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"),
                       F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
    sizes = {(r.fold, r.label): r["count"] for r in data.groupBy("fold", "label").count().collect()}
    cuts = column_cuts(data, "features")
    offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts])))
    sampled = any(s.subsample < 1 for s in specs)
    blocks, n_blocks = _blocks(data, cuts, sum(sizes.values()), sampled)
    held = math.ceil(sum(sizes.values()) * len(specs) / LOCAL_MARGINS) if n_blocks == 1 else 1
    groups = max(1, min(len(specs), max(sc.defaultParallelism // n_blocks, held)))
    priors = []
    for spec in specs:
        one, all_ = (sum(c for (fold, label), c in sizes.items() if fold != spec.fold and (label > 0 or k)) for k in (0, 1))
        priors.append(math.log(max(one, 0.5) / max(all_ - one, 0.5)))
    # models are dealt by depth, so that every group has deep ones
    order = sorted(range(len(specs)), key=lambda m: -specs[m].depth)
    dealt = [order[g::groups] for g in range(groups)]

    def started(item):
        number, (ids, bins, label, fold, count) = item
        ids, bins, label, fold, count, cell = collapsed(ids, bins.reshape(len(cuts), -1), label, fold, count, sampled)
        codes = coded(bins, offsets)
        for g, models in enumerate(dealt):
            margin = np.tile(np.array([priors[m] for m in models])[:, None], (1, bins.shape[1])).T
            yield number * groups + g, _Block(ids, bins, codes, label, fold, models, margin, cell, count)

    state = blocks.flatMap(started).partitionBy(n_blocks * groups, int).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[list[Tree]] = [[] for _ in specs]
    counts: dict = {}
    stages, last, old = set(stages), max(s.rounds for s in specs), None
    for first in range(0, last, CHECKPOINT_ROUNDS) if n_blocks == 1 else ():
        turns = range(first, min(last, first + CHECKPOINT_ROUNDS))
        run = state.mapValues(partial(_rounds, turns=turns, specs=specs, offsets=offsets, stages=stages, seed=seed)).persist(StorageLevel.MEMORY_AND_DISK)
        for by_turn, counted in run.map(lambda kv: kv[1][1:]).collect():
            counts.update(counted)
            for own in by_turn:
                for m, tree in own.items():
                    trees[m].append(tree)
        state.unpersist()
        state = run.mapValues(lambda v: v[0]).persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        state.count()
        run.unpersist()
    for turn in range(last) if n_blocks > 1 else ():
        live = [turn < s.rounds for s in specs]
        grown = {m: (Tree(), [0] if on else []) for m, on in enumerate(live)}
        for level in range(max(s.depth for s, on in zip(specs, live) if on)):
            sums = state.flatMap(partial(_sums, trees=grown, specs=specs, offsets=offsets, level=level, turn=turn, seed=seed))
            sums = sums.reduceByKey(add, min(len(specs), n_blocks * groups))
            for m, found in sums.map(partial(_splits, specs=specs, offsets=offsets, turn=turn, seed=seed)).collect():
                grown[m] = grown[m][0], _extended(*grown[m], found, specs[m], level)
            if old is not None:
                old.unpersist()
                old = None
            if not any(nodes for _, nodes in grown.values()):
                break
        for m, on in enumerate(live):
            if on:
                trees[m].append(grown[m][0])
        state, old = state.mapValues(partial(_advanced, trees={m: t for m, (t, _) in grown.items()}, specs=specs)).persist(StorageLevel.MEMORY_AND_DISK), state
        if turn % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
            state.checkpoint()
        if turn + 1 in stages:
            for m, c in state.flatMap(partial(_held_counts, specs=specs)).reduceByKey(add, groups).collect():
                counts[m, turn + 1] = c
    state.unpersist()
    return [Ensemble(p, s.rate, s.depth, cuts, t) for p, s, t in zip(priors, specs, trees)], counts


def search(data: DataFrame, points: list[Boosting], folds: int, seed: int = 42) -> tuple[int, list[float], Ensemble]:
    """(index of the best point, mean F1 of class 1 over the folds of every point, the best point fitted on all rows).

    Ties go to the first point.
    """
    kinds = list(dict.fromkeys(replace(p, rounds=0) for p in points))
    most = {k: max(p.rounds for p in points if replace(p, rounds=0) == k) for k in kinds}
    specs = [replace(k, rounds=most[k], fold=f) for k in kinds for f in range(-1, folds)]
    models, counts = fit_together(data, specs, {p.rounds for p in points}, seed)
    place = {(replace(s, rounds=0, fold=-1), s.fold): m for m, s in enumerate(specs)}

    def f1(point: Boosting) -> float:
        found = [counts[place[replace(point, rounds=0), f], point.rounds] for f in range(folds)]
        return float(np.mean([2 * tp / (2 * tp + fp + fn) if tp else 0.0 for tp, fp, fn in found]))

    scores = [f1(p) for p in points]
    best = max(range(len(points)), key=lambda k: (scores[k], -k))
    model = models[place[replace(points[best], rounds=0), -1]]
    return best, scores, replace(model, trees=model.trees[:points[best].rounds])
