"""Exact k-nearest-neighbour join (K1 Euclidean, K2 Manhattan).

Plan, all on Spark:

1. The reference side is cut into cells by a kd tree: every inner node sends
   rows with x[axis] <= cut to the left. The tree is grown on the driver from a
   bounded random sample; it only decides where rows go, so any tree gives the
   same result. A cell's region is a box, and the distance of a query to that box
   is a lower bound on its distance to every row of the cell.
2. A cell holds ``block_rows`` rows or, in tables of more than ``MIN_CELLS`` such
   cells, up to ``group_rows``: vectors are shuffled once per visited cell, so
   cells of a fixed small size would ship every vector n / block_rows times. Cells
   and their visitors are split into hash chunks of ``group_rows``, so every (cell,
   ref chunk, query chunk) group is bounded even when one value holds a third of
   the table. ``group_rows`` grows with the table up to ``MAX_GROUP_ROWS``, so until
   then a vector is shuffled a fixed number of times, however long the table is.
3. Pass A: each query is matched against its own cell -> an upper bound
   on its k-th distance. Pass B: it visits only the cells whose box lies
   within that bound, and a group returns only candidates within it, so few rows
   beyond k per query are shuffled. Candidates of both
   passes are merged with a window per query ordered by (distance, ref id).

Within a group, both sides are ordered into small boxes; a block of queries
skips the boxes of references beyond its bounds. numpy screens the rest (|q|^2 +
|r|^2 - 2 q.r, or sums of float32 differences, keeping every pair within a
proven rounding band), then recomputes the survivors' distances dimension by
dimension (the summation order of an SQL list sum) and keeps
each query's local top k by (distance, id). The global top k by
(distance, id) is a subset of the union of local top k, so the result is
exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

MAX_SLABS = 4096                 # bound on the cell table (collected, broadcast)
MIN_CELLS = 16                   # cells a table is cut into before cells grow beyond block_rows
GROUP_ROWS = 16384               # rows per side of a group, in larger tables up to
MAX_GROUP_ROWS = 65536
SAMPLE_PER_CELL, SAMPLE_ROWS = 64, 65536
BOX_ROWS = 256                   # rows of a box inside a group
CAND_SCHEMA = "_qid long, _rid long, _d double"


def _pairwise(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances (squared for euclidean), summed over dimensions in order."""
    out = np.zeros((q.shape[0], r.shape[0]))
    for j in range(q.shape[1]):
        diff = q[:, j:j + 1] - r[None, :, j]
        if metric == "euclidean":
            out += diff * diff
        else:
            out += np.abs(diff)
    return out


def _exact_rows(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the listed (query row, ref row) pairs, summed over dimensions in order."""
    out = np.zeros(len(rows))
    for j in range(q.shape[1]):
        diff = q[rows, j] - r[cols, j]
        out += diff * diff if metric == "euclidean" else np.abs(diff)
    return out


def _box_gap(q_lo: np.ndarray, q_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
    """Lower bound on the distance (squared for euclidean) between boxes, row by row; rounded down."""
    gap = np.maximum(np.maximum(lo - q_hi, q_lo - hi), 0.0)
    return (np.einsum("ij,ij->i", gap, gap) if metric == "euclidean" else gap.sum(axis=1)) * (1 - 1e-9)


def _boxes(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in boxes of at most ``rows``: halves along the widest axis."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        part = x[at]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order, half = np.argpartition(part[:, axis], len(at) // 2), len(at) // 2
        todo += [at[order[half:]], at[order[:half]]]
    return out


def _few_copies(rv: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep so that of equal vectors the k + 1 smallest ids remain: a query's k nearest
    by (distance, id), itself left out, hold no others."""
    as_bytes = np.ascontiguousarray(rv).view(np.dtype((np.void, rv.dtype.itemsize * rv.shape[1]))).ravel()
    _, group = np.unique(as_bytes, return_inverse=True)
    order = np.lexsort((rid, group))
    g, i = group[order], rid[order]
    new_group = np.r_[True, g[1:] != g[:-1]]
    step = np.cumsum(np.r_[True, (i[1:] != i[:-1]) | new_group[1:]])       # distinct (group, id), numbered
    start = np.maximum.accumulate(np.where(new_group, step, 0))
    return np.sort(order[step - start <= k])


class _Screen:
    """Approximate distances of query rows to the references, each within ``tol`` of the exact one less ``shift``.

    Euclidean: |r|^2 - 2 q.r in one BLAS product, so the squared distance less |q|^2; rounding error at most
    1e-9 * (|q|^2 + max|r|^2) + 1e-300. Where it is fine against the bounds the product is in float32: error
    at most (d + 8) * 2^-23 * (|q|^2 + max|r|^2) + (d + 8) * 1e-37. Manhattan: float32 sums over tiles that stay in
    the cache; error at most (d + 4) * 2^-23 * (|q| + max|r|), float64 where values are too large for it;
    int16 steps of a common size (error at most a step per dimension) where those are fine against the bounds.
    """

    def __init__(self, rv: np.ndarray, metric: str, qv: np.ndarray, bound: np.ndarray):
        self.metric, self.step = metric, 0.0
        dim = rv.shape[1]
        if metric == "euclidean":
            sq = np.einsum("ij,ij->i", rv, rv)
            self.top = sq.max()
            reach = np.einsum("ij,ij->i", qv, qv).max() + self.top
            self.small = bool(reach < 1e30) and bool(
                (dim + 8) * (2.0 ** -23 * reach + 1e-37) <= 1e-3 * np.median(bound) < np.inf)
            self.cols = np.empty((len(rv), dim + 1), np.float32 if self.small else np.float64)
            self.cols[:, :dim], self.cols[:, dim] = rv, sq
        else:
            self.top = np.abs(rv).sum(axis=1).max()
            self.small = self.top < 1e30
            self.low = np.minimum(rv.min(axis=0), qv.min(axis=0)) if dim else np.empty(0)
            width = (np.maximum(rv.max(axis=0), qv.max(axis=0)) - self.low).max(initial=0.0)
            if dim and 32767 // dim and (dim + 1) * width / (32767 // dim) <= 0.05 * np.median(bound) < np.inf:
                self.step = width / (32767 // dim)
            self.cols = np.ascontiguousarray(self._coded(rv).T)

    def _coded(self, x: np.ndarray) -> np.ndarray:
        if self.step:
            return np.rint((x - self.low) / self.step).astype(np.int16)
        return x.astype(np.float32 if self.small else np.float64)

    def shift(self, q: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", q, q) if self.metric == "euclidean" else np.zeros(len(q))

    def tol(self, q: np.ndarray) -> np.ndarray:
        if self.metric == "euclidean":
            reach = np.einsum("ij,ij->i", q, q) + self.top
            return (q.shape[1] + 8) * (2.0 ** -23 * reach + 1e-37) if self.small else 1e-9 * reach + 1e-300
        if self.step:
            return (q.shape[1] + 1) * self.step + 1e-12 * (np.abs(q).sum(axis=1) + self.top)
        return (q.shape[1] + 4) * (2.0 ** -23 if self.small else 1e-15) * (np.abs(q).sum(axis=1) + self.top) + 1e-30

    def __call__(self, q: np.ndarray, at) -> np.ndarray:
        """``at``: slice or row numbers of the references."""
        if self.metric == "euclidean":
            own = np.empty((len(q), q.shape[1] + 1), self.cols.dtype)
            own[:, :-1], own[:, -1] = -2.0 * q, 1.0
            return own @ self.cols[at].T
        cols = self.cols[:, at]
        q = self._coded(q)
        out = np.empty((len(q), cols.shape[1]), np.float32 if self.small else np.float64)
        for s in range(0, len(q), 16):
            part = q[s:s + 16]
            for a in range(0, cols.shape[1], 4096):
                tile = np.zeros((len(part), min(4096, cols.shape[1] - a)), cols.dtype)
                diff = np.empty_like(tile)
                for j in range(q.shape[1]):
                    np.subtract(part[:, j:j + 1], cols[j, a:a + 4096], out=diff)
                    np.abs(diff, out=diff)
                    tile += diff
                out[s:s + 16, a:a + 4096] = tile
        if self.step:
            out *= np.float32(self.step)
        return out


def _at_most(approx: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """approx <= limit by row, the limits rounded up to the type of ``approx``."""
    if approx.dtype != limit.dtype:
        with np.errstate(over="ignore"):
            limit = np.nextafter(limit.astype(approx.dtype), approx.dtype.type(np.inf))
    return approx <= limit[:, None]


def _kth(approx: np.ndarray, k: int) -> np.ndarray:
    """k-th smallest value per row (inf if there are fewer)."""
    if approx.shape[1] < k:
        return np.full(len(approx), np.inf)
    return np.partition(approx, k - 1, axis=1)[:, k - 1].astype(np.float64)


def _within_kth(approx: np.ndarray, rows: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
    """Which of the found pairs (in order of their query rows) lie within their row's k-th approximation plus its slack."""
    keep = np.ones(len(rows), bool)
    ends = np.cumsum(np.bincount(rows, minlength=len(slack)))
    for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
        if b - a > k:
            found = approx[a:b]
            keep[a:b] = found <= np.float64(np.partition(found, k - 1)[k - 1]) + slack[i]
    return keep


def _local_topk(k: int, metric: str, exclude_self: bool):
    def fn(queries: pa.Table, refs: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if queries.num_rows and refs.num_rows:
            # a null id counts as the smallest long
            qid, rid = (pc.fill_null(t.column(c), -2 ** 63).to_numpy() for t, c in ((queries, "_qid"), (refs, "_rid")))
            bound = queries.column("_bound").to_numpy()
            qv, rv = (_matrix(t.column(c).combine_chunks(), True) for t, c in ((queries, "_qv"), (refs, "_rv")))
            found += _group_topk(qv, qid, bound, rv, rid, k, metric, exclude_self)
        return pa.table(dict(zip(("_qid", "_rid", "_d"), map(np.concatenate, zip(*found)))))
    return fn


def _group_topk(qv, qid, bound, rv, rid, k: int, metric: str, exclude_self: bool):
    """Per block of queries: (query ids, ref ids, distances) of the k nearest within the bounds."""
    keep = _few_copies(rv, rid, k) if rv.shape[1] else np.arange(len(rv))
    parts = _boxes(rv[keep], BOX_ROWS)
    order = keep[np.concatenate(parts)]
    rv, rid = rv[order], rid[order]
    ends = np.cumsum([len(p) for p in parts])
    starts = np.r_[0, ends[:-1]]
    lo, hi = np.minimum.reduceat(rv, starts, axis=0), np.maximum.reduceat(rv, starts, axis=0)
    screen = _Screen(rv, metric, qv, bound)
    for at in _boxes(qv, max(16, min(BOX_ROWS, BOX_ROWS * GROUP_ROWS // len(rv)))):   # bounds a block's distances
        q, ids = qv[at], qid[at]
        tol, shift = screen.tol(q), screen.shift(q)
        limit = bound[at] + tol
        gap = _box_gap(q.min(axis=0), q.max(axis=0), lo, hi, metric)

        def others(approx, cols):
            if exclude_self:
                approx[ids[:, None] == rid[cols][None, :]] = np.inf
            return approx

        if np.isinf(limit).any() and len(parts) > 1:       # the nearest boxes give a first bound
            near, held = [], 0
            for b in np.argsort(gap, kind="stable"):
                near.append(np.arange(starts[b], ends[b]))
                held += len(near[-1])
                if held > k:
                    break
            near = np.concatenate(near)
            limit = np.minimum(limit, _kth(others(screen(q, near), near), k) + shift + 2 * tol)
        wanted = np.flatnonzero(~(gap > limit.max()))
        if not len(wanted):
            continue
        cols = (slice(0, len(rid)) if len(wanted) == len(parts) else
                np.concatenate([np.arange(starts[b], ends[b]) for b in wanted]))
        approx = screen(q, cols)
        mask = _at_most(approx, limit - shift)
        if np.count_nonzero(mask) > mask.size // 16:
            mask = _at_most(approx, np.minimum(limit - shift, _kth(others(approx, cols), k) + 2 * tol))
        hits = np.flatnonzero(mask)
        rows, picked = np.divmod(hits, mask.shape[1])
        near = approx.ravel()[hits]
        picked = picked if isinstance(cols, slice) else cols[picked]
        valid = np.isfinite(near)
        if exclude_self:
            valid &= ids[rows] != rid[picked]
        if len(hits) > 8 * k * len(q):
            valid[valid] = _within_kth(near[valid], rows[valid], 2 * tol, k)
        rows, picked = rows[valid], picked[valid]
        dd = _exact_rows(q, rv, rows, picked, metric)
        # per query: order by (exact d, rid) and keep k
        best = np.lexsort((rid[picked], dd, rows))
        rows, picked, dd = rows[best], picked[best], dd[best]
        first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.array([], dtype=int)
        pos = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        sel = (pos < k) & (dd <= bound[at][rows])
        yield ids[rows[sel]], rid[picked[sel]], dd[sel]


class _Cells:
    """kd tree of the reference side (small driver metadata): nodes by number, the root first."""

    def __init__(self, sample: np.ndarray, n_cells: int, choice: str, seed: int):
        self.axis, self.cut, self.left, self.right = [-1], [0.0], [-1], [-1]
        dim = sample.shape[1] if sample.ndim == 2 else 0
        lo, hi = [np.full(dim, -np.inf)], [np.full(dim, np.inf)]
        rng = np.random.default_rng(seed)
        todo, leaves = [(-len(sample), 0, sample)], 1
        while todo and leaves < n_cells:
            _, node, rows = heapq.heappop(todo)
            if len(rows) < 2 or not dim:
                continue
            spread = rows.var(axis=0)
            axes = np.flatnonzero(spread > 0)
            if not len(axes):
                continue
            axis = int(rng.choice(axes)) if choice == "random" else int(np.argmax(spread))
            x = np.sort(rows[:, axis])
            cut = x[(len(x) - 1) // 2]
            if cut == x[-1]:
                cut = x[np.searchsorted(x, cut) - 1]
            go_left = rows[:, axis] <= cut
            if go_left.all() or not go_left.any():
                continue
            self.axis[node], self.cut[node] = axis, float(cut)
            for side, part in ((self.left, rows[go_left]), (self.right, rows[~go_left])):
                new = len(self.axis)
                side[node] = new
                for values, v in ((self.axis, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1)):
                    values.append(v)
                lo.append(lo[node].copy())
                hi.append(hi[node].copy())
                (hi if side is self.left else lo)[new][axis] = cut
                heapq.heappush(todo, (-len(part), new, part))
            leaves += 1
        self.axis, self.cut, self.left, self.right = map(np.array, (self.axis, self.cut, self.left, self.right))
        self.lo, self.hi = np.stack(lo), np.stack(hi)
        self.cell = np.where(self.axis < 0, np.cumsum(self.axis < 0) - 1, -1)
        self.size = leaves

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        node = np.zeros(len(x), np.int64)
        inner = np.arange(len(x)) if self.size > 1 else np.empty(0, np.int64)
        while len(inner):
            at = node[inner]
            node[inner] = np.where(x[inner, self.axis[at]] <= self.cut[at], self.left[at], self.right[at])
            inner = inner[self.axis[node[inner]] >= 0]
        return self.cell[node]

    def _side(self, v: np.ndarray, node: np.ndarray, axis: np.ndarray, metric: str) -> np.ndarray:
        """Part of the distance (squared for euclidean) to the nodes' boxes that lies along an axis each."""
        gap = np.maximum(np.maximum(self.lo[node, axis] - v, v - self.hi[node, axis]), 0.0)
        return gap * gap if metric == "euclidean" else gap

    def within(self, x: np.ndarray, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell whose box lies within the row's bound."""
        row, node, gap, out = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x)), []
        while len(row):
            leaf = self.axis[node] < 0
            out.append((row[leaf], self.cell[node[leaf]]))
            row, node, gap = row[~leaf], node[~leaf], gap[~leaf]
            # a child's box differs from its parent's along one axis; the gap there only grows
            axis = self.axis[node]
            v, rest = x[row, axis], gap - self._side(x[row, axis], node, axis, metric)
            children = [(child, rest + self._side(v, child, axis, metric)) for child in (self.left[node], self.right[node])]
            near = [~(g * (1 - 1e-9) > bound[row]) for _, g in children]
            node, gap = (np.concatenate([c[i][n] for c, n in zip(children, near)]) for i in (0, 1))
            row = np.concatenate([row[n] for n in near])
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _matrix(vectors: pa.Array, as_nan: bool = False) -> np.ndarray:
    """Vectors as rows; nulls inside them are refused, or become NaN."""
    if vectors.null_count or not as_nan and vectors.flatten().null_count:
        raise ValueError("neighbour join: a vector is null or holds a null")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _with_cell(df: DataFrame, vec: str, cells: _Cells) -> DataFrame:
    """Adds the cell of each row's vector as ``_cell``."""
    if cells.size == 1:
        return df.withColumn("_cell", F.lit(0))

    def route(batches):
        for b in batches:
            if b.num_rows:
                found = cells.of(_matrix(b.column(b.schema.get_field_index(vec)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "_cell"])
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(route, f"{schema}, _cell int")


def _visits(qb: DataFrame, cells: _Cells, metric: str, count: bool) -> DataFrame:
    """Visits of pass B: a row per query and cell other than its own within its bound, or their number by cell."""
    def visit(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                own = part.column(part.schema.get_field_index("_cell")).to_numpy()
                bound = part.column(part.schema.get_field_index("_bound")).to_numpy()
                row, cell = cells.within(_matrix(part.column(part.schema.get_field_index("_qv"))), bound, metric)
                row, cell = row[cell != own[row]], cell[cell != own[row]]
                if count:
                    at, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))],
                                                     names=["_cell", "n"])
                    continue
                for s in range(0, len(row), 8192):
                    rows = part.take(pa.array(row[s:s + 8192])).select(["_qid", "_qv", "_bound"])
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell[s:s + 8192].astype(np.int32))],
                                                     names=["_qid", "_qv", "_bound", "_cell"])
    return qb.mapInArrow(visit, "_cell int, n long" if count else "_qid long, _qv array<double>, _bound double, _cell int")


def _counts(rows: DataFrame) -> dict:
    return {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.sum("n").alias("n")).collect()}


def group_rows(n: int) -> int:
    """Rows per side of a group in a table of ``n`` rows."""
    return min(MAX_GROUP_ROWS, max(GROUP_ROWS, math.ceil(n / MIN_CELLS)))


def _block_topk(visits: DataFrame, refs: DataFrame, rcount: dict, vcount: dict, k: int, metric: str,
                exclude_self: bool) -> DataFrame:
    """Local top-k candidates, none beyond the query's ``_bound``, for every (query, visited cell) pair
    (None when nothing is visited)."""
    spark = visits.sparkSession
    most = group_rows(sum(rcount.values()))
    tab = [(c, math.ceil(rcount[c] / most), math.ceil(n / most)) for c, n in vcount.items() if c in rcount]
    if not tab:
        return None
    # cell table: bounded by max_slabs rows, safe to broadcast
    table = F.broadcast(spark.createDataFrame(tab, "_cell int, _rchunks int, _qchunks int"))
    q = (visits.join(table, "_cell")
         .withColumn("_qc", F.pmod(F.xxhash64("_qid"), F.col("_qchunks")).cast("int"))
         .withColumn("_rc", F.explode(F.sequence(F.lit(0), F.col("_rchunks") - 1)))
         .select("_cell", "_rc", "_qc", "_qid", "_qv", "_bound"))
    r = (refs.join(table, "_cell")
         .withColumn("_rc", F.pmod(F.xxhash64("_rid"), F.col("_rchunks")).cast("int"))
         .withColumn("_qc", F.explode(F.sequence(F.lit(0), F.col("_qchunks") - 1)))
         .select("_cell", "_rc", "_qc", "_rid", "_rv"))
    keys = ["_cell", "_rc", "_qc"]
    # The distance blocks are CPU-bound: spread the groups over explicit hash partitions (AQE does
    # not coalesce a repartition with a given count), one group per partition up to a bound.
    n_groups = sum(rc * qc for _, rc, qc in tab)
    sc = spark.sparkContext
    n_parts = int(max(1, min(n_groups, max(4 * sc.defaultParallelism,
                                           int(spark.conf.get("spark.sql.shuffle.partitions"))), MAX_SLABS)))
    q = q.repartition(n_parts, *keys)
    r = r.repartition(n_parts, *keys)
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(
        _local_topk(k, metric, exclude_self), CAND_SCHEMA)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, *, qid: str = "id", rid: str = "id",
             qvec: str = "features", rvec: str = "features", metric: str = "euclidean",
             exclude_self: bool = False, block_rows: int = 2048, seed: int = 7,
             max_slabs: int = MAX_SLABS, projection: str = "pca") -> DataFrame:
    """For every query row, its k nearest reference rows.

    Returns (qid, rank 1..k, rid, distance); ties are broken by the smaller
    reference id. exclude_self drops pairs with equal ids (self-join).
    projection: 'pca' cuts each cell along the axis of its largest variance (the
    widest boxes apart, so the most pruning), 'random' along a seeded random axis.
    Any cuts keep the result exact.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    ship_package(queries.sparkSession)     # the numpy kernel runs in Python workers
    same = queries is refs and qid == rid and qvec == rvec
    # both sides are written once to the shared checkpoint folder: every later pass starts from a
    # file scan (no replay of the inputs' lineage, cheap plans, survives executor loss)
    r = cut_lineage(refs.select(F.col(rid).cast("long").alias("_rid"),
                                F.col(rvec).cast("array<double>").alias("_rv")), "knn-refs")
    if same:
        q = r.select(F.col("_rid").alias("_qid"), F.col("_rv").alias("_qv"))
    else:
        q = cut_lineage(queries.select(F.col(qid).cast("long").alias("_qid"),
                                       F.col(qvec).cast("array<double>").alias("_qv")), "knn-queries")
    n_r = r.count()
    # small tables: block_rows rows a cell; larger ones: a group's rows, and no fewer than MIN_CELLS cells
    n_cells = max(1, min(math.ceil(n_r / block_rows), max(MIN_CELLS, math.ceil(n_r / group_rows(n_r))), max_slabs))
    sample = np.empty((0, 0))
    if n_cells > 1:
        share = min(1.0, min(SAMPLE_PER_CELL * n_cells, SAMPLE_ROWS) / n_r)
        rows = (r if share == 1.0 else r.sample(False, share, seed)).select("_rv").toArrow()["_rv"].combine_chunks()
        sample = _matrix(rows) if len(rows) else sample
    cells = _Cells(sample, n_cells, projection, seed)
    r, q = _with_cell(r, "_rv", cells), _with_cell(q, "_qv", cells)
    one = F.lit(1).alias("n")
    rcount = _counts(r.select("_cell", one))
    qcount = rcount if same else _counts(q.select("_cell", one))
    w = Window.partitionBy("_qid").orderBy("_d", "_rid")

    # pass A: own cell (with a single cell this is already the whole answer)
    cand = _block_topk(q.select("_qid", "_qv", F.lit(float("inf")).alias("_bound"), "_cell"), r, rcount, qcount, k,
                       metric, exclude_self)
    if cand is None:
        return q.sparkSession.createDataFrame([], "qid long, rank long, rid long, distance double")
    top = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    if cells.size > 1:
        top = cut_lineage(top, "knn-pass-a")      # k rows per query; feeds the bound and the merge
        bound = top.groupBy("_qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("_d")).alias("_dk"))
        # written once: read for the number of visits and for the visits
        qb = cut_lineage(q.join(bound, "_qid", "left").select(
            "_qid", "_qv", F.coalesce("_dk", F.lit(float("inf"))).alias("_bound"), "_cell"), "knn-bounds")
        cand_b = _block_topk(_visits(qb, cells, metric, False), r, rcount, _counts(_visits(qb, cells, metric, True)), k,
                             metric, exclude_self)
        if cand_b is not None:
            top = (top.select(*CAND_COLS).unionByName(cand_b)
                   .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k))
    d = F.sqrt("_d") if metric == "euclidean" else F.col("_d")
    return top.select(F.col("_qid").alias("qid"), F.col("_rk").cast("long").alias("rank"),
                      F.col("_rid").alias("rid"), d.alias("distance"))


CAND_COLS = ["_qid", "_rid", "_d"]


def brute_force_knn(queries: pd.DataFrame, refs: pd.DataFrame, k: int, metric: str = "euclidean",
                    exclude_self: bool = False) -> pd.DataFrame:
    """Test helper on small pandas frames (id, features): the definition K1 must equal."""
    import pandas as pd

    qv = np.stack(queries["features"].to_numpy()).astype(np.float64)
    rv = np.stack(refs["features"].to_numpy()).astype(np.float64)
    d = _pairwise(qv, rv, metric)
    rows = []
    for i, q in enumerate(queries["id"].to_numpy()):
        cand = [(d[i, j], int(r)) for j, r in enumerate(refs["id"].to_numpy()) if not (exclude_self and r == q)]
        cand.sort()
        for rank, (dd, r) in enumerate(cand[:k], 1):
            rows.append((int(q), rank, r, math.sqrt(dd) if metric == "euclidean" else dd))
    return pd.DataFrame(rows, columns=["qid", "rank", "rid", "distance"])
