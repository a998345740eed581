"""Linear SVM with squared hinge loss (M6) and sigmoid calibration (M7), all models of a search in the same passes.

A model minimises ``|w|^2 / 2 + C * sum(max(0, 1 - y (x w))^2)``, the intercept
being the weight of a column of ones, by Newton steps: a pass over the rows
adds up every open model's loss, gradient and Hessian inside the tasks, Spark
sums them by (model, place), and the driver solves a system of the size of
the columns. A step that does not lower the loss enough is halved. The sigmoid
of each model is fitted in the same way, with two parameters, on the rows left
out for it, towards (n+ + 1) / (n+ + 2) and 1 / (n- + 2).

A calibrated classifier is the mean of ``parts`` such models, each fitted
without one part of its rows. A search fits those of all grid points, of all
folds and on all rows together: its passes are the steps of the slowest model.
Parts follow from a row's ``turn``, its rank in its class modulo folds x parts,
and are the stratified parts of the rows outside the fold.

Columns must be finite (ValueError). Rows of one class are allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .extra_trees import _matrix, _table

#: A model is done when a step promises less than this share of the loss; numbers that one pass sums (models in groups).
PROMISE = 1e-12
SUMS_A_PASS = 4_000_000


@dataclass(frozen=True)
class Margin:
    """One SVM: rows of ``fold`` are not seen (-1: none), rows of ``part`` calibrate it."""

    c: float
    fold: int
    part: int


@dataclass(frozen=True)
class Layout:
    """How rows fall into parts."""

    folds: int
    parts: int

    def part(self, turn: np.ndarray, fold: np.ndarray, without: int) -> np.ndarray:
        if without < 0:
            return turn % self.parts
        return (turn // self.folds * (self.folds - 1) + fold - (fold > without)) % self.parts

    def roles(self, turn: np.ndarray, fold: np.ndarray, model: Margin) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the rows that fit the model and of those that calibrate it."""
        seen, part = fold != model.fold, self.part(turn, fold, model.fold)
        return seen & (part != model.part), seen & (part == model.part)


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def hinge_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared hinge loss with gradient and Hessian of rows ``x`` (labels -1 and 1), one after another."""
    gap = 1 - y * (x @ w)
    near = gap > 0
    x, y, gap = x[near], y[near], gap[near]
    return np.concatenate([[gap @ gap], -2 * (x.T @ (y * gap)), 2 * (x.T @ x).ravel()])


def sigmoid_sums(margin: np.ndarray, target: np.ndarray, ab: np.ndarray) -> np.ndarray:
    """Cross entropy of the sigmoid a * margin + b with gradient and Hessian."""
    z = ab[0] * margin + ab[1]
    p = 0.5 * (1 + np.tanh(z / 2))
    v, one = p * (1 - p), np.column_stack([margin, np.ones(len(margin))])
    return np.concatenate([[np.sum(np.logaddexp(0, z) - target * z)], one.T @ (p - target), (one.T @ (one * v[:, None])).ravel()])


def newton(evaluate: Callable[[dict], dict], starts: dict, passes: int) -> dict:
    """Minima from ``starts``; ``evaluate`` gives (loss, gradient, Hessian) for {model: place}."""
    trial, held, steps, out = dict(starts), {}, {}, dict(starts)
    for _ in range(passes):
        if not trial:
            break
        for m, (loss, gradient, hessian) in evaluate(trial).items():
            if not np.isfinite(loss):
                raise ValueError("features must be finite")
            if m in held and loss > held[m] + 1e-4 * steps[m][1] * steps[m][2]:
                direction, share, slope = steps[m]
                share /= 2
            else:
                held[m], out[m] = loss, trial[m]
                direction = -np.linalg.solve(hessian, gradient)
                share, slope = 1.0, float(gradient @ direction)
            if -slope * share <= PROMISE * (1 + abs(held[m])):
                del trial[m]
                continue
            steps[m] = direction, share, slope
            trial[m] = out[m] + share * direction
    return out


def _summed(data: DataFrame, add: Callable[[pa.RecordBatch, dict], None]) -> dict:
    """{model: vector}: what ``add`` adds up over all batches."""
    def run(batches):
        sums: dict = {}
        for b in batches:
            if b.num_rows:
                add(b, sums)
        for m, v in sums.items():
            yield _table({"model": np.full(len(v), m, np.int32), "place": np.arange(len(v), dtype=np.int32), "v": v.astype(np.float64)})

    out: dict = {}
    for r in data.mapInArrow(run, "model int, place int, v double").groupBy("model", "place").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["model"], {})[r["place"]] = r["v"]
    return {m: np.array([v[i] for i in range(len(v))]) for m, v in out.items()}


def _add(sums: dict, m: int, v: np.ndarray) -> None:
    sums[m] = sums[m] + v if m in sums else v


def _read(b: pa.RecordBatch) -> tuple:
    return _with_ones(_matrix(b)), b.column("label").to_numpy(), b.column("turn").to_numpy(), b.column("fold").to_numpy()


def _split(v: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    return float(v[0]), v[1:d + 1], v[d + 1:].reshape(d, d)


def fit_margins(data: DataFrame, models: list[Margin], layout: Layout, d: int, passes: int) -> list[np.ndarray]:
    """Weights (intercept last) of every model."""
    def evaluate(trial: dict) -> dict:
        out, names = {}, list(trial)
        together = max(1, SUMS_A_PASS // (1 + d + d * d))
        for s in range(0, len(names), together):
            now = {m: trial[m] for m in names[s:s + together]}

            def add(b, sums, now=now):
                x, y, turn, fold = _read(b)
                for m, w in now.items():
                    used = layout.roles(turn, fold, models[m])[0]
                    _add(sums, m, hinge_sums(x[used], 2.0 * y[used] - 1, w))

            found = _summed(data, add)
            for m, w in now.items():
                loss, gradient, hessian = _split(found[m], d) if m in found else (0.0, np.zeros(d), np.zeros((d, d)))
                c = models[m].c
                out[m] = w @ w / 2 + c * loss, w + c * gradient, np.eye(d) + c * hessian
        return out

    found = newton(evaluate, {m: np.zeros(d) for m in range(len(models))}, passes)
    return [found[m] for m in range(len(models))]


def fit_sigmoids(data: DataFrame, models: list[Margin], weights: list[np.ndarray], layout: Layout, passes: int = 100) -> list[np.ndarray]:
    """Slope and intercept of every model's sigmoid."""
    targets, starts = [], {}
    groups = [(r["turn"], r["fold"], r["label"], r["count"]) for r in data.groupBy("turn", "fold", "label").count().collect()]
    turn, fold, label, count = (np.array(c) for c in zip(*groups))
    for m, model in enumerate(models):
        held = layout.roles(turn, fold, model)[1]
        pos, neg = (int(count[held & (label == v)].sum()) for v in (1, 0))
        targets.append((1 / (neg + 2), (pos + 1) / (pos + 2)))
        starts[m] = np.array([0.0, np.log((pos + 1) / (neg + 1))])

    def evaluate(trial: dict) -> dict:
        def add(b, sums):
            x, y, turn, fold = _read(b)
            for m, ab in trial.items():
                held = layout.roles(turn, fold, models[m])[1]
                low, high = targets[m]
                _add(sums, m, sigmoid_sums(x[held] @ weights[m], np.where(y[held] > 0, high, low), ab))

        found = _summed(data, add)
        out = {}
        for m in trial:
            loss, gradient, hessian = _split(found[m], 2) if m in found else (0.0, np.zeros(2), np.zeros((2, 2)))
            # margins that are all equal leave the slope open
            out[m] = loss, gradient, hessian + 1e-10 * (1 + np.trace(hessian)) * np.eye(2)
        return out

    found = newton(evaluate, starts, passes)
    return [found[m] for m in range(len(models))]


def probability(x: np.ndarray, fitted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """P(1) of rows ``x`` (with the column of ones): the mean over the parts."""
    return sum(0.5 * (1 + np.tanh((ab[0] * (x @ w) + ab[1]) / 2)) for w, ab in fitted) / len(fitted)


def search(data: DataFrame, cs: list[float], folds: int, parts: int, passes: int) -> tuple[list[float], list[list[tuple[np.ndarray, np.ndarray]]]]:
    """(mean F1 of class 1 over the folds for every C, parts of the classifier of every C on all rows).

    ``data`` has features array<double>, label 0/1, fold and turn; with fewer than two folds only the second is fitted.
    """
    ship_package(data.sparkSession)
    data = cut_lineage(data.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"),
                                   F.col("fold").cast("int").alias("fold"), F.col("turn").cast("int").alias("turn")), "svm")
    first = data.select(F.size("features")).first()
    if first is None:
        raise ValueError("empty training table")
    layout, held_out = Layout(folds, parts), list(range(folds)) if folds > 1 else []
    models = [Margin(float(c), f, p) for c in cs for f in [-1] + held_out for p in range(parts)]
    weights = fit_margins(data, models, layout, first[0] + 1, passes)
    fitted = list(zip(weights, fit_sigmoids(data, models, weights, layout)))
    classifiers = {(i, f): fitted[s:s + parts] for s, (i, f) in zip(range(0, len(models), parts), ((i, f) for i in range(len(cs)) for f in [-1] + held_out))}

    def add(b, sums):
        x, y, _, fold = _read(b)
        for i in range(len(cs)):
            for f in held_out:
                mine = fold == f
                said, true = probability(x[mine], classifiers[i, f]) > 0.5, y[mine] > 0
                _add(sums, i * folds + f, np.array([(said & true).sum(), (said != true).sum()]))

    scores = [0.0] * len(cs)
    for m, (hits, misses) in (_summed(data, add) if held_out else {}).items():
        scores[m // folds] += 2 * hits / (2 * hits + misses) / folds if hits else 0.0
    return scores, [classifiers[i, -1] for i in range(len(cs))]
