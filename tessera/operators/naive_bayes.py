"""Gaussian naive Bayes (M8) as a pyspark.ml Estimator.

Fit is one grouped aggregate (one for all folds and points of a grid search): per-class count, mean and variance of the
feature vector (``Summarizer``, JVM-side). Variances are population
variances plus ``varSmoothing`` x the largest per-feature variance of the
whole training set, which is derived from the per-class moments (no extra
pass). Transform is a narrow projection with the fitted moments as
literal arrays. ``pyspark.ml.classification.NaiveBayes(modelType='gaussian')``
ignores its smoothing parameter, hence this estimator.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(df: DataFrame, col: str) -> Column:
    """Feature column as array<double>, whether it is a vector or an array."""
    if isinstance(df.schema[col].dataType, VectorUDT):
        return vector_to_array(F.col(col), "float64")
    return F.col(col).cast("array<double>")


def as_vector(df: DataFrame, col: str) -> Column:
    from pyspark.ml.functions import array_to_vector
    if isinstance(df.schema[col].dataType, VectorUDT):
        return F.col(col)
    return array_to_vector(F.col(col).cast("array<double>"))


class HasScoreCol(Params):
    scoreCol = Param(Params._dummy(), "scoreCol", "column for P(label = 1)", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(scoreCol="score")

    def getScoreCol(self) -> str:
        return self.getOrDefault(self.scoreCol)


class _GaussianNBParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol):
    varSmoothing = Param(Params._dummy(), "varSmoothing", "share of the largest feature variance added to all",
                         typeConverter=TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(varSmoothing=1e-9)


class GaussianNB(Estimator, _GaussianNBParams):
    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
                 scoreCol="score", varSmoothing=1e-9):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "GaussianNBModel":
        stats = {y: m for (_, y), m in self._moments(dataset, F.lit(0)).items()}
        if not stats:
            raise ValueError("empty training table")
        return self._model(stats, self.getOrDefault(self.varSmoothing))

    def _moments(self, dataset: DataFrame, fold: Column) -> dict:
        """(fold, class) -> (rows, means, population variances): one aggregate."""
        vec = as_vector(dataset, self.getFeaturesCol()).alias("_v")
        summ = Summarizer.metrics("count", "mean", "variance")
        rows = (dataset.select(fold.alias("_f"), F.col(self.getLabelCol()).cast("double").alias("_y"), vec)
                .groupBy("_f", "_y").agg(summ.summary(F.col("_v")).alias("s")).collect())
        stats = {}
        for r in rows:
            n = r["s"]["count"]
            mean = r["s"]["mean"].toArray().tolist()
            var_s = r["s"]["variance"].toArray().tolist()
            stats[r["_f"], r["_y"]] = (n, mean, [v * (n - 1) / n if n > 1 else 0.0 for v in var_s])
        return stats

    def _model(self, stats: dict, smoothing: float) -> "GaussianNBModel":
        classes = sorted(stats)
        n_all = sum(s[0] for s in stats.values())
        d = len(next(iter(stats.values()))[1])
        mu_all = [sum(s[0] * s[1][j] for s in stats.values()) / n_all for j in range(d)]
        var_all = [sum(s[0] * (s[2][j] + (s[1][j] - mu_all[j]) ** 2) for s in stats.values()) / n_all
                   for j in range(d)]
        eps = smoothing * (max(var_all) if var_all else 0.0)
        model = GaussianNBModel(
            classes=classes,
            priors=[stats[c][0] / n_all for c in classes],
            theta=[stats[c][1] for c in classes],
            var=[[v + eps for v in stats[c][2]] for c in classes],
            epsilon=eps,
        )
        return self._copyValues(model)

    def fit_grid(self, data: DataFrame, points: list[dict], folds: int, key: str, fold: str):
        """(index of the best point, score of each point, model of the best on all rows), with the folds in column ``fold``.

        The moments of the rows outside a fold are those of the other folds together: one pass finds them for all
        folds, and one scores all points on the rows that their folds leave out."""
        moments, models = self._moments(data, F.col(fold)), []
        for f in range(folds):
            stats = {y: _together([m for (g, c), m in moments.items() if c == y and g != f]) for y in {c for g, c in moments if g != f}}
            for rows, found in (("training", stats), ("validation", [g for g, _ in moments if g == f])):
                if not found:
                    raise ValueError(f"The {rows} data at fold {f} is empty.")
            fitted = [self._model(stats, p.get("varSmoothing", self.getOrDefault(self.varSmoothing))) for p in points]
            models.append([(m.classes, m.parts()) for m in fitted])

        def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((folds, len(points), 3), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, of = np.array(b.column("x").flatten()).reshape(b.num_rows, -1), b.column("y").to_numpy() == 1, b.column("f").to_numpy()
                for f in range(folds):
                    held, true = x[of == f].T, y[of == f]
                    for i, (classes, parts) in enumerate(models[f]):
                        jll = []
                        for const, mean, weight in parts:       # term by term, as the expression of the model does
                            total = np.zeros(held.shape[1])
                            for e, t, w in zip(held, mean, weight):
                                total += (e - t) * (e - t) * w
                            jll.append(const - 0.5 * total)
                        said = np.array(classes)[np.argmax(jll, 0)] == 1
                        out[f, i] += [(said & true).sum(), (said & ~true).sum(), (~said & true).sum()]
            f, i = np.indices(out.shape[:2], np.int32)
            columns = {"f": f.ravel(), "i": i.ravel()} | {c: out[:, :, k].ravel() for k, c in enumerate(("tp", "fp", "fn"))}
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

        rows = data.select(as_array(data, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), F.col(fold).cast("int").alias("f"))
        sums = rows.mapInArrow(counted, "f int, i int, tp long, fp long, fn long").groupBy("f", "i").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        scores = [[] for _ in points]
        for _, i, tp, fp, fn in sorted(sums.collect()):
            precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
            scores[i].append(2 * precision * recall / (precision + recall) if tp else 0.0)
        means = [sum(s) / len(s) for s in scores]
        best = max(range(len(points)), key=lambda i: (means[i], -i))       # first best wins
        return best, means, self.copy()._set(**points[best]).fit(data)


def _together(parts: list[tuple]) -> tuple:
    """(rows, means, population variances) of several sets of rows from those of each."""
    n = sum(p[0] for p in parts)
    mean = [sum(p[0] * p[1][j] for p in parts) / n for j in range(len(parts[0][1]))]
    return n, mean, [sum(p[0] * (p[2][j] + (p[1][j] - mean[j]) ** 2) for p in parts) / n for j in range(len(mean))]


class GaussianNBModel(Model, _GaussianNBParams):
    def __init__(self, classes=None, priors=None, theta=None, var=None, epsilon=0.0):
        super().__init__()
        self.classes, self.priors, self.theta, self.var, self.epsilon = classes, priors, theta, var, epsilon

    def parts(self) -> list[tuple[float, list[float], list[float]]]:
        """(constant, means, inverse variances) of each class."""
        return [(math.log(prior) - 0.5 * sum(math.log(2.0 * math.pi * v) for v in va), th, [1.0 / v for v in va])
                for prior, th, va in zip(self.priors, self.theta, self.var)]

    def joint_log_likelihood(self, x: Column) -> list[Column]:
        out = []
        for const, th, iv in self.parts():
            th_a = F.array(*[F.lit(float(t)) for t in th])
            iv_a = F.array(*[F.lit(v) for v in iv])
            terms = F.transform(x, lambda e, i: (e - th_a[i]) * (e - th_a[i]) * iv_a[i])
            out.append(F.lit(const) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = as_array(dataset, self.getFeaturesCol())
        tmp = dataset.withColumn("_jll", F.array(*self.joint_log_likelihood(x)))
        jll = [F.col("_jll")[i] for i in range(len(self.classes))]
        top = F.greatest(*jll) if len(jll) > 1 else jll[0]
        # argmax; the first (smallest) class wins ties
        pred = F.lit(float(self.classes[-1]))
        for i in reversed(range(len(self.classes) - 1)):
            pred = F.when(jll[i] >= top, F.lit(float(self.classes[i]))).otherwise(pred)
        lse = top + F.log(sum((F.exp(j - top) for j in jll), F.lit(0.0)))
        pos = self.classes.index(1.0) if 1.0 in self.classes else len(self.classes) - 1
        return tmp.withColumn(self.getPredictionCol(), pred) \
                  .withColumn(self.getScoreCol(), F.exp(jll[pos] - lse)).drop("_jll")
