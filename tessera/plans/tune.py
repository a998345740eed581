"""Grid search, cell runner and experiment matrix.

A cell = balance the training rows -> tune a classifier by k-fold grid
search on the balanced rows (best mean F1 of class 1, first grid point wins
ties, refit on all balanced rows) -> score the test rows -> one result
record. The balanced table is built once per balancer, checkpointed to
the shared checkpoint folder, and shared by all classifiers of the matrix. Fits run on the executors; grid points are
submitted in parallel driver threads (``parallelism``).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.sampling import stratified_folds
from ..session import cut_lineage


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """G1: every combination of the listed values, in the reference's (dict) order."""
    if not grid:
        return [{}]
    names = list(grid)
    return [dict(zip(names, combo)) for combo in itertools.product(*(grid[n] for n in names))]


def param_maps(est: Estimator, grid: dict[str, list]):
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder.addGrid(est.getParam(name), list(values))
    return builder.build()


@dataclass
class SearchResult:
    model: object
    best: dict
    scores: list[tuple[dict, float]] = field(default_factory=list)


def grid_search(est: Estimator, grid: dict[str, list], train: DataFrame, folds: int = 3, seed=42,
                key: str = "id", label: str = "label", parallelism: int = 4) -> SearchResult:
    """K-fold grid search scored by F1 of class 1; plain fit without a grid."""
    if not grid:
        return SearchResult(est.fit(train), {})
    data = stratified_folds(train, label, key, k=folds, seed=seed, fold_col="fold")
    data = data.withColumn(label, F.col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    if hasattr(est, "fit_grid"):  # fits all points and folds together
        points = expand_grid(grid)
        best_i, metrics, model = est.fit_grid(data, points, folds, key, "fold")
        data.unpersist()
        return SearchResult(model, points[best_i], list(zip(points, metrics)))
    maps = param_maps(est, grid)
    evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, labelCol=label,
                                                  predictionCol="prediction")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                        foldCol="fold", parallelism=parallelism, seed=seed)
    cvm = cv.fit(data)
    metrics = list(cvm.avgMetrics)
    best_i = max(range(len(metrics)), key=lambda i: (metrics[i], -i))     # first best wins
    named = [({p.name: v for p, v in m.items()}, s) for m, s in zip(maps, metrics)]
    data.unpersist()
    return SearchResult(cvm.bestModel, named[best_i][0], named)


@dataclass
class Cell:
    balancer: str
    classifier: str
    estimator: Callable[[], Estimator]
    grid: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.balancer} + {self.classifier}"


def run_cell(cell: Cell, balanced: DataFrame, test: DataFrame, folds: int = 3, seed=42, key: str = "id",
             label: str = "label", bands=M.BANDS, decorate: bool = False, parallelism: int = 4):
    """Tune on the balanced rows, score the test rows, return (result record, search result)."""
    search = grid_search(cell.estimator(), cell.grid, balanced, folds, seed, key, label, parallelism)
    scored = search.model.transform(test)
    return M.evaluate(scored, cell.name, label, "prediction", "score", bands, decorate), search


def run_matrix(train: DataFrame, test: DataFrame, balancers: dict[str, Callable[[DataFrame], DataFrame]],
               cells: list[Cell], folds: int = 3, seed=42, key: str = "id", label: str = "label",
               decorate: bool = False, parallelism: int = 4) -> DataFrame:
    """All cells; each balancer runs once and its table is shared by its classifiers."""
    results = []
    spark = train.sparkSession
    for bal_name in dict.fromkeys(c.balancer for c in cells):
        # written to the shared checkpoint folder: the balanced table feeds every fit of the
        # balancer's cells, so an executor loss must not replay the balancer (a kNN join for SMOTE)
        balanced = cut_lineage(balancers[bal_name](train), "balanced")
        for cell in (c for c in cells if c.balancer == bal_name):
            rec, _ = run_cell(cell, balanced, test, folds, seed, key, label, decorate=decorate,
                              parallelism=parallelism)
            # one row per cell: keep it as a small local table, not a cached plan
            results.append(spark.createDataFrame(rec.collect(), rec.schema))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return M.leaderboard(out)
