"""Classifiers (M1-M7, M9-M11) as pyspark.ml estimators fitted on the cluster.

Every estimator here reads a ``features`` vector (or array) column and a
0/1 ``label`` and writes ``prediction`` (double) and ``score`` (P(label=1),
or the decision value when there is no probability). Parameter names of the
reference map as follows (the objective scaling differs: the reference sums
losses, Spark averages them):

* C (inverse regularisation)  -> regParam = 1 / (C * n_rows)
* penalty l1 / l2             -> elasticNetParam 1 / 0
* decision tree, forest       -> ``exact_trees`` (the best of all cuts per node, one forest for all grid points)
* extra-trees                 -> ``extra_trees`` (a random cut per node, the same passes)
* linear SVM                  -> ``linear_svm`` (squared hinge; C as it is)
* boosting                    -> ``boosting`` (all grid points and folds in the same passes)
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extra_trees, linear_svm
from .boosting import Boosting, fit_together, search
from .exact_trees import ExactForest
from .knn import knn_join
from .naive_bayes import GaussianNB, HasScoreCol, as_array, as_vector
from .sampling import stratified_folds

MAX_DEPTH = 30


def depth(d) -> int:
    """Depth of boosted trees for a grid value: None means the deepest that boosting numbers; deeper ones are refused."""
    if d is not None and int(d) > MAX_DEPTH:
        raise ValueError(f"maxDepth {d} is above {MAX_DEPTH}, the deepest boosted tree")
    return MAX_DEPTH if d is None else int(d)


def with_score(df: DataFrame, score: str = "score") -> DataFrame:
    """Add P(label = 1) from a Spark model's probability (or raw prediction) vector."""
    if score in df.columns:
        return df
    src = "probability" if "probability" in df.columns else "rawPrediction"
    return df.withColumn(score, vector_to_array(F.col(src))[1])


class _Wrapped(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    """Estimator that builds a Spark estimator at fit time (n_rows known), then scores with it."""

    def _spark_estimator(self, n_rows: int):
        raise NotImplementedError

    def _fit(self, dataset: DataFrame):
        vec = dataset.withColumn(self.getFeaturesCol(), as_vector(dataset, self.getFeaturesCol()))
        n = vec.count() if self._needs_n else 0
        est = self._spark_estimator(n).setFeaturesCol(self.getFeaturesCol()).setLabelCol(self.getLabelCol())
        return _WrappedModel(est.fit(vec.withColumn(self.getLabelCol(), F.col(self.getLabelCol()).cast("double"))),
                             self.getFeaturesCol(), self.getPredictionCol(), self.getScoreCol())

    _needs_n = False


class _WrappedModel(Model):
    def __init__(self, inner, features: str, prediction: str, score: str):
        super().__init__()
        self.inner, self.features, self.prediction, self.score = inner, features, prediction, score

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vec = dataset.withColumn(self.features, as_vector(dataset, self.features))
        drop = [c for c in ("rawPrediction", "probability", self.prediction, self.score) if c in vec.columns]
        out = self.inner.transform(vec.drop(*drop))
        out = with_score(out, self.score)
        return out.drop(*[c for c in ("rawPrediction", "probability") if c in out.columns])


def _p(name: str, doc: str, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


class SkLogisticRegression(_Wrapped):
    """M1: C, penalty l1/l2, max_iter."""
    C = _p("C", "inverse regularisation strength", TypeConverters.toFloat)
    penalty = _p("penalty", "l1 or l2", TypeConverters.toString)
    maxIter = _p("maxIter", "iterations", TypeConverters.toInt)
    _needs_n = True

    @keyword_only
    def __init__(self, *, C=1.0, penalty="l2", maxIter=1000, featuresCol="features", labelCol="label",
                 predictionCol="prediction", scoreCol="score", seed=42):
        super().__init__()
        self._setDefault(C=1.0, penalty="l2", maxIter=1000)
        self._set(**self._input_kwargs)

    def _spark_estimator(self, n):
        c = self.getOrDefault(self.C)
        return LogisticRegression(regParam=1.0 / (c * max(n, 1)), standardization=False,
                                  elasticNetParam=1.0 if self.getOrDefault(self.penalty) == "l1" else 0.0,
                                  maxIter=self.getOrDefault(self.maxIter))


class ExtraTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    """n_estimators, max_depth, min_samples_split, max_features. A grid search grows one forest per fold for all points."""
    nEstimators = _p("nEstimators", "trees", TypeConverters.toInt)
    maxDepth = _p("maxDepth", "depth, None = unlimited", TypeConverters.identity)
    minSamplesSplit = _p("minSamplesSplit", "rows of a node that may be split", TypeConverters.toInt)
    maxFeatures = _p("maxFeatures", "sqrt, log2 or None", TypeConverters.identity)
    _defaults = {"nEstimators": 100, "maxDepth": None, "minSamplesSplit": 2, "maxFeatures": "sqrt"}

    @keyword_only
    def __init__(self, *, nEstimators=100, maxDepth=None, minSamplesSplit=2, maxFeatures="sqrt", featuresCol="features",
                 labelCol="label", predictionCol="prediction", scoreCol="score", seed=42):
        super().__init__()
        self._setDefault(seed=42, **self._defaults)
        self._set(**self._input_kwargs)

    def _point(self, columns: int, values: dict | None = None) -> extra_trees.Forest:
        v = {name: self.getOrDefault(name) for name in self._defaults} | (values or {})
        drawn = {"sqrt": math.sqrt(columns), "log2": math.log2(max(columns, 1)), None: columns}[v["maxFeatures"]]
        return extra_trees.Forest(int(v["nEstimators"]), v["maxDepth"], int(v["minSamplesSplit"]), max(1, int(drawn)))

    def _rows(self, dataset: DataFrame, key: str, fold=None) -> tuple[DataFrame, int]:
        x = as_array(dataset, self.getFeaturesCol())
        first = dataset.select(F.size(x)).first()
        if first is None:
            raise ValueError("empty training table")
        own = F.col(key) if key in dataset.columns else F.monotonically_increasing_id()
        return dataset.select(own.alias("id"), x.alias("features"), F.col(self.getLabelCol()).alias("label"),
                              (F.lit(0) if fold is None else F.col(fold)).alias("fold")), first[0]

    def _fit(self, dataset):
        rows, columns = self._rows(dataset, "id")
        return self._copyValues(ExtraTreesModel(extra_trees.fit(rows, self._point(columns), self.getOrDefault(self.seed))))

    def fit_grid(self, data: DataFrame, points: list[dict], folds: int, key: str, fold: str):
        """(index of the best point, score of each point, model of the best on all rows), with the folds in column ``fold``."""
        rows, columns = self._rows(data, key, fold)
        best, scores, grown = extra_trees.search(rows, [self._point(columns, p) for p in points], folds, self.getOrDefault(self.seed))
        return best, scores, self._copyValues(ExtraTreesModel(grown))


class ExtraTreesModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    def __init__(self, grown=None):
        super().__init__()
        self.grown = grown

    def _transform(self, dataset):
        return self.grown.scored(dataset, as_array(dataset, self.getFeaturesCol()), self.getScoreCol(), self.getPredictionCol())


class SkDecisionTree(ExtraTrees):
    """M3: max_depth, min_samples_split, min_samples_leaf, criterion gini/entropy; the best of all cuts in every node."""
    minSamplesLeaf = _p("minSamplesLeaf", "rows per leaf", TypeConverters.toInt)
    criterion = _p("criterion", "gini or entropy", TypeConverters.toString)
    _defaults = {"maxDepth": None, "minSamplesSplit": 2, "minSamplesLeaf": 1, "criterion": "gini"}

    @keyword_only
    def __init__(self, *, maxDepth=None, minSamplesSplit=2, minSamplesLeaf=1, criterion="gini", featuresCol="features",
                 labelCol="label", predictionCol="prediction", scoreCol="score", seed=42):
        own = dict(self._input_kwargs)
        super().__init__()
        self._set(**own)

    def _point(self, columns, values=None):
        v = {name: self.getOrDefault(name) for name in self._defaults} | (values or {})
        return ExactForest(1, v["maxDepth"], int(v["minSamplesSplit"]), columns, int(v["minSamplesLeaf"]), v["criterion"])


class SkRandomForest(ExtraTrees):
    """M4: n_estimators, max_depth, min_samples_split, min_samples_leaf, max_features sqrt/log2/None, bootstrap (Poisson counts)."""
    minSamplesLeaf = SkDecisionTree.minSamplesLeaf
    bootstrap = _p("bootstrap", "sample rows per tree", TypeConverters.toBoolean)
    _defaults = {"nEstimators": 100, "maxDepth": None, "minSamplesSplit": 2, "minSamplesLeaf": 1, "maxFeatures": "sqrt", "bootstrap": True}

    @keyword_only
    def __init__(self, *, nEstimators=100, maxDepth=None, minSamplesSplit=2, minSamplesLeaf=1, maxFeatures="sqrt", bootstrap=True,
                 featuresCol="features", labelCol="label", predictionCol="prediction", scoreCol="score", seed=42):
        own = dict(self._input_kwargs)
        super().__init__()
        self._set(**own)

    def _point(self, columns, values=None):
        v = {name: self.getOrDefault(name) for name in self._defaults} | (values or {})
        drawn = super()._point(columns, values)
        return ExactForest(drawn.trees, drawn.depth, drawn.min_split, drawn.features, int(v["minSamplesLeaf"]), "gini", bool(v["bootstrap"]))


class SkGradientBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    """M5: n_estimators, max_depth, learning_rate, subsample, min_samples_split. Grid searches fit all points and folds together."""
    nEstimators = _p("nEstimators", "boosting rounds", TypeConverters.toInt)
    maxDepth = _p("maxDepth", "depth", TypeConverters.identity)
    learningRate = _p("learningRate", "shrinkage", TypeConverters.toFloat)
    subsample = _p("subsample", "row share per round", TypeConverters.toFloat)
    colsample = _p("colsample", "feature share per tree (1.0 = all)", TypeConverters.toFloat)
    minSamplesSplit = _p("minSamplesSplit", "rows of a node that may be split", TypeConverters.toInt)
    _defaults = {"nEstimators": 100, "maxDepth": 3, "learningRate": 0.1, "subsample": 1.0, "colsample": 1.0, "minSamplesSplit": 2}
    _fixed: dict = {}

    @keyword_only
    def __init__(self, *, nEstimators=100, maxDepth=3, learningRate=0.1, subsample=1.0, colsample=1.0, minSamplesSplit=2,
                 featuresCol="features", labelCol="label", predictionCol="prediction", scoreCol="score", seed=42):
        super().__init__()
        self._setDefault(seed=42, **self._defaults)
        self._set(**self._input_kwargs)

    def _point(self, values: dict | None = None) -> Boosting:
        v = {name: self.getOrDefault(name) for name in self._defaults} | (values or {})
        return Boosting(int(v["nEstimators"]), depth(v["maxDepth"]), float(v["learningRate"]), float(v["subsample"]), float(v["colsample"]),
                        min_split=int(v.get("minSamplesSplit", 2)), l1=float(v.get("regAlpha", 0)), l2=float(v.get("regLambda", 0)), **self._fixed)

    def _rows(self, dataset: DataFrame, key: str | None, fold=None) -> DataFrame:
        own = F.col(key) if key in dataset.columns else F.xxhash64(as_array(dataset, self.getFeaturesCol()))
        return dataset.select(own.cast("long").alias("id"), as_array(dataset, self.getFeaturesCol()).alias("features"),
                              F.col(self.getLabelCol()).alias("label"), (F.lit(0) if fold is None else F.col(fold)).alias("fold"))

    def _fit(self, dataset):
        models, _ = fit_together(self._rows(dataset, "id"), [self._point()], seed=self.getOrDefault(self.seed))
        return self._copyValues(BoostedModel(models[0]))

    def fit_grid(self, data: DataFrame, points: list[dict], folds: int, key: str, fold: str):
        """(index of the best point, score of each point, model of the best on all rows), with the folds in column ``fold``."""
        best, scores, model = search(self._rows(data, key, fold), [self._point(p) for p in points], folds, self.getOrDefault(self.seed))
        return best, scores, self._copyValues(BoostedModel(model))


class RegularisedBoosting(SkGradientBoosting):
    """M9: second-order gains, L1 and L2 leaf penalties, columns drawn per tree, at least a Hessian of 1 in a leaf."""
    regAlpha = _p("regAlpha", "L1 penalty of leaves", TypeConverters.toFloat)
    regLambda = _p("regLambda", "L2 penalty of leaves", TypeConverters.toFloat)
    _defaults = {"nEstimators": 100, "maxDepth": 6, "learningRate": 0.3, "subsample": 1.0, "colsample": 1.0, "regAlpha": 0.0, "regLambda": 1.0}
    _fixed = {"split": "newton", "min_hessian": 1.0}

    @keyword_only
    def __init__(self, *, nEstimators=100, maxDepth=6, learningRate=0.3, subsample=1.0, colsample=1.0, regAlpha=0.0, regLambda=1.0,
                 featuresCol="features", labelCol="label", predictionCol="prediction", scoreCol="score", seed=42):
        own = dict(self._input_kwargs)
        super().__init__()
        self._set(**own)


class BoostedModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    def __init__(self, ensemble=None):
        super().__init__()
        self.ensemble = ensemble

    def _transform(self, dataset):
        return self.ensemble.scored(dataset, as_array(dataset, self.getFeaturesCol()), self.getScoreCol(), self.getPredictionCol())


class SkMLP(_Wrapped):
    """Hidden layer sizes, max_iter (l-bfgs, sigmoid hidden units)."""
    hidden = _p("hidden", "hidden layer sizes", TypeConverters.toListInt)
    maxIter = _p("maxIter", "iterations", TypeConverters.toInt)
    _needs_n = False

    @keyword_only
    def __init__(self, *, hidden=(100,), maxIter=200, featuresCol="features", labelCol="label",
                 predictionCol="prediction", scoreCol="score", seed=42):
        super().__init__()
        self._setDefault(hidden=[100], maxIter=200, seed=42)
        kw = dict(self._input_kwargs)
        if "hidden" in kw:
            kw["hidden"] = list(kw["hidden"])
        self._set(**kw)

    def _fit(self, dataset):
        d = dataset.select(F.size(as_array(dataset, self.getFeaturesCol()))).first()[0]
        self._layers = [d, *self.getOrDefault(self.hidden), 2]
        return super()._fit(dataset)

    def _spark_estimator(self, n):
        return MultilayerPerceptronClassifier(layers=self._layers, maxIter=self.getOrDefault(self.maxIter),
                                              solver="l-bfgs", seed=self.getOrDefault(self.seed))


class CalibratedLinearSVC(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    """M6 + M7: linear SVM (squared hinge loss) with sigmoid calibration over k stratified folds (``linear_svm``).

    Score = mean of the k calibrated probabilities; prediction = score > 0.5. A grid search fits all
    points, folds and calibration folds together. Needs an ``id`` column for the folds; ``maxIter`` bounds the passes.
    """
    C = _p("C", "inverse regularisation strength", TypeConverters.toFloat)
    folds = _p("folds", "calibration folds", TypeConverters.toInt)
    maxIter = _p("maxIter", "iterations", TypeConverters.toInt)
    idCol = _p("idCol", "row key", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, C=1.0, folds=3, maxIter=2000, idCol="id", featuresCol="features", labelCol="label",
                 predictionCol="prediction", scoreCol="score", seed=42):
        super().__init__()
        self._setDefault(C=1.0, folds=3, maxIter=2000, idCol="id", seed=42)
        self._set(**self._input_kwargs)

    def _search(self, dataset, points: list[dict], folds: int, key: str, fold: str | None):
        lc, k = self.getLabelCol(), self.getOrDefault(self.folds)
        data = dataset.select(F.col(key), as_array(dataset, self.getFeaturesCol()).alias("features"), F.col(lc).cast("int").alias("label"),
                              (F.lit(0) if fold is None else F.col(fold)).alias("fold"))
        data = stratified_folds(data, "label", key, k=max(1, folds) * k, seed=self.getOrDefault(self.seed), fold_col="turn")
        scores, classifiers = linear_svm.search(data, [float(p.get("C", self.getOrDefault(self.C))) for p in points], folds, k,
                                                self.getOrDefault(self.maxIter))
        best = max(range(len(points)), key=lambda i: (scores[i], -i))
        pairs = [(w[:-1].tolist(), float(w[-1]), float(ab[0]), float(ab[1])) for w, ab in classifiers[best]]
        return best, scores, self._copyValues(CalibratedLinearSVCModel(pairs))

    def _fit(self, dataset):
        return self._search(dataset, [{}], 1, self.getOrDefault(self.idCol), None)[2]

    def fit_grid(self, data: DataFrame, points: list[dict], folds: int, key: str, fold: str):
        """(index of the best point, score of each point, model of the best on all rows), with the folds in column ``fold``."""
        return self._search(data, points, folds, key, fold)


class CalibratedLinearSVCModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol, HasSeed):
    def __init__(self, pairs=None):
        super().__init__()
        self.pairs = pairs or []

    def _transform(self, dataset):
        x = as_array(dataset, self.getFeaturesCol())
        probs = []
        for w, b, a, c in self.pairs:
            wa = F.array(*[F.lit(float(v)) for v in w])
            margin = F.aggregate(F.zip_with(x, wa, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) + F.lit(b)
            probs.append(1.0 / (1.0 + F.exp(-(F.lit(a) * margin + F.lit(c)))))
        score = sum(probs[1:], probs[0]) / F.lit(float(len(probs)))
        return dataset.withColumn(self.getScoreCol(), score) \
                      .withColumn(self.getPredictionCol(), (F.col(self.getScoreCol()) > 0.5).cast("double"))


class KNNClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol):
    """M2: k nearest training rows vote; weights 'uniform' or 'distance' (1/d; rows at d = 0
    alone decide when present); score = weighted share of label 1; ties -> 0. Needs an id column."""
    k = _p("k", "neighbours", TypeConverters.toInt)
    weights = _p("weights", "uniform or distance", TypeConverters.toString)
    metric = _p("metric", "euclidean or manhattan", TypeConverters.toString)
    idCol = _p("idCol", "row key", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k=5, weights="uniform", metric="euclidean", idCol="id", featuresCol="features",
                 labelCol="label", predictionCol="prediction", scoreCol="score"):
        super().__init__()
        self._setDefault(k=5, weights="uniform", metric="euclidean", idCol="id")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        key, fc, lc = self.getOrDefault(self.idCol), self.getFeaturesCol(), self.getLabelCol()
        train = dataset.select(F.col(key).cast("long").alias("id"), as_array(dataset, fc).alias("features"),
                               F.col(lc).cast("int").alias("label"))
        return self._copyValues(KNNModel(train))

    def fit_grid(self, data: DataFrame, points: list[dict], folds: int, key: str, fold: str):
        """(index of the best point, score of each point, model of the best on all rows), with the folds in column ``fold``.

        One neighbour join per metric and fold: the k nearest of a point are the first k of the largest k."""
        full = [{n: self.getOrDefault(n) for n in ("k", "weights", "metric")} | p for p in points]
        scores = [[] for _ in points]
        for metric in dict.fromkeys(p["metric"] for p in full):
            at = [i for i, p in enumerate(full) if p["metric"] == metric]
            for f in range(folds):
                train = self._fit(data.filter(F.col(fold) != f)).train
                rows = self._fit(data.filter(F.col(fold) == f)).train
                nn = knn_join(rows.select("id", "features"), train, max(full[i]["k"] for i in at), metric=metric)
                votes = _votes(nn, train)
                sums = []
                for i in at:
                    w = F.when(F.col("rank") <= full[i]["k"], _weight(full[i]["weights"])).otherwise(0.0)
                    sums += [F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias(f"_w1_{i}"), F.sum(w).alias(f"_wa_{i}")]
                scored = rows.select("id", "label").join(votes.groupBy(F.col("qid").alias("id")).agg(*sums), "id")
                yes, counts = F.col("label") == 1, []
                for i in at:
                    said = F.col(f"_w1_{i}") > F.col(f"_wa_{i}") - F.col(f"_w1_{i}")
                    counts += [F.count_if(said & yes).alias(f"tp_{i}"), F.count_if(said & ~yes).alias(f"fp_{i}"),
                               F.count_if(~said & yes).alias(f"fn_{i}")]
                got = scored.agg(*counts).first()
                for i in at:
                    tp, fp, fn = (got[f"{c}_{i}"] for c in ("tp", "fp", "fn"))
                    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
                    scores[i].append(2 * precision * recall / (precision + recall) if tp else 0.0)
        means = [sum(s) / len(s) for s in scores]
        best = max(range(len(points)), key=lambda i: (means[i], -i))       # first best wins
        return best, means, self.copy()._set(**points[best]).fit(data)


def _votes(nn: DataFrame, train: DataFrame) -> DataFrame:
    """Neighbours with their labels and whether the query has any at distance 0."""
    votes = nn.join(train.select(F.col("id").alias("rid"), "label"), "rid")
    return votes.withColumn("_zero", F.max((F.col("distance") == 0).cast("int")).over(_by_q()))


def _weight(weights: str):
    if weights != "distance":
        return F.lit(1.0)
    return F.when(F.col("_zero") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))


class KNNModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasScoreCol):
    k = KNNClassifier.k
    weights = KNNClassifier.weights
    metric = KNNClassifier.metric
    idCol = KNNClassifier.idCol

    def __init__(self, train=None):
        super().__init__()
        self.train = train

    def _transform(self, dataset):
        key = self.getOrDefault(self.idCol)
        q = dataset.select(F.col(key).cast("long").alias("id"), as_array(dataset, self.getFeaturesCol()).alias("features"))
        nn = knn_join(q, self.train, self.getOrDefault(self.k), metric=self.getOrDefault(self.metric))
        votes = _votes(nn, self.train).withColumn("_w", _weight(self.getOrDefault(self.weights)))
        agg = votes.groupBy("qid").agg(F.sum(F.when(F.col("label") == 1, F.col("_w")).otherwise(0.0)).alias("_w1"),
                                       F.sum("_w").alias("_wa"))
        scored = agg.select(F.col("qid").alias(key), (F.col("_w1") / F.col("_wa")).alias(self.getScoreCol()),
                            (F.col("_w1") > F.col("_wa") - F.col("_w1")).cast("double").alias(self.getPredictionCol()))
        drop = [c for c in (self.getScoreCol(), self.getPredictionCol()) if c in dataset.columns]
        return dataset.drop(*drop).join(scored, key)


def _by_q():
    from pyspark.sql import Window
    return Window.partitionBy("qid")
