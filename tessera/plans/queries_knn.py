"""Registered queries of the neighbour family (K1-K2, B3-B9, M2) on the embeddings table.

The embeddings' class 0 (about a tenth of the rows) is the minority:
label = 1 for it, 0 for every other class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance as B
from ..operators.knn import knn_join
from ..operators.models import KNNClassifier
from ..operators.sampling import stratified_split
from ..sources.adapter import embedding_view
from .common import rounded


def _emb(spark, sf_dir) -> DataFrame:
    return embedding_view(spark, sf_dir).withColumnRenamed("vec_id", "id")


def _vec_summary(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "label", F.col("is_synthetic").cast("int").alias("is_synthetic"), "base_id", "neighbor_id", "gap",
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("f_sum"),
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x).alias("f_sq"))


def q_knn_join_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: 5 nearest other vectors of every embedding (Euclidean), ties by id."""
    e = _emb(spark, sf_dir)
    return rounded(knn_join(e, e, 5, exclude_self=True))


def q_knn_join_manhattan(spark, sf_dir):
    """K2: the same with Manhattan distance."""
    e = _emb(spark, sf_dir)
    return rounded(knn_join(e, e, 5, metric="manhattan", exclude_self=True))


def q_smote(spark, sf_dir):
    """SMOTE (k=5) of the minority up to the majority count."""
    return rounded(_vec_summary(B.smote(_emb(spark, sf_dir), seed=42)))


def q_smote_partial(spark, sf_dir):
    """SMOTE to 0.75 x the majority count."""
    return rounded(_vec_summary(B.smote(_emb(spark, sf_dir), seed=42, sampling_strategy=0.75)))


def q_adasyn(spark, sf_dir):
    """ADASYN (k=5)."""
    return rounded(_vec_summary(B.adasyn(_emb(spark, sf_dir), seed=42)))


def q_tomek_links(spark, sf_dir):
    """Mutual nearest-neighbour pairs of opposite classes."""
    return B.tomek_links(_emb(spark, sf_dir))


def q_smote_tomek(spark, sf_dir):
    """SMOTE, then both ends of every Tomek link removed."""
    out = B.smote_tomek(_emb(spark, sf_dir), seed=42)
    return out.select("id", "label", F.col("is_synthetic").cast("int").alias("is_synthetic"))


def q_near_miss(spark, sf_dir):
    """NearMiss-1 (k=3) undersampling."""
    return B.near_miss(_emb(spark, sf_dir)).select("id", "label")


def q_balance_fallback_report(spark, sf_dir):
    """ADASYN with SMOTE as the fallback; rows per class and the balancer used."""
    out, name = B.with_fallback(_emb(spark, sf_dir), ("B3_ADASYN", lambda d: B.adasyn(d, seed=42)),
                                ("B2_SMOTE", lambda d: B.smote(d, seed=42)))
    return B.balanced_counts(out, name)


#: Rows of a block in the queries that run the many-block plan on a small table.
SMALL_BLOCK = 64


def q_knn_join_blocks_euclidean(spark, sf_dir):
    """K1 through many blocks: slabs, pass A and the visits of pass B."""
    e = _emb(spark, sf_dir)
    return rounded(knn_join(e, e, 5, exclude_self=True, block_rows=SMALL_BLOCK))


def q_knn_join_blocks_manhattan(spark, sf_dir):
    """K2 through many blocks."""
    e = _emb(spark, sf_dir)
    return rounded(knn_join(e, e, 5, metric="manhattan", exclude_self=True, block_rows=SMALL_BLOCK))


def q_adasyn_blocks(spark, sf_dir):
    """B5 on the many-block neighbour join."""
    return rounded(_vec_summary(B.adasyn(_emb(spark, sf_dir), seed=42, block_rows=SMALL_BLOCK)))


def q_tomek_links_blocks(spark, sf_dir):
    """B6 on the many-block neighbour join."""
    return B.tomek_links(_emb(spark, sf_dir), block_rows=SMALL_BLOCK)


def q_near_miss_blocks(spark, sf_dir):
    """B8 on the many-block neighbour join."""
    return B.near_miss(_emb(spark, sf_dir), block_rows=SMALL_BLOCK // 4).select("id", "label")


def _knn_scores(spark, sf_dir, weights):
    e = _emb(spark, sf_dir)
    sp = stratified_split(e, "label", "id", 0.3, 42)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    model = KNNClassifier(k=5, weights=weights).fit(train)
    out = model.transform(test)
    return rounded(out.select("id", "label", F.col("prediction").cast("int").alias("prediction"), "score"))


def q_knn_classifier_uniform(spark, sf_dir):
    """M2: 5-NN vote (uniform weights) of test embeddings against the training split."""
    return _knn_scores(spark, sf_dir, "uniform")


def q_knn_classifier_distance(spark, sf_dir):
    """M2: 5-NN vote with 1/d weights."""
    return _knn_scores(spark, sf_dir, "distance")


QUERIES = {
    "knn_join_euclidean": q_knn_join_euclidean,
    "knn_join_manhattan": q_knn_join_manhattan,
    "smote": q_smote,
    "smote_partial": q_smote_partial,
    "adasyn": q_adasyn,
    "tomek_links": q_tomek_links,
    "smote_tomek": q_smote_tomek,
    "near_miss": q_near_miss,
    "balance_fallback_report": q_balance_fallback_report,
    "knn_join_blocks_euclidean": q_knn_join_blocks_euclidean,
    "knn_join_blocks_manhattan": q_knn_join_blocks_manhattan,
    "adasyn_blocks": q_adasyn_blocks,
    "tomek_links_blocks": q_tomek_links_blocks,
    "near_miss_blocks": q_near_miss_blocks,
    "knn_classifier_uniform": q_knn_classifier_uniform,
    "knn_classifier_distance": q_knn_classifier_distance,
}
