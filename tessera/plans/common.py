"""Shared building blocks of the registered queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import PrepModel, Preprocessor, drop_unlabelled
from ..operators.sampling import stratified_split
from ..session import cut_lineage
from ..sources.adapter import SURVEY_ROLES, survey_view

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (sums differ in the last bits by partitioning)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def survey_split(spark: SparkSession, sf_dir: str, seed=42, test_size: float = 0.3) -> DataFrame:
    """Labelled survey rows with a seeded, exact, stratified 'split' column."""
    labelled = drop_unlabelled(survey_view(spark, sf_dir), SURVEY_ROLES.target)
    return stratified_split(labelled, SURVEY_ROLES.target, SURVEY_ROLES.key, test_size, seed)


def survey_prepared(spark: SparkSession, sf_dir: str, fit_on: str = "train", seed=42,
                    persist: bool = True) -> tuple[PrepModel, DataFrame]:
    """Fit the preparation on train rows ('train') or all labelled rows ('all'); encode all rows."""
    split = survey_split(spark, sf_dir, seed)
    if persist:
        split = cut_lineage(split, "survey-split")
    fit_rows = split.filter(F.col("split") == "train") if fit_on == "train" else split
    model = Preprocessor(SURVEY_ROLES).fit(fit_rows)
    return model, model.transform(split, keep=("split",))


def assemble(df: DataFrame, feature_cols, out: str = "features") -> DataFrame:
    """Features as one ML vector column (kept next to the key and label)."""
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="keep").transform(df)
