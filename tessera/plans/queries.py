"""Registered queries (Spark side). Each takes (spark, sf_dir) and returns a DataFrame.

Names follow the operator they exercise (SURVEY section 2 ids in the
docstrings); the SQL oracle of each lives in ``oracle_sql.py``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.naive_bayes import GaussianNB
from ..operators.prep import Preprocessor, drop_unlabelled
from ..operators.profile import class_balance, null_profile, null_total, value_counts
from ..operators.roles import observed_roles, role_report
from ..operators.sampling import stratified_folds, undersample
from ..sources.adapter import SURVEY_ROLES, survey_view
from ..sources.io import infer_types, read_csv, read_csv_inferred, read_csv_strings, reload_split, table_shape, write_table
from ..session import cut_lineage, scratch_path
from .common import assemble, rounded, survey_prepared, survey_split

R = SURVEY_ROLES


def _labelled(spark, sf_dir):
    return drop_unlabelled(survey_view(spark, sf_dir), R.target)


def _fit_all(spark, sf_dir):
    # the fit reads the labelled rows in several passes: keep them instead of re-joining each time
    lab = cut_lineage(_labelled(spark, sf_dir), "labelled")
    return lab, Preprocessor(R).fit(lab)


# --- scans, sinks, projections (S1-S4, P1-P8, R1-R2) ----------------------------------

def q_survey_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1+S2: write the survey table as header CSV under the shared scratch root, scan it back typed."""
    df = survey_view(spark, sf_dir)
    path = write_table(df, scratch_path(spark, "survey-csv"), "csv")
    return rounded(read_csv(spark, path, df.schema))


def q_survey_csv_types(spark, sf_dir):
    """Types inferred from the survey table's CSV, with the counts that decide them."""
    path = write_table(survey_view(spark, sf_dir), scratch_path(spark, "survey-csv"), "csv")
    return infer_types(read_csv_strings(spark, path))


def q_survey_csv_inferred(spark, sf_dir):
    """The survey table's CSV scanned back with inferred types (codes with gaps are doubles)."""
    path = write_table(survey_view(spark, sf_dir), scratch_path(spark, "survey-csv"), "csv")
    return rounded(read_csv_inferred(spark, path))


def q_table_shape(spark, sf_dir):
    """S3: rows x columns of the survey table."""
    return table_shape(survey_view(spark, sf_dir))


def q_split_parquet_reload(spark, sf_dir):
    """S2+S4: prepared train and test tables written as Parquet stages, reloaded with the label
    separated from the features; rows per (split, label) and feature count."""
    _, prepared = survey_prepared(spark, sf_dir)
    paths = {}
    for part in ("train", "test"):
        paths[part] = write_table(prepared.filter(F.col("split") == part).drop("split"),
                                  scratch_path(spark, f"stage-{part}"), "parquet")
    train, test, features = reload_split(spark, paths["train"], paths["test"], "label", R.key)
    both = train.select(F.lit("train").alias("split"), "label").unionByName(
        test.select(F.lit("test").alias("split"), "label"))
    return both.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.lit(len(features)).cast("long").alias("n_features"))


def q_drop_unlabelled(spark, sf_dir):
    """Drop rows with a missing target; keep key and target."""
    return _labelled(spark, sf_dir).select(R.key, R.target)


def q_role_check(spark, sf_dir):
    """R1+R2+P8: every table / role-list name (one listed column is absent) with its role and problem, and what its values show."""
    survey, listed = survey_view(spark, sf_dir), replace(R, numeric=(*R.numeric, "ABSENT"))
    return role_report(spark, survey, listed).join(observed_roles(survey, listed), "column_name", "left")


# --- profiles (A1-A8) ---------------------------------------------------------------

def q_class_balance(spark, sf_dir):
    """Class counts, shares, imbalance ratio."""
    return rounded(class_balance(survey_view(spark, sf_dir), R.target))


def q_null_profile(spark, sf_dir):
    """A1: missing values per column of the raw survey table."""
    return null_profile(survey_view(spark, sf_dir))


def q_null_total(spark, sf_dir):
    """A2: missing feature cells before and after imputation (labelled rows)."""
    lab, model = _fit_all(spark, sf_dir)
    dtypes = dict(lab.dtypes)
    imputed = lab.select(*[model.imputed(c, dtypes).alias(c) for c in R.features])
    before = null_total(lab, R.features).withColumnRenamed("n_missing", "n_missing_before")
    after = null_total(imputed, R.features).withColumnRenamed("n_missing", "n_missing_after")
    return before.select("*", F.lit(1).alias("_k")).join(F.broadcast(after.select("*", F.lit(1).alias("_k"))), "_k").drop("_k")


def q_value_counts(spark, sf_dir):
    """A3: frequency table (missing group kept) of the coded columns."""
    return value_counts(survey_view(spark, sf_dir), list(R.binary) + list(R.categorical))


def q_quartiles(spark, sf_dir):
    """Exact linear-interpolated quartiles of the imputed numeric columns."""
    lab, model = _fit_all(spark, sf_dir)
    rows = [(c, model.quartiles[c][0], model.quartiles[c][1]) for c in R.numeric]
    return rounded(spark.createDataFrame(rows, "column_name string, q1 double, q3 double"))


def q_outlier_counts(spark, sf_dir):
    """Values outside [q1 - 6 iqr, q3 + 6 iqr] per numeric column."""
    lab, model = _fit_all(spark, sf_dir)
    dtypes = dict(lab.dtypes)
    aggs = []
    for c in R.numeric:
        lo, hi = model.bounds[c]
        x = model.imputed(c, dtypes)
        aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).cast("long").alias(c))
    wide = lab.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in R.numeric)
    return wide.selectExpr(f"stack({len(R.numeric)}, {stack}) AS (column_name, n_capped)")


# --- preparation (F1-F8) ------------------------------------------------------------

def q_prep_stats(spark, sf_dir):
    """fitted medians, quartiles, bounds, mean, sigma, capped counts."""
    _, model = _fit_all(spark, sf_dir)
    return rounded(model.stats_table(spark))


def q_median_impute(spark, sf_dir):
    """numeric columns with missing values filled by the exact median."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return rounded(lab.select(R.key, *[model.imputed(c, d).alias(c) for c in R.numeric]))


def q_mode_impute(spark, sf_dir):
    """coded columns with missing values filled by the most frequent value (smallest on ties)."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return lab.select(R.key, *[model.imputed(c, d).alias(c) for c in list(R.binary) + list(R.categorical)])


def q_iqr_cap(spark, sf_dir):
    """imputed numeric columns clipped to the IQR x 6 fence."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return rounded(lab.select(R.key, *[model.capped(c, d).alias(c) for c in R.numeric]))


def q_target_encode(spark, sf_dir):
    """Yes -> 1, No -> 0, else missing (all rows, labelled or not)."""
    df = survey_view(spark, sf_dir)
    model = Preprocessor(R).fit(drop_unlabelled(df, R.target))
    return df.select(R.key, R.target, model.target().alias("label"))


def q_label_encode(spark, sf_dir):
    """binary column coded by the rank of its string value."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return lab.select(R.key, *[model.code(c, d).cast("int").alias(c) for c in R.binary])


def q_one_hot(spark, sf_dir):
    """one 0/1 column per level of every multi-category column."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return lab.select(R.key, *[col for c in R.categorical for col in model.dummies(c, d)])


def q_zscore(spark, sf_dir):
    """capped numeric columns standardised with the population sigma."""
    lab, model = _fit_all(spark, sf_dir)
    d = dict(lab.dtypes)
    return rounded(lab.select(R.key, *[model.scaled(c, d).alias(c) for c in R.numeric]))


def q_prepared_table(spark, sf_dir):
    """F8: the whole chain fitted on all labelled rows, as the reference does."""
    lab, model = _fit_all(spark, sf_dir)
    return rounded(model.transform(lab))


# --- splits and undersampling (T1, T2, B1, B2) ----------------------------------------

def q_stratified_split(spark, sf_dir):
    """Exact seeded 70/30 stratified split of the labelled rows."""
    return survey_split(spark, sf_dir).select(R.key, R.target, "split")


def q_stratified_folds(spark, sf_dir):
    """3 stratified folds of the training rows."""
    tr = survey_split(spark, sf_dir).filter(F.col("split") == "train")
    return stratified_folds(tr, R.target, R.key, k=3, seed=42).select(R.key, R.target, "fold")


def _train_rows(spark, sf_dir):
    model, prepared = survey_prepared(spark, sf_dir)
    return model, prepared.filter(F.col("split") == "train"), prepared.filter(F.col("split") == "test")


def q_random_undersample(spark, sf_dir):
    """B1: training rows undersampled 1:1, seed 42."""
    _, train, _ = _train_rows(spark, sf_dir)
    return undersample(train, "label", R.key, seed=42).select(R.key, "label")


def q_random_undersample_seed123(spark, sf_dir):
    """B1 with seed 123."""
    _, train, _ = _train_rows(spark, sf_dir)
    return undersample(train, "label", R.key, seed=123).select(R.key, "label")


def q_partial_undersample(spark, sf_dir):
    """B2: majority down to n_min / 0.5."""
    _, train, _ = _train_rows(spark, sf_dir)
    return undersample(train, "label", R.key, seed=42, ratio=0.5).select(R.key, "label")


# --- naive Bayes cells, metrics, leaderboard (M8, E1-E12, R3, G3-G5) -------------------

def nb_scored(spark, sf_dir, seed=42, ratio=None, var_smoothing=1e-9, prepared=None):
    model, train, test = prepared or _train_rows(spark, sf_dir)
    feats = model.feature_columns()
    bal = undersample(train, "label", R.key, seed=seed, ratio=ratio)
    nb = GaussianNB(varSmoothing=var_smoothing).fit(assemble(bal, feats))
    return nb.transform(assemble(test, feats))


def q_naive_bayes_scores(spark, sf_dir):
    """M8: Gaussian NB fitted on RUS-balanced train rows; test predictions and P(Yes)."""
    return rounded(nb_scored(spark, sf_dir).select(R.key, "label", F.col("prediction").cast("int").alias("prediction"),
                                                   "score"))


def q_stream_naive_bayes_scores(spark, sf_dir):
    """Streaming predict: the test rows arrive as files and are scored by the fitted preparation
    and RUS + NB model in micro-batches (Structured Streaming, foreachBatch)."""
    from ..streaming import score_stream
    # the fit, the training rows and the arriving files read the split: write it once
    split = cut_lineage(survey_split(spark, sf_dir), "survey-split")
    model = Preprocessor(R).fit(split.filter(F.col("split") == "train"))
    prepared = model.transform(split, keep=("split",))
    feats = model.feature_columns()
    bal = undersample(prepared.filter(F.col("split") == "train"), "label", R.key, seed=42)
    nb = GaussianNB().fit(assemble(bal, feats))
    test_raw = split.filter(F.col("split") == "test").drop("split")
    src = scratch_path(spark, "stream-src")
    # four micro-batches, each of a file per core: one file would be one task
    per_batch = spark.sparkContext.defaultParallelism
    test_raw.repartition(4 * per_batch, R.key).write.parquet(src)
    sink = score_stream(spark, src, test_raw.schema, model, nb, scratch_path(spark, "stream-sink"),
                        files_per_trigger=per_batch)
    out = spark.read.parquet(sink)
    return rounded(out.select(R.key, "label", F.col("prediction").cast("int").alias("prediction"), "score"))


def q_confusion_matrix(spark, sf_dir):
    """Confusion counts of the RUS + NB cell."""
    return M.confusion(nb_scored(spark, sf_dir))


def q_roc_auc(spark, sf_dir):
    """Mid-rank ROC AUC of the RUS + NB cell."""
    return rounded(M.roc_auc(nb_scored(spark, sf_dir)))


def q_rus_naive_bayes_cell(spark, sf_dir):
    """Flagship: scan -> drop unlabelled -> split -> prepare -> RUS -> NB -> result record."""
    return rounded(M.evaluate(nb_scored(spark, sf_dir), "B1_RUS + C7_NaiveBayes"))


NB_CELLS = (("B1_RUS", 42, None), ("B4_RUS123", 123, None), ("RUS_partial", 42, 0.5))


def _nb_results(spark, sf_dir):
    prepared = _train_rows(spark, sf_dir)       # one split + preparation shared by all cells
    rows = [M.evaluate(nb_scored(spark, sf_dir, seed, ratio, prepared=prepared), f"{name} + C7_NaiveBayes")
            for name, seed, ratio in NB_CELLS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_naive_bayes_leaderboard(spark, sf_dir):
    """Three undersampling cells with NB, ranked by avg TPR."""
    return rounded(M.leaderboard(_nb_results(spark, sf_dir)))


def q_best_cell(spark, sf_dir):
    """The top cell of the NB leaderboard."""
    return rounded(M.best_cell(_nb_results(spark, sf_dir)))


def q_leaderboard_report(spark, sf_dir):
    """Formatted report columns of the NB leaderboard."""
    return M.report(_nb_results(spark, sf_dir))


def q_band_counts(spark, sf_dir):
    """Cells per target band of the NB leaderboard."""
    return M.band_counts(_nb_results(spark, sf_dir))


QUERIES = {
    "survey_csv_roundtrip": q_survey_csv_roundtrip,
    "survey_csv_types": q_survey_csv_types,
    "survey_csv_inferred": q_survey_csv_inferred,
    "table_shape": q_table_shape,
    "split_parquet_reload": q_split_parquet_reload,
    "drop_unlabelled": q_drop_unlabelled,
    "role_check": q_role_check,
    "class_balance": q_class_balance,
    "null_profile": q_null_profile,
    "null_total": q_null_total,
    "value_counts": q_value_counts,
    "quartiles": q_quartiles,
    "outlier_counts": q_outlier_counts,
    "prep_stats": q_prep_stats,
    "median_impute": q_median_impute,
    "mode_impute": q_mode_impute,
    "iqr_cap": q_iqr_cap,
    "target_encode": q_target_encode,
    "label_encode": q_label_encode,
    "one_hot": q_one_hot,
    "zscore": q_zscore,
    "prepared_table": q_prepared_table,
    "stratified_split": q_stratified_split,
    "stratified_folds": q_stratified_folds,
    "random_undersample": q_random_undersample,
    "random_undersample_seed123": q_random_undersample_seed123,
    "partial_undersample": q_partial_undersample,
    "naive_bayes_scores": q_naive_bayes_scores,
    "stream_naive_bayes_scores": q_stream_naive_bayes_scores,
    "confusion_matrix": q_confusion_matrix,
    "roc_auc": q_roc_auc,
    "rus_naive_bayes_cell": q_rus_naive_bayes_cell,
    "naive_bayes_leaderboard": q_naive_bayes_leaderboard,
    "best_cell": q_best_cell,
    "leaderboard_report": q_leaderboard_report,
    "band_counts": q_band_counts,
}
