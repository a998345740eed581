"""Streaming scoring equals batch scoring; the matrix shares balancers and ranks cells."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.naive_bayes import GaussianNB
from tessera.operators.prep import Preprocessor
from tessera.operators.roles import Roles
from tessera.operators.sampling import undersample
from tessera.plans.common import assemble
from tessera.plans.tune import Cell, run_matrix
from tessera.session import scratch_path
from tessera.streaming import score_stream
from tessera.streaming.scoring import score_batch


def _survey(spark, n=300):
    rng = np.random.default_rng(0)
    y = rng.random(n) < 0.3
    rows = pd.DataFrame({"key": np.arange(n, dtype=np.int64), "Class": np.where(y, "Yes", "No"),
                         "x": rng.normal(size=n) + y * 2.0, "c": np.where(rng.random(n) < 0.5, "a", "b")})
    return spark.createDataFrame(rows, "key long, Class string, x double, c string")


def test_stream_equals_batch(spark):
    df = _survey(spark)
    roles = Roles("key", "Class", categorical=("c",), numeric=("x",))
    prep = Preprocessor(roles).fit(df)
    nb = GaussianNB().fit(assemble(prep.transform(df), prep.feature_columns()))
    src = scratch_path(spark, "t-src")
    df.repartition(3).write.parquet(src)
    sink = score_stream(spark, src, df.schema, prep, nb, scratch_path(spark, "t-sink"))
    streamed = {r.key: (r.prediction, round(r.score, 9)) for r in spark.read.parquet(sink).collect()}
    batch = {r.key: (r.prediction, round(r.score, 9)) for r in score_batch(df, prep, nb).collect()}
    assert streamed == batch and len(streamed) == 300


def test_matrix_ranks_cells(spark):
    rng = np.random.default_rng(1)
    n = 200
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64), "features": [list(r) for r in rng.normal(size=(n, 3)) + y[:, None]],
                        "label": y})
    df = spark.createDataFrame(pdf, "id long, features array<double>, label int")
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    bal = {"RUS": lambda d: undersample(d, "label", "id", seed=42), "NONE": lambda d: d}
    cells = [Cell(b, "NB", lambda: GaussianNB(), {"varSmoothing": [1e-9, 1e-3]}) for b in bal]
    board = run_matrix(train, test, bal, cells).orderBy("position").collect()
    assert [r.position for r in board] == [1, 2]
    assert board[0].avg_tpr >= board[1].avg_tpr
    assert all(r.tn + r.fp + r.fn + r.tp == 50 for r in board)


def test_arriving_files_of_a_batch_fill_the_cores(spark, tmp_path, monkeypatch):
    """four micro-batches, each of a file per core, from a split that is computed once."""
    import tessera.streaming as streaming
    from tessera.plans import queries
    spark.range(600).selectExpr("id o_orderkey", "id % 50 o_custkey", "if(id % 2 = 0, 'F', 'O') o_orderstatus",
                                "double(id * 7919 % 400000) o_totalprice", "concat(id % 5, '-X') o_orderpriority"
                                ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id c_custkey", "double(id * 37 % 10000) c_acctbal", "concat('S', id % 3) c_mktsegment"
                               ).write.parquet(f"{tmp_path}/customer.parquet")
    seen, plain = [], streaming.score_stream

    def watched(spark, src, *a, **k):
        seen.append((len(spark.read.parquet(src).inputFiles()), k.get("files_per_trigger", 1)))
        return plain(spark, src, *a, **k)
    monkeypatch.setattr(streaming, "score_stream", watched)
    splits, split = [], queries.survey_split
    monkeypatch.setattr(queries, "survey_split", lambda *a: splits.append(1) or split(*a))
    scored = queries.q_stream_naive_bayes_scores(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(4 * cores, cores)] and splits == [1]
    assert sorted(r.CONTROL for r in scored.collect()) == sorted(
        r.CONTROL for r in split(spark, str(tmp_path)).filter("split = 'test'").collect())
