"""Score a stream of new survey rows with a fitted preparation and classifier.

This is the predict step of a cell (preparation transform -> model
transform) run by Structured Streaming over files as they arrive. Each
micro-batch is scored with ``foreachBatch`` (any fitted model works,
including ones whose transform joins or groups) and written to
``<sink>/batch=<id>`` in overwrite mode, so a replayed batch after a
failure rewrites the same output (idempotent sink); the checkpoint
location records progress in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def score_batch(df: DataFrame, prep, model, keep=()) -> DataFrame:
    """Preparation transform -> feature vector -> model transform."""
    feats = prep.feature_columns()
    prepared = prep.transform(df, keep=tuple(keep))
    vec = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(prepared)
    return model.transform(vec)


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, prep, model, sink_dir: str,
                 columns=("prediction", "score"), files_per_trigger: int = 1,
                 checkpoint_dir: str | None = None) -> str:
    """Score every file under ``source_dir`` (available now) into ``sink_dir``; returns the sink path."""
    key = prep.roles.key
    ckpt = checkpoint_dir or scratch_path(spark, "stream-ckpt")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(batch, prep, model)
        out = scored.select(key, "label", *columns, F.lit(batch_id).cast("long").alias("batch_id"))
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return sink_dir
