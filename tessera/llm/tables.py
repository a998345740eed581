"""Helpers shared by the operators: tables, checked broadcasts and a global row index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Broadcast bound for small lookup tables, in rows (checked, with a shuffle join beyond it).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(col: str | Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that operators add columns without name clashes."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def lookup_join(df: DataFrame, small: DataFrame, cond, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table expected to be small: broadcast after counting it, a shuffle join above ``max_rows``.

    ``small`` should be cut or cheap, since it is counted first.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, cond, how)


def global_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Add ``idx``: the 0-based place of each row in the total order ``order``.

    One range shuffle, sorted partitions, and an offset per partition. No
    window runs over a key, so a source with a third of the rows is spread
    like any other. The placed rows are written to the shared folder first:
    the offsets and the rows then come from one computation, also after an
    executor is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = cut_lineage(placed, name)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn("idx", F.col("_off") + inside).drop("_at", "_part", "_off"))
