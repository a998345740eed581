"""Proportional stratified interleaving: every shard holds the sources in the corpus's proportions.

Rows are ranked within each source in a seeded hash order, all rows are
sorted by fractional rank, and the order is cut into runs of equal length.
Both ranks come from a range-partitioned global index, so no source has to
fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_text
from tessera.llm.tables import global_index, lookup_join
from tessera.session import cut_lineage


def stratified_shards(rows: DataFrame, shards: int, seed: int = 42, key: str = "key", stratum: str = "stratum") -> DataFrame:
    """Add ``rank`` (0-based, within the stratum), ``fraction``, ``position``, ``shard`` and ``slot`` to ``rows``.

    Shard row counts differ by at most one, and so does each stratum's share
    of a shard from its exact share, up to one row for either end. A null
    stratum is a stratum of its own. Equal keys are ordered by their hash
    and then arbitrarily; shards of equal rows are interchangeable. ``rows``
    should be narrow (ids, no texts) without columns of these names.
    """
    hashed = rows.withColumn("_h", hash_text(F.coalesce(F.col(key).cast("string"), F.lit("null")), f"shard-{seed}"))
    ranked = global_index(hashed, [stratum, "_h", key], "shard-ranks")
    strata = cut_lineage(ranked.groupBy(F.col(stratum).alias("_s")).agg(F.min("idx").alias("_first"), F.count("*").alias("_n")),
                         "shard-strata")
    total = strata.agg(F.sum("_n")).first()[0] or 0
    ranked = lookup_join(ranked, strata, F.col(stratum).eqNullSafe(F.col("_s")))
    rank = F.col("idx") - F.col("_first")
    ranked = ranked.withColumn("rank", rank).withColumn(
        "fraction", (2 * F.col("rank") + 1).cast("double") / (2 * F.col("_n")).cast("double")).drop("idx", "_s", "_first", "_n")
    placed = global_index(ranked, ["fraction", "_h", key], "shard-places").withColumnRenamed("idx", "position")
    if not total:
        return (placed.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).drop("_h"))
    # position * shards div total: runs of total/shards rows, lengths at most one apart
    shard = F.expr(f"(position * {shards}L) div {total}L")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start).drop("_h"))
