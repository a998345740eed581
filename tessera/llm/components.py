"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _stars(pairs: DataFrame) -> bool:
    """Whether every u of the pairs (u, v), u > v, has one v that is no u itself; rounds change no such table."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges between ids -> (id, class): the smallest id of each component, for every id on an edge.

    Each round hangs the larger neighbours of every vertex on its smallest
    one, then all smaller neighbours, until every vertex hangs on one that
    hangs on none; rounds needed grow with the logarithm of the longest path.
    Rounds are written to the shared folder. Loops and repeated edges do no
    harm; an empty table gives no rows.
    """
    pairs = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a row for each pair, so what repeats here is left for the end of the round
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large, "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(
        pairs.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
