"""Mixing sources to target weights by Poisson replication.

Each source s gets a mean repetition rate: its share of the weights times
the wanted size, over the size it has. A document's number of copies is the
Poisson quantile of a uniform draw hashed from (seed, key), so it does not
depend on partitioning or retries. Documents are exploded by their count and
all copies shuffled globally by a hashed order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_text, unit_draw
from tessera.llm.tables import lookup_join, packed
from tessera.session import cut_lineage

#: A rate above this is drawn as a sum of several Poisson draws of at most this mean.
RATE_STEP = 16.0
#: Terms of the distribution table; P(X > 63) is below 1e-16 at the largest mean.
TERMS = 64


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0,
                 source: str = "source", text: str = "text", target_size: int | None = None) -> DataFrame:
    """One row per source: ``source``, ``size`` (UTF-8 bytes + 1 per document), ``rate``,
    ``draws`` and ``cdf`` (distribution table of one draw).

    ``target_size`` is the wanted size of the mix, by default that of the
    input. Null is a source of its own, named by the key '' in ``weights``.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    stats = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size.cast("long")).alias("size"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.coalesce(F.col("source"), F.lit("")) == name, F.lit(float(w))).otherwise(weight)
    stats = cut_lineage(stats.withColumn("weight", weight), "mix-sources")
    total = stats.agg(F.sum("weight").alias("w"), F.sum("size").alias("n")).first()
    wanted = float(target_size if target_size is not None else (total.n or 0))
    all_weight = float(total.w or 0) or 1.0
    stats = stats.withColumn("rate", F.col("weight") / F.lit(all_weight) * F.lit(wanted) / F.col("size"))
    stats = stats.withColumn("draws", F.greatest(F.ceil(F.col("rate") / RATE_STEP), F.lit(1)).cast("int"))
    stats = stats.withColumn("mean", F.col("rate") / F.col("draws"))
    first = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"),
                              F.array_append(a["c"], F.element_at(a["c"], -1) + a["p"] * F.col("mean") / k).alias("c")),
        lambda a: a["c"])
    return stats.select("source", "size", "rate", "draws", cdf.alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = 42,
                key: str = "doc_id", source: str = "source", text: str = "text",
                target_size: int | None = None) -> DataFrame:
    """Rows ``doc`` (all columns of the document), ``copy`` (from 1), ``rate``, ``order_key``; globally shuffled.

    An empty table gives no rows. Null keys, texts and sources are values
    like others. Rows with equal keys get equal counts.
    """
    rates = cut_lineage(source_rates(docs, weights, default_weight, source, text, target_size), "mix-rates")
    rows = docs.select(packed(docs).alias("doc"))
    rates = rates.select(F.struct("source", "rate", "draws", "cdf").alias("r"))
    joined = lookup_join(rows, rates, F.col(f"doc.`{source}`").eqNullSafe(F.col("r.source")))
    id_text = F.coalesce(F.col(f"doc.`{key}`").cast("string"), F.lit("null"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("r.draws")), F.lit(0),
        lambda n, j: n + F.size(F.filter(F.col("r.cdf"), lambda c: c <= unit_draw(id_text, j, f"copies-{seed}"))))
    copies = (joined.select("doc", F.col("r.rate").alias("rate"), count.alias("n"), id_text.alias("k"))
              .filter("n > 0")
              .select("doc", "rate", "k", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")))
    keyed = copies.select("doc", "copy", "rate", hash_text("k", F.col("copy"), f"order-{seed}").alias("order_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "order_key").sortWithinPartitions("order_key")
