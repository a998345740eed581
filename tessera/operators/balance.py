"""Class rebalancing by synthesis and cleaning (B3-B9), on the exact kNN join.

Tables are (id long >= 0, features array<double>, label int). Outputs add
``is_synthetic``, ``base_id``, ``neighbor_id`` and ``gap``; a synthetic row
gets id -(rank(base) * M + j) (M = largest copy count + 1), unique and
negative, so later neighbour joins (Tomek) can use it like any id.

All random choices are md5 draws of (base id, copy number, seed, purpose):
re-runnable, partition-independent and reproducible in SQL. SMOTE gives
every minority row floor(N / n_min) copies and one more to the first
N mod n_min rows in hash order (same total as sampling bases with
replacement, less variance).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_draw
from ..session import cut_lineage
from .knn import knn_join
from .profile import order_statistic
from .sampling import class_counts, exact_rank


class BalanceError(RuntimeError):
    """A balancer's precondition does not hold (the caller may fall back)."""


def _binary(counts: dict) -> tuple:
    if len(counts) != 2:
        raise BalanceError(f"need two classes, got {sorted(counts)}")
    (lo_lbl, n_lo), (hi_lbl, n_hi) = sorted(counts.items(), key=lambda kv: (kv[1], kv[0]))
    return lo_lbl, n_lo, hi_lbl, n_hi


def _originals(df: DataFrame, key: str, features: str, label: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(features).cast("array<double>").alias("features"),
                     F.col(label).cast("int").alias("label"), F.lit(False).alias("is_synthetic"),
                     F.lit(None).cast("long").alias("base_id"), F.lit(None).cast("long").alias("neighbor_id"),
                     F.lit(None).cast("double").alias("gap"))


def _synthesize(minority: DataFrame, copies: DataFrame, nn: DataFrame, k: int, seed, label_value,
                max_copies: int) -> DataFrame:
    """Interpolated rows: copies (id, r, g) -> g rows per base along a random minority neighbour."""
    mult = int(max_copies) + 1
    syn = copies.filter(F.col("g") > 0).select(
        F.col("id").alias("base_id"), "r", F.explode(F.sequence(F.lit(1), F.col("g").cast("int"))).alias("j"))
    syn = syn.select(
        "base_id", "r", "j",
        (F.floor(unit_draw(F.col("base_id"), F.col("j"), seed, "nn") * k) + 1).cast("long").alias("nn_rank"),
        unit_draw(F.col("base_id"), F.col("j"), seed, "gap").alias("gap"))
    syn = syn.join(nn.select(F.col("qid").alias("base_id"), F.col("rank").alias("nn_rank"),
                             F.col("rid").alias("neighbor_id")), ["base_id", "nn_rank"])
    base = minority.select(F.col("id").alias("base_id"), F.col("features").alias("_bx"))
    nbr = minority.select(F.col("id").alias("neighbor_id"), F.col("features").alias("_nx"))
    syn = syn.join(base, "base_id").join(nbr, "neighbor_id")
    feats = F.zip_with("_bx", "_nx", lambda a, b: a + F.col("gap") * (b - a))
    return syn.select(
        (-(F.col("r") * F.lit(mult) + F.col("j"))).cast("long").alias("id"), feats.alias("features"),
        F.lit(label_value).cast("int").alias("label"), F.lit(True).alias("is_synthetic"),
        F.col("base_id").cast("long"), F.col("neighbor_id").cast("long"), "gap")


def smote(df: DataFrame, key: str = "id", features: str = "features", label: str = "label", k: int = 5,
          seed=42, sampling_strategy: float = 1.0, block_rows: int = 2048) -> DataFrame:
    """Add int(strategy * n_maj) - n_min synthetic minority rows."""
    base = _originals(df, key, features, label)
    counts = class_counts(base, "label")
    min_lbl, n_min, _, n_maj = _binary(counts)
    n_new = int(sampling_strategy * n_maj - n_min)
    if n_min <= k:
        raise BalanceError(f"SMOTE needs more than k={k} minority rows, got {n_min}")
    if n_new <= 0:
        return base
    minority = base.filter(F.col("label") == min_lbl).select("id", "features", "label")
    nn = knn_join(minority, minority, k, exclude_self=True, block_rows=block_rows)
    q, e = divmod(n_new, n_min)
    ranked = exact_rank(minority, "label", "id", seed, rank="r")
    copies = ranked.select("id", "r", (F.lit(q) + (F.col("r") <= e).cast("int")).alias("g"))
    return base.unionByName(_synthesize(minority, copies, nn, k, seed, min_lbl, q + (1 if e else 0)))


def _round_half_even_div(num, den):
    """round(num / den) half-to-even, exactly, for non-negative integer expressions."""
    q = F.floor(num / den).cast("long")
    rem = num - q * den
    up = (rem * 2 > den) | ((rem * 2 == den) & (q % 2 == 1))
    return q + up.cast("long")


def adasyn(df: DataFrame, key: str = "id", features: str = "features", label: str = "label", k: int = 5,
           seed=42, block_rows: int = 2048) -> DataFrame:
    """Synthetic count per minority row proportional to the share of other-class rows among
    its k neighbours in the whole table; interpolation toward minority neighbours."""
    base = _originals(df, key, features, label)
    counts = class_counts(base, "label")
    min_lbl, n_min, _, n_maj = _binary(counts)
    n_new = n_maj - n_min
    if n_min <= k:
        raise BalanceError(f"ADASYN needs more than k={k} minority rows, got {n_min}")
    minority = base.filter(F.col("label") == min_lbl).select("id", "features", "label")
    everyone = base.select("id", "features")
    nn_all = knn_join(minority, everyone, k, exclude_self=True, block_rows=block_rows)
    labels = base.select(F.col("id").alias("rid"), F.col("label").alias("_rl"))
    # one row per minority row; written once because it feeds a sum and the copy counts
    hard = cut_lineage(nn_all.join(labels, "rid").groupBy("qid")
                       .agg(F.count_if(F.col("_rl") != F.lit(min_lbl)).alias("cnt")), "adasyn-hard")
    total = hard.agg(F.sum("cnt")).first()[0] or 0
    if total == 0:
        raise BalanceError("ADASYN: no minority row has a neighbour of another class")
    g = _round_half_even_div(F.col("cnt") * F.lit(n_new), F.lit(total))
    ranked = exact_rank(minority, "label", "id", seed, rank="r")
    copies = ranked.join(hard.select(F.col("qid").alias("id"), g.alias("g")), "id").select("id", "r", "g")
    g_sum, g_max = copies.agg(F.sum("g"), F.max("g")).first()
    if not g_sum:
        raise BalanceError("ADASYN: rounding leaves no row to generate")
    nn_min = knn_join(minority, minority, k, exclude_self=True, block_rows=block_rows)
    return base.unionByName(_synthesize(minority, copies, nn_min, k, seed, min_lbl, g_max))


def tomek_links(df: DataFrame, key: str = "id", features: str = "features", label: str = "label",
                block_rows: int = 2048) -> DataFrame:
    """Pairs (id_a < id_b) of opposite-class rows that are each other's nearest neighbour."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(features).alias("features"),
                     F.col(label).cast("int").alias("label"))
    nn = knn_join(rows, rows, 1, exclude_self=True, block_rows=block_rows).select("qid", "rid")
    lab = rows.select("id", "label")
    a = nn.join(lab.withColumnRenamed("id", "qid").withColumnRenamed("label", "ql"), "qid") \
          .join(lab.withColumnRenamed("id", "rid").withColumnRenamed("label", "rl"), "rid")
    a = a.filter((F.col("ql") != F.col("rl")) & (F.col("qid") < F.col("rid")))
    back = nn.select(F.col("qid").alias("rid"), F.col("rid").alias("qid"))   # reverse edges
    mutual = a.join(back, ["qid", "rid"], "left_semi")
    return mutual.select(F.col("qid").alias("id_a"), F.col("rid").alias("id_b"),
                         F.col("ql").alias("label_a"), F.col("rl").alias("label_b"))


def remove_tomek(df: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Drop both ends of every Tomek link (sampling strategy 'all')."""
    links = tomek_links(df, block_rows=block_rows)
    ends = links.select(F.col("id_a").alias("id")).unionByName(links.select(F.col("id_b").alias("id")))
    return df.join(ends, "id", "left_anti")


def smote_tomek(df: DataFrame, key: str = "id", features: str = "features", label: str = "label", k: int = 5,
                seed=42, block_rows: int = 2048) -> DataFrame:
    """SMOTE, then remove both ends of every Tomek link of the result."""
    balanced = cut_lineage(smote(df, key, features, label, k, seed, block_rows=block_rows), "smote")
    return remove_tomek(balanced, block_rows)


def near_miss(df: DataFrame, key: str = "id", features: str = "features", label: str = "label", k: int = 3,
              block_rows: int = 2048) -> DataFrame:
    """B8 (version 1): keep the n_min majority rows with the smallest mean distance to their
    k nearest minority rows (ties by id); keep every minority row."""
    base = _originals(df, key, features, label)
    min_lbl, n_min, maj_lbl, _ = _binary(class_counts(base, "label"))
    if n_min < k:
        raise BalanceError(f"NearMiss needs at least k={k} minority rows, got {n_min}")
    minority = base.filter(F.col("label") == min_lbl)
    majority = base.filter(F.col("label") == maj_lbl)
    nn = knn_join(majority.select("id", "features"), minority.select("id", "features"), k, block_rows=block_rows)
    # mean of the k distances summed in ascending order (k values per row: bounded)
    avg = cut_lineage(nn.groupBy("qid").agg(
        (F.aggregate(F.array_sort(F.collect_list("distance")), F.lit(0.0), lambda a, b: a + b) / F.lit(k))
        .alias("avg_d")), "nearmiss-avg")
    v = order_statistic(avg, F.col("avg_d"), n_min - 1)
    below = avg.filter(F.col("avg_d") < F.lit(v))
    n_below = below.count()
    ties = avg.filter(F.col("avg_d") == F.lit(v))
    # ids in two parts, each exact as a double
    high, low, rank = F.shiftright("qid", 31), F.col("qid").bitwiseAND(F.lit((1 << 31) - 1)), n_min - n_below - 1
    top = int(order_statistic(ties, high, rank))
    id_cut = (top << 31) + int(order_statistic(ties.filter(high == top), low, rank - ties.filter(high < top).count()))
    keep = below.select("qid").unionByName(ties.filter(F.col("qid") <= F.lit(id_cut)).select("qid"))
    chosen = majority.join(keep.withColumnRenamed("qid", "id"), "id", "left_semi")
    return minority.unionByName(chosen)


def balanced_counts(df: DataFrame, balancer: str, label: str = "label") -> DataFrame:
    """B9 report: rows per class after balancing, with the balancer that produced them."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(balancer).alias("balancer"), F.col(label).alias("label"), "n_rows")


def with_fallback(df: DataFrame, primary: tuple[str, Callable], fallback: tuple[str, Callable]):
    """Run the primary balancer; on a failed precondition run the fallback. Returns (table, name)."""
    try:
        return primary[1](df), primary[0]
    except BalanceError:
        return fallback[1](df), fallback[0]
