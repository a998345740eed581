"""Exact, seeded, partition-independent splits and samples.

Order within a class is (md5(key|seed), key). A plain
``row_number() OVER (PARTITION BY class ...)`` would put a whole class in
one task, so ranks are computed in two steps:

1. a histogram of the first 3 md5 hex digits per class (at most
   n_classes x 4,096 rows: a proven size bound), collected;
2. its running counts give each bucket's offset (or the bucket where a
   class's quota is reached, refined by further digits while that bucket
   is large); rows are ranked only inside their (class, bucket).

Both steps give exactly the plain window's ranks (tests check this).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket, hash_text

HEX_DIGITS = 3          # 4,096 buckets per class and level
MAX_CLASSES = 256       # bound on a histogram: MAX_CLASSES x 16**HEX_DIGITS rows
EDGE_ROWS = 1 << 21     # a cut bucket larger than this is split again by the next digits


def _with_hash(df: DataFrame, key: str, seed, hex_digits: int = HEX_DIGITS) -> DataFrame:
    h = hash_text(F.col(key), seed)
    return df.withColumn("_h", h).withColumn("_b", hash_bucket(F.col("_h"), hex_digits))


def class_counts(df: DataFrame, label: str) -> dict:
    """Per-class row counts (one small aggregate; at most MAX_CLASSES rows)."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    return {r[label]: r["count"] for r in rows}


def _histogram(hashed: DataFrame, label: str, prefix_len: int, where=None) -> dict:
    """{class: sorted [(hash prefix, rows)]}: at most MAX_CLASSES x 16**HEX_DIGITS entries."""
    src = hashed if where is None else hashed.filter(where)
    b = F.substring("_h", 1, prefix_len)
    rows = src.groupBy(label, b.alias("_p")).agg(F.count(F.lit(1)).alias("n")) \
              .limit(MAX_CLASSES * 16 ** HEX_DIGITS + 1).collect()
    if len(rows) > MAX_CLASSES * 16 ** HEX_DIGITS:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    out: dict = {}
    for r in rows:
        out.setdefault(r[label], []).append((r["_p"], r["n"]))
    for v in out.values():
        v.sort()
    return out


def _cut(buckets: list, quota: int):
    """(prefix of the bucket holding the quota-th row, rows still needed from it, its size)."""
    before = 0
    for p, n in buckets:
        if before + n >= quota:
            return p, quota - before, n
        before += n
    return None


def _cut_points(hashed: DataFrame, label: str, quotas) -> dict:
    """{class: (cut prefix, rows needed from it)}; prefixes are refined while the cut bucket
    holds more than EDGE_ROWS rows, so the final window ranks a bounded number of rows."""
    hist = _histogram(hashed, label, HEX_DIGITS)
    if callable(quotas):
        quotas = quotas({k: sum(n for _, n in v) for k, v in hist.items()})
    cuts = {}
    for k, q in quotas.items():
        if q <= 0 or k not in hist:
            continue
        prefix, need, size = _cut(hist[k], q)
        while size > EDGE_ROWS and len(prefix) < 32:
            cond = (F.col(label) == F.lit(k)) & F.col("_h").startswith(prefix)
            sub = _histogram(hashed, label, len(prefix) + HEX_DIGITS, cond)[k]
            prefix, need, size = _cut(sub, need)
        cuts[k] = (prefix, need)
    return cuts


def _label_map(label: str, mapping: dict, value_type: str) -> Column:
    expr = F.lit(None).cast(value_type)
    for k, v in mapping.items():
        cond = F.col(label).isNull() if k is None else (F.col(label) == F.lit(k))
        expr = F.when(cond, F.lit(v).cast(value_type)).otherwise(expr)
    return expr


def flag_top_per_class(df: DataFrame, label: str, key: str, quotas, seed,
                       flag: str = "selected") -> DataFrame:
    """Add boolean ``flag``: row is among the first quotas[class] rows of its class.

    ``quotas`` is a dict, or a function of the class counts returning one
    (the counts come from the same histogram). Rows whose hash prefix sorts
    before the class's cut prefix are selected and rows after it are not,
    with no shuffle; only the cut bucket (at most EDGE_ROWS rows) is ranked
    with a window.
    """
    hashed = _with_hash(df, key, seed)
    cuts = _cut_points(hashed, label, quotas)
    plen = _label_map(label, {k: len(v[0]) for k, v in cuts.items()}, "int")
    cut_p = _label_map(label, {k: v[0] for k, v in cuts.items()}, "string")
    need = _label_map(label, {k: v[1] for k, v in cuts.items()}, "long")
    head = F.expr("substring(_h, 1, 32)").substr(F.lit(1), plen)
    in_cut = F.coalesce(head == cut_p, F.lit(False))
    rest = hashed.filter(~in_cut).withColumn(flag, F.coalesce(head < cut_p, F.lit(False)))
    w = Window.partitionBy(label).orderBy("_h", key)
    edge = hashed.filter(in_cut).withColumn(flag, F.row_number().over(w) <= need)
    return rest.unionByName(edge).drop("_h", "_b")


def exact_rank(df: DataFrame, label: str, key: str, seed, rank: str = "rank") -> DataFrame:
    """1-based rank of each row within its class by (md5(key|seed), key).

    rank = rows of the class in earlier buckets (from the collected
    histogram, at most MAX_CLASSES x 4,096 entries, broadcast) + row number
    inside the (class, bucket) partition (about 1/4,096 of the class).
    """
    spark = df.sparkSession
    hashed = _with_hash(df, key, seed)
    hist = _histogram(hashed, label, HEX_DIGITS)
    rows = []
    for k, buckets in hist.items():
        before = 0
        for p, n in buckets:
            rows.append((k, p, before))
            before += n
    schema = f"{label} {dict(df.dtypes)[label]}, _b string, _off long"
    offsets = spark.createDataFrame(rows, schema)
    # bounded by MAX_CLASSES x 16**HEX_DIGITS rows: safe to broadcast.
    # Labels are non-null here (unlabelled rows are dropped before splitting).
    ranked = hashed.join(F.broadcast(offsets), [label, "_b"])
    wb = Window.partitionBy(label, "_b").orderBy("_h", key)
    return ranked.withColumn(rank, (F.col("_off") + F.row_number().over(wb)).cast("long")).drop("_h", "_b", "_off")


def largest_remainder(counts: dict, total: int) -> dict:
    """Allot ``total`` draws to classes in proportion to counts (exact integers).

    floor(total*c/n) each, then one more to the largest remainders; ties go
    to the smaller class value.
    """
    n = sum(counts.values())
    base = {k: (total * c) // n for k, c in counts.items()}
    rem = {k: (total * c) % n for k, c in counts.items()}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda k: (-rem[k], _sort_key(k)))
    for k in order[:left]:
        base[k] += 1
    return base


def _sort_key(k):
    return (k is None, k)


def split_quota(counts: dict, test_size: float = 0.3) -> dict:
    """Per-class test rows of a stratified split: ceil(test_size*n), largest remainder."""
    n = sum(counts.values())
    return largest_remainder(counts, int(math.ceil(test_size * n)))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.3, seed=42,
                     split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' / 'train'; per-class test counts are exact."""
    flagged = flag_top_per_class(df, label, key, lambda counts: split_quota(counts, test_size), seed,
                                 flag="_is_test")
    return flagged.withColumn(split_col, F.when(F.col("_is_test"), "test").otherwise("train")).drop("_is_test")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed=42, fold_col: str = "fold") -> DataFrame:
    """fold = (rank within class - 1) mod k; fold sizes per class differ by at most 1."""
    ranked = exact_rank(df, label, key, seed, rank="_rk")
    return ranked.withColumn(fold_col, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def undersample(df: DataFrame, label: str, key: str, seed=42, ratio: float | None = None) -> DataFrame:
    """B1/B2: keep every minority row and a seeded subset of each other class.

    ratio=None: every class down to the minority count (1:1).
    ratio=r (two classes): majority down to int(n_min / r).
    """
    def quotas(counts):
        n_min = min(counts.values())
        if ratio is None:
            return {k: n_min for k in counts}
        target = int(n_min / ratio)
        return {k: (c if c == n_min else min(c, target)) for k, c in counts.items()}

    flagged = flag_top_per_class(df, label, key, quotas, seed, flag="_keep")
    return flagged.filter("_keep").drop("_keep")
