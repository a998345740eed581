"""Target-distribution importance resampling: hashed n-gram gains, Gumbel keys and an exact top draw.

Arrow kernels do the text work of a slice: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn texts
into word numbers; shifted numbers form the word pairs, and only distinct
words and pairs get a CRC-32. A pair's CRC is put together from those of its
words, since appending bytes to a string is a linear map of its CRC. Gains
are taken by bucket and reduced by document.

Bucket counts are summed over all documents and all target texts; the table
of gains has ``BUCKETS`` entries however large the corpus is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import global_index, packed
from tessera.session import cut_lineage, ship_package

# Production parameters.
BUCKETS = 10_000
DRAW_PERCENT = 25
MIN_WORDS = 20
SEED = 7
SLICE_BYTES = 2 << 20

#: Everything ASCII but letters and digits ends a word.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class CrcJoin:
    """CRC-32 of joined strings from the CRCs of their parts and the length of the second."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, n: int) -> np.ndarray:
        """What appending ``n`` bytes does to each byte of a CRC (the map is linear over bits)."""
        if n not in self.tables:
            zeros = bytes(n)
            bits = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros) for k in range(32)]
            out = np.zeros((4, 256), np.uint32)
            for k, image in enumerate(bits):
                out[k // 8, (np.arange(256) >> k % 8) & 1 == 1] ^= np.uint32(image)
            self.tables[n] = out
        return self.tables[n]

    def __call__(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = second.copy()
        by = np.argsort(length, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else ():
            table, crc = self._table(int(length[part[0]])), first[part]
            for byte in range(4):
                out[part] ^= table[byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
        return out


def text_features(texts: pa.Array, buckets: int, join: CrcJoin) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, text and bucket of every feature: words, then word pairs)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=_BREAK)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(full), rows.filter(full).to_numpy().astype(np.int64)
    n_words = np.bincount(rows, minlength=len(texts))
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(known))
    size = np.fromiter(map(len, known), np.int64, len(known))
    inside = np.flatnonzero(rows[1:] == rows[:-1])
    pairs, where = np.unique(at[inside] * len(known) + at[inside + 1], return_inverse=True)
    left, right = np.divmod(pairs, max(1, len(known)))
    pair_crc = join(spaced[left], crc[right], size[right])
    bucket = np.concatenate(((crc % np.uint32(buckets))[at], (pair_crc % np.uint32(buckets))[where.reshape(-1)])).astype(np.int64)
    return n_words, np.concatenate((rows, rows[inside])), bucket


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; at most ``buckets`` rows reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, total = CrcJoin(), np.zeros(buckets, np.int64)
        for part in A.string_slices(batches, "text", SLICE_BYTES):
            total += np.bincount(text_features(part.column("text"), buckets, join)[2], minlength=buckets)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = texts.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and the raw corpus's smoothed bucket shares, rounded down."""
    S, T_, b = int(raw.sum()), int(target.sum()), len(raw)
    ratio = ((t + 1) * (S + b) / ((s + 1) * (T_ + b)) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def feature_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc``, ``n_words``, ``n_features`` and ``weight`` (mean gain of the features, rounded down; none: 0)."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = CrcJoin()
        for part in A.string_slices(batches, "text", SLICE_BYTES):
            n_words, rows, bucket = text_features(part.column("text"), len(gains), join)
            n = np.bincount(rows, minlength=part.num_rows)
            by = np.argsort(rows, kind="stable")
            total = np.zeros(part.num_rows, np.int64)
            some = n > 0
            total[some] = np.add.reduceat(gains[bucket[by]], (np.cumsum(n) - n)[some]) if len(by) else 0
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             ["doc", "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField("doc", kept.schema)] + [T.StructField(k, T.LongType()) for k in ("n_words", "n_features", "weight")])
    return docs.select(packed(kept).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(weigh, schema)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = DRAW_PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all), ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    One row per input row. The ``percent`` of all rows with at least
    ``min_words`` words that score highest are drawn and get the ranks 1, 2,
    3...; the rest have a null rank. Equal scores go by key, a null key last;
    its noise is that of the key 'null'. Rows with equal keys share their
    noise and are ranked apart, by weight. A null text has no words. An empty
    target weighs every bucket alike up to smoothing; an empty table gives no
    rows. ``keep`` must hold the key.
    """
    ship_package(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    weighed = feature_weights(docs, gains, text, keep)
    id_text = F.coalesce(F.col(f"doc.`{key}`").cast("string"), F.lit("null"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")), "importance-scores")
    able = F.col("n_words") >= min_words
    draw = scored.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col(f"doc.`{key}`").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = global_index(scored.filter(able), order, "importance-ranks").withColumn("rank", F.when(F.col("idx") < draw, F.col("idx") + 1)).drop("idx")
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
