"""Quality rules: base counts and a hashed n-gram log-likelihood ratio for every document.

Word unigrams and bigrams are hashed into ``BUCKETS``. The trusted target
(documents labelled good) and the raw corpus (all documents) each give a
multinomial over the buckets, counted over whole texts with one partial
count per task. A document's score is its mean log ratio per n-gram; it is
kept if the score reaches ``THRESHOLD`` and no base rule fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import body, lookup_join, packed
from tessera.session import ship_package

# Production parameters.
BUCKETS = 1 << 16
THRESHOLD = -0.1
#: Pseudo-count of a bucket in the raw corpus; the target gets its proportion, so an unseen n-gram scores 0.
SMOOTHING = 20.0
#: Share of the raw n-grams below which the target's pseudo-count falls no further: what a small trusted sample misses by chance scores near 0.
SMOOTHED_SHARE = 1 / 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Trusted ids are broadcast up to this many rows, and joined by a shuffle beyond.
TRUSTED_BROADCAST_ROWS = 5_000_000

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CHAR_IN_WORD = A.SPACED_WORD & ((np.arange(256) & 0xC0) != 0x80)

STATS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
         ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]


def _buckets(codes: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram bucket and bigram bucket at each word, and whether a bigram starts there (``first``: texts' first words)."""
    one = (codes & np.uint64(buckets - 1)).astype(np.int64)
    two = np.zeros(len(codes), np.int64)
    two[:-1] = (A.run_codes(codes, 2) & np.uint64(buckets - 1)).astype(np.int64)
    inside = np.ones(len(codes), bool)
    inside[first[1:][first[1:] > 0] - 1] = False
    return one, two, inside


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target) over all rows of ``texts`` (body, trusted); empty buckets left out."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in A.slices(batches):
            data, starts = A.joined(A.bodies(part))
            at, _, codes = A.words(data, A.SPACED)
            if not len(codes):
                continue
            first = A.by_text(at, starts)
            one, two, inside = _buckets(codes, first, buckets)
            raw += np.bincount(one, minlength=buckets) + np.bincount(two[inside], minlength=buckets)
            trusted = np.repeat(np.array(part.column("trusted").to_pylist(), bool), np.diff(first))
            target += np.bincount(one[trusted], minlength=buckets) + np.bincount(two[inside & trusted], minlength=buckets)
        used = np.flatnonzero(raw)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    parts = texts.select("body", "trusted").mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Smoothed log(target share / raw share) of every bucket (collects at most ``buckets`` rows).

    The pseudo-counts follow the raw multinomial's size and the target's in
    the same proportion. A target under ``SMOOTHED_SHARE`` of the raw n-grams
    keeps the pseudo-count it has at that share, so few labels give ratios
    nearer to 0, not lower ones. Zeros without a target.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(buckets)
    part = target.sum() / raw.sum()
    smoothing *= max(1.0, SMOOTHED_SHARE / part)
    return np.log((target + smoothing * part) / part) - np.log(raw + smoothing)


def text_stats(part: list[bytes], ratios: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The columns STATS for a list of texts."""
    data, starts = A.joined(part)
    at, _, codes = A.words(data, A.SPACED)
    first, n = A.by_text(at, starts), len(part)
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[first])
    per_byte = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[starts])
    n_words = np.diff(first)
    repeat = np.zeros(len(codes), bool)
    if len(codes) > 2:
        owner = np.repeat(np.arange(n), n_words)
        threes = np.flatnonzero(owner[:-2] == owner[2:])
        key = A.mix64(A.run_codes(codes, 3)[threes] ^ A.mix64(owner[threes].astype(np.uint64) + np.uint64(1)))
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        found = threes[count[where] > 1]
        for k in range(3):
            repeat[found + k] = True
    duplicates = np.zeros(n, np.int64)
    for k, text in enumerate(part):
        lines = [x for x in text.split(b"\n") if x.strip()]
        duplicates[k] = len(lines) - len(set(lines))
    score = np.full(n, np.nan)
    if len(codes):
        one, two, inside = _buckets(codes, first, len(ratios))
        some = n_words > 0
        total = np.add.reduceat(ratios[one] + np.where(inside, ratios[two], 0.0), first[:-1][some])
        score[some] = total / (2 * n_words[some] - 1)
    n_repeat = per_text(repeat)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return [n_words, per_byte(_CHAR_IN_WORD[data]), per_byte(_SYMBOL[data]), duplicates, n_repeat, failed, score,
            ~failed & (score >= threshold)]


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all) and ``quality`` (struct of STATS), one per input row, in no order.

    Trusted: ids with a label row of quality 1 (repeated label rows count
    once). Null text: no words, so the base rules fail; ``score`` is null
    without words. An empty table gives no rows. Without any trusted text all
    ratios are 0 and only the base rules decide.
    """
    ship_package(docs.sparkSession)
    trusted = labels.filter("quality = 1").select(F.col(key).alias("_id")).distinct()
    rows = docs.select(F.col(key).alias("_key"), body(text).alias("body"))
    flagged = lookup_join(rows, trusted, F.col("_key") == F.col("_id"), "left", TRUSTED_BROADCAST_ROWS)
    counts = ngram_counts(flagged.select("body", F.col("_id").isNotNull().alias("trusted")), buckets)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(counts, buckets))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in A.slices(batches):
            columns = text_stats(A.bodies(part), ratios.value, threshold)
            arrays = [pa.array(x, from_pandas=True) for x in columns]
            stats = pa.StructArray.from_arrays(arrays, [k for k, _ in STATS])
            yield pa.RecordBatch.from_arrays([part.column("doc"), stats], ["doc", "quality"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    doc = packed(kept).alias("doc")
    schema = T.StructType([T.StructField("doc", kept.schema), T.StructField("quality", T.StructType([T.StructField(k, t) for k, t in STATS]))])
    return docs.select(doc, body(text).alias("body")).mapInArrow(score, schema)
