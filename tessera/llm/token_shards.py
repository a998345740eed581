"""Training-order materialisation: token sequences at the slots of a keyed permutation, in fixed-stride shards.

Documents are sorted by key, tokenized and cut into sequences of fixed
length. The sequences are numbered in that order, a keyed Feistel network
with cycle-walking permutes the numbers, and the sequences are range
partitioned by their slot. A shard is a run of slots; every slot takes the
same number of bytes, so a reader finds any slot by its place and resumes
where it stopped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import body
from tessera.session import scratch_path, ship_package

# Production parameters.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEQUENCE = 512
SHARD_SLOTS = 1 << 16
#: Sequences that a reader takes at once.
SEGMENT_SLOTS = 1 << 12
ROUNDS = 6
#: Text encoded at a time; the larger, the fewer segments are encoded twice.
SLICE_BYTES = 8 << 20
TOKEN = np.dtype("<u2")

#: White space that is not ASCII; texts with it are encoded whole.
_OTHER_WHITE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Token ids of byte texts. Distinct space-led segments of a slice are encoded once and copied to all places.

    A segment is a run of ASCII white space and the run of other characters
    after it. The split pattern never crosses from a character to white space
    after it, so the tokens of a text are those of its segments.
    """

    def __init__(self, ranks_text: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        self.end = max(ranks.values()) + 1  # a free id

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), TOKEN)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        odd = {}
        if _OTHER_WHITE.search(b"\n".join(texts)):
            odd = {k: self.whole(t) for k, t in enumerate(texts) if _OTHER_WHITE.search(t)}
        texts = [b"" if k in odd else t for k, t in enumerate(texts)]
        data, starts = A.joined(texts)
        at, stop, codes = A.words(data, A.SPACED)
        first = A.by_text(at, starts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
        leads = first[:-1][np.diff(first) > 0]  # each text's first word
        begin[leads] = starts[:-1][np.diff(first) > 0]
        space = at - begin
        lead = np.where(space == 1, data[begin], 0).astype(np.uint64)
        for k in np.flatnonzero(space > 1):
            lead[k] = int.from_bytes(blake2b(data[begin[k]:at[k]].tobytes(), digest_size=8).digest(), "little") | 256
        key = A.mix64(codes ^ A.mix64(lead + np.uint64(1)))
        _, index, where = np.unique(key, return_index=True, return_inverse=True)
        led = space[index] > 0
        ids, n_ids = self._encode(data, begin[index], stop[index], led)
        # tokens of each word's segment, in order, and of white space at the end of a text
        begins = np.cumsum(n_ids) - n_ids
        take, count = begins[where], n_ids[where]
        flat = ids[np.arange(count.sum()) + np.repeat(take - (np.cumsum(count) - count), count)] if len(count) else ids[:0]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, count, len(texts)))))[1:].astype(np.int64) if len(texts) else []
        out, used = [], 0
        for k, cut in enumerate(cuts):
            tokens = flat[used:cut]
            tail = int(stop[first[k + 1] - 1]) if first[k + 1] > first[k] else int(starts[k])
            if tail < starts[k + 1] - 1:
                tokens = np.concatenate([tokens, self.whole(data[tail:starts[k + 1] - 1].tobytes())])
            out.append(odd.get(k, tokens))
            used = cut
        return out

    def _encode(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of segments end to end, and the number of each. Those that begin with white space are encoded in one call."""
        size = stop - begin
        n_ids = np.zeros(len(size), np.int64)
        parts: dict[bool, np.ndarray] = {}
        own = np.flatnonzero(led)
        lengths = size[own]
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - (ends - lengths), lengths)
        parts[True] = self.whole(data[source].tobytes())
        edge = np.searchsorted(np.cumsum(self.sizes[parts[True]]), ends, "left") + 1 if len(ends) else ends
        n_ids[own] = np.diff(edge, prepend=0)
        rest = [self.whole(data[a:b].tobytes()) for a, b in zip(begin[~led], stop[~led])]
        n_ids[~led] = [len(x) for x in rest]
        out = np.empty(int(n_ids.sum()), TOKEN)
        place = np.repeat(led, n_ids)
        out[place] = parts[True]
        out[~place] = np.concatenate(rest) if rest else 0
        return out, n_ids


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walking cycles back inside."""
    if n <= 1:
        return x.copy()
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = A.mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key % (1 << 64)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (A.mix64(right + k) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks_text: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(ranks_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_text)
    return _ENCODERS[key]


def vocabulary_text(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
              length: int = SEQUENCE) -> DataFrame:
    """Sequences of all documents in key order: key, seq, part, place, n_tokens, tokens (16-bit little-endian, unpadded).

    A document's tokens and one end id are cut into runs of ``length``; a
    null or empty text gives the end id alone. Rows with equal keys are
    ordered by a digest of their text, then by the compressed text; the ranges
    are sampled from keys and digests alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary_text(vocabulary))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body(text)).alias("digest"), body(text).alias("body"))

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compressed texts, which halves what the sort moves."""
        press = zstandard.ZstdCompressor(level=1)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("digest"), pa.array([press.compress(t) for t in A.bodies(part)], pa.binary())],
                                             ["key", "digest", "body"])

    rows = rows.mapInArrow(squeeze, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("digest", T.LongType()),
                                                  T.StructField("body", T.BinaryType())]))
    rows = rows.repartitionByRange(parts, "key", "digest").sortWithinPartitions("key", "digest", "body")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, part_id = _encoder(shared.value), 0, TaskContext.get().partitionId()
        end = np.array([encoder.end], TOKEN)
        expand = zstandard.ZstdDecompressor()
        for part in (b.slice(first, last - first) for b in batches
                     for first, last in A.cuts(np.array([zstandard.frame_content_size(t) for t in A.bodies(b)], np.int64), SLICE_BYTES)):
            index, seq, count, tokens = [], [], [], []
            for k, ids in enumerate(encoder.texts([expand.decompress(t) for t in A.bodies(part)])):
                ids = np.concatenate([ids, end])
                for s, i in enumerate(range(0, len(ids), length)):
                    run = ids[i:i + length]
                    index.append(k)
                    seq.append(s)
                    count.append(len(run))
                    tokens.append(run.tobytes())
            n = len(index)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(index, pa.int64())), pa.array(seq, pa.int64()), pa.array([part_id] * n, pa.int32()),
                 pa.array(range(place, place + n), pa.int64()), pa.array(count, pa.int32()), pa.array(tokens, pa.binary())],
                ["key", "seq", "part", "place", "n_tokens", "tokens"])
            place += n

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("seq", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
                           T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    return rows.mapInArrow(encode, schema)


def training_order(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                   length: int = SEQUENCE, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """Rows slot, shard, offset, key, seq, n_tokens, payload; sorted by slot within partitions of whole segments.

    ``payload`` has ``2 * length`` bytes, padded with the end id;
    ``offset`` is its byte position in its shard. Slots are gapless from 0.
    An empty table gives no rows. The tokenized sequences are written to the
    shared folder once; the numbering and the payloads come from there, so a
    lost executor changes neither.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-sequences")
    tokenized(docs, key, text, vocabulary, length).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    # one row per partition of the tokenized table
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    ordered = sorted(counts)
    offsets = np.zeros(ordered[-1] + 1 if ordered else 1, np.int64)
    offsets[ordered] = np.cumsum([counts[p] for p in ordered]) - [counts[p] for p in ordered] if ordered else 0
    end = _encoder(vocabulary_text(vocabulary)).end

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = offsets[b.column("part").to_numpy()] + b.column("place").to_numpy()
            slot = feistel(index, total, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array((slot // shard_slots).astype(np.int32)), pa.array(slot % shard_slots * (2 * length)),
                 b.column("key"), b.column("seq"), b.column("n_tokens"), b.column("tokens")],
                ["slot", "shard", "offset", "key", "seq", "n_tokens", "tokens"])

    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("offset", T.LongType()), T.StructField("key", docs.schema[key].dataType),
                           T.StructField("seq", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # slots are a permutation, so equal ranges of them hold equal numbers of rows and need no sample
    segment = segment_slots(shard_slots)
    share = max(1, -(-total // (parts * segment))) * segment
    placed = rows.mapInArrow(place, schema).repartitionById(parts, (F.col("slot") / share).cast("int")).sortWithinPartitions("slot")
    pad = F.unhex(F.lit(int(end).to_bytes(2, "little").hex() * length))
    payload = F.substring(F.concat(F.col("tokens"), pad), 1, 2 * length)
    return placed.withColumn("payload", payload).drop("tokens")


def segment_slots(shard_slots: int = SHARD_SLOTS) -> int:
    """Slots of a segment: the largest divisor of a shard's slots up to ``SEGMENT_SLOTS``."""
    return next(n for n in range(min(SEGMENT_SLOTS, shard_slots), 0, -1) if shard_slots % n == 0)


def write_shards(ordered: DataFrame, path: str, shard_slots: int = SHARD_SLOTS) -> None:
    """Write rows of ``training_order`` as fixed-stride binary segments: one folder per shard, columns segment, n_slots and data.

    A shard's segments, end to end, are its bytes: the sequence of a slot
    stands at its ``offset``, inside segment ``slot % shard_slots //
    segment_slots(shard_slots)``. Raises if a partition does not hold whole
    segments in slot order.
    """
    segment = segment_slots(shard_slots)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        first = None
        for b in batches:
            for slot, payload in zip(b.column("slot").to_pylist(), b.column("payload").to_pylist()):
                if held and slot % segment == 0:
                    yield packed(first, held)
                    held = []
                if not held:
                    first = slot
                if slot != first + len(held) or first % segment:
                    raise ValueError(f"slot {slot} is out of order")
                held.append(payload)
        if held:
            yield packed(first, held)

    def packed(first: int, held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([first // shard_slots], pa.int64()), pa.array([first % shard_slots // segment], pa.int64()),
                                           pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["shard", "segment", "n_slots", "data"])

    rows = ordered.select("slot", "payload").mapInArrow(pack, "shard long, segment long, n_slots long, data binary")
    rows.write.partitionBy("shard").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, payload) from ``slot`` on, sorted within partitions: opens the shards and segments from that slot's on, and goes to its byte."""
    segment = segment_slots(shard_slots)
    shard, part = slot // shard_slots, slot % shard_slots // segment
    here = (F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("segment") >= part))

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first, stride = r["shard"] * shard_slots + r["segment"] * segment, len(r["data"]) // r["n_slots"]
                skip = max(0, slot - first)
                yield pa.RecordBatch.from_arrays([pa.array(range(first + skip, first + r["n_slots"]), pa.int64()),
                                                  pa.array([r["data"][i:i + stride] for i in range(skip * stride, len(r["data"]), stride)], pa.binary())],
                                                 ["slot", "payload"])

    rows = spark.read.schema("segment long, n_slots long, data binary, shard long").parquet(path).filter(F.col("shard") >= shard).filter(here)
    return rows.sortWithinPartitions("shard", "segment").mapInArrow(unpack, "slot long, payload binary")
