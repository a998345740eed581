"""Benchmark decontamination with an FM-index per shard of texts.

A task cuts its texts into shards of bounded size and indexes each: word
codes, suffix order, Burrows-Wheeler transform, a wavelet matrix for rank
queries and sampled suffix positions. All test phrases are searched
backward at once; the occurrences found are located by walking to the next
sampled suffix, and merged to removal spans of each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import body, packed
from tessera.session import cut_lineage, ship_package

# Production parameters.
WINDOW_WORDS = 10
SHARD_BYTES = 3 << 19
SAMPLE = 16
#: Benchmark text searched at a time; larger benchmarks go through the shards in blocks.
BLOCK_BYTES = 32 << 20


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Suffix array of ``ids`` (positive, the last one the only 0) by prefix doubling.

    Starts from the order of the first three ids and afterwards sorts only
    suffixes that are still tied.
    """
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length())
    take = max(1, 63 // bits)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([ids, np.zeros(take, ids.dtype)]).astype(np.uint64)
    for k in range(take):
        key = (key << np.uint64(bits)) | padded[k:k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # first place of the group
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    # places whose group has more than one suffix
    tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    step = take
    while len(tied):
        at = order[tied]
        own, ahead = rank[at], rank[np.minimum(at + step, n)]
        by = np.argsort((own << np.int64(32)) | (ahead + 1), kind="stable")
        at, own, ahead = at[by], own[by], ahead[by]
        order[tied] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])))
        place = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = place
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
        step *= 2
    return order


class FmIndex:
    """FM-index of an integer text: wavelet-matrix ranks over its transform, and sampled suffix positions."""

    def __init__(self, ids: np.ndarray, sample: int = SAMPLE):
        self.n, self.sample = len(ids), sample
        order = suffix_order(ids)
        transform = ids[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(ids))))  # smaller symbols in the text
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = transform
        for bit in range(max(1, int(ids.max()).bit_length()) - 1, -1, -1):
            ones = ((row >> bit) & 1).astype(bool)
            counts = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            self.levels.append((bit, counts, self.n - int(counts[-1])))
            row = np.concatenate((row[~ones], row[ones]))
        marked = order % sample == 0
        self.marks = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
        self.sampled = order[marked]

    def ranks(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(place), place
        for bit, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = counts[low], counts[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def step_back(self, place: np.ndarray) -> np.ndarray:
        """The place of the suffix that starts one earlier (reads the transform's symbol on the way)."""
        low, at, symbol = np.zeros_like(place), place, np.zeros_like(place)
        for _, counts, zeros in self.levels:
            one = counts[at + 1] > counts[at]
            a, b = counts[low], counts[at]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
            symbol = (symbol << 1) | one
        return self.before[symbol] + at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of ``phrases`` (right-aligned ids; -1: not in the text): ranges of suffixes."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live, width = np.arange(len(phrases)), phrases.shape[1]
        for k in range(width):
            live = live[lengths[live] > k] if k else live
            if not len(live):
                break
            symbol = phrases[live, width - 1 - k]
            known = symbol >= 0
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.ranks(symbol, low[live])
            high[live] = self.before[symbol] + self.ranks(symbol, high[live])
            live = live[high[live] > low[live]]
        high[high < low] = low[high < low]
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffix places."""
        place, out = place.copy(), np.zeros(len(place), np.int64)
        left, steps = np.arange(len(place)), 0
        while len(left):
            at = place[left]
            marked = self.marks[at + 1] > self.marks[at]
            done = left[marked]
            out[done] = self.sampled[self.marks[place[done]]] + steps
            left = left[~marked]
            place[left] = self.step_back(place[left])
            steps += 1
        return out


class Phrases:
    """The distinct windows of benchmark items, as word codes right-aligned in rows, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS):
        data, starts = A.joined([x for _, x in items])
        at, _, codes = A.words(data, A.ALNUM)
        first = A.by_text(at, starts)
        rows: dict[bytes, set[int]] = {}
        self.names = [x for x, _ in items]
        for k in range(len(items)):
            own = codes[first[k]:first[k + 1]]
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                rows.setdefault(own[i:i + window].tobytes(), set()).add(k)
        self.lengths = np.array([len(x) // 8 for x in rows], np.int64)
        self.codes = np.zeros((len(rows), window), np.uint64)
        for r, x in enumerate(rows):
            self.codes[r, window - len(x) // 8:] = np.frombuffer(x, np.uint64)
        self.items = list(rows.values())
        self.used = np.arange(window)[None, :] >= window - self.lengths[:, None]


def shard_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts, ends and each text's first word, and (first word, phrase) of every occurrence."""
    data, starts = A.joined(texts)
    at, stop, codes = A.words(data, A.ALNUM)
    first = A.by_text(at, starts)
    none = np.zeros(0, np.int64)
    if not len(codes) or not len(phrases.lengths):
        return at, stop, first, none, none
    known, ids = np.unique(codes, return_inverse=True)
    # symbols: 0 ends the shard, 1 ends a text, words follow
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.arange(len(codes)) + text_of
    symbols = np.ones(len(codes) + len(texts) + 1, np.int64)
    symbols[place] = ids + 2
    symbols[-1] = 0
    where = np.searchsorted(known, phrases.codes)
    where[where == len(known)] = 0
    rows = np.where(phrases.used & (known[where] == phrases.codes), where + 2, -1)
    index = FmIndex(symbols)
    low, high = index.search(rows, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = index.locate(np.repeat(low, count) + within)
    word = np.searchsorted(place, found)
    return at, stop, first, word, phrase


HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                    T.StructField("items", T.ArrayType(T.StringType())),
                    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def hits(texts: list[bytes], phrases: Phrases) -> list[dict]:
    """For each text: words, words hit, items, and removal spans (byte offsets, merged)."""
    at, stop, first, word, phrase = shard_hits(texts, phrases)
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
    out = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in np.diff(first)]
    owner = np.searchsorted(first, word, "right") - 1
    items: dict[int, set[int]] = {}
    for t, p in np.unique(np.stack([owner, phrase], 1), axis=0) if len(word) else ():
        items.setdefault(int(t), set()).update(phrases.items[p])
    for t in np.flatnonzero(n_hit):
        own = hit[first[t]:first[t + 1]]
        edges = np.flatnonzero(np.diff(own, prepend=False, append=False)) + first[t]
        spans = [{"start": int(at[a] - offsets[t]), "end": int(stop[b - 1] - offsets[t])} for a, b in zip(edges[::2], edges[1::2])]
        out[t] |= {"n_hit": int(n_hit[t]), "items": sorted({phrases.names[k] for k in items[int(t)]}), "spans": spans}
    return out


def merged(a: dict | None, b: dict, text: bytes) -> dict:
    """Union of two results for the same text."""
    if a is None or not a["spans"]:
        return b
    if not b["spans"]:
        return a
    spans: list[dict] = []
    for s in sorted(a["spans"] + b["spans"], key=lambda s: (s["start"], s["end"])):
        if spans and (s["start"] <= spans[-1]["end"] or not _n_words(text[spans[-1]["end"]:s["start"]])):
            spans[-1]["end"] = max(spans[-1]["end"], s["end"])
        else:
            spans.append(dict(s))
    return {"n_words": b["n_words"], "n_hit": sum(_n_words(text[s["start"]:s["end"]]) for s in spans),
            "items": sorted({*a["items"], *b["items"]}), "spans": spans}


def _n_words(piece: bytes) -> int:
    return len(A.words(np.frombuffer(piece + b"\n", np.uint8), A.ALNUM)[0])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
                       keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all) and ``hit``: n_words, n_hit, items (sorted as strings),
    spans (bytes of the text).

    Every row of ``docs`` is searched for every window of every item; the
    benchmark is read in blocks of at most about ``block_bytes``, whatever
    its size. Items with equal ids count as one. Null texts and items have no
    words; an item of fewer words than a window is one window. Empty tables
    give no rows or no hits.
    """
    spark = docs.sparkSession
    ship_package(spark)
    queries = benchmark.select(F.col(item).cast("string").alias("name"), body(item_text).alias("body")).filter(F.length("body") > 0)
    size = queries.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    doc, text_field, hit = T.StructField("doc", kept.schema), T.StructField("body", T.BinaryType()), T.StructField("hit", HIT)
    out = docs.select(packed(kept).alias("doc"), body(text).alias("body"), F.lit(None).cast(HIT).alias("hit"))
    for k in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k).collect()
        known = spark.sparkContext.broadcast(Phrases([(r[0] or "", bytes(r[1])) for r in rows], window))

        names = ["doc", "hit"] if k == blocks - 1 else ["doc", "body", "hit"]

        def search(batches: Iterable[pa.RecordBatch], known=known, names=names) -> Iterator[pa.RecordBatch]:
            for part in A.slices(batches, limit=SHARD_BYTES):
                texts = A.bodies(part)
                found = hits(texts, known.value)
                if part.column("hit").null_count < part.num_rows:
                    found = [merged(a, b, x) for a, b, x in zip(part.column("hit").to_pylist(), found, texts)]
                done = part.set_column(part.schema.get_field_index("hit"), "hit", pa.array(found, part.schema.field("hit").type))
                yield done.select(names)

        out = out.mapInArrow(search, T.StructType([f for f in (doc, text_field, hit) if f.name in names]))
    return out


def without_spans(raw: Column, spans: Column) -> Column:
    """The text (bytes ``raw``) with its removal spans cut out, a line feed in place of each."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").cast("binary").alias("out"))
    between = lambda at, end: F.substring(raw, (at + 1).cast("int"), (end - at).cast("int"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], between(a["at"], s["start"]), F.lit("\n").cast("binary")).alias("out"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], between(a["at"], F.octet_length(raw).cast("long")))).cast("string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str | None = None, **options) -> DataFrame:
    """``docs`` with the benchmark windows cut out of its texts; documents with no words left go.

    A cut joins the words around it, so cut texts are searched again until
    nothing is hit; a round takes at least a word from each text it reads, and
    only texts cut in the round before are read again. Clean documents come
    back as they are, also those without words. The column ``length``, if
    named, is set to the new number of characters of a text that was cut.
    """
    done, rest = None, docs
    while True:
        found = cut_lineage(find_contamination(rest, benchmark, text=text, **options), "decontaminated")
        clean = found.filter("hit.n_hit = 0").select("doc.*")
        done = clean if done is None else done.unionByName(clean)
        found = found.filter("hit.n_hit > 0 AND hit.n_hit < hit.n_words")
        if found.isEmpty():
            return done
        found = found.withColumn("cut", without_spans(body(F.col(f"doc.`{text}`")), F.col("hit.spans")))
        new = {text: F.col("cut"), length: F.char_length("cut")}
        rest = found.select(*[new.get(c, F.col(f"doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
