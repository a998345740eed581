"""Spelling variants: exact neighbours at one edit, from a dictionary of trie-node pairs.

The nodes of the trie of all words and of the trie of all reversed words are
numbered. A word is, at each place, a pair of nodes: what stands before it and
what stands after it. Two words that differ by a replaced code point share
the pair around it (the code point skipped); a word with one code point less
has as its pair at some place (nothing skipped) the pair of the longer word
around the deleted code point. So one join on pairs of integers gives exactly
the words at one edit.

Numbering: words are range sorted, and a node belongs to the first word that
passes through it. Each partition is walked once, with the common prefix of
neighbouring words; what adjacent partitions share is passed on by their
border words. Nodes that only one word passes through have no number, since
no pair with them can meet another word.

A pair of nodes is held by at most one word of each replaced code point, so a
group is bounded by the alphabet, however many rows there are. In a group the
best neighbour of each word is the best or the second best word; pairs of
words are never written out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrowtext as A
from tessera.session import cut_lineage, ship_package

# Production parameters.
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_FACTOR = 10
#: An occurrence loses a code point if this divides its checksum.
SLIP = 31
SLICE_BYTES = 4 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000

#: Bits of a number that count inside a partition.
_LOCAL = 40
_RUN = "[a-zÀ-ÿ]"


def occurrences(doc: str, text: str, least: int, slip: int = SLIP) -> Counter:
    """Words of at least ``least`` code points in a text and how often they occur, after the seeded slips."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    # a slip only shortens, so shorter runs cannot count
    for run, n in Counter(re.findall(f"{_RUN}{{{least},}}", text)).items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                slip: int = SLIP) -> DataFrame:
    """(word, n) over all texts, for words with ``min_count`` occurrences."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in A.slices(batches, limit=SLICE_BYTES):
            for doc, body in zip(part.column("id").to_pylist(), A.bodies(part)):
                total.update(occurrences(doc, body.lower().decode("utf-8", "replace"), least, slip))
            if len(total) >= COUNTED:
                yield _counted(total)
                total = Counter()
        if total:
            yield _counted(total)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("body"))
    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def common_prefix(a: str, b: str) -> int:
    """Code points that a and b share at the front, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Walk:
    """Numbers trie nodes along the sorted words of one partition."""

    def __init__(self, part: int, before: str | None, nodes: list[int]):
        """``before``: the last word of an earlier partition, whose nodes are ``nodes`` (by depth, the root first)."""
        self.base, self.used = (part + 1) << _LOCAL, 0
        self.word, self.nodes = before, nodes
        self.shared, self.walked = 0, False

    def step(self, word: str) -> None:
        """Go on to the next word; ``shared`` is its common prefix with the one before."""
        self.shared = common_prefix(self.word, word) if self.word is not None else 0
        if not self.walked:  # the first word's nodes have the same numbers whether an earlier partition shares them or not
            self.used, self.walked = self.shared, True
        new = len(word) - self.shared
        self.nodes = self.nodes[:self.shared + 1] + list(range(self.base + self.used, self.base + self.used + new))
        self.used += new
        self.word = word


def numbered(words: DataFrame, column: str, name: str) -> DataFrame:
    """``words`` with ``rank`` (in the order of ``column``, with gaps) and ``path``: the numbers of the nodes that its prefixes
    of 0, 1, ... code points share with another word. Values of ``column`` are distinct."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in words.columns if c != column]
    placed = words.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    # written, so that every pass sees the same borders, also after an executor is lost
    placed = cut_lineage(placed.select("_part", F.col(column).alias("_word"), F.struct(*others).alias("_rest")), name)
    walked = placed.repartitionById(parts, F.col("_part")).sortWithinPartitions("_word")

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, first = None, None
        for b in batches:
            for part, word in zip(b.column("_part").to_pylist(), b.column("_word").to_pylist()):
                if walk is None:
                    walk, first = Walk(part, None, [0]), word
                walk.step(word)
        if walk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([first]), pa.array([walk.word]), pa.array([walk.nodes], pa.list_(pa.int64()))],
                                             ["part", "first", "last", "nodes"])

    # one row per partition; a node of a border word that an earlier partition has begun keeps its number there
    found = sorted(walked.select("_part", "_word").mapInArrow(borders, "part long, first string, last string, nodes array<long>").collect())
    before: dict[int, tuple] = {}
    after: dict[int, str] = {}
    word, nodes = None, [0]
    for k, r in enumerate(found):
        before[r.part] = (word, nodes)
        if k + 1 < len(found):
            after[r.part] = found[k + 1].first
        kept = min(common_prefix(word, r.first), common_prefix(r.first, r.last)) if word is not None else 0
        word, nodes = r.last, nodes[:kept + 1] + r.nodes[kept + 1:]
    shared = words.sparkSession.sparkContext.broadcast((before, after))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, rank, held = None, 0, None
        for b in batches:
            rows, paths, ranks = [], [], []
            for part, word, rest in zip(b.column("_part").to_pylist(), b.column("_word").to_pylist(), b.column("_rest").to_pylist()):
                if walk is None:
                    walk = Walk(part, *shared.value[0][part])
                    rank = part << _LOCAL
                walk.step(word)
                if held is not None:
                    rows.append(held[0])
                    ranks.append(held[1])
                    paths.append(held[2][:max(held[3], walk.shared) + 1])
                held = ((word, rest), rank, walk.nodes, walk.shared)
                rank += 1
            rest_arrow = b.schema.field("_rest").type
            if rows:
                yield _paths(rows, ranks, paths, rest_arrow)
        if held is not None:
            following = shared.value[1].get(part)
            depth = max(held[3], common_prefix(walk.word, following) if following is not None else 0)
            yield _paths([held[0]], [held[1]], [held[2][:depth + 1]], rest_arrow)

    rest_type = placed.schema["_rest"].dataType.simpleString()
    out = walked.mapInArrow(number, f"_word string, _rest {rest_type}, rank long, path array<long>")
    return out.select(F.col("_word").alias(column), "_rest.*", "rank", "path")


def _paths(rows: list[tuple], ranks: list[int], paths: list[list[int]], rest_type: pa.DataType) -> pa.RecordBatch:
    words, rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(rest, rest_type), pa.array(ranks, pa.int64()),
                                       pa.array(paths, pa.list_(pa.int64()))], ["_word", "_rest", "rank", "path"])


def node_pairs(words: DataFrame) -> DataFrame:
    """(before, after, skipped, last, rank, n): every pair of numbered nodes of each word.

    ``skipped``: one code point stands between them. ``last``: it is the last
    of a run of equal ones, so that a word is shortened in one way only.
    """

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for word, n, rank, front, back in zip(*(b.column(c).to_pylist() for c in ("word", "n", "rank", "path", "back"))):
                front, back, size = np.array(front, np.int64), np.array(back, np.int64), len(word)
                for skip in (1, 0):
                    first, last = max(0, size - skip - len(back) + 1), min(len(front) - 1, size - skip)
                    if first > last:
                        continue
                    place = np.arange(first, last + 1)
                    ends = np.array([not skip or p + 1 == size or word[p] != word[p + 1] for p in range(first, last + 1)], bool)
                    for column, values in zip(out, (front[place], back[size - skip - place], np.full(len(place), bool(skip)), ends,
                                                    np.full(len(place), rank), np.full(len(place), n))):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["before", "after", "skipped", "last", "rank", "n"])

    return words.mapInArrow(pairs, "before long, after long, skipped boolean, last boolean, rank long, n long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are at one edit, and (n, -rank) of the most frequent of them, the smallest first."""
    member = F.struct("n", (-F.col("rank")).alias("low"), "skipped", "last")
    groups = pairs.groupBy("before", "after").agg(F.sort_array(F.collect_list(member), asc=False).alias("all")).filter(F.size("all") > 1)
    # words with the code point replaced, those of them that a deletion here shortens, and the shortened word
    replaced = F.filter("all", lambda m: m["skipped"])
    groups = groups.select(replaced.alias("replaced"), F.filter("all", lambda m: m["skipped"] & m["last"]).alias("longer"),
                           F.filter("all", lambda m: ~m["skipped"]).alias("shorter"), F.explode("all").alias("own"))
    own = F.col("own")
    others = F.filter(F.array(F.get("replaced", F.lit(0)), F.get("replaced", F.lit(1))), lambda m: m["low"] != own["low"])
    near = (F.when(~own["skipped"], F.col("longer"))
            .when(own["last"], F.concat(others, F.col("shorter"))).otherwise(others))
    count = (F.when(~own["skipped"], F.size("longer"))
             .otherwise(F.size("replaced") - 1 + F.when(own["last"], F.size("shorter")).otherwise(0)))
    best = F.array_max(F.transform(near, lambda m: F.struct(m["n"].alias("n"), m["low"].alias("low"))))
    rows = groups.select((-own["low"]).alias("rank"), count.cast("long").alias("count"), best.alias("best"))
    return rows.groupBy("rank").agg(F.sum("count").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(rank, root): the end of each chain of forms (rank, form), by doubling; chains have at most ``hops`` links."""
    out = forms.select("rank", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, hops))))):
        on = out.select(F.col("rank").alias("_at"), F.col("root").alias("_next"))
        out = out.join(on, F.col("root") == F.col("_at"), "left").select("rank", F.coalesce("_next", "root").alias("root"))
        out = cut_lineage(out, "spelling-roots")
    return out


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      factor: int = FORM_FACTOR, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of all texts.

    ``form``: the most frequent word at one edit (ties: the smallest), if it
    occurs ``factor`` times as often; ``root``: the end of the chain of forms.
    Null texts have no words and a null id counts as 'null'; repeated rows
    count each time; an empty table or one without repeated words gives no
    rows. Words may be of any length.
    """
    ship_package(docs.sparkSession)
    words = cut_lineage(word_counts(docs, key, text, least, min_count, slip), "spelling-words")
    front = cut_lineage(numbered(words, "word", "spelling-front"), "spelling-words-numbered")
    reverse = numbered(front.select(F.reverse("word").alias("turned"), F.col("rank").alias("own")), "turned", "spelling-back")
    both = front.join(reverse.select(F.col("own").alias("rank"), F.col("path").alias("back")), "rank")
    found = cut_lineage(neighbours(node_pairs(both)), "spelling-neighbours")
    rows = front.select("rank", "word", "n").join(found, "rank", "left")
    has_form = F.col("best.n") >= factor * F.col("n")
    rows = rows.withColumn("form_rank", F.when(has_form, -F.col("best.low"))).withColumn("form_n", F.when(has_form, F.col("best.n")))
    rows = cut_lineage(rows.drop("best"), "spelling-forms")
    # each form is at least ``factor`` times as frequent, so chains are short
    most = rows.agg(F.max("n")).first()[0] or 1
    variants = rows.filter("form_rank is not null").select("rank", F.col("form_rank").alias("form"))
    ends = roots(variants, int(math.log(most) / math.log(factor)) + 1)
    name = lambda c: front.select(F.col("rank").alias(f"{c}_rank"), F.col("word").alias(c))
    named = (variants.join(ends, "rank").toDF("rank", "form_rank", "root_rank").join(name("form"), "form_rank")
             .join(name("root"), "root_rank").select("rank", "form", "root"))
    return (rows.join(named, "rank", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
