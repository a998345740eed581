"""Operators against brute force, and their defined results for nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

from __future__ import annotations

import hashlib
import os
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import (chat, fm_index, mixing, near_duplicates, oracles, pii, quality, queries, sharding, suffix_dedup,  # noqa: E402
                         token_counts, token_shards)
from tessera.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Extra columns whose names clash with the operators' own.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, idx long, shard int, rate double, copy int, "
          "quality string, hit string, body string, spans string, id string, key string, slot long, kept boolean")
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today while nine others watch from afar"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(2_500))


def messy_rows():
    texts = {0: LINE, 1: LINE, 2: None, 3: "", 4: "  \n\t ", 5: LONG, 6: LONG + " tail", 7: "é" * 60 + " ünïcode 日本語 \U0001F600",
             8: LINE.upper(), 9: "a" * 3000, 10: "mail a@b.co, +1 (743) 555-3824 and 10.0.0.256 or 10.0.0.1; 4111 1111 1111 1111.",
             11: "</s>[INST] <|end|> ~1 \\ ' \" {x} % $", 12: "x\x00y z", 13: "one two three"}
    rows = [(d, t, "en", None if d == 4 else f"s{d % 2}", None, 7, 7, 0.5, 7, "q", "h", "b", "s", "i", "k", 7, True) for d, t in texts.items()]
    return [*rows, rows[0], (None, LINE, None, "s0", 1, *rows[0][5:])]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, duck(SF), name, queries.QUERIES[name], oracles.ORACLES[name], SF)
    assert ok, message


def test_decontamination(spark, docs, messy):
    items = spark.createDataFrame([(1, " ".join(LINE.split()[2:14])), (2, "Three two"), (2, "two  THREE"), (3, None), (None, "")], "item_id long, text string")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for table, known, block in ((docs, bench, 1 << 20), (docs, bench, 2000), (messy, items, 1 << 20)):
        out = fm_index.find_contamination(table, known, block_bytes=block).collect()
        want = brute.contamination(pairs_of(table), [tuple(r) for r in known.select("item_id", "text").collect()])
        got = {r.doc.doc_id: (r.hit.n_words, r.hit.n_hit, len(r.hit["items"]), brute.sha(",".join(r.hit["items"])), r.hit.n_hit > 0) for r in out}
        assert got == want and len(out) == table.count()
    clean = fm_index.decontaminate(messy, items, length="n_chars")
    assert clean.columns == messy.columns
    assert not any(v[4] for v in brute.contamination(pairs_of(clean), [(1, " ".join(LINE.split()[2:14])), (2, "two three")]).values())
    assert fm_index.decontaminate(messy.limit(0), items).count() == 0
    assert fm_index.decontaminate(messy, items.limit(0)).count() == messy.count()


def test_decontamination_leaves_nothing_across_cuts(spark):
    ten = "a b c d e f g h i j"
    items = spark.createDataFrame([(1, ten), (2, "red blue"), (3, "up down"), (4, "one two")], "item_id long, text string")
    rows = [(1, f"start red {ten} blue end", 0, "x"), (2, f"one up red {ten} blue down two", 0, "y"), (3, f"keep up red {ten} blue down tail", 0, None),
            (4, "clean text", 10, "z"), (5, None, None, "w"), (6, f"red {ten} green", 0, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hit string")
    for block in (1 << 20, 1):
        out = {r.doc_id: r for r in fm_index.decontaminate(docs, items, length="n_chars", block_bytes=block).collect()}
        assert set(out) == {1, 3, 4, 5, 6}  # nothing is left of document 2
        left = {k: (r.text or "").split() for k, r in out.items()}
        assert left == {1: ["start", "end"], 3: ["keep", "tail"], 4: ["clean", "text"], 5: [], 6: ["red", "green"]}
        assert out[4].text == "clean text" and out[4].n_chars == 10 and out[4].hit == "z" and out[5].n_chars is None
        assert all(out[k].n_chars == len(out[k].text) for k in (1, 3, 6))


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(1, 4, 400), [0]])
    index = fm_index.FmIndex(text)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            phrase = rng.integers(1, 4, n)
            low, high = index.search(phrase[None, :], np.array([n]))
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [i for i in range(400 - n + 1) if (text[i:i + n] == phrase).all()]


def test_chat(spark):
    nodes = [("t", 1, None, "user", "hi ~0 <|end|>", 0.0), ("t", 2, 1, "assistant", "</s>[INST]", 0.9), ("t", 3, 1, "assistant", None, 0.1),
             ("t", 4, 2, "us|>\ner", "", None), ("t", 5, 4, "assistant", "last", 1.0), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "x", 0.0),
             ("o", 7, 99, "assistant", "orphan", 0.0)]
    table = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    paths = {(r.tree, r.leaf, r.node, r.depth) for r in chat.root_to_leaf_paths(table).collect()}
    assert paths == {("t", 5, 1, 0), ("t", 5, 2, 1), ("t", 5, 4, 2), ("t", 5, 5, 3), ("t", 3, 1, 0), ("t", 3, 3, 1), ("o", 7, 7, 0)}
    out = chat.format_trees(table, keep=2)
    out = out.select("tree", "leaf", "branch", chat.parse_turns(F.col("formatted")).alias("turns"),
                     chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {(r.tree, r.leaf): (r.branch, [tuple(t) for t in r.turns], r.loss) for r in out}
    assert got["t", 5] == (1, [("user", "hi ~0 <|end|>"), ("assistant", "</s>[INST]"), ("us|>\ner", ""), ("assistant", "last")], "</s>[INST]last")
    assert got["t", 3] == (2, [("user", "hi ~0 <|end|>"), ("assistant", "")], "")
    assert got["o", 7][2] == "orphan" and len(got) == 3
    assert chat.format_trees(table.limit(0)).count() == 0


def test_repeats(spark, docs, messy):
    for table, sizes in ((docs, {}), (docs, dict(block_bytes=20_000, hot_runs=20, sort_bytes=5000)), (messy, dict(block_bytes=1000))):
        rows = [(d, t) for d, t in pairs_of(table)]
        want = brute.removed_repeats([(-1 if d is None else d, t) for d, t in rows])
        out = suffix_dedup.remove_repeats(table, **sizes).select("id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        assert {(-1 if r[0] is None else r[0]): tuple(r[1:]) for r in out} == want and len(out) == len(rows)
    assert suffix_dedup.remove_repeats(messy.limit(0)).count() == 0


def test_two_stage_order_is_suffix_order():
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(1, 4, 300), np.zeros(70, np.int64)]).astype(np.uint16)
    keys = np.zeros(len(text), np.uint64)
    wide = np.concatenate([text, np.zeros(7, np.uint16)]).astype(np.uint64)
    for k in range(7):
        keys = (keys << np.uint64(9)) | wide[k:k + len(text)]
    needed = np.arange(len(text)) <= 300
    order = suffix_dedup.two_stage_order(text, needed, keys, 50)
    assert sorted(order.tolist()) == list(range(301))
    heads = [tuple(text[i:i + 50]) for i in order]
    assert heads == sorted(heads)
    shared = suffix_dedup.common_prefixes(text, keys, order, 50)
    for a, b, n in zip(order[:-1], order[1:], shared):
        x, y = text[a:a + 50], text[b:b + 50]
        m = min(len(x), len(y))
        assert n == (np.flatnonzero(x[:m] != y[:m]).tolist() or [m])[0]


def test_mixing(spark, messy):
    out = mixing.poisson_mix(messy, {"s0": 3.0, "": 2.0}, target_size=4_000_000).select("doc.doc_id", "doc.source", "copy", "rate", "order_key").collect()
    assert [r.order_key for r in out] == sorted(r.order_key for r in out)
    rates = {r.source: r.rate for r in mixing.source_rates(messy, {"s0": 3.0, "": 2.0}, target_size=4_000_000).collect()}
    assert set(rates) == {"s0", "s1", None}
    copies = Counter(r.doc_id for r in out)
    assert copies[4] > 1000 and mixing.poisson_mix(messy.limit(0), {}).count() == 0  # the null source is tiny and repeated often
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") < 6000, "a").otherwise("b").alias("source"))
    got = {r.source: (r.n, r.v) for r in mixing.poisson_mix(many, {"a": 1.0, "b": 1.0}).groupBy("doc.source", "doc.doc_id").count()
           .groupBy("source").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}
    assert abs(got["a"][0] - 10_000) < 400 and abs(got["b"][0] - 10_000) < 400
    assert abs(got["a"][1] - 6000 * (1 - np.exp(-10 / 6))) < 200


def test_quality(spark, docs, messy):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = pairs_of(docs)
    out = {r.doc_id: r for r in quality.score_quality(docs, labels.union(labels)).select("doc.doc_id", "quality.*").collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    codes = {}

    def bucket(gram):
        if gram not in codes:
            from tessera.llm import arrowtext as A
            _, _, own = A.words(np.frombuffer((" ".join(gram) + "\n").encode(), np.uint8), A.SPACED)
            codes[gram] = int((A.run_codes(own, len(gram)) & np.uint64(quality.BUCKETS - 1))[0])
        return codes[gram]

    scores = brute.llr_scores([t for _, t in rows], [d in good for d, _ in rows], bucket)
    for (d, t), s in zip(rows, scores):
        r, base = out[d], brute.quality_base(t)
        assert tuple(r[1:7]) == base
        assert (r.score is None) == (s is None) and (s is None or abs(r.score - s) < 1e-9)
        assert r.kept == (not base[5] and s >= quality.THRESHOLD)
    none = labels.limit(0)
    for r in quality.score_quality(messy, none).collect():
        assert tuple(r.quality)[:6] == brute.quality_base(r.doc.text)
        assert r.quality.kept == (not r.quality.base_failed)  # no target: only the base rules
    assert quality.score_quality(messy.limit(0), none).count() == 0


@pytest.mark.parametrize("percent, lost, caught", [(50, 0.01, 0.95), (10, 0.05, 0.8), (5, 0.05, 0.6)])
def test_quality_verdict_holds_at_smaller_label_shares(spark, percent, lost, caught):
    """Good documents whose labels are held out are kept when few labels are given, and junk is still found."""
    large = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    given = labels.filter(F.col("quality") == 1).filter(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < percent)
    out = quality.score_quality(spark.read.parquet(f"{large}/documents.parquet"), given, keep=["doc_id"])
    rows = out.select("doc.doc_id", "quality.kept", "quality.base_failed").filter("not base_failed").join(labels, "doc_id")
    rows = rows.join(given.select("doc_id"), "doc_id", "left_anti")
    rejected = {r["quality"]: r["share"] for r in rows.groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()}
    assert rejected[1] <= lost and rejected[0] >= caught


def test_sharding(spark, messy):
    rows = messy.select(F.col("doc_id").alias("key"), F.col("source").alias("stratum"))
    out = sharding.stratified_shards(rows, 4).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == messy.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert sharding.stratified_shards(rows.limit(0), 4).count() == 0
    many = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("stratum"))
    for r in sharding.stratified_shards(many, 16).groupBy("shard", "stratum").count().collect():
        assert abs(r["count"] - 4000 / 7 / 16) <= 2


def test_personal_data(spark, docs, messy):
    for table in (docs, messy):
        for r in pii.find_personal_data(table).select("doc.doc_id", "doc.text", "base", pii.spans_text(F.col("base")).alias("joined"),
                                                      pii.spans_text(F.col("spans")).alias("spans")).collect():
            want = brute.personal_data(r.text)
            assert tuple(sum(b.kind == k for b in r.base) for k in range(4)) == want[:4] and r.joined == want[5]
            assert set(filter(None, r.joined.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.find_personal_data(messy.limit(0)).count() == 0


def test_personal_data_from_context(spark):
    seeds = [(k, f"some words badge: +1 (555) 010-{1000 + k} more") for k in range(8)]
    table = spark.createDataFrame([*seeds, (100, "then badge: QX77-20411 and code1 here"), (101, "plain code1 words badge none")], "doc_id long, text string")
    out = {r.doc.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find_personal_data(table).collect()}
    assert out[100] == [(4, "QX77-20411")] and out[101] == [] and all(len(out[k]) == 1 for k in range(8))


def test_near_duplicates(spark, docs, messy):
    want, _ = brute.near_classes(pairs_of(docs))
    assert dict(map(tuple, near_duplicates.near_duplicate_classes(docs).collect())) == want
    rows = [(d, t) for d, t in pairs_of(messy) if d is not None]
    want, _ = brute.near_classes(list(dict(rows).items()))
    out = near_duplicates.near_duplicate_classes(messy).collect()
    assert {r.id: r.class_id for r in out if r.id is not None} == want
    assert [r.class_id for r in out if r.id is None] == [None] and len(out) == messy.count()
    assert near_duplicates.near_duplicate_classes(messy.limit(0)).count() == 0


def test_near_duplicate_chains_and_groups(spark):
    """A chain whose ends differ, and many edited copies of one text: few leaders a round must still join all."""
    words = [f"u{k}" for k in range(200)]
    chain = [(k, " ".join(words[3 * k:3 * k + 120])) for k in range(4)]
    base = [f"v{k}" for k in range(150)]
    group = [(100 + k, " ".join([*base[:k], f"e{k}", *base[k + 1:]])) for k in range(12)]
    rows = chain + group
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute.near_classes(rows)
    assert dict(map(tuple, near_duplicates.near_duplicate_classes(table, leaders=4).collect())) == want


def test_pairs_exactly_at_the_threshold_are_linked(spark):
    """Pairs that share 8 of 10, 12 of 15, 56 of 70 shingles (linked) and 7 of 9 (not), judged by exact fractions."""
    rows = []
    for shared, left, right in [(8, 1, 1), (12, 1, 2), (12, 2, 1), (56, 7, 7), (7, 1, 1)] * 4:
        word = [f"p{len(rows)}w{k}" for k in range(shared + 4)]
        for n, side in ((left, "l"), (right, "r")):
            rows.append((len(rows), " ".join([*word, *[f"{side}{len(rows)}x{k}" for k in range(n)]])))
    want = {}
    for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
        one, two = set(brute.shingle_weights(x)), set(brute.shingle_weights(y))
        want |= {a: a, b: a if Fraction(len(one & two), len(one | two)) >= Fraction(8, 10) else b}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(a != c for a, c in want.items()) == 16
    assert dict(map(tuple, near_duplicates.near_duplicate_classes(table).collect())) == want


def test_sketches_do_not_drop_linked_pairs_of_few_shingles(spark):
    """Pairs of 4 shared shingles of 5, among them some whose unequal registers never share their 4 bits by chance."""
    rows = []
    for k in [*range(450, 460), 823, 985, 1328, 1422, 1427]:
        words = [f"t{k}w{i}" for i in range(8)]
        rows += [(2 * k, k, " ".join([*words, f"l{k}x0"])), (2 * k + 1, k, " ".join(words))]
    table = spark.createDataFrame(rows, "id long, bucket long, text string")
    sketches = near_duplicates.sketched(table.select("id", F.col("text").cast("binary").alias("body")))
    open_rows = table.select("bucket", "id", F.lit(0.0).alias("far"), F.col("id").alias("class"))
    found = near_duplicates.led_pairs(open_rows, open_rows.filter("id % 2 = 0"), sketches, near_duplicates.SIMILARITY).collect()
    assert sorted(map(tuple, found)) == [(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2])]


def test_texts_of_a_repeated_id_are_classed_apart(spark):
    """Each text of an id is in its own class, and the stage keeps one document of each class."""
    text = lambda name, n=120: " ".join(f"{name}{k}" for k in range(n))
    rows = [(5, text("a"), 5), (5, text("b"), 3), (7, text("a", 118), 5), (3, text("b", 119), 3), (9, text("c"), 9), (9, text("c"), 9),
            (20, text("d"), 20), (20, text("e"), 20), (30, text("f"), 30), (30, text("g"), 29), (29, text("g"), 29), (31, text("f", 118), 30),
            (40, text("h"), 40), (40, text("h", 119), 40), (40, text("i"), 40), (41, text("i", 119), 40)]
    table = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    out = near_duplicates.classed(table).collect()
    digests = {hashlib.md5(t.encode()).digest(): t for _, t, _ in rows}
    assert Counter((r.id, digests[bytes(r.copy_of)], r.class_id) for r in out) == Counter(rows)
    assert Counter(r.class_id for r in near_duplicates.near_duplicate_classes(table).collect()) == Counter(c for *_, c in rows)
    kept = Counter((d, t.split()[0][0]) for d, t in pairs_of(corpus_pipeline.near_dedup(spark, table, SF)))
    assert kept == Counter([(5, "a"), (3, "b"), (9, "c"), (20, "d"), (20, "e"), (30, "f"), (29, "g"), (40, "h"), (40, "i")])


def test_pair_similarity_is_probability_jaccard():
    texts = [LINE, LINE + " " + LINE, "a b", "", "one two three four five six one two three four five six", "one two three four five six"]
    for a in texts:
        got = near_duplicates.pair_similarities([a.encode()] * len(texts), [b.encode() for b in texts])
        want = [brute.probability_jaccard(brute.shingle_weights(a), brute.shingle_weights(b)) for b in texts]
        assert np.allclose(got, want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (8, 9), (7, 7), (20, 10), (20, 11), (11, 12)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8, 10: 10, 20: 10, 11: 10, 12: 10}


def test_training_order(spark, messy, tmp_path):
    for n in (1, 2, 5, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n, 7).tolist()) == list(range(n))
    encoder = token_shards.Encoder(token_shards.vocabulary_text())
    ordered = token_shards.training_order(messy, length=64, shard_slots=50)
    out = ordered.collect()
    assert [r.slot for r in out] == list(range(len(out)))
    assert all(len(r.payload) == 128 and r.offset == r.slot % 50 * 128 and r.shard == r.slot // 50 for r in out)
    found = Counter()
    parts = {}
    for r in out:
        parts.setdefault((r.key, r.seq), []).append(np.frombuffer(bytes(r.payload), "<u2")[:r.n_tokens])
    for d, t in {(d, t) for d, t in pairs_of(messy) if d not in (0, None)}:
        ids = np.concatenate([parts[d, s][0] for s in range(sum(k[0] == d for k in parts))])
        assert ids[-1] == encoder.end and encoder.encoding.decode_bytes(ids[:-1].tolist()) == (t or "").encode()
        assert (ids[:-1] == encoder.whole((t or "").encode())).all()
        found[d] += 1
    token_shards.write_shards(ordered, str(tmp_path / "shards"), 50)
    for first in (0, 1, 50, 60, 99, len(out) - 1):  # resumes at any slot, inside a shard too
        got = {r.slot: bytes(r.payload) for r in token_shards.read_from(spark, str(tmp_path / "shards"), first, 50).collect()}
        assert got == {r.slot: bytes(r.payload) for r in out[first:]}
    assert token_shards.training_order(messy.limit(0)).count() == 0


def test_slots_follow_a_plain_feistel_network(spark, tmp_path, monkeypatch):
    """Sequences in order of (key, seq), each at the slot that a scalar network with cycle-walking gives its number."""
    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> shift)) * factor % (1 << 64)
        return x

    df = spark.createDataFrame([(k * 7 % 101, "word " * (k % 9)) for k in range(101)], "doc_id long, text string")
    monkeypatch.setattr(token_shards, "SEGMENT_SLOTS", 4)
    out = token_shards.training_order(df, length=4, shard_slots=12, seed=5)
    rows = out.collect()
    n, half = len(rows), (int(len(rows) - 1).bit_length() + 1) // 2
    want = {}
    for k, key in enumerate(sorted((r.key, r.seq) for r in rows)):
        x = k
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for r in range(1, token_shards.ROUNDS + 1):
                left, right = right, left ^ (mix(right + mix(r + 5)) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                break
        want[x] = key
    assert {r.slot: (r.key, r.seq) for r in rows} == want
    token_shards.write_shards(out, str(tmp_path / "s"), 12)
    assert token_shards.read_from(spark, str(tmp_path / "s"), 17, 12).count() == n - 17
    assert all(len(r.data) == 8 * r.n_slots for r in spark.read.parquet(str(tmp_path / "s")).collect())


def test_token_counts(spark, docs, messy):
    library = token_counts.Counter(token_counts.vocabulary_text()).library
    for table, piece in ((docs, token_counts.PIECE_BYTES), (messy, 1000), (messy, token_counts.PIECE_BYTES)):
        for r in token_counts.count_tokens(table, piece=piece).collect():
            text = r.doc.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(messy.limit(0)).count() == 0


def test_pipeline(spark, docs):
    rows = dict(pairs_of(docs))
    steps, table = [], docs
    for _, stage in corpus_pipeline.STAGES:
        from tessera.session import cut_lineage
        table = cut_lineage(stage(spark, table, SF), "pipeline-test")
        steps.append(table)
    kept = {d for d, _ in pairs_of(steps[0])}
    scored = {r.doc_id: r.kept for r in queries.op5_llr_quality(spark, SF).collect()}
    assert kept == {d for d in rows if scored[d]}
    classes, _ = brute.near_classes([(d, rows[d]) for d in kept])
    assert sorted(d for d, _ in pairs_of(steps[1])) == sorted(set(classes.values()))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(v[4] for v in brute.contamination(pairs_of(steps[2]), items).values())
    dirty = brute.contamination(pairs_of(steps[1]), items)
    after = dict(pairs_of(steps[2]))
    assert all(after[d] == rows[d] for d, v in dirty.items() if not v[4])
    assert all(s.columns == docs.columns for s in steps[:4])
    assert {d for d, _ in pairs_of(steps[3])} == {r.doc_id for r in steps[4].select("doc_id").distinct().collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    from tessera.llm import components
    written = []
    real = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name: written.append(name) or real(df, name))
    star = [(k, 1) for k in range(2, 40)] + [(k, 50) for k in range(51, 60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(star, "u long, v long")).collect()))
    assert got == {1: 1, 50: 50, **dict(star)} and written == ["cc-edges"]
    path = [(k, k + 1) for k in range(1, 30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path, "u long, v long")).collect()))
    assert got == {k: 1 for k in range(1, 31)}


def test_signatures_of_texts_together_and_alone(monkeypatch):
    texts = [LONG.encode(), b"", *[f"a{k} b c d e f{k}".encode() for k in range(20)]]
    text, code, count = near_duplicates.shingles(texts)
    alone = [near_duplicates.signatures(np.zeros((text == t).sum(), np.int64), code[text == t], count[text == t].astype(float), 1, 64)
             for t in range(len(texts))]
    looks, real = [], near_duplicates.np.log
    monkeypatch.setattr(near_duplicates.np, "log", lambda x: looks.append(len(x)) or real(x))
    both = near_duplicates.signatures(text, code, count.astype(float), len(texts), 64)
    assert (both == np.concatenate(alone)).all() and not both[1].any()
    assert sum(looks) < 3 * len(code) + len(texts) * 64 * 16  # arrivals drawn
