"""Spelling variants, importance resampling and the hidden Markov model against brute force, and their defined edge results."""

from __future__ import annotations

import math
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute_models as brute  # noqa: E402
from test_llm_operators import LINE, SF, messy_rows, pairs_of  # noqa: E402

from tessera.llm import arrowtext, fm_index, hidden_markov, importance, near_duplicates, queries, spelling, token_counts, token_shards  # noqa: E402

#: Extra columns whose names clash with the operators' own.
SCHEMA = ("doc_id long, text string, word string, rank long, n long, score double, weight double, doc string, block long, "
          "sizes string, held string, path string, seq string, idx long, form string, n_words long, best string")


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r[:2], *["x", 1, 1, 0.5, 0.5, "d", 1, "s", "h", "p", "q", 1, "f", 1, "b"]) for r in messy_rows()], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def variants_of(df, **settings):
    rows = spelling.spelling_variants(df, **settings).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_variants(spark, docs, messy):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op11_trie_pair_spelling"](spark, SF).collect()}
    assert got == brute.variants(pairs_of(docs)) and sum(v[3] > 0 for v in got.values()) > 100
    assert variants_of(messy) == brute.variants(pairs_of(messy))
    assert variants_of(messy.limit(0)) == {}


def test_spelling_of_close_words_in_every_way(spark):
    """Short words over three letters: runs of equal letters, every kind of edit, chains, ties, and words on all partition borders."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(700)]
    words += ["chain"] * 300 + ["chian"] + ["chaine"] * 20 + ["chainee"] * 2 + ["a" * 30_000] * 2 + ["a" * 29_999] * 40
    texts = [(k, " ".join(words[k::9])) for k in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for settings in ({"least": 2, "min_count": 1, "factor": 2, "slip": 31}, {"least": 1, "min_count": 2, "factor": 10, "slip": 7}):
        assert variants_of(df, **settings) == brute.variants(texts, **settings)


def test_trie_nodes_are_shared_by_equal_prefixes_only(spark):
    words = sorted({"".join(x) for x in np.random.default_rng(5).choice(list("ab"), (300, 6))} | {"a", "b", "abba"})
    rows = spelling.numbered(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "word", "test-trie").orderBy("rank").collect()
    assert [r.word for r in rows] == words
    node, prefix = {}, {}
    for r in rows:
        shared = max(len(os.path.commonprefix([r.word, w])) for w in words if w != r.word)
        assert len(r.path) == shared + 1
        for depth, number in enumerate(r.path):
            assert node.setdefault(r.word[:depth], number) == number and prefix.setdefault(number, r.word[:depth]) == r.word[:depth]


def test_importance_resampling(spark, docs, messy):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    aims = [r.text for r in bench.select("text").collect()]
    got = queries.QUERIES["op12_importance_resampling"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == brute.importance(pairs_of(docs), aims)
    for table, target, texts in ((messy, bench, aims), (messy, bench.limit(0), []), (messy.limit(0), bench, aims)):
        out = importance.resample(table, target, keep=["doc_id"]).select("doc.doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, out.collect()), key=repr) == brute.importance(pairs_of(table), texts)
    whole = importance.resample(messy, bench)
    assert whole.select("doc.*").columns == messy.columns


def test_joined_checksums():
    rng, join = np.random.default_rng(0), importance.CrcJoin()
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 40, (200, 2))] + [(b"x", bytes(100_000))]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    got = join(crc(0), crc(1), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_word_frequencies_and_held_out_gain(spark, docs, messy):
    rows = queries.QUERIES["op13_hidden_markov"](spark, SF).collect()
    want = brute.word_frequency_scores(pairs_of(docs))
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    out = hidden_markov.score_texts(messy, states=3, rounds=1, classes=97).collect()
    want = brute.word_frequency_scores(pairs_of(messy))
    repeated = want[0][3]
    assert len(out) == messy.count() and all(r.train_tokens == repeated for r in out)
    for r in out:
        assert (r.held_out, r.n_tokens, r.n_known) == want[r.doc.doc_id][:3] or r.doc.doc_id == 0
        assert math.isfinite(r.score) and r.score <= 0 and r.doc.asDict().keys() == set(messy.columns)
    assert hidden_markov.score_texts(messy.limit(0), states=2, rounds=1).count() == 0


def test_without_training_texts_all_is_unknown(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    row = hidden_markov.score_texts(spark.createDataFrame([(held, LINE)], "doc_id long, text string"), rounds=1).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and abs(row.base_score) < 1e-9 and abs(row.score) < 1e-9


def test_chunked_recursions_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(hidden_markov, "CHUNK", 8)
    rng = np.random.default_rng(1)
    k, classes = 3, 20
    corpus = hidden_markov.Corpus(1000, 30, rng.integers(1, 50, classes) + 0.1)
    model = hidden_markov.Model.estimated(rng.random(k), 20 * rng.random((k, k)), 9 * rng.random((classes, k)), corpus)
    sizes = np.array([1, 8, 9, 24, 25, 7, 100, 16, 3])
    seq = rng.integers(0, classes + 1, sizes.sum())
    logs = hidden_markov.Sequences(model, seq, sizes).forward()
    run = hidden_markov.Sequences(model, seq, sizes, precise=False)
    run.forward()
    found = run.expected(seq, classes)
    plain = [brute.forward_backward(model.start, model.move, model.emit, s) for s in np.split(seq, np.cumsum(sizes)[:-1])]
    assert np.allclose(logs, [p[0] for p in plain], rtol=1e-12)
    for got, want in zip(found, (sum(p[i] for p in plain) for i in (1, 2, 3))):
        assert np.allclose(got, want[:len(got)], rtol=1e-4)


def test_distributed_rounds_equal_the_plain_ones(spark):
    """One Baum-Welch round and the final scores, against the plain recursions over the same first guess; the model's probabilities add up to 1."""
    texts = [(k, " ".join(np.random.default_rng(k).choice(list("abcdefgh"), 30 + 40 * (k % 7)))) for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    blocks = hidden_markov.pack_blocks(df, "doc_id", "text", None)
    counts = hidden_markov.word_counts(blocks, 3, 50)
    corpus = hidden_markov.corpus_totals(counts, 50)
    coded = hidden_markov.encode(blocks, counts, corpus)
    model = hidden_markov.train(coded, corpus, states=4, rounds=1)
    guess, seqs = [np.zeros(4), np.zeros((4, 4)), np.zeros((50, 4))], []
    for d, t in texts:
        seq = np.array([zlib.crc32(w.encode()) % 50 for w in [*t.split(), "\n"]])
        if zlib.crc32(str(d).encode()) % 10:
            seqs.append(seq)
            s = hidden_markov._seeded_states(seq, np.array([len(seq)]), 4)
            guess[0][s[0]] += 1
            np.add.at(guess[1], (s[:-1], s[1:]), 1)
            np.add.at(guess[2], (seq, s), 1)
    first = hidden_markov.Model.estimated(*guess, corpus)
    plain = [brute.forward_backward(first.start, first.move, first.emit, s) for s in seqs]
    want = hidden_markov.Model.estimated(*(sum(p[i] for p in plain) for i in (1, 2)), sum(p[3] for p in plain)[:50], corpus)
    assert np.allclose(model.emit, want.emit, rtol=1e-4) and np.allclose(model.move, want.move, rtol=1e-4)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and np.allclose(model.start.sum(), 1)


def twins(letters, n):
    """Two words of n letters that polynomial hashes modulo a power of two cannot tell apart from some length on."""
    odd = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[k] for k in odd), "".join(letters[1 - k] for k in odd)


@pytest.mark.parametrize("n", [33, 64, 512, 1024, 4096])
def test_codes_of_long_words_differ(n):
    for table in (arrowtext.ALNUM, arrowtext.SPACED):
        a, b = twins("ab", n)
        data, _ = arrowtext.joined([f"{a} {b} {a} x".encode()])
        codes = arrowtext.words(data, table)[2]
        assert codes[0] == codes[2] and len(set(codes.tolist())) == 3


def test_long_words_that_once_met(spark):
    """Decontamination, near-duplicates, token output and token counts with words of 1,024 and 4,096 letters that share polynomial codes."""
    pairs = [twins("ab", 1024), twins("ac", 4096)]
    texts = [(k, w) for k, w in enumerate([*pairs[0], *pairs[1], " ".join(pairs[0]), " ".join(pairs[1] + pairs[0])])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(7, pairs[0][0])], "item_id long, text string")
    hits = {r.doc.doc_id: r.hit.n_hit for r in fm_index.find_contamination(df, items).collect()}
    assert hits == {k: t.split().count(pairs[0][0]) for k, t in texts}
    classes = {r.id: r.class_id for r in near_duplicates.near_duplicate_classes(df).collect()}
    assert classes[0] != classes[1] and classes[2] != classes[3]
    counter = token_counts.Counter(token_counts.vocabulary_text())
    for r in token_counts.count_tokens(df).collect():
        assert r.n_tokens == len(counter.library.encode(r.doc.text, add_special_tokens=False).ids)
    encoder = token_shards._encoder(token_shards.vocabulary_text())
    for (_, t), ids in zip(texts, encoder.texts([t.encode() for _, t in texts])):
        assert int(encoder.sizes[ids].sum()) == len(t) and encoder.whole(t.encode()).tolist() == ids.tolist()
