"""Language-model scores from a hidden Markov model over word classes.

A text is its words and one end. Hidden states follow each other by a
transition matrix and emit a class of words (``CLASSES`` hashed classes, so
the model has a fixed size); a class emits its words in proportion to their
training counts. All words are counted exactly, whatever their number.

1. Texts are packed into blocks with a dictionary of their words. The
   dictionaries are dealt by class, summed, and the counts return to the
   blocks, which are written once as sequences of classes.
2. Baum-Welch: each round broadcasts the model, runs the scaled forward and
   backward recursions in the tasks, and sums expected counts over partitions.
3. The scaled forward recursion gives the exact likelihood of every text.

Long texts do not run step by step: sequences are cut into chunks of
``CHUNK`` tokens, all chunks advance together, and a chunk in the middle of a
text is one product of matrices that carries the state across it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import packed
from tessera.session import cut_lineage, scratch_path, ship_package

# Production parameters.
STATES = 8
CLASSES = 65_535
ROUNDS = 4
#: Every tenth document by checksum is not learned from.
HELD_OUT = 10
BLOCK_BYTES = 8 << 20
#: Tokens that advance together, and tokens in a chunk.
TOGETHER = 250_000
CHUNK = 256
#: Added to the count of each word; an unknown word has this count.
SMOOTHING = 0.1
#: Share of a state's emissions that follows the whole corpus.
COMMON = 0.1
#: Word bytes of dictionaries in one hash partition, and pieces of the expected counts.
PARTITION_BYTES = 32 << 20
PIECES = 64

_END = "\n"  # white space, so no word


def _put(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _get(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(tokens of each text, local word number of every token, dictionary); the end is the last word of the dictionary."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    rows = rows.filter(full).to_numpy().astype(np.int64)
    n = np.bincount(rows, minlength=len(texts))
    known = pa.concat_arrays([coded.dictionary, pa.array([_END], pa.string())])
    seq = np.full(int(n.sum()) + len(texts), len(known) - 1, np.int32)
    seq[np.arange(len(rows)) + rows] = coded.indices.to_numpy()
    return n + 1, seq, known


def pack_blocks(docs: DataFrame, key: str, text: str, keep: list[str] | None) -> DataFrame:
    """(block, docs, sizes, held, seq, words, counts): texts as word numbers with their block's dictionary, written once."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    held = F.crc32(id_text.cast("binary")) % HELD_OUT == 0

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in A.string_slices(batches, "text", BLOCK_BYTES):
            sizes, seq, words = tokenized(b.column("text"))
            out = b.column("held").to_numpy(zero_copy_only=False)
            counts = np.bincount(seq[np.repeat(~out, sizes)], minlength=len(words))
            doc = b.column("doc")
            yield pa.RecordBatch.from_arrays([
                pa.array([(part << 32) + n]), pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc), pa.array([_put(sizes)]),
                pa.array([_put(out)]), pa.array([_put(seq)]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([_put(counts)])], ["block", "docs", "sizes", "held", "seq", "words", "counts"])
            n += 1

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(kept.schema)), T.StructField("sizes", T.BinaryType()),
                           T.StructField("held", T.BinaryType()), T.StructField("seq", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.BinaryType())])
    rows = docs.select(packed(kept).alias("doc"), held.alias("held"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(pack, schema)
    path = scratch_path(docs.sparkSession, "lm-blocks")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def word_counts(blocks: DataFrame, partitions: int, classes: int) -> DataFrame:
    """Training counts of all words, dealt by class.

    Rows with a ``block`` hold counts and classes of some of its words
    (``local``: their numbers there); rows without one hold classes, their
    counts and their numbers of distinct training words (``local``).
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, counts = b.column("words")[k].values, _get(b.column("counts")[k].as_py(), np.int64)
                crc = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.int64, len(words))
                own = crc % classes
                part = own % partitions
                by = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[by], prepend=-1, append=partitions))
                sorted_words, block = words.take(pa.array(by)), b.column("block")[k].as_py()
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                offsets = pa.array(edges, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[by[a]]) for a, _ in spans], pa.int64()), pa.array([block] * len(spans), pa.int64()),
                    pa.ListArray.from_arrays(offsets, sorted_words), pa.array([_put(by[a:z].astype(np.int32)) for a, z in spans]),
                    pa.array([_put(own[by[a:z]].astype(np.int32)) for a, z in spans]), pa.array([_put(counts[by[a:z]]) for a, z in spans])],
                    ["part", "block", "words", "local", "class", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "local", "class", "counts"]
        rows = [(b.column("block")[k].as_py(), b.column("words")[k].values, *(b.column(c)[k].as_py() for c in names[1:]))
                for b in batches for k in range(b.num_rows)]
        if not rows:
            return
        coded = pa.concat_arrays([r[1] for r in rows]).dictionary_encode()
        at = coded.indices.to_numpy()
        own = np.concatenate([_get(r[3], np.int32) for r in rows])
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, at, np.concatenate([_get(r[4], np.int64) for r in rows]))
        end = 0
        for block, words, local, kind, _ in rows:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([local]), pa.array([kind]),
                                              pa.array([_put(total[at[end:end + len(words)]])])], names)
            end += len(words)
        class_of = np.zeros(len(total), np.int64)
        class_of[at] = own
        kinds, where = np.unique(class_of, return_inverse=True)
        mass = np.zeros(len(kinds), np.int64)
        np.add.at(mass, where, total)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([_put(np.bincount(where, total > 0).astype(np.int64))]),
                                          pa.array([_put(kinds.astype(np.int32))]), pa.array([_put(mass)])], names)

    wire = "part long, block long, words array<string>, local binary, class binary, counts binary"
    dealt = blocks.select("block", "words", "counts").mapInArrow(deal, wire)
    return dealt.repartitionById(partitions, F.col("part").cast("int")).mapInArrow(add, "block long, local binary, class binary, counts binary")


@dataclass
class Corpus:
    """Training totals: tokens, distinct words, and smoothed mass of each class."""

    tokens: int
    distinct: int
    mass: np.ndarray

    @property
    def total(self) -> float:
        return self.tokens + SMOOTHING * (self.distinct + 1)

    @property
    def unknown(self) -> float:
        return SMOOTHING / self.total


def corpus_totals(counts: DataFrame, classes: int) -> Corpus:
    """Sums over the rows without a block: each class is in one of them, so at most ``classes`` entries reach the driver."""
    mass, tokens, distinct = np.zeros(classes), 0, 0
    for r in counts.filter("block is null").collect():
        own, types = _get(r["counts"], np.int64), _get(r["local"], np.int64)
        mass[_get(r["class"], np.int32)] = own + SMOOTHING * types
        tokens, distinct = tokens + int(own.sum()), distinct + int(types.sum())
    return Corpus(tokens, distinct, mass)


def encode(blocks: DataFrame, counts: DataFrame, corpus: Corpus) -> DataFrame:
    """(docs, sizes, held, seq, known, base, inner): blocks as class sequences (an unknown word: the class after the last).

    By document: tokens that are known, the sum of log10 of smoothed counts, and log10 of the words' shares of their classes.
    """
    classes = len(corpus.mass)
    log_mass = np.log10(np.append(np.maximum(corpus.mass, 1e-300), SMOOTHING))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                sizes, seq = _get(b.column("sizes")[k].as_py(), np.int64), _get(b.column("seq")[k].as_py(), np.int32)
                answers = b.column("answers")[k].as_py()
                local = np.concatenate([_get(x["local"], np.int32) for x in answers])
                count, own = np.zeros(len(local), np.int64), np.zeros(len(local), np.int32)
                count[local] = np.concatenate([_get(x["counts"], np.int64) for x in answers])
                own[local] = np.concatenate([_get(x["class"], np.int32) for x in answers])
                own[count == 0] = classes
                log_count = np.log10(count + SMOOTHING)
                first = np.cumsum(sizes) - sizes
                per_text = lambda x: np.add.reduceat(x[seq], first)
                yield pa.RecordBatch.from_arrays([b.column("docs").slice(k, 1), b.column("sizes").slice(k, 1), b.column("held").slice(k, 1),
                                                  *[pa.array([_put(x)]) for x in (own[seq].astype(np.uint16), per_text((count > 0).astype(np.int64)),
                                                                                  per_text(log_count), per_text(log_count - log_mass[own]))]],
                                                 ["docs", "sizes", "held", "seq", "known", "base", "inner"])

    answers = (counts.filter("block is not null").groupBy("block")
               .agg(F.collect_list(F.struct("local", F.col("class"), "counts")).alias("answers")))
    both = blocks.select("block", "docs", "sizes", "held", "seq").join(answers, "block").drop("block")
    binary = ["sizes", "held", "seq", "known", "base", "inner"]
    schema = T.StructType([blocks.schema["docs"]] + [T.StructField(c, T.BinaryType()) for c in binary])
    path = scratch_path(blocks.sparkSession, "lm-classes")
    both.mapInArrow(code, schema).write.option("compression", "none").parquet(path)
    return blocks.sparkSession.read.parquet(path)


@dataclass
class Model:
    """Start and transition probabilities, and emissions (class after the last: an unknown word) by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def estimated(cls, start: np.ndarray, move: np.ndarray, emitted: np.ndarray, corpus: Corpus, common: float = COMMON) -> Model:
        """From expected counts; every state shares a part of the corpus's own distribution and its unknown word."""
        known = corpus.total - SMOOTHING
        share = corpus.mass / known if known > 0 else corpus.mass
        own = emitted / np.maximum(emitted.sum(0), 1e-300)
        own = np.where(emitted.sum(0) > 0, own, share[:, None])
        emit = (1 - corpus.unknown) * ((1 - common) * own + common * share[:, None])
        k = len(start)
        return cls((start + 1 / k) / (start.sum() + 1), (move + 1) / (move.sum(1, keepdims=True) + k),
                   np.vstack([emit, np.full((1, k), corpus.unknown)]))


class _Aligned:
    """Chunks side by side, the longest first: the tokens at place 0 of all of them, then those at place 1, and so on."""

    def __init__(self, chunks: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.chunks = chunks[np.argsort(-size[chunks], kind="stable")]
        own = size[self.chunks]
        steps = int(own[0]) if len(own) else 0
        self.live = np.searchsorted(-own, -np.arange(steps), "left")  # chunks longer than t
        self.off = np.concatenate(([0], np.cumsum(self.live)))
        place = np.repeat(np.arange(steps), self.live)
        rank = np.arange(self.off[-1]) - self.off[place]
        self.tokens = at[self.chunks][rank] + place
        self.ends = self.off[own - 1] + np.arange(len(own)) if len(own) else own


class Sequences:
    """Class sequences of some texts, cut into chunks that advance together. Arrays hold a column for each token.

    ``precise``: exact likelihoods. Otherwise emissions are scaled by token, for expected counts in single precision.
    """

    def __init__(self, model: Model, seq: np.ndarray, sizes: np.ndarray, precise: bool = True):
        self.n, self.sizes, self.precise = len(sizes), sizes, precise
        kind = np.float64 if precise else np.float32
        emit = model.emit if precise else model.emit / np.maximum(model.emit.max(1, keepdims=True), 1e-300)
        self.start, self.move, self.emit = model.start.astype(kind), model.move.astype(kind), emit.T.astype(kind)[:, seq]
        self.first = np.cumsum(sizes) - sizes
        self.pieces = -(-sizes // CHUNK)
        self.head = np.cumsum(self.pieces) - self.pieces  # first chunk of each text
        self.doc = np.repeat(np.arange(len(sizes)), self.pieces)
        self.place = np.arange(len(self.doc)) - self.head[self.doc]
        self.at = self.first[self.doc] + self.place * CHUNK
        self.size = np.minimum(CHUNK, sizes[self.doc] - self.place * CHUNK)
        self.last = self.place == self.pieces[self.doc] - 1
        self.scale = np.empty(len(seq), kind)
        self.alpha = None if precise else np.empty((len(self.start), len(seq)), kind)

    def _aligned(self, chunks: np.ndarray) -> _Aligned:
        return _Aligned(chunks, self.at, self.size)

    def _matrices(self, chunks: np.ndarray) -> np.ndarray:
        """For full chunks, what carries a state before the chunk to a state at its end, up to a factor."""
        k, emit = len(self.start), self.emit[:, self.at[chunks] + np.arange(CHUNK)[:, None]]
        out = np.repeat(np.eye(k, dtype=emit.dtype)[:, :, None], len(chunks), 2)
        for t in range(CHUNK):
            out = np.matmul(self.move.T, out)
            out *= emit[:, t]
            if t % 4 == 3:
                out /= out.sum((0, 1))
        return out

    def _forward(self, chunks: np.ndarray, prior: np.ndarray, ends: np.ndarray) -> None:
        """Run through chunks from the distributions of their first states (columns by chunk) and set the states at their ends."""
        run = self._aligned(chunks)
        emit, state, step = self.emit[:, run.tokens], prior[:, run.chunks], self.move.T
        scale = np.empty(len(run.tokens), emit.dtype)
        for t, m in enumerate(run.live.tolist()):
            own = emit[:, run.off[t]:run.off[t] + m]
            own *= step @ state[:, :m] if t else state
            own.sum(0, out=scale[run.off[t]:run.off[t] + m])
            own /= scale[run.off[t]:run.off[t] + m]
            state = own
        ends[:, run.chunks] = emit[:, run.ends]
        self.scale[run.tokens] = scale
        if self.alpha is not None:
            self.alpha[:, run.tokens] = emit

    def forward(self) -> np.ndarray:
        """Natural log likelihood of every text, if precise; sets the filtered states otherwise."""
        k, chunks = len(self.start), len(self.doc)
        self.middle = np.flatnonzero((self.place > 0) & ~self.last)
        self.carry, self.where = self._matrices(self.middle), np.zeros(chunks, np.int64)
        self.where[self.middle] = np.arange(len(self.middle))
        ends, prior = np.empty((k, chunks), self.move.dtype), np.empty((k, chunks), self.move.dtype)
        prior[:, self.head] = self.start[:, None]
        self._forward(self.head, prior, ends)
        self.order = np.argsort(-self.pieces, kind="stable")
        for j in range(1, int(self.pieces.max()) - 1 if self.n else 0):  # states at the ends of chunks in the middle
            chunk = self._inner(j)
            state = np.einsum("kn,kln->ln", ends[:, chunk - 1], self.carry[:, :, self.where[chunk]])
            ends[:, chunk] = state / state.sum(0)
        rest = np.flatnonzero(self.place > 0)
        prior[:, rest] = self.move.T @ ends[:, rest - 1]
        self._forward(rest, prior, ends)
        return np.add.reduceat(np.log(self.scale), self.first) if self.precise else None

    def _inner(self, j: int) -> np.ndarray:
        """Chunk j of every text of which it is in the middle."""
        texts = self.order[:int(np.searchsorted(-self.pieces[self.order], -(j + 1), "left"))]
        return self.head[texts] + j

    def _backward(self, chunks: np.ndarray, future: np.ndarray, before: np.ndarray, beta: np.ndarray) -> None:
        """Run back through chunks from the weights of the states at their ends and set the weights of the states before them."""
        run = self._aligned(chunks)
        emit, back = self.emit[:, run.tokens], future[:, run.chunks]
        held = np.empty_like(emit)
        for t in range(len(run.live) - 1, -1, -1):
            m, here = int(run.live[t]), slice(run.off[t], run.off[t + 1])
            held[:, here] = back[:, :m]
            own = self.move @ (emit[:, here] * back[:, :m])
            own /= own.sum(0)
            back[:, :m] = own
        before[:, run.chunks] = back
        beta[:, run.tokens] = held

    def expected(self, seq: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions, after ``forward``."""
        k, chunks = len(self.start), len(self.doc)
        beta, future = np.empty_like(self.alpha), np.ones((k, chunks), self.alpha.dtype)
        before = np.empty_like(future)
        ends = np.flatnonzero(self.last)
        self._backward(ends, future, before, beta)
        inner = ends[self.place[ends] > 0]
        future[:, inner - 1] = before[:, inner]
        for j in range(int(self.pieces.max()) - 2 if self.n else 0, 0, -1):
            chunk = self._inner(j)
            back = np.einsum("kln,ln->kn", self.carry[:, :, self.where[chunk]], future[:, chunk])
            future[:, chunk - 1] = back / back.sum(0)
        self._backward(np.flatnonzero(~self.last), future, before, beta)
        state = self.alpha * beta
        total = state.sum(0)
        state /= total
        emitted = np.stack([np.bincount(seq, state[i], classes + 1)[:classes] for i in range(k)], 1)
        # a transition's weight needs no sum of its own: it is the forward scale times the product of both sides
        beta *= self.emit
        beta /= self.scale * total
        beta[:, self.first] = 0
        moved = self.alpha[:, :-1] @ beta[:, 1:].T
        return state[:, self.first].sum(1).astype(np.float64), (self.move * moved).astype(np.float64), emitted


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row and token ranges of texts that advance together."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    for a, z in A.cuts(sizes, TOGETHER):
        yield a, z, int(ends[a]), int(ends[z])


def _seeded_states(seq: np.ndarray, sizes: np.ndarray, states: int) -> np.ndarray:
    """First guess: the state of a token comes from the text's most frequent class and from the class before it."""
    n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    pair, count = np.unique(doc * 65_536 + seq, return_counts=True)
    owner, kind = np.divmod(pair, 65_536)
    by = np.lexsort((kind, -count, owner))
    mode = kind[by[np.searchsorted(owner[by], np.arange(n))]]
    groups = max(1, states // 2)
    theme = (A.mix64(mode.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    previous = np.concatenate((seq[:1], seq[:-1])).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    previous[first] = seq[first]  # nothing before a text's first token
    inside = (A.mix64(previous + np.uint64(1 << 20)) % np.uint64(max(1, states // groups))).astype(np.int64)
    return theme[doc] * (states // groups) + inside


def train(blocks: DataFrame, corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the texts that are not held out; each round's counts are summed over partitions in ``PIECES`` pieces."""
    spark, classes = blocks.sparkSession, len(corpus.mass)
    rows = blocks.select("sizes", "held", "seq")
    model = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, move, emitted, some = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), False
            for b in batches:
                for r in b.to_pylist():
                    sizes, held, seq = _get(r["sizes"], np.int64), _get(r["held"], bool), _get(r["seq"], np.uint16).astype(np.int64)
                    seq, sizes = seq[np.repeat(~held, sizes)], sizes[~held]
                    for a, z, p, q in _together(sizes):
                        some, part, own = True, seq[p:q], sizes[a:z]
                        if shared.value is None:
                            guess = _seeded_states(part, own, states)
                            first = np.cumsum(own) - own
                            start += np.bincount(guess[first], minlength=states)
                            inner = np.ones(len(part), bool)
                            inner[first] = False
                            to = np.flatnonzero(inner)
                            move += np.bincount(guess[to - 1] * states + guess[to], minlength=states * states).reshape(states, states)
                            emitted += np.bincount(part * states + guess, minlength=(classes + 1) * states).reshape(-1, states)[:classes]
                        else:
                            run = Sequences(shared.value, part, own, precise=False)
                            run.forward()
                            for total, found in zip((start, move, emitted), run.expected(part, classes)):
                                total += found
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.array([_put(emitted[k::PIECES].astype(np.float32)) for k in range(PIECES)]),
                                                  pa.array([_put(np.vstack([start, move])) if not k else None for k in range(PIECES)], pa.binary())],
                                                 ["piece", "emitted", "moves"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            emitted, moves, piece = 0.0, 0.0, None
            for b in batches:
                for r in b.to_pylist():
                    piece = r["piece"]
                    emitted = emitted + _get(r["emitted"], np.float32).astype(np.float64)
                    if r["moves"] is not None:
                        moves = moves + _get(r["moves"], np.float64)
            if piece is not None:
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([_put(emitted)]),
                                                  pa.array([_put(moves) if piece == 0 else None], pa.binary())], ["piece", "emitted", "moves"])

        wire = "piece long, emitted binary, moves binary"
        found = rows.mapInArrow(count, wire).repartitionById(PIECES, F.col("piece").cast("int")).mapInArrow(add, wire).collect()
        shared.destroy()
        emitted, moves = np.zeros((classes, states)), np.zeros((states + 1, states))
        for r in found:
            emitted[r.piece::PIECES] = _get(r.emitted, np.float64).reshape(-1, states)
            if r.piece == 0:
                moves = _get(r.moves, np.float64).reshape(-1, states)
        model = Model.estimated(moves[0], moves[1:], emitted, corpus)
    return model


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, classes: int = CLASSES,
                keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all), ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score`` (log10 probabilities of the text under smoothed word frequencies and under the model), one per input row.

    A null text is an end alone; a null key counts as 'null'; rows with equal
    keys are held out together. Without training texts every token is
    unknown, with probability 1 in both models; an empty table gives no rows.
    ``classes`` is at most 65,535. Words and texts may be of any length.
    """
    spark = docs.sparkSession
    ship_package(spark)
    blocks = pack_blocks(docs, key, text, keep)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // PARTITION_BYTES) + 1)
    counts = cut_lineage(word_counts(blocks, partitions, classes), "lm-counts")
    corpus = corpus_totals(counts, classes)
    coded = encode(blocks, counts, corpus)
    model = spark.sparkContext.broadcast(train(coded, corpus, states, rounds))
    unit = np.log10(corpus.total)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                sizes, held, seq, known, base, inner = (_get(b.column(c)[k].as_py(), t) for c, t in (
                    ("sizes", np.int64), ("held", bool), ("seq", np.uint16), ("known", np.int64), ("base", np.float64), ("inner", np.float64)))
                found = np.concatenate([Sequences(model.value, seq[p:q].astype(np.int64), sizes[a:z]).forward() for a, z, p, q in _together(sizes)])
                docs = b.column("docs")[k].values
                yield pa.RecordBatch.from_arrays([docs, pa.array(held), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), corpus.tokens)),
                                                  pa.array(base - sizes * unit), pa.array(found / np.log(10) + inner)], names)

    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
              ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    names = ["doc"] + [k for k, _ in fields]
    schema = T.StructType([T.StructField("doc", coded.schema["docs"].dataType.elementType)] + [T.StructField(k, t) for k, t in fields])
    return coded.mapInArrow(score, schema)
