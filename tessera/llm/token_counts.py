"""Exact token counts from a tokenizer compiled to a finite-state transducer.

The merge table of a word-level BPE vocabulary is compiled to a deterministic
transducer over bytes. A state holds the longest suffix of the word that
begins some token, and for every place where a token could still have begun
the last token before it and the count there. The tokenization of a prefix is
fixed by its last token: the one suffix that is a token and whose pair with
the token before it survives merging. Each transition is annotated with the
change of the token count, so a word's count is the sum along its path. States
and transitions are compiled when first met, in a table of bounded size.

All words of a slice run through the table at once. Texts longer than a piece
are cut anywhere; each piece becomes a state map (what precedes its first
white space, the count between, what follows its last white space), and maps
compose associatively in a tree scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import arrowtext as A
from tessera.llm.tables import body, packed
from tessera.session import ship_package

# Production parameters.
VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
#: States kept in a worker's table; it starts anew beyond (about 0.5 KB each).
MAX_STATES = 150_000

# Fixed by the vocabulary's format: end-of-word suffix, and the contractions and classes of its split pattern.
END = "</w>"
_LETTER = "a-zß-öø-ɏ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\n{_LETTER}0-9]+|\n")
_SHIFT = 0x1000  # a word's last character is shifted by this, so it differs from the same character inside


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Transitions:
    """Open-addressing table from (state, byte) to (next state, change of the count), read with arrays of keys."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.change = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int8)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where it would go."""
        mask = (1 << self.bits) - 1
        out = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero((self.keys[out] != keys) & (self.keys[out] >= 0))
        while len(left):
            out[left] = (out[left] + 1) & mask
            there = self.keys[out[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        """Add keys that are distinct and not in the table."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, to, change = (np.concatenate(x) for x in ((self.keys[old], keys), (self.to[old], to), (self.change[old], change)))
            self.__init__(max(self.bits + 1, int(2 * len(keys)).bit_length()))
        self.used += len(keys)
        while len(keys):
            slots, first = np.unique(self.slots(keys), return_index=True)
            self.keys[slots], self.to[slots], self.change[slots] = keys[first], to[first], change[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, change = keys[rest], to[rest], change[rest]


class Transducer:
    """Deterministic transducer of a BPE merge table whose words end in a marked character."""

    def __init__(self, merges: list, max_states: int = MAX_STATES):
        own = lambda t: t[:-len(END) - 1] + chr(ord(t[-len(END) - 1]) + _SHIFT) if t.endswith(END) else t
        self.ranks: dict[tuple[str, str], int] = {}
        chars = byte_characters()
        self.tokens = {c for b in chars for c in (b, chr(ord(b) + _SHIFT))}
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((own(a), own(b)), k)
            self.tokens.add(own(a) + own(b))
        self.begins = {t[:k] for t in self.tokens for k in range(len(t))}
        self.chars, self.max_states = chars, max_states
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.inner, self.final = Transitions(), Transitions()
        # entries: (length of the suffix, last token before it or None at the start, count there minus the count here)
        self._number(("", ((0, None, 0),)))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def merged(self, text: str) -> list[str]:
        """Tokens of ``text`` by applying merges in order of rank, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, last: str | None, token: str) -> bool:
        key = (last or "", token)
        if key not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = self.merged((last or "") + token) == ([last, token] if last else [token])
        return self.pairs[key]

    def _step(self, state: tuple, char: str) -> tuple[tuple, int]:
        text, entries = state
        text += char
        for size, last, count in reversed(entries):
            token = text[len(text) - size - 1:]
            if token in self.tokens and self._follows(last, token):
                change = count + 1
                break
        else:
            raise ValueError(f"no valid token ends {text!r}")
        older = {size + 1: (before, n - change) for size, before, n in entries}
        new = [(0, token, 0)]
        new += [(size, *older[size]) for size in sorted(older) if text[len(text) - size:] in self.begins]
        return (text[len(text) - new[-1][0]:] if new[-1][0] else "", tuple(new)), change

    def _compile(self, keys: np.ndarray, final: bool) -> None:
        to, change = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int8)
        for k, key in enumerate(keys.tolist()):
            char = self.chars[key & 255]
            state, change[k] = self._step(self.states[key >> 8], chr(ord(char) + _SHIFT) if final else char)
            to[k] = 0 if final else self._number(state)
        (self.final if final else self.inner).put(keys, to, change)

    def _read(self, keys: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes for the keys, compiling those that are missing."""
        table = self.final if final else self.inner
        slots = table.slots(keys)
        if (missing := table.keys[slots] < 0).any():
            self._compile(np.unique(keys[missing]), final)
            slots = table.slots(keys)
        return table.to[slots], table.change[slots]

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Token counts of the words data[start:start+length] (length at least 1)."""
        if len(self.states) > self.max_states:
            self.reset()
        by = np.argsort(-length, kind="stable")
        start, length = start[by], length[by]
        at, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        falling = -length
        for column in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(falling, -column, "left"))  # words longer than column
            ends = int(np.searchsorted(falling, -column - 1, "left"))  # of these, the longer ones go on
            keys = at[:live] * 256 + data[start[:live] + column]
            if ends < live:
                total[ends:live] += self._read(keys[ends:], True)[1]
            if ends:
                at[:ends], change = self._read(keys[:ends], False)
                total[:ends] += change
        out = np.empty(len(start), np.int64)
        out[by] = total
        return out


@dataclass
class PieceMap:
    """What a piece does to the tokenizer's state: text up to the first white space, tokens between, text after the last.

    ``open``: the piece has no white space and is all head.
    """

    head: bytes
    count: int
    tail: bytes
    open: bool


class Counter:
    """Counts tokens of byte texts: the transducer for common scripts, the library for everything else."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("the vocabulary must mark word ends")
        self.transducer = Transducer(model["merges"])
        ok = np.zeros(256, bool)
        ok[0x21:0x7F] = True
        ok[0x80:0xC0] = True  # continuation bytes; what they continue decides
        ok[0xC3:0xCA] = True
        self.common = ok

    def _chunk_counts(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Token counts of chunks without ASCII white space."""
        bad = ~self.common[data]
        pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
        # signs and letters outside the plain rules, and special tokens
        bad[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair == 0x3C7C)
        seen = np.concatenate(([0], np.cumsum(bad, dtype=np.int64)))
        odd = seen[stop] > seen[start]
        out = np.zeros(len(start), np.int64)
        if odd.any():
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[odd], stop[odd])]
            out[odd] = [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        plain = np.flatnonzero(~odd)
        if len(plain):
            lengths = (stop - start)[plain] + 1
            ends = np.cumsum(lengths)
            source = np.arange(ends[-1]) + np.repeat(start[plain] - (ends - lengths), lengths)
            source[ends - 1] = -1
            chunks = np.where(source < 0, 10, data[source]).astype(np.uint8)
            lowered = chunks.tobytes().decode().lower()
            parts = _SPLIT.findall(lowered)
            lowered = np.frombuffer(lowered.encode(), np.uint8)
            letters = np.flatnonzero((lowered & 0xC0) != 0x80)
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            first = np.concatenate((letters, [len(lowered)]))[np.concatenate(([0], np.cumsum(size)))]
            begin, length = first[:-1], np.diff(first)
            breaks = lowered[begin] == 10
            owner = np.concatenate(([0], np.cumsum(breaks)[:-1]))
            words = ~breaks
            counts = self.transducer.count(lowered, begin[words], length[words])
            out[plain] = np.bincount(owner[words], counts, len(plain)).astype(np.int64)
        return out

    def chunks(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of texts that begin and end at white space or at the ends of a text."""
        data, starts = A.joined(pieces)
        at, stop, codes = A.words(data, A.SPACED)
        if not len(codes):
            return np.zeros(len(pieces), np.int64)
        _, index, where = np.unique(codes, return_index=True, return_inverse=True)
        counts = self._chunk_counts(data, at[index], stop[index])[where]
        total = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(total[A.by_text(at, starts)])

    def maps(self, pieces: list[bytes]) -> list[PieceMap]:
        """State maps of pieces cut anywhere."""
        cuts = [_white(p) for p in pieces]
        inside = self.chunks([p[a:b] if a is not None else b"" for p, (a, b) in zip(pieces, cuts)])
        return [PieceMap(p, 0, b"", True) if a is None else PieceMap(p[:a], int(n), p[b:], False)
                for p, (a, b), n in zip(pieces, cuts, inside)]

    def compose(self, a: PieceMap, b: PieceMap) -> PieceMap:
        """The map of piece a followed by piece b; associative."""
        if a.open:
            return PieceMap(a.head + b.head, b.count, b.tail, b.open)
        if b.open:
            return PieceMap(a.head, a.count, a.tail + b.head, False)
        middle = int(self.chunks([a.tail + b.head])[0])
        return PieceMap(a.head, a.count + middle + b.count, b.tail, False)

    def scan(self, maps: list[PieceMap]) -> PieceMap:
        """Composition of consecutive maps, pairwise in rounds."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def texts(self, texts: list[bytes], piece: int = PIECE_BYTES) -> list[int]:
        long = [k for k, t in enumerate(texts) if len(t) > piece]
        out = self.chunks([t if len(t) <= piece else b"" for t in texts]).tolist()
        for k in long:
            t = texts[k]
            maps = [m for i in range(0, len(t), piece) for m in self.maps([t[i:i + piece]])]
            whole = self.scan(maps)
            out[k] = whole.count + sum(self.chunks([whole.head, whole.tail]).tolist())
        return out


_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _white(piece: bytes) -> tuple[int | None, int | None]:
    """Start of the first ASCII white space and end of the last."""
    first = _WHITE.search(piece)
    if first is None:
        return None, None
    return first.start(), max(piece.rfind(x) for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) + 1


_COUNTERS: dict[int, Counter] = {}


def _counter(vocabulary: str) -> Counter:
    """One counter per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def vocabulary_text(path: str | None = None) -> str:
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None, piece: int = PIECE_BYTES,
                 keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc`` (the columns ``keep``, by default all), ``n_bytes`` and ``n_tokens``, one per input row.

    ``vocabulary`` is the path of a tokenizer file on the driver; its text is
    sent to the executors. A null text is empty; an empty table gives no
    rows; equal rows give equal results.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary_text(vocabulary))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for part in A.slices(batches, limit=SLICE_BYTES):
            texts = A.bodies(part)
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array(counter.texts(texts, piece), pa.int64())], ["doc", "n_bytes", "n_tokens"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs
    schema = T.StructType([T.StructField("doc", kept.schema), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(packed(kept).alias("doc"), body(text).alias("body")).mapInArrow(count, schema)
