"""Texts in Arrow batches and vectorised word codes for operators that run numpy inside Spark tasks.

A task sees bounded slices of its partition (``SLICE_BYTES`` of text, or one
longer text), and scans a slice in windows of ``WINDOW`` bytes, so memory
does not grow with the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
WINDOW = 1 << 20
#: Bytes of a word up to which its code is a polynomial hash.
SHORT = 32
#: Separator between the texts of a slice; it belongs to no word in either alphabet.
SEPARATOR = 10


def slices(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice (``columns``, by default body) have at most ``limit`` bytes, or it is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(np.fromiter((len(x) for x in bodies(batch, c)), np.int64, batch.num_rows) for c in columns or ("body",))
        for first, last in cuts(sizes, limit):
            yield batch.slice(first, last - first)


def string_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like ``slices``, by the bytes of a string column, which stays in Arrow."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)
            for first, last in cuts(sizes, limit):
                yield batch.slice(first, last - first)


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to at most ``limit``, or of one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        used = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield first, last
        first = last


def bodies(batch: pa.RecordBatch, column: str = "body") -> list[bytes]:
    return [x or b"" for x in batch.column(column).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a separator after each as one byte array, and the start of each (plus the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return data, starts


def _table(word_bytes: Iterable[int], lower: bool) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in word_bytes:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


#: Words of lower-cased letters, digits and all non-ASCII characters; other bytes map to 0.
ALNUM = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)], lower=True)
#: Words between white space. NUL is a word character here, so it gets a code of its own below.
SPACED = _table([b for b in range(256) if b not in (32, 9, 10, 11, 12, 13)], lower=False)
SPACED_WORD = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])

_MULTIPLIER = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(WINDOW + 1, _MULTIPLIER, np.uint64)) * np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
_INVERSES = np.cumprod(np.full(WINDOW + 1, pow(_MULTIPLIER, -1, 1 << 64), np.uint64)) * np.uint64(_MULTIPLIER)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit codes of all words in ``data``; equal words have equal codes.

    ``data`` ends with a separator. Codes of words of up to ``SHORT`` bytes
    are polynomial hashes over seeded byte values. Modulo a power of two,
    such hashes meet for certain pairs of long words whatever the multiplier,
    so longer words get a cryptographic digest.
    """
    is_word = (table != 0) if table is ALNUM else SPACED_WORD
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            inside = np.flatnonzero(~is_word[data[at:end]])
            if not len(inside):  # a word longer than the window
                stop = at + WINDOW
                while is_word[data[stop]]:
                    stop += 1
                parts.append((np.array([at]), np.array([stop]), _digests(table[data[at:stop]], [(0, stop - at)])))
                at = stop
                continue
            end = at + int(inside[-1]) + 1
        piece = data[at:end]
        mask = is_word[piece]
        edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
        start, stop = edges[::2], edges[1::2]
        if len(start):
            prefix = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUES[table[piece]] * _POWERS[:len(piece)], out=prefix[1:])
            code = (prefix[stop] - prefix[start]) * _INVERSES[start]
            code = mix64(code + (stop - start).astype(np.uint64))
            if len(long := np.flatnonzero(stop - start > SHORT)):
                code[long] = _digests(table[piece], zip(start[long].tolist(), stop[long].tolist()))
            parts.append((start + at, stop + at, code))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _digests(mapped: np.ndarray, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(mapped[a:b], digest_size=8).digest(), "little") for a, b in spans], np.uint64)


def run_codes(codes: np.ndarray, length: int, step: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64-bit codes of all runs of ``length`` consecutive word codes (one fewer than length shorter)."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, length):
        out = mix64(out * np.uint64(step) + codes[k:k + n])
    return out


def by_text(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For word positions of a slice, where each text's words begin (plus the end)."""
    return np.searchsorted(positions, starts)
