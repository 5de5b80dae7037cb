"""Vectorised numpy helpers for text columns inside Arrow tasks.

A text column is handled as one byte buffer with offsets. Words, shingles and substrings get 64-bit hashes from
prefix sums of a polynomial hash, so no Python object is made for a word. Slices bound the memory of a task by bytes
of text (one longer text makes a slice of its own), whatever number of rows an Arrow batch has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Words of so many bytes or more are hashed by blake2b: the polynomial hash has known collisions of long words.
LONG_WORD = 32
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and those of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, m in enumerate((_MULTIPLIER, _INVERSE)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial hash of buf[s:e] times the s-th power."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice holds at most limit bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (n + 1 values).

    outside may mark other bytes that end words.
    """
    n = len(buf)
    inside = ~outside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes."""
    h = mix(span_hash(prefix_hash(buf), starts, ends) + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's k-word shingles, and row offsets. A row of 1 to k - 1 words has one, of all its words."""
    starts, ends, first = words(buf, offsets)
    h = word_hash(buf, starts, ends)
    counts = np.diff(first)
    n = len(h)
    out = np.full(max(0, n - k + 1), 0x51ED270B, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(_MULTIPLIER) + h[j : n - k + 1 + j])
    lengths = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], lengths)
    short = np.flatnonzero((counts > 0) & (counts < k))
    got = np.zeros(at[-1], np.uint64)
    whole = np.repeat(counts >= k, lengths)
    got[whole] = out[index[whole]]
    for row in short:
        value = np.array([counts[row]], np.uint64)
        for word in h[first[row] : first[row + 1]]:
            value = mix(value * np.uint64(_MULTIPLIER) + word)
        got[at[row]] = value[0]
    return got, at
