"""Byte-level BPE: a heap of merge ranks over a doubly linked list of symbols, and decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels

# Fixed values of the tokenizer's pre-splitting, 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Encodings of so many distinct pieces are remembered by a worker; then the memory is emptied.
REMEMBER = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Vocabulary:
    """Merge ranks and byte strings read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab = read["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        as_bytes = lambda s: bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        self.strings = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def encode_word(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equal ones; entries whose symbols have changed are stale."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


LETTER = 1


def _classes() -> np.ndarray:
    """For every code point 0 for white space, 1 for a letter, 2 for a number, 3 for the rest."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 3, np.uint8)
    for value, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            shift = 0x800 * (m.start() >= 0xD800)
            out[m.start() + shift : m.end() + shift] = value
    return out


class Splitter:
    """Cuts texts where the tokenizer does before merges, for all texts of a slice at once."""

    def __init__(self, special: dict[str, int]):
        self.classes = _classes()
        self.special = special

    def starts(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of the texts, which are joined in text and end at ends, and where each piece starts."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(points)
        kind = self.classes[points]
        first = np.zeros(n + 1, bool)
        first[0], first[ends] = True, True
        for token in self.special:
            at = text.find(token)
            while at >= 0:  # texts end before and after a special token, which no text may cross
                inside = first[at + 1 : at + len(token)].any()
                if not inside:
                    first[[at, at + len(token)]] = True
                    kind = kind.copy()
                    kind[at : at + len(token)] = 3
                at = text.find(token, at + (1 if inside else len(token)))
        edge = first[:n].copy()
        last = first[1:].copy()
        space, blank = kind == 0, points == 32
        start = edge | np.concatenate([[True], kind[1:] != kind[:-1]]) if n else edge
        single = np.zeros(n, bool)
        single[:-1] = space[:-1] & ~space[1:] & ~last[:-1]  # the last space before a word of the same text
        start |= single
        after = np.zeros(n, bool)
        after[1:] = single[:-1] & blank[:-1]
        start &= ~after
        for i in np.flatnonzero(start & (points == 39)):
            size = next((len(c) for c in CONTRACTIONS if text.startswith(c, i)), 0)
            if size and not edge[i + 1 : i + size].any():
                start[i + 1 : i + size] = False
                if i + size < n:
                    start[i + size] = True
        return points, np.flatnonzero(start)


class Pieces:
    """The pieces of some texts: where each one starts and stops in the joined text, each text's first piece (n + 1 values),
    a place and a hash of each distinct piece, and every piece's number among these.

    Hashes group the pieces; each is then compared with its group's first by code points, and if any differs (clash) all are
    told apart as strings. Without a clash the distinct pieces are in the order of their hashes.
    """

    def __init__(self, splitter: Splitter, texts: list[str]):
        self.text = "".join(texts)
        ends = np.cumsum([0, *(len(t) for t in texts)])
        self.points, self.starts = splitter.starts(self.text, ends[1:][ends[1:] < len(self.text)])
        n = len(self.points)
        self.stops = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, ends)
        power, inverse = kernels.powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(kernels.mix(self.points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
        hashes = (prefix[self.stops] - prefix[self.starts]) * inverse[self.starts]
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.places = order[new]
        self.hashes = hashes[self.places]
        self.clash = not self._same()
        if self.clash:
            numbers: dict[str, int] = {}
            self.number = np.array([numbers.setdefault(p, len(numbers)) for p in self.strings(np.arange(len(order)))])
            self.places = np.unique(self.number, return_index=True)[1]
            self.hashes = hashes[self.places]

    def _same(self) -> bool:
        """Whether every piece has the code points of the one that stands for it."""
        lengths, at = self.stops - self.starts, self.places[self.number]
        if not np.array_equal(lengths, lengths[at]):
            return False
        shift = np.repeat((self.starts[at] - self.starts).astype(np.int32), lengths)
        shift += np.arange(len(self.points), dtype=np.int32)
        return np.array_equal(self.points[shift], self.points)

    def strings(self, places: np.ndarray) -> list[str]:
        text = self.text
        return [text[s:e] for s, e in zip(self.starts[places].tolist(), self.stops[places].tolist(), strict=True)]


def distinct_pieces(splitter: Splitter, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of the texts, each piece's number in order, and each text's first piece (n + 1 values)."""
    found = Pieces(splitter, texts)
    return found.strings(found.places), found.number, found.first


class Memory(dict):
    """For a piece its number of ids, the ids joined by commas after one comma, the bytes they decode to, and the ids packed."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str):
        v = self.vocabulary
        ids = [v.special[piece]] if piece in v.special else v.encode_word(piece.encode())
        decoded = b"".join(map(v.strings.__getitem__, ids))
        self[piece] = got = (len(ids), "".join(f",{i}" for i in ids), decoded, np.array(ids, "<i4").tobytes())
        return got


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def tools(path: str) -> tuple[Splitter, Memory]:
    """A worker's splitter and its memory of encoded pieces, which outlive a task."""
    v = vocabulary(path)
    return Splitter(v.special), Memory(v)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and return (id_col, n_tokens, ids_sha256, decoded_sha256), and with
    with_ids also ids and decoded.

    path is the tokenizer's JSON file, which every executor can read. A special token's string inside a text becomes
    its id. Null texts count as empty: no ids. One row for each input row, repeated ones included; a null id stays null; other columns are
    ignored. A text of any length is encoded whole, by one task with some ten 8-byte values a character. Ids must be numbers.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]):
        splitter, memory = tools(path)
        for part in kernels.slices(batches, "__text"):
            if len(memory) > REMEMBER:
                memory.clear()
            texts = [t or "" for t in kernels.column(part, "__text").to_pylist()]
            pieces, number, first = distinct_pieces(splitter, texts)
            known = list(zip(*map(memory.__getitem__, pieces), strict=True)) or [(), (), (), ()]
            counts, joined, decoded, packed = (np.array(c, object)[number] for c in known)
            sizes = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])[first]
            shas, back_shas, backs = [], [], []
            for s, e in zip(first[:-1], first[1:], strict=True):
                back = b"".join(decoded[s:e]).decode("utf-8", "replace")
                shas.append(hashlib.sha256("".join(joined[s:e])[1:].encode()).hexdigest())
                back_shas.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    backs.append(back)
            columns = [kernels.column(part, "__id"), pa.array(np.diff(sizes)), pa.array(shas), pa.array(back_shas)]
            if with_ids:
                flat = np.frombuffer(b"".join(packed), "<i4")
                columns += [pa.ListArray.from_arrays(sizes.astype(np.int32), flat), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
