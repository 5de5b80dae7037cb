"""Repeated substrings by suffix arrays over shards of the places that can repeat.

Hashes only choose which places are worth a comparison and which of them are one class of equal places; that a string
repeats is read from a suffix array's common prefixes, of which every class sends two members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm import kernels
from cadenza.session import broadcast_up_to, materialize

#: Symbols hashed at each place for the choice of anchors: bytes, and words.
GRAM, GRAM_WORDS = 32, 4
#: Text of one suffix array, and of one group of places that have to share it; larger groups are divided.
SHARD_BYTES, GROUP_BYTES = 1 << 20, 1 << 19
#: Alphabets up to this size are induced bucket by bucket; in larger ones most buckets are nearly empty.
BUCKETS = 1024
#: Rows of one or two hashes (anchors that repeat, documents to look up) are broadcast up to this number; else a shuffle
#: joins them.
BROADCAST_ROWS = 2_000_000
#: Neighbouring classes that the same two documents stand for are compared together, in stretches up to this size.
STRETCH = 1 << 16
BYTES, WORDS = 0, 1


# --- suffix array by induced sorting -------------------------------------------------------------------------------


def _split(received: list[list[np.ndarray]], text: np.ndarray, places: np.ndarray) -> None:
    """Append the places to the lists of their first symbols, in order."""
    if not len(places):
        return
    symbols = text[places]
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols, prepend=symbols[:1] + 1))
    for s, e in zip(cuts, [*cuts[1:], len(places)], strict=True):
        received[symbols[s]].append(places[s:e])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _before(places: np.ndarray) -> np.ndarray:
    return places[places > 0] - 1


def _waves(text: np.ndarray, places: np.ndarray, symbol: int) -> list[np.ndarray]:
    """The places of a bucket, then those before them with the same symbol, and so on."""
    out = []
    while len(places):
        out.append(places)
        before = _before(places)
        places = before[text[before] == symbol]
    return out


def _by_buckets(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-S ones in the order given, one symbol's bucket after another."""
    k = int(text.max()) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]
    _split(seeds, text, lms)
    found: list[np.ndarray] = []
    for c in range(k):  # suffixes larger than their successor, smallest bucket first
        mine = _joined(_waves(text, _joined(larger[c]), c))
        found.append(mine)
        before = _before(np.concatenate([mine, *seeds[c]]))
        _split(larger, text, before[text[before] > c])
    out: list[np.ndarray] = []
    smaller[0] = [np.array([len(text) - 1])]
    for c in range(k - 1, -1, -1):  # the others, each bucket from its end
        mine = _joined(_waves(text, _joined(smaller[c]), c))
        before = _before(np.concatenate([mine, found[c][::-1]]))
        _split(smaller, text, before[text[before] < c])
        out += [mine[::-1], found[c]]
    return np.concatenate(out[::-1])


def _along(text: np.ndarray, places: np.ndarray, ends: np.ndarray, rank: np.ndarray, ends_first: bool) -> np.ndarray:
    """The places in order; each one's suffix runs on to the next place until it meets one of the ends, whose ranks are
    known (rank, by place). At equal symbols an end is the smaller one if ends_first.

    All symbols' buckets are filled together: places are ranked by their first symbol, then by where twice as many
    symbols lead each time, until a run has met its end.
    """
    m, size = len(places), len(places) + len(ends)
    both = np.concatenate([places, ends])
    slot = np.zeros(len(text) + 1, np.int64)
    slot[both] = np.arange(size)
    to = np.concatenate([slot[places + 1], np.arange(m, size)])
    key = text[both].astype(np.int64) * 2
    key[:m] += ends_first
    key[m:] += not ends_first
    key *= len(text)
    key[m:] += rank[ends]
    order = np.argsort(key)
    head = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    now = np.empty(size, np.int64)  # the place in order of the first one of equal rank
    now[order] = np.maximum.accumulate(np.where(head, np.arange(size), 0))
    while not head.all():
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # only these are sorted again
        mine = order[tied]
        key = now[mine] * size + now[to[mine]]
        again = np.argsort(key)
        key, mine = key[again], mine[again]
        order[tied] = mine
        head[tied[1:]] = key[1:] != key[:-1]
        now[mine] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        to = to[to]
    return both[order[order < m]]


def _by_chains(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-S ones in the order given, all buckets of a type at once."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    rank[lms] = np.arange(len(lms))
    larger = np.flatnonzero(~is_s)
    if not len(larger):
        return lms
    order_l = _along(text, larger, lms, rank, False)
    rank[order_l] = np.arange(len(order_l))
    smaller = np.flatnonzero(is_s[:-1])
    met = larger[is_s[larger - 1]] if larger[0] else larger[1:][is_s[larger[1:] - 1]]
    order_s = _along(text, smaller, met, rank, True) if len(smaller) else smaller
    order_s = np.concatenate([[n - 1], order_s])
    both = np.concatenate([order_l, order_s])  # in a bucket those of type L come first
    return both[np.argsort(text[both], kind="stable")]


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    return _by_buckets(text, lms) if int(text.max()) < BUCKETS else _by_chains(text, is_s, lms)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many of the first symbols at places a and b are equal, at most lengths (each at least 1)."""
    at = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(at, lengths)
    unlike = text[np.repeat(a, lengths) + inside] != text[np.repeat(b, lengths) + inside]
    return np.minimum.reduceat(np.where(unlike, inside, np.repeat(lengths, lengths)), at) if len(a) else lengths


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols 0 to k - 1, whose last one is the only 0.

    The leftmost-S substrings are put in order by a first induction, named, and their string is sorted by recursion if a
    name repeats; a second induction from the sorted ones gives all suffixes.
    """
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    after = np.sign(text[1:].astype(np.int64) - text[:-1])  # 1: smaller than its successor, so of type S
    change = np.flatnonzero(after)
    is_s = np.ones(n, bool)
    is_s[:-1] = np.repeat(after[change] > 0, np.diff(change, prepend=-1))  # equal ones as the next unlike one
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    rough = _induce(text, is_s, lms)
    marked = np.zeros(n, bool)
    marked[lms] = True
    order = rough[marked[rough]]
    ends = np.zeros(n, np.int64)
    ends[lms] = np.append(lms[1:] + 1, n)
    lengths = ends[order] - order
    new = np.diff(lengths, prepend=-1) != 0
    same = np.flatnonzero(~new)
    new[same] = _equal(text, order[same - 1], order[same], lengths[same]) < lengths[same]
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(new) - 1
    if names[order[-1]] + 1 < len(lms):
        order = lms[suffix_array(names[lms])]
    return _induce(text, is_s, order)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, window: int) -> np.ndarray:
    """For each place the length of the prefix its suffix shares with the one before it in order; values below window
    may be too large by a chance of hashes, others are compared symbol by symbol.

    Where the symbols before the two suffixes are equal the value is one less than that of the place before; only the
    others are searched, by prefix hashes.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (phi > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[phi[reducible] - 1]
    first = np.flatnonzero(~reducible)
    prefix, found = np.zeros(n + 1, np.uint64), np.zeros(len(first), np.int64)
    np.cumsum(kernels.mix(text.astype(np.uint64) + np.uint64(1)) * kernels.powers(n + 1)[0][:-1], out=prefix[1:])
    live = np.flatnonzero(phi[first] >= 0)
    i, j = first[live], phi[first[live]]
    room = n - np.maximum(i, j)
    low, step = np.zeros(len(live), np.int64), np.full(len(live), window, np.int64)

    def same(which, length):
        a, b = i[which], j[which]
        return kernels.span_hash(prefix, a, a + length) == kernels.span_hash(prefix, b, b + length)

    growing = np.flatnonzero(room >= window)  # a shorter common prefix than the window is as good as none
    high = np.full(len(live), 1)
    while len(growing):
        to = np.minimum(step[growing], room[growing])
        equal = same(growing, to)
        low[growing[equal]] = to[equal]
        high[growing[equal]] = to[equal] + 1
        high[growing[~equal]] = np.where(low[growing[~equal]] > 0, to[~equal], 1)
        growing = growing[equal & (to < room[growing])]
        step[growing] *= 8
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        equal = same(open_, middle)
        low[open_[equal]] = middle[equal]
        high[open_[~equal]] = middle[~equal]
        open_ = open_[high[open_] - low[open_] > 1]
    sure = np.flatnonzero(low >= window)
    low[sure] = _equal(text, i[sure], j[sure], low[sure])
    found[live] = low
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    values = np.zeros(n, np.int64)
    values[first] = found
    return np.maximum(values[last] - (at - last), 0)


def repeated(segments: list[np.ndarray], window: int, owners: list | None = None) -> list[np.ndarray]:
    """For each segment of symbols (2 or more) whether the window that starts at each place also starts at another place
    of any segment, and with owners, at a place of a segment with another owner."""
    starts = np.cumsum([0, *(len(s) + 1 for s in segments)])
    text = np.ones(starts[-1] + 1, np.int64)
    text[-1] = 0
    for s, x in zip(starts, segments, strict=False):
        text[s : s + len(x)] = x
    if text.max() < 1 << 16:
        text = text.astype(np.uint16)
    sa = suffix_array(text)
    enough = permuted_lcp(text, sa, window) >= window
    if owners is None:
        twice = enough.copy()
        twice[sa[:-1]] |= enough[sa[1:]]
    else:
        numbers = {o: k for k, o in enumerate(dict.fromkeys(owners))}
        own = np.repeat([*map(numbers.__getitem__, owners), -1], [*np.diff(starts), 1])[sa]
        heads = np.flatnonzero(~enough[sa])
        unlike = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
        twice = np.zeros(len(text), bool)
        twice[sa] = np.repeat(unlike, np.diff(np.append(heads, len(sa))))
    return [twice[s : s + max(0, len(x) - window + 1)] for s, x in zip(starts, segments, strict=False)]


# --- which places can repeat ---------------------------------------------------------------------------------------


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _middle(window: int, gram: int) -> int:
    """Windows whose anchor lies at most so far from their start are looked for apart from the others."""
    return (window - gram) // 2


def anchored_runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, over rows of symbols with hashes: row, anchor, first and last window start
    in the row, fingerprint, halves and context hash.

    A window's anchor is its leftmost gram with the smallest hash, so equal windows have equal anchors at equal places.
    Halves are 32 bits each of the symbols that all windows share whose anchor is near their start (high bits) or is not.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 3)
    if len(values) < window:
        return none
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * kernels.powers(n + 1)[0][:n], out=prefix[1:])
    at = np.arange(n - gram + 1)
    grams = kernels.mix(kernels.span_hash(prefix, at, at + gram))
    bits = np.uint64(n.bit_length())
    least = _sliding_min((grams >> bits << bits) | at.astype(np.uint64), window - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(starts)]
    ok = starts + window <= offsets[row + 1]
    changed = np.ones(len(starts), bool)
    changed[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
    first = np.flatnonzero(ok & changed)
    if not len(first):
        return none
    ends = np.ones(len(starts), bool)
    ends[:-1] = changed[1:] | ~ok[1:]
    last = np.flatnonzero(ok & ends)
    anchor, row, half = anchor[first], row[first], _middle(window, gram)
    shape = (anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    context = kernels.mix(kernels.span_hash(prefix, first, last + window) + kernels.mix(shape)) | np.uint64(1)
    near, far = last >= anchor - half, first < anchor - half
    right = np.where(near, kernels.mix(kernels.span_hash(prefix, anchor, np.where(near, anchor + window - half, anchor))), 0)
    left = np.where(far, kernels.mix(kernels.span_hash(prefix, np.where(far, anchor - half - 1, anchor), anchor + gram)), 0)
    halves = right >> np.uint64(32) << np.uint64(32) | left >> np.uint64(32)
    base = offsets[row]
    return row, anchor - base, first - base, last - base, grams[anchor], halves, context


def _pieces(buf: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows' bytes, a long row in pieces that overlap by a window less one: (place in the row, bytes, offsets)."""
    if len(offsets) > 2 or len(buf) <= 4 * kernels.SLICE_BYTES:
        yield 0, buf, offsets
        return
    for s in range(0, len(buf) - window + 1, kernels.SLICE_BYTES):
        piece = buf[s : s + kernels.SLICE_BYTES + window - 1]
        yield s, piece, np.array([0, len(piece)])


ANCHORS = "__id long, __hash long, kind int, at int, first int, last int, start int, size int, print long, halves long, context long"


def _anchors(docs: DataFrame, window: int, passage: int) -> DataFrame:
    """The runs of all documents, in bytes and in words, each with the place and size of its bytes."""
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for part in kernels.slices(batches, "__text"):
            buf, offsets = kernels.flatten(kernels.column(part, "__text"))
            found = []
            for base, piece, cuts in _pieces(buf, offsets, window):
                row, at, first, last, *hashes = anchored_runs(kernels._VALUES[piece], cuts, window, min(GRAM, window))
                found.append((row, BYTES, at + base, first + base, last + base, first + base, last - first + window, *hashes))
            if passage:
                starts, ends, cuts = kernels.words(buf, offsets)
                values = kernels.mix(kernels.span_hash(kernels.prefix_hash(buf), starts, ends) + (ends - starts).astype(np.uint64))
                row, at, first, last, print_, *hashes = anchored_runs(values, cuts, passage, min(GRAM_WORDS, passage))
                begin = starts[cuts[row] + first]
                size = ends[cuts[row] + last + passage - 1] - begin
                found.append((row, WORDS, at, first, last, begin - offsets[row], size, ~print_, *hashes))
            for row, kind, *columns in found:
                ints = [pa.array(c.astype(np.int32)) for c in columns[:5]]
                longs = [pa.array(c.view(np.int64)) for c in columns[5:]]
                own = [kernels.column(part, c).take(pa.array(row)) for c in ("__id", "__hash")]
                kinds = pa.array(np.full(len(row), kind, np.int32))
                yield pa.RecordBatch.from_arrays([*own, kinds, *ints, *longs], names=names)

    return docs.mapInArrow(run, ANCHORS)


# --- deciding by suffix arrays -------------------------------------------------------------------------------------
#
# A part is a stretch of one class's bytes: its group (key), the class (c1, c2) and the kind, the document (__id, __hash),
# its first and last window (lo, hi) counted from the class's first one, the anchor (off, counted likewise), the least
# and the greatest distance of an anchor that the group is for (near, far), and the bytes.
PARTS = "key long, c1 long, c2 long, kind int, __id long, __hash long, lo int, hi int, off int, near int, far int, bytes binary"
SPANS = "c1 long, c2 long, s int, e int"


def _symbols(kind: int, data: list[bytes]) -> list[np.ndarray]:
    if kind == BYTES:
        return [np.frombuffer(d, np.uint8).astype(np.uint16) + 2 for d in data]
    numbers: dict[bytes, int] = {}
    return [np.array([numbers.setdefault(w, len(numbers) + 2) for w in d.split()], np.int64) for d in data]


def _spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _by_suffix_array(parts: DataFrame, sizes: dict) -> DataFrame:
    """Runs of repeated windows, counted from the class's first one, of parts whose groups are small enough."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        kind = int(shard["kind"].iloc[0])
        owners = list(zip(shard["__id"], shard["__hash"], strict=True)) if kind == WORDS else None
        flags = repeated(_symbols(kind, shard["bytes"].tolist()), sizes[kind], owners)
        rows = []
        for c1, c2, lo, flag in zip(shard["c1"].tolist(), shard["c2"].tolist(), shard["lo"].tolist(), flags, strict=True):
            rows += [(c1, c2, lo + s, lo + e) for s, e in zip(*_spans_of(flag), strict=True)]
        out = pd.DataFrame(rows, columns=["c1", "c2", "s", "e"]).drop_duplicates()
        return out.astype({"c1": "int64", "c2": "int64", "s": "int32", "e": "int32"})

    return parts.groupBy("kind", "shard").applyInPandas(run, SPANS)


def _divided(parts: DataFrame, sizes: dict) -> DataFrame:
    """Each part as two, for the nearer and the farther anchors; the new group's key is the symbols all its windows share."""
    schema = PARTS + ", piece long"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                window = sizes[r["kind"]]
                joint, units = (b"", [r["bytes"][i : i + 1] for i in range(len(r["bytes"]))]) if r["kind"] == BYTES else (b" ", r["bytes"].split())
                middle = (r["near"] + r["far"]) // 2
                for near, far in ((r["near"], middle), (middle + 1, r["far"])):
                    lo, hi = max(r["lo"], r["off"] - far), min(r["hi"], r["off"] - near)
                    if near > far or lo > hi:
                        continue
                    mine = joint.join(units[lo - r["lo"] : hi - r["lo"] + window])
                    core = joint.join(units[r["off"] - near - r["lo"] : r["off"] - far + window - r["lo"]])
                    short = lambda *x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little", signed=True)
                    rows.append(r | {"key": short(r["key"], near, far, core), "lo": lo, "hi": hi, "near": near, "far": far, "bytes": mine, "piece": short(r["off"] - lo, mine)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*batch.schema, pa.field("piece", pa.int64())]))

    return parts.mapInArrow(run, schema)


def _decided(parts: DataFrame, sizes: dict) -> DataFrame:
    """Runs of repeated windows of all parts. A group too large for one suffix array is divided by the distance from
    window to anchor, as far as single distances, where all windows of a group are equal; equal parts become one class,
    of which two members go on."""
    groups = materialize(parts.groupBy("key").agg(F.sum(F.length("bytes")).alias("n"), F.max(F.col("far") - F.col("near")).alias("range")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = groups.filter((F.col("n") > GROUP_BYTES) & (F.col("range") > 0)).select("key")  # at most total / GROUP_BYTES rows
    any_large = large.limit(1).count()
    small = parts.join(broadcast_up_to(large, BROADCAST_ROWS), "key", "left_anti") if any_large else parts
    shard = F.pmod(F.hash("key"), F.lit(max(1, -(-total // SHARD_BYTES)))).alias("shard")
    spans = _by_suffix_array(small.select("*", shard), sizes)
    if not any_large:
        return spans
    pieces = materialize(_divided(parts.join(broadcast_up_to(large, BROADCAST_ROWS), "key", "left_semi").select(*parts.columns), sizes), "pieces")
    member = F.struct("__id", "__hash", "c1", "c2", "kind", "lo", "hi", "off", "near", "far", "bytes")
    classes = pieces.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(member).alias("one"), F.max(member).alias("two"))
    two = F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))
    classes = classes.select("key", "piece", F.explode(two).alias("m"))
    fields = [F.col(f"m.{c}") for c in ("kind", "__id", "__hash", "lo", "hi", "off", "near", "far", "bytes")]
    # Windows are counted from the part's own first one, as parts of one class begin at different windows of theirs.
    own = classes.select("key", F.col("key").alias("c1"), F.col("piece").alias("c2"), *fields)
    own = own.select("key", "c1", "c2", "kind", "__id", "__hash", F.lit(0).alias("lo"), (F.col("hi") - F.col("lo")).alias("hi"), (F.col("off") - F.col("lo")).alias("off"), "near", "far", "bytes")
    found = _decided(materialize(own, "parts"), sizes).withColumnsRenamed({"c1": "key", "c2": "piece"})
    back = pieces.select("key", "piece", "c1", "c2", "lo").join(found, ["key", "piece"])
    return spans.unionAll(back.select("c1", "c2", (F.col("s") + F.col("lo")).alias("s"), (F.col("e") + F.col("lo")).alias("e")))


def _pairs(classes: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Two members of every class of bytes with several, those of neighbouring classes put together: the places to read,
    of stretches (c1, with c2 0), and which stretch has which class where."""
    several = classes.filter((F.col("n") > 1) & (F.col("kind") == BYTES))
    delta = F.col("two.first") - F.col("one.first")
    rows = several.select("c1", "c2", "width", "one", "two", F.col("one.first").alias("first"), F.xxhash64("one.__id", "one.__hash", "two.__id", "two.__hash", delta).alias("pair"))
    # A window frame holds the classes of two documents at one shift, which their lengths bound.
    along = Window.partitionBy("pair").orderBy("first")
    apart = F.coalesce(F.lag(F.col("first") + F.col("width")).over(along) + 1 < F.col("first"), F.lit(True))
    apart = apart | (F.floor(F.col("first") / STRETCH) != F.floor(F.lag("first").over(along) / STRETCH))
    rows = rows.withColumn("number", F.sum(apart.cast("int")).over(along))
    rows = rows.withColumn("sid", F.xxhash64("pair", "number"))
    stretches = rows.groupBy("sid").agg(
        F.min("first").alias("first"), F.max(F.col("first") + F.col("width")).alias("last"), F.min(F.struct("first", "one", "two")).alias("m"),
        F.collect_list(F.struct("c1", "c2", "first", "width")).alias("members"),
    )
    stretches = materialize(stretches, "stretches")
    whole = F.array(F.struct(F.col("sid").alias("key"), F.lit(0).alias("lo"), (F.col("last") - F.col("first")).alias("hi"), F.lit(0).alias("near"), F.lit(0).alias("far")))
    place = lambda side: stretches.select(
        F.col("sid").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(BYTES).alias("kind"), F.lit(0).alias("off"),
        f"m.{side}.__id", f"m.{side}.__hash", f"m.{side}.start", (F.col("last") - F.col("first") + window).alias("size"), whole.alias("stretches"),
    )
    members = stretches.select("sid", F.col("first").alias("base"), F.explode("members").alias("c")).select("sid", "c.c1", "c.c2", (F.col("c.first") - F.col("base")).alias("at"), "c.width")
    return place("one").unionAll(place("two")), members


def _halves(classes: DataFrame, sizes: dict) -> DataFrame:
    """The places to read of one member of every class that shares its near or far half with another class."""
    grams = {kind: min(gram, sizes[kind]) for kind, gram in ((BYTES, GRAM), (WORDS, GRAM_WORDS))}
    by_kind = lambda value: F.when(F.col("kind") == BYTES, value(BYTES)).otherwise(value(WORDS))
    half = by_kind(lambda kind: max(0, _middle(sizes[kind], grams[kind])))
    farthest = by_kind(lambda kind: max(0, sizes[kind] - grams[kind]))
    width, off = F.col("width"), F.col("off")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.greatest(F.lit(0), off - half).cast("int").alias("lo"), width.alias("hi"), F.lit(0).alias("near"), half.alias("far")),
        F.struct(F.lit(1).alias("side"), F.lit(0).alias("lo"), F.least(width, off - half - 1).cast("int").alias("hi"), (half + 1).alias("near"), farthest.alias("far")),
    )
    halves = classes.select("c1", "c2", "halves", F.explode(sides).alias("s")).select("c1", "c2", "halves", "s.*").filter("lo <= hi")
    shared = F.when(F.col("side") == 0, F.shiftright("halves", 32)).otherwise(F.col("halves").bitwiseAND(0xFFFFFFFF))
    halves = materialize(halves.select("c1", "c2", "lo", "hi", "near", "far", F.xxhash64("c1", "side", shared).alias("key")), "halves")
    several = materialize(halves.groupBy("key").count().filter("count > 1").select("key"), "keys")
    halves = halves.join(broadcast_up_to(several, BROADCAST_ROWS), "key", "left_semi")
    halves = halves.groupBy("c1", "c2").agg(F.collect_list(F.struct("key", "lo", "hi", "near", "far")).alias("stretches"))
    return classes.join(halves, ["c1", "c2"]).select("c1", "c2", "kind", "off", "one.__id", "one.__hash", "one.start", "one.size", "stretches")


def _parts_of(docs: DataFrame, places: DataFrame, sizes: dict) -> DataFrame:
    """The places' bytes, cut into their stretches."""
    places = materialize(places, "places")
    ids = materialize(places.select("__id", "__hash").distinct(), "ids")
    texts = docs.select("__id", "__hash", F.col("__text").cast("binary").alias("data"))
    texts = texts.join(broadcast_up_to(ids, BROADCAST_ROWS), ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    read = places.join(texts, ["__id", "__hash"])
    read = read.select("c1", "c2", "kind", "off", "__id", "__hash", "stretches", F.substring("data", F.col("start") + 1, F.col("size")).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]):
        names = [c.split()[0] for c in PARTS.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.binary()]
        for batch in batches:
            rows = []
            columns = (kernels.column(batch, c).to_pylist() for c in ("c1", "c2", "kind", "__id", "__hash", "off", "stretches", "bytes"))
            for c1, c2, kind, doc, key, off, stretches, data in zip(*columns, strict=True):
                words = data.split() if kind == WORDS else None
                for s in stretches:
                    e = s["hi"] + sizes[kind]
                    mine = data[s["lo"] : e] if words is None else b" ".join(words[s["lo"] : e])
                    rows.append((s["key"], c1, c2, kind, doc, key, s["lo"], s["hi"], off, s["near"], s["far"], mine))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return read.mapInArrow(run, PARTS)


def _runs(docs: DataFrame, classes: DataFrame, sizes: dict) -> DataFrame:
    """The runs of repeated windows of every class, counted from its first one. Words that a class of two documents has
    need no array; all bytes are decided by one."""
    pairs, members = _pairs(classes, sizes[BYTES])
    parts = materialize(_parts_of(docs, pairs.unionAll(_halves(classes, sizes)), sizes), "parts")
    found = materialize(_decided(parts, sizes).distinct(), "found")
    low, high = F.greatest("s", "at") - F.col("at"), F.least(F.col("e"), F.col("at") + F.col("width") + 1) - F.col("at")
    paired = members.join(found.filter("c2 = 0").select(F.col("c1").alias("sid"), "s", "e"), "sid")
    paired = paired.select("c1", "c2", low.cast("int").alias("s"), high.cast("int").alias("e")).filter("s < e")
    words = classes.filter((F.col("kind") == WORDS) & (F.struct("one.__id", "one.__hash") != F.struct("two.__id", "two.__hash")))
    words = words.select("c1", "c2", F.lit(0).alias("s"), (F.col("width") + 1).cast("int").alias("e"))
    return found.filter("c2 <> 0").unionAll(paired).unionAll(words).distinct()


def _covered(base: np.ndarray, n: int, first: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """Which of n symbols the windows that start from base + first to before base + stop cover."""
    step = np.bincount(base + first, minlength=n + 1) - np.bincount(base + stop - 1 + window, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _cut(joined: DataFrame, id_col: str, sizes: dict, with_kept: bool) -> DataFrame:
    schema = f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"

    def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    def run(batches: Iterator[pa.RecordBatch]):
        for part in kernels.slices(batches, "__text"):
            buf, offsets = kernels.flatten(kernels.column(part, "__text"))
            spans = kernels.column(part, "spans")
            row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
            kind, first, stop = (spans.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("kind", "start", "stop"))
            mine = kind == BYTES
            gone = _covered(offsets[row[mine]], len(buf), first[mine], stop[mine], sizes[BYTES])
            heads = gone.copy()
            heads[1:] &= ~gone[:-1]
            edges = offsets[:-1][np.diff(offsets) > 0]
            heads[edges] = gone[edges]
            lengths = np.zeros(len(spans), np.int64)  # words that matter, at the start of each text
            np.maximum.at(lengths, row[~mine], stop[~mine] - 1 + sizes[WORDS])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            known = _covered(ends[row[~mine]], ends[-1], first[~mine], stop[~mine], sizes[WORDS])
            kept = [buf[s:e][~gone[s:e]].tobytes() if n else buf[s:e].tobytes() for s, e, n in zip(offsets[:-1], offsets[1:], sums(gone, offsets), strict=True)]
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            counts = [pa.array(c.astype(np.int64)) for c in (np.diff(offsets), sums(gone, offsets), sums(heads, offsets), sums(known, ends))]
            columns = [kernels.column(part, "__id"), *counts[:3], pa.array(shas, pa.string()), counts[3], pa.array(kept, pa.binary())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"][: 7 if with_kept else 6]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return joined.mapInArrow(run, schema + (", kept binary" if with_kept else ""))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, passage: int = 51, with_kept: bool = False
) -> DataFrame:
    """Remove every byte of the UTF-8 texts that a string of `window` bytes covers which starts anywhere else too:
    (id_col, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words), and with with_kept the remaining bytes. One row
    per input row. n_passage_words counts the words that a run of `passage` words covers which another document has too
    (words [^\\x20\\x09-\\x0D]+, whatever space is between them); such passages may be shorter than the window and are
    reported, not removed. passage 0 leaves them out.

    Each run of windows that share an anchor (the gram with the smallest hash) has a context, its bytes or words; equal
    windows have equal anchors. Runs with one context are a class. Two members of each class of bytes with several go into
    a shard, and so does one of each class that shares the half about an anchor with another class; the shards' suffix
    arrays and permuted common prefixes tell which windows repeat, for all members of the class.

    Null counts as empty; texts shorter than the window lose nothing; texts longer than a few slices are anchored piece
    by piece; repeated rows are copies of each other, but one document for n_passage_words; a null id stays null; other
    columns are ignored.
    """
    sizes = {BYTES: window, WORDS: passage}
    docs = docs.select(F.col(id_col).cast("long").alias("__own"), F.col(text_col).alias("__text"))
    key = F.xxhash64("__text")
    docs = docs.select("__own", F.coalesce("__own", key).alias("__id"), key.alias("__hash"), "__text")
    found = materialize(_anchors(docs, window, passage), "anchors")
    several = materialize(found.groupBy("print").count().filter("count > 1").select("print"), "prints")
    shared = materialize(found.join(broadcast_up_to(several, BROADCAST_ROWS), "print", "left_semi"), "shared")
    member = F.struct("__id", "__hash", "first", "start", "size")
    classes = shared.groupBy(F.col("print").alias("c1"), F.col("context").alias("c2")).agg(
        F.count("*").alias("n"), F.min(member).alias("one"), F.max(member).alias("two"), F.first("kind").alias("kind"),
        F.first("halves").alias("halves"), F.first(F.col("last") - F.col("first")).alias("width"), F.first(F.col("at") - F.col("first")).alias("off"),
    )
    runs = materialize(_runs(docs, materialize(classes, "classes"), sizes), "runs").withColumnsRenamed({"c1": "print", "c2": "context"})
    spans = shared.select("__id", "__hash", "kind", "first", "print", "context").join(runs, ["print", "context"])
    spans = spans.select("__id", "__hash", F.struct("kind", (F.col("first") + F.col("s")).alias("start"), (F.col("first") + F.col("e")).alias("stop")).alias("span"))
    spans = materialize(spans.groupBy("__id", "__hash").agg(F.collect_set("span").alias("spans")), "spans")
    ids = broadcast_up_to(spans.select("__id", "__hash"), BROADCAST_ROWS)
    touched = docs.join(ids, ["__id", "__hash"], "left_semi").join(spans, ["__id", "__hash"])
    whole = docs.join(ids, ["__id", "__hash"], "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    names = [F.col("__own").alias("__id"), "__text", "spans"]
    return _cut(touched.select(*names).unionAll(whole.select(*names)), id_col, sizes, with_kept)
