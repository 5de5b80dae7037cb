"""A content-addressed store of token ids: unique chunks, document recipes and Merkle manifests, all as Parquet.

<path>/rows/is_chunk=true   key (sha256 of the ids as little-endian unsigned 32-bit), n, ids (packed): each unique chunk once
<path>/rows/is_chunk=false  the unplaced recipes
<path>/recipes    file, doc_id, start, n_tokens, chunks (sha256 in order), root: in ascending doc_id order
<path>/manifests  one row for each recipe file's range: first and last doc_id, start, n_docs, n_tokens, Merkle root
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm import bpe, kernels
from cadenza.session import materialize

#: Ids hashed together by the rolling hash, and bounds of a chunk; the mean lies a little over 2 ** CUT_BITS.
ROLL, CUT_BITS, SHORTEST, LONGEST = 16, 9, 128, 4096
END_ID = 0
#: Chunks, and encoded pieces (about 100 bytes each), that a worker remembers before it forgets all.
REMEMBER, REMEMBER_PIECES = 400_000, 1_000_000
#: Bytes of text that a task encodes at once; more of them share the search for known pieces.
SLICE_BYTES = 1 << 20


def marks(ids: np.ndarray) -> np.ndarray:
    """Where a stream may be cut: the ends of all runs of ROLL ids whose hash begins with CUT_BITS zero bits.

    The hash is a polynomial over the run's ids; it is rolled by differences of one running sum.
    """
    n = len(ids) - ROLL + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, inverse = kernels.powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(kernels.mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    rolling = (sums[ROLL:] - sums[:n]) * inverse[:n]
    return np.flatnonzero(kernels.mix(rolling) >> np.uint64(64 - CUT_BITS) == 0) + ROLL


def cuts(marked: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids with these marks: neither too short, but for the last, nor too long."""
    out, last = [], 0
    for to in [*marked, n]:
        while to - last > LONGEST:
            last += LONGEST
            out.append(last)
        if to - last >= SHORTEST or to == n > last:
            out.append(to)
            last = to
    return out


def chunk_ends(streams: list[np.ndarray]) -> list[list[int]]:
    """cuts() of every stream; they are hashed together, and runs that cross from one to the next do not count."""
    ends = np.cumsum([0, *map(len, streams)])
    found = marks(np.concatenate(streams)) if streams else np.zeros(0, np.int64)
    own = np.searchsorted(ends, found, "left") - 1
    inside = found - ends[own] >= ROLL
    found, own = found[inside] - ends[own[inside]], own[inside]
    at = np.searchsorted(own, np.arange(len(streams) + 1))
    return [cuts(found[at[k] : at[k + 1]].tolist(), len(s)) for k, s in enumerate(streams)]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Hash pairs level by level; an odd one moves up. No leaves: the hash of nothing."""
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


class Known:
    """Pieces that a worker has encoded, by 64-bit hash in ascending order; their code points and ids lie in one array each."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.places = np.zeros((1 << 12, 4), np.int64)  # by slot: where ids begin, how many there are, and the same of code points
        self.ids, self.points, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.uint32), [0, 0]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of these ascending hashes is or belongs, and which of them are new."""
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        return at, new

    def holds(self, at: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bool:
        """Whether the pieces at these places have these code points."""
        begins, sizes = self.places[self.slots[at], 2:].T
        return np.array_equal(sizes, lengths) and np.array_equal(_pick(self.points, begins, lengths), _pick(points, starts, lengths))

    def add(self, at: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> None:
        """New pieces at the places that find() gave for their hashes; ids and code points lie one piece after another."""
        first, n = len(self.hashes), len(hashes)
        while first + n > len(self.places):
            self.places = np.concatenate([self.places, np.zeros_like(self.places)])
        for k, (name, data, counts) in enumerate((("ids", ids, sizes), ("points", points, lengths))):
            held = getattr(self, name)
            while self.used[k] + len(data) > len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            held[self.used[k] : self.used[k] + len(data)] = data
            setattr(self, name, held)
            self.places[first : first + n, 2 * k] = self.used[k] + np.cumsum(counts) - counts
            self.places[first : first + n, 2 * k + 1] = counts
            self.used[k] += len(data)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, np.arange(first, first + n))


@lru_cache(1)
def _tools(path: str):
    """The tokenizer, a splitter, the bytes of each id's string, and the worker's memory of encoded pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocab = tokenizer.get_vocab()
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = len(token)  # a byte-level string has a character for each byte
    return tokenizer, bpe.Splitter(special), sizes, Known()


def _encoded(tokenizer, sizes_of: np.ndarray, pieces: list[str], lengths: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' ids in a row and how many each has; lengths are their bytes. Where each one's ids end follows from the
    ids' byte counts. Pieces that the tokenizer itself would cut apart (split) go to it as one string."""
    found, counts = [], []
    for k in range(0, len(pieces), 8192):
        part = pieces[k : k + 8192]
        got = tokenizer.encode_batch_fast(["".join(part) if split else part], is_pretokenized=not split, add_special_tokens=False)
        ids = np.array(got[0].ids, "<u4")
        wanted, covered = np.cumsum(lengths[k : k + 8192]), np.cumsum(sizes_of[ids])
        ends = np.searchsorted(covered, wanted) + 1
        if len(covered) < ends[-1] or not np.array_equal(covered[ends - 1], wanted):
            raise ValueError("the tokenizer's ids do not cover its input")
        found.append(ids)
        counts.append(np.diff(ends, prepend=0))
    return np.concatenate(found), np.concatenate(counts)


def _encoded_pieces(tools, cut: bpe.Pieces, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces at these places, one piece after another, and how many each has."""
    tokenizer, splitter, sizes_of, _ = tools
    starts, stops, points = cut.starts[places], cut.stops[places], cut.points
    lengths = stops - starts
    own = _pick(points, starts, lengths)
    last = np.concatenate([[0], np.cumsum(lengths)])
    width = np.concatenate([[0], np.cumsum(1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000))])
    letters = np.concatenate([[0], np.cumsum(splitter.classes[own] == bpe.LETTER)])
    # A space and letters, after which another such piece starts a new one for the tokenizer too.
    plain = (points[starts] == 32) & (lengths > 1) & (letters[last[1:]] - letters[last[:-1]] == lengths - 1)
    width = width[last[1:]] - width[last[:-1]]
    parts, begins, sizes, total = [], np.zeros(len(places), np.int64), np.zeros(len(places), np.int64), 0
    for split in (True, False):
        mine = np.flatnonzero(plain == split)
        if len(mine):
            ids, counts = _encoded(tokenizer, sizes_of, cut.strings(places[mine]), width[mine], split)
            begins[mine], sizes[mine] = total + np.cumsum(counts) - counts, counts
            total += len(ids)
            parts.append(ids)
    return _pick(np.concatenate(parts), begins, sizes), sizes


def _pick(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of an array one after another."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """The library's ids of every text: it encodes each distinct piece between its own word boundaries once.

    A piece counts as known if its code points are those of a known one. Where a hash stands for two contents, which
    only contrived texts bring about, the texts' distinct pieces are encoded anew and not remembered."""
    tools = _tools(path)
    known = tools[3]
    cut = bpe.Pieces(tools[1], texts)
    if len(known.hashes) > REMEMBER_PIECES:
        known.clear()
    starts = cut.starts[cut.places]
    lengths = cut.stops[cut.places] - starts
    at, new = known.find(cut.hashes)
    if not len(starts):
        return [np.zeros(0, "<u4") for _ in texts]
    if cut.clash or not known.holds(at[~new], cut.points, starts[~new], lengths[~new]):
        ids, sizes = _encoded_pieces(tools, cut, cut.places)
        begins = np.cumsum(sizes) - sizes
    else:
        if new.any():
            own = _pick(cut.points, starts[new], lengths[new])
            known.add(at[new], cut.hashes[new], *_encoded_pieces(tools, cut, cut.places[new]), own, lengths[new])
            at, _ = known.find(cut.hashes)
        ids, (begins, sizes) = known.ids, known.places[known.slots[at], :2].T
    counts = sizes[cut.number]
    flat = _pick(ids, begins[cut.number], counts)
    at = np.concatenate([[0], np.cumsum(counts)])[cut.first]
    return [flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]


def pack(ids: np.ndarray) -> bytes:
    """Little-endian ids as one zstandard frame, after a byte that tells their width: 2 where all fit, else 4."""
    width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
    return bytes([width]) + _squeezer().compress(ids.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}").astype("<u4")


@lru_cache(1)
def _squeezer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


MANIFESTS = "file int, first_id long, last_id long, start long, n_docs long, n_tokens long, root binary"
ROWS = "is_chunk boolean, key binary, n long, ids binary, doc_id long, chunks array<binary>"


def _rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of two kinds: a recipe for each document (key: its id and root), and chunks (key: sha256), each of them
    about once in a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()
        kinds = [pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())]
        for part in kernels.slices(batches, "__text", SLICE_BYTES):
            if len(seen) > REMEMBER:
                seen.clear()
            texts = [t or "" for t in kernels.column(part, "__text").to_pylist()]
            rows = []
            streams = [np.append(ids, np.uint32(END_ID)).astype("<u4") for ids in encode_texts(tokenizer_path, texts)]
            for doc, ids, ends in zip(kernels.column(part, "__id").to_pylist(), streams, chunk_ends(streams), strict=True):
                last, chunks = 0, []
                for to in ends:
                    sha = hashlib.sha256(ids[last:to].tobytes()).digest()
                    if sha not in seen:
                        rows.append((True, sha, to - last, pack(ids[last:to]), None, None))
                        seen.add(sha)
                    chunks.append(sha)
                    last = to
                key = hashlib.sha256(f"{doc}:".encode() + merkle_root(chunks)).digest()
                rows.append((False, key, len(ids), None, doc, chunks))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["is_chunk", "key", "n", "ids", "doc_id", "chunks"])

    return docs.mapInArrow(run, ROWS)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS + ", copies long").parquet(f"{path}/rows")


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append END_ID, and write the store below path (see the module's docstring).

    Documents are in ascending id order, rows without an id first; rows that repeat an id follow each other, each with
    a recipe of its own. Null and empty texts hold the end id alone. A chunk that any documents share is stored once.
    Other columns are ignored; an empty table writes an empty store. A text of any length is encoded whole, by one task.
    Ids must be numbers.

    Chunks and recipes leave the encoding tasks in one shuffle, so texts are encoded once and chunks move once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # Dealt out first: a task has almost no repeats of its own left to put together before the shuffle.
    rows = _rows(docs, tokenizer_path).repartition("is_chunk", "key").groupBy("is_chunk", "key").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "ids", "doc_id", "chunks"))
    )
    rows.write.option("compression", "snappy").partitionBy("is_chunk").parquet(f"{path}/rows")
    found = _stored(spark, path).filter("not is_chunk").select(
        "doc_id", F.col("n").alias("n_tokens"), "key", "chunks", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    files = max(1, found.rdd.getNumPartitions())
    order = (F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("copy"))
    ordered = found.repartitionByRange(files, *order).withColumn("file", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    sums = ordered.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # A row for each file, so the one task of this window has no more rows than there are files.
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sums.select("file", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ordered.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, "file")
    placed = placed.select("file", "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "chunks")
    _with_roots(placed).sortWithinPartitions("file", "start").write.parquet(f"{path}/recipes")
    _manifests(docs.sparkSession.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifests")


def _manifests(recipes: DataFrame) -> DataFrame:
    """A row for each file's range of recipes, with the Merkle root over their roots."""
    by_file = recipes.groupBy("file").agg(
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
        F.min("start").alias("start"),
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.transform(F.array_sort(F.collect_list(F.struct("start", "root"))), lambda r: r["root"]).alias("roots"),
    )
    return _rooted(by_file)


def _with_roots(recipes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            roots = [merkle_root(leaves) for leaves in kernels.column(batch, "chunks").to_pylist()]
            yield batch.append_column("root", pa.array(roots, pa.binary()))

    return recipes.mapInArrow(run, "file int, doc_id long, start long, n_tokens long, chunks array<binary>, root binary")


def _rooted(manifests: DataFrame) -> DataFrame:
    """The roots of a file's documents replaced by the root of their tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            roots = pa.array([merkle_root(leaves) for leaves in kernels.column(batch, "roots").to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("roots"), "root", roots)

    return manifests.mapInArrow(run, MANIFESTS)


def _unlike(recipes: DataFrame, path: str, schema: str) -> DataFrame:
    """No rows, of this schema; an error where the recipes' manifests, built again, differ from the stored ones."""
    spark = recipes.sparkSession
    try:
        stored = spark.read.schema(MANIFESTS).parquet(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], MANIFESTS)
    fields = [c.split()[0] for c in MANIFESTS.split(", ")]
    sides = [df.select("file", F.struct(*fields).alias(side)) for df, side in ((_manifests(recipes), "built"), (stored, "stored"))]
    unlike = sides[0].join(sides[1], "file", "full").filter(~F.col("built").eqNullSafe(F.col("stored"))).select("file")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                raise ValueError(f"the recipes of file {batch.column(0)[0].as_py()} differ from their manifest")
        yield from ()

    return unlike.mapInArrow(run, schema)


def _shift(length: int) -> int:
    """x to the power 8 * length modulo the crc32 polynomial, bits reversed as crc32 has them."""
    out, base = 1 << 31, 1 << 23
    while length:
        if length & 1:
            out = _times(out, base)
        base, length = _times(base, base), length >> 1
    return out


def _times(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


_shift_of = lru_cache(1 << 16)(_shift)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """The crc32 of byte strings in a row, from each one's crc32 and length."""
    out = 0
    for crc, length in parts:
        out = _times(_shift_of(length), out) ^ crc
    return out


def _opened(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """(sha, n, crc[, ids]) of every stored chunk, after a check of its bytes against its address."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for sha, packed in zip(kernels.column(batch, "key").to_pylist(), kernels.column(batch, "ids").to_pylist(), strict=True):
                data = unpack(packed).tobytes()
                if hashlib.sha256(data).digest() != sha:
                    raise ValueError(f"a chunk differs from its address {sha.hex()}")
                rows.append((sha, len(data) // 4, zlib.crc32(data), np.frombuffer(data, "<u4").tolist() if with_ids else None))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            size = 4 if with_ids else 3
            yield pa.RecordBatch.from_arrays(columns[:size], names=["sha", "n", "crc", "ids"][:size])

    kept = "sha binary, n long, crc long" + (", ids array<long>" if with_ids else "")
    return _stored(spark, path).filter("is_chunk").select("key", "ids").mapInArrow(run, kept)


def _parts(spark: SparkSession, path: str, with_ids: bool) -> tuple[DataFrame, DataFrame]:
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("start", F.posexplode("chunks").alias("at", "sha"))
    return recipes, parts.join(_opened(spark, path, with_ids), "sha", "left")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored chunks alone.

    A document's crc32 comes from those of its chunks, so that no chunk's bytes are shuffled; a missing chunk, a changed
    one, a wrong length or a wrong Merkle root is an error, as are recipes of a file that differ from its manifest in
    number, tokens, range or root.
    """
    recipes, parts = _parts(spark, path, False)
    listed = F.array_sort(F.collect_list(F.struct("at", "sha", "n", "crc")))
    whole = recipes.select("doc_id", "start", "n_tokens", "root").join(parts.groupBy("start").agg(listed.alias("parts")), "start")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            crcs = []
            columns = [kernels.column(batch, c).to_pylist() for c in ("doc_id", "n_tokens", "root", "parts")]
            for doc, n, root, chunks in zip(*columns, strict=True):
                if any(c["crc"] is None for c in chunks) or sum(c["n"] for c in chunks) != n:
                    raise ValueError(f"document {doc} cannot be rebuilt")
                if merkle_root([c["sha"] for c in chunks]) != root:
                    raise ValueError(f"the recipe of document {doc} differs from its root")
                crcs.append(joined_crc([(c["crc"], 4 * c["n"]) for c in chunks]))
            out = [kernels.column(batch, c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kept = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return whole.mapInArrow(run, kept).unionAll(_unlike(recipes, path, kept))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids, put together from its chunks; the errors of read_digests."""
    recipes, parts = _parts(spark, path, True)
    listed = F.array_sort(F.collect_list(F.struct("at", "ids")))
    joined = parts.groupBy("start").agg(F.flatten(F.transform(listed, lambda c: c["ids"])).alias("ids"))
    lost = F.raise_error(F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(" cannot be rebuilt")))
    ids = F.when(F.size("ids") == F.col("n_tokens"), F.col("ids")).otherwise(lost.cast("array<long>")).alias("ids")
    whole = recipes.select("doc_id", "start", "n_tokens").join(joined, "start").select("doc_id", "start", "n_tokens", ids)
    rooted = _with_roots(recipes.drop("root"))  # the chunks' roots, whatever the recipes say
    return whole.unionAll(_unlike(rooted, path, "doc_id long, start long, n_tokens long, ids array<long>"))
