"""Tar archives as Spark data sources: members read in parallel by byte range, written, and unpacked into shard files.

A plain tar file has an index of its headers, which reading skips between; so a member, or a range of one, is a task of its
own. A .tar.zst file of several frames with known sizes is read likewise, each task unpacking only the frames it needs. Other packed archives
can only be read from the beginning: one task streams each of them. No task holds a member; at most it holds a frame or a line.
"""

from __future__ import annotations

import bisect
import fnmatch
import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cadenza.session import broadcast_up_to, materialize

LISTEN_SUFFIXES = (".jsonl", ".ndjson", ".json", ".listens")
#: Names of archives; those after the first are streams.
PACKED = (".tar", ".tar.zst", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
#: Bytes of a member that a task reads, and of a chunk that it holds at once.
RANGE_BYTES, CHUNK_BYTES = 128 << 20, 1 << 20
#: A frame with more content is not unpacked as a whole; its archive is a stream.
FRAME_BYTES = 64 << 20
#: Bytes of lines that a task sorts when it packs them, and what a row takes besides its value.
PART_BYTES, ROW_BYTES = 64 << 20, 64
#: Ranges whose line counts are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 1_000_000

SCHEMAS = {
    "lines": "origin string, block long, at long, value string",
    "counts": "origin string, block long, n long",
    "chunks": "origin string, number long, at long, data binary",
}


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def listed(path: str, suffixes: tuple[str, ...], below: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder (and those below it), or of those that a pattern names, in order, with these
    suffixes."""
    fs, at = file_system(path)
    if any(c in at for c in "*?["):
        base = at[: min(at.find(c) for c in "*?[" if c in at)].rpartition("/")[0]
        found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if fnmatch.fnmatch(x.path, at)]
    else:
        found = [fs.get_file_info(at)]
        if found[0].type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=below))
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    files = [(scheme + x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and x.path.endswith(suffixes)]
    if not files:
        raise FileNotFoundError(f"no archive at {path}")
    return sorted(files)


def frames_of(file, size: int) -> list[tuple[int, int, int, int]] | None:
    """(begin and end in the file, begin and end of the content) of a .zst file's frames, from their headers and their blocks'; None
    if a frame does not tell its size or is too large."""
    import zstandard

    out, at, content = [], 0, 0
    while at < size:
        file.seek(at)
        head = file.read(18)
        if head[1:4] == b"\x2a\x4d\x18" and 0x50 <= head[0] < 0x60:  # a skippable frame
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        about = zstandard.get_frame_parameters(head)
        if about.content_size in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR) or about.content_size > FRAME_BYTES:
            return None
        begin, last = at, False
        at += zstandard.frame_header_size(head)
        while not last:
            file.seek(at)
            block = int.from_bytes(file.read(3), "little")
            last = bool(block & 1)
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 * about.has_checksum
        out.append((begin, at, content, content + about.content_size))
        content += about.content_size
    return out


class Frames(io.RawIOBase):
    """The content of a file's frames, to be read at any place; one frame is unpacked at a time."""

    def __init__(self, file, frames: list[tuple[int, int, int, int]]):
        self.file, self.frames, self.starts = file, frames, [f[2] for f in frames]
        self.at, self.held, self.data = 0, -1, b""

    def readable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.at

    def seek(self, offset, whence=0):
        self.at = offset + (0, self.at, self.frames[-1][3] if self.frames else 0)[whence]
        return self.at

    def readinto(self, into):
        import zstandard

        k = bisect.bisect_right(self.starts, self.at) - 1
        while 0 <= k < len(self.frames) and self.frames[k][3] <= self.at:
            k += 1
        if not 0 <= k < len(self.frames):
            return 0
        begin, end, first, _ = self.frames[k]
        if self.held != k:
            self.file.seek(begin)
            self.held, self.data = k, zstandard.decompress(self.file.read(end - begin))
        part = self.data[self.at - first : self.at - first + len(into)]
        into[: len(part)] = part
        self.at += len(part)
        return len(part)


@dataclass
class Range(InputPartition):
    """Bytes start to stop of an archive's content, within one member; a stream has no range and holds all members."""

    path: str
    origin: str = ""
    number: int = 0
    member: tuple[int, int] = (0, 0)
    start: int = 0
    stop: int = 0
    stream: bool = False
    frames: list | None = field(default=None, repr=False)


def _content(path: str, frames: list | None):
    fs, at = file_system(path)
    file = fs.open_input_file(at)
    return file if frames is None else io.BufferedReader(Frames(file, frames), CHUNK_BYTES)


def _stream(path: str):
    """The content of a packed archive from its beginning, still as a tar stream."""
    fs, at = file_system(path)
    file = fs.open_input_file(at)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)
    return file


def index(path: str, size: int, suffixes: tuple[str, ...], step: int | None) -> list[Range]:
    """The ranges of an archive's wanted members, of at most step bytes; without a step one for each member."""
    frames = None
    if not path.endswith(".tar"):
        if path.endswith(".zst"):
            with _content(path, None) as file:
                frames = frames_of(file, size)
        if frames is None:
            return [Range(path, stream=True)]
    out = []
    with _content(path, frames) as file, tarfile.open(fileobj=file, mode="r:") as archive:
        for number, m in enumerate(x for x in archive if x.isfile() and x.name.endswith(suffixes)):
            begin, end = m.offset_data, m.offset_data + m.size
            for start in range(begin, max(end, begin + 1), step or max(1, end - begin)):
                stop = min(start + step, end) if step else end
                # A line that begins in the range may end in a later frame, so all from the first one on may be needed.
                mine = frames and [f for f in frames if f[3] > max(start - 1, begin) and f[2] < end]
                out.append(Range(path, f"{path}!{m.name}", number, (begin, end), start, stop, frames=mine))
    return out


def _chunks(r: Range, suffixes: tuple[str, ...]) -> Iterator[tuple[str, int, int, bytes]]:
    """(origin, number, offset in the member, data) of a range, or of all members of a stream."""
    if not r.stream:
        with _content(r.path, r.frames) as file:
            file.seek(r.start)
            at = r.start
            while at < r.stop and (data := file.read(min(CHUNK_BYTES, r.stop - at))):
                yield r.origin, r.number, at - r.member[0], data
                at += len(data)
            if at < r.stop:
                raise EOFError(f"{r.origin} ends early")
        return
    with _stream(r.path) as file, tarfile.open(fileobj=file, mode="r|" if r.path.endswith(".zst") else "r|*") as archive:
        for number, m in enumerate(x for x in archive if x.isfile() and x.name.endswith(suffixes)):
            member, at = archive.extractfile(m), 0
            while data := member.read(CHUNK_BYTES):
                yield f"{r.path}!{m.name}", number, at, data
                at += len(data)
            if at < m.size:
                raise EOFError(f"{m.name} of {r.path} ends early")


def _lines(r: Range, suffixes: tuple[str, ...]) -> Iterator[tuple[str, list[bytes]]]:
    """Runs of lines, without line feeds, that begin within a range: (origin, lines). Lines may end after it."""
    if r.stream:
        origin, rest = None, b""
        for name, _, at, data in _chunks(r, suffixes):
            if at == 0:
                if rest:
                    yield origin, [rest]
                origin, rest = name, b""
            *whole, rest = (rest + data).split(b"\n")
            yield origin, whole
        if rest:
            yield origin, [rest]
        return
    begin, end = r.member
    with _content(r.path, r.frames) as file:
        at = max(begin, r.start - 1)
        file.seek(at)
        rest, skip, done = b"", r.start > begin, r.start >= r.stop
        while not done:
            data = file.read(min(CHUNK_BYTES, end - at))
            if not data and at < end:
                raise EOFError(f"{r.origin} ends early")
            at += len(data)
            if skip:  # up to the first line feed, which the byte before the range may be
                _, found, data = data.partition(b"\n")
                if not found and at < min(end, r.stop):
                    continue
                skip = False
                if not found or at - len(data) >= r.stop:
                    return
            *whole, rest = (rest + data).split(b"\n")
            first, over = at - len(rest) - sum(len(x) + 1 for x in whole), []
            for x in whole:
                if first >= r.stop:
                    break
                over.append(x)
                first += len(x) + 1
            done = first >= r.stop or at >= end
            if at >= end and rest and first < r.stop and len(over) == len(whole):
                over.append(rest)
            yield r.origin, over


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.what = options["path"], options.get("what", "lines")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.suffixes = tuple(options.get("suffixes", ",".join(LISTEN_SUFFIXES)).split(","))

    def partitions(self):
        ranges = [r for path, size in listed(self.path, PACKED) for r in index(path, size, self.suffixes, None if self.what == "chunks" else self.range_bytes)]
        if self.what == "counts":  # only members of several ranges need them, and of these the last does not
            ranges = [r for r in ranges if not r.stream and r.stop < r.member[1]]
        return ranges or [Range("")]

    def read(self, r: Range):
        if not r.path:
            return
        if self.what == "chunks":
            for origin, number, at, data in _chunks(r, self.suffixes):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (origin, number, at, data)], names=["origin", "number", "at", "data"])
            return
        block, at, last = r.start - r.member[0], 0, None
        for origin, lines in _lines(r, self.suffixes):
            at = at if origin == last else 0
            last = origin
            if self.what == "lines" and lines:
                values = pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines], pa.string())
                numbers = pa.array(range(at + 1, at + 1 + len(lines)), pa.int64())
                columns = [pa.array([origin] * len(lines)), pa.array([block] * len(lines), pa.int64()), numbers, values]
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "block", "at", "value"])
            at += len(lines)
        if self.what == "counts":
            yield pa.RecordBatch.from_arrays([pa.array([r.origin]), pa.array([block]), pa.array([at])], names=["origin", "block", "n"])


class Archive(DataSource):
    """Options: path, what (lines, counts or chunks), suffixes of wanted members, joined by commas, and range_bytes."""

    @classmethod
    def name(cls):
        return "packed_archive"

    def schema(self):
        return SCHEMAS[self.options.get("what", "lines")]

    def reader(self, schema):
        return ArchiveReader(self.options)


def _read(spark: SparkSession, path: str, what: str, suffixes: tuple[str, ...], range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(Archive)
    options = {"what": what, "suffixes": ",".join(suffixes), "range_bytes": str(range_bytes)}
    return spark.read.format("packed_archive").options(**options).load(path)


def tar_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = LISTEN_SUFFIXES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(origin, line, value) of the wanted members of tar archives of any size; origin is file!member.

    path names a file, a folder, or files by a pattern, in any file system that pyarrow opens. Lines end at line feeds
    alone (and a carriage return before one) and are numbered from 1 within a member. Ranges of large members are read
    in parallel; a first pass counts the lines in the ranges before.
    """
    rows = _read(spark, path, "lines", suffixes, range_bytes)
    counts = materialize(_read(spark, path, "counts", suffixes, range_bytes), "ranges")
    # What lies before the next range: a row for each range, a window for each member.
    before = F.sum("n").over(Window.partitionBy("origin").orderBy("block"))
    starts = counts.select("origin", (F.col("block") + range_bytes).alias("block"), before.alias("before"))
    out = rows.join(broadcast_up_to(starts, BROADCAST_RANGES), ["origin", "block"], "left")
    return out.select("origin", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("line"), "value")


def tar_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = LISTEN_SUFFIXES) -> DataFrame:
    """(origin, bytes, sha256) of the same members, over their bytes as they are; a task streams a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, size = None, hashlib.sha256(), 0

        def row():
            return pa.RecordBatch.from_pydict({"origin": [last], "bytes": [size], "sha256": [sha.hexdigest()]})

        for batch in batches:
            for origin, data in zip(batch.column("origin").to_pylist(), batch.column("data"), strict=True):
                if origin != last:
                    if last is not None:
                        yield row()
                    last, sha, size = origin, hashlib.sha256(), 0
                sha.update(data.as_buffer())
                size += len(data.as_buffer())
        if last is not None:
            yield row()

    return _read(spark, path, "chunks", suffixes).select("origin", "data").mapInArrow(run, "origin string, bytes long, sha256 string")


def pack(lines: DataFrame, path: str) -> None:
    """Write rows (archive, member, line, value) as path/<archive>.tar: members by name, lines by number, each ended by a line feed.

    Ranges of about PART_BYTES are sorted and written as parts, one for each member in a range; then a task streams the parts of an archive into
    it, and holds none of them. An archive appears under its name when it is whole, so a repeated task leaves the same file.
    """
    total = lines.agg(F.sum(F.octet_length("value") + ROW_BYTES)).first()[0] or 0
    key = ("archive", "member", "line")
    rows = lines.select(*key, "value").repartitionByRange(max(1, -(-total // PART_BYTES)), *key).sortWithinPartitions(*key)
    fs, root = file_system(path)
    parts = f"{root}/.parts.{uuid.uuid4().hex}"
    fs.create_dir(parts, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        made, out = [], None
        for batch in batches:
            for archive, member, task, value in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "task", "value")), strict=True):
                if out is None or (archive, member) != (made[-1]["archive"], made[-1]["member"]):
                    if out is not None:
                        out.close()
                    made.append({"archive": archive, "member": member, "task": task, "part": uuid.uuid4().hex, "bytes": 0})
                    out = fs.open_output_stream(f"{parts}/{made[-1]['part']}")
                data = value.encode() + b"\n"
                out.write(data)
                made[-1]["bytes"] += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(made)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        archive = member = out = None
        left, written = 0, 0

        def end(with_archive: bool):
            nonlocal written
            if out is not None:
                out.write(b"\0" * (-left % 512))
                written += -left % 512
                if with_archive:
                    out.write(b"\0" * 1024)
                    out.close()
                    fs.move(temporary, f"{root}/{archive}.tar")

        for batch in batches:
            for name, inner, part, size in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "part", "size")), strict=True):
                if (name, inner) != (archive, member):
                    end(name != archive)
                    if name != archive:
                        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(temporary)
                    info = tarfile.TarInfo(inner)
                    info.size = left = size
                    out.write(info.tobuf())
                    archive, member = name, inner
                with fs.open_input_stream(f"{parts}/{part}") as file:
                    while data := file.read(CHUNK_BYTES):
                        out.write(data)
                        written += len(data)
        end(True)
        yield pa.RecordBatch.from_pydict({"bytes": pa.array([written], pa.int64())})

    try:
        pieces = rows.withColumn("task", F.spark_partition_id()).mapInArrow(write, "archive string, member string, task long, part string, bytes long")
        pieces = materialize(pieces, "parts").withColumn("size", F.sum("bytes").over(Window.partitionBy("archive", "member")))
        pieces = pieces.repartition("archive").sortWithinPartitions("archive", "member", "task")
        pieces.mapInArrow(join, "bytes long").agg(F.sum("bytes")).collect()
    finally:
        fs.delete_dir(parts)


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceWriter):
    """Streams members' chunks into files of their own and hashes them; the manifest that names them is written on commit alone."""

    def __init__(self, options: dict):
        self.root, self.version, self.attempt, self.archive = (options[k] for k in ("root", "version", "attempt", "archive"))

    def write(self, rows):
        fs, root = file_system(f"{self.root}/{self.version}/{self.attempt}")
        files, out, made = [], None, []
        try:
            for row in rows:
                if out is None or row["origin"] != files[-1]["origin"]:
                    if out is not None:
                        out.close()
                    folder = f"year={row['year']}/month={row['month']}"
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    relative = f"{self.attempt}/{folder}/{uuid.uuid4().hex}.listens"
                    files.append({"origin": row["origin"], "number": row["number"], "relative_path": relative, "year": row["year"], "month": row["month"], "size_bytes": 0, "sha256": hashlib.sha256()})
                    made.append(f"{root}/{relative.partition('/')[2]}")
                    out = fs.open_output_stream(made[-1])
                out.write(row["data"])
                files[-1]["sha256"].update(row["data"])
                files[-1]["size_bytes"] += len(row["data"])
            if out is not None:
                out.close()
        except BaseException:
            for path in made:
                fs.delete_file(path)
            raise
        return Written([f | {"sha256": f["sha256"].hexdigest()} for f in files])

    def commit(self, messages):
        fs, root = file_system(f"{self.root}/{self.version}")
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["origin"].rpartition("!")[0], f["number"]))
        months = [(f["year"], f["month"]) for f in files]
        if not files or len(set(months)) < len(months):
            self.abort(messages)
            raise ValueError("no monthly shards were found" if not files else "two members are shards of one month")
        manifest = {
            "manifest_version": 1,
            "source_version": self.version,
            "archive_path": self.archive,
            "created_at": datetime.now(tz=UTC).isoformat(),
            "shard_count": len(files),
            "total_uncompressed_bytes": sum(f["size_bytes"] for f in files),
            "shards": [{"number": k, "member_name": f["origin"].partition("!")[2]} | {c: f[c] for c in ("relative_path", "year", "month", "size_bytes", "sha256")} for k, f in enumerate(files)],
        }
        with fs.open_output_stream(f"{root}/manifest.json.{self.attempt}") as out:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        fs.move(f"{root}/manifest.json.{self.attempt}", f"{root}/manifest.json")
        for old in fs.get_file_info(pyarrow.fs.FileSelector(root)):  # what earlier attempts left
            if old.type == pyarrow.fs.FileType.Directory and old.base_name != self.attempt:
                fs.delete_dir(old.path)

    def abort(self, messages):
        fs, root = file_system(f"{self.root}/{self.version}/{self.attempt}")
        if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(root)


class Shards(DataSource):
    @classmethod
    def name(cls):
        return "packed_shards"

    def schema(self):
        return "origin string, number long, year int, month int, at long, data binary"

    def writer(self, schema, overwrite):
        return ShardWriter(self.options)


def shard_files(spark: SparkSession, path: str, root: str, version: str, force: bool = False) -> DataFrame:
    """Unpack an archive's members …/listens/<year>/<month>.listens into files below root/version, and return their manifest.

    A version that has a manifest is left as it is, unless force is set; then new files are written, the manifest is swapped, and
    the old files go. Without a manifest there are no shards, whatever files a failed run has left: they go with the next commit. Each member is hashed while a task
    streams it into its file; two members of one month, or none at all, are an error, and then nothing is published.
    """
    fs, at = file_system(f"{root}/{version}")
    if force or fs.get_file_info(f"{at}/manifest.json").type != pyarrow.fs.FileType.File:
        spark.dataSource.register(Shards)
        member = r"(?:^|/)listens/(\d+)/(\d+)\.listens$"
        chunks = _read(spark, path, "chunks", (".listens",)).filter(F.col("origin").rlike(member))
        part = lambda k: F.regexp_extract(F.substring_index("origin", "!", -1), member, k).cast("int")
        rows = chunks.select("origin", "number", part(1).alias("year"), part(2).alias("month"), "at", "data")
        options = {"root": root, "version": version, "attempt": f"files-{uuid.uuid4().hex}", "archive": path}
        rows.write.format("packed_shards").mode("append").options(**options).save()
    return manifest(spark, root, version)


def manifest(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(number, member_name, relative_path, year, month, size_bytes, sha256) of a version's shards, in the archive's order."""
    shard = "number long, member_name string, relative_path string, year int, month int, size_bytes long, sha256 string"
    read = spark.read.schema(f"shards array<struct<{shard.replace(' long', ':long').replace(' string', ':string').replace(' int', ':int')}>>")
    return read.option("multiLine", True).json(f"{root}/{version}/manifest.json").select(F.inline("shards"))


def scheduled(shards: DataFrame, max_shards: int | None = None) -> DataFrame:
    """The first shards of a manifest, in its order; all of them without a limit."""
    return shards if max_shards is None else shards.orderBy("number").limit(max_shards)


def schedule_totals(shards: DataFrame, max_shards: int | None = None) -> DataFrame:
    """(shard_count, scheduled_shard_count, total_uncompressed_bytes, scheduled_uncompressed_bytes)."""
    totals = lambda rows, n, size: rows.agg(F.count("*").alias(n), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias(size))
    every = totals(shards, "shard_count", "total_uncompressed_bytes")
    return every.join(totals(scheduled(shards, max_shards), "scheduled_shard_count", "scheduled_uncompressed_bytes"), how="cross")


def shard_lines(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(year, month, value) of the lines of a version's shards; only files that its manifest names are read."""
    files = [(f"{root}/{version}/{r['relative_path']}", r["year"], r["month"]) for r in manifest(spark, root, version).collect()]
    names = spark.createDataFrame([(f.rpartition("/")[2], y, m) for f, y, m in files], "name string, year int, month int")
    lines = spark.read.option("lineSep", "\n").text([f for f, _, _ in files]).select(F.col("_metadata.file_name").alias("name"), "value")
    return lines.join(F.broadcast(names), "name").select("year", "month", "value")
