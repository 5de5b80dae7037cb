"""Archives larger than a task reads at once, in parallel and as streams; shard files and their manifest."""

import hashlib
import io
import random
import tarfile

import pytest
import zstandard

from cadenza.operators import orchestration
from cadenza.sources import packed


def tar_of(members):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return raw.getvalue()


@pytest.fixture(scope="module")
def members():
    r = random.Random(4)
    lines = ["x" * r.choice([0, 1, 5, 90, 900]) + f" é\u2028{k}" for k in range(3000)]
    big = "\n".join(lines).encode()
    return [("d/listens/2020/1.listens", big), ("d/listens/2020/2.listens", big + b"\n"), ("d/notes.txt", b"no"), ("d/listens/2021/3.listens", b""), ("d/" + "n" * 150 + ".json", b"\n\r\nlast")]


def frames(data, size):
    return b"".join(zstandard.compress(data[k : k + size]) for k in range(0, len(data), size)) + b"\x50\x2a\x4d\x18\x03\0\0\0abc"


@pytest.mark.parametrize("step", [9, 100_000, 1 << 27])
def test_every_container_and_range_gives_the_same_lines(spark, tmp_path, members, step):
    if step == 9:
        members = [(n, d[-60:]) for n, d in members]
    raw = tar_of(members)
    (tmp_path / "a.tar").write_bytes(raw)
    (tmp_path / "b.tar.zst").write_bytes(frames(raw, 60_000 if step > 9 else 4000))
    if step == 100_000:
        import gzip

        (tmp_path / "c.tar.gz").write_bytes(gzip.compress(raw))
        chunks = zstandard.ZstdCompressor().compressobj()
        (tmp_path / "d.tar.zst").write_bytes(chunks.compress(raw) + chunks.flush())
    rows = packed.tar_lines(spark, str(tmp_path), range_bytes=step)
    got = {}
    for r in rows.collect():
        got.setdefault(r.origin.rpartition("/")[2] if "nnn" not in r.origin else r.origin[-155:], {}).setdefault(r.origin.partition("!")[0], []).append((r.line, r.value))
    want = {n.rpartition("/")[2] if "nnn" not in n else n[-155:]: d for n, d in members if n.endswith((".listens", ".json")) and d}
    assert set(got) == set(want)
    for name, data in want.items():
        lines = [x.removesuffix("\r") for x in data.decode("utf-8", "replace").removesuffix("\n").split("\n")]
        for found in got[name].values():
            assert sorted(found) == list(enumerate(lines, 1))
    assert all(len(x) == len(list(tmp_path.iterdir())) for x in got.values())


def test_ranges_are_tasks_of_their_own(spark, tmp_path, members):
    (tmp_path / "a.tar").write_bytes(tar_of(members))
    spark.dataSource.register(packed.Archive)
    read = spark.read.format("packed_archive").option("range_bytes", "100000")
    assert read.load(str(tmp_path / "*.tar")).rdd.getNumPartitions() > 12
    assert len(packed.index(str(tmp_path / "a.tar"), 0, (".listens",), None)) == 3


def test_short_archives_and_none(spark, tmp_path, members):
    raw = tar_of(members)
    (tmp_path / "cut.tar").write_bytes(raw[: len(raw) // 3])
    with pytest.raises(Exception, match="(?s)early|unexpected end"):
        packed.tar_lines(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no archive"):
        packed.tar_lines(spark, str(tmp_path / "*.zip")).collect()


def test_shards(spark, tmp_path, members):
    kept = [m for m in members if "listens" in m[0]]
    (tmp_path / "dump.tar").write_bytes(tar_of(members))
    root = str(tmp_path / "shards")
    first = packed.shard_files(spark, str(tmp_path / "dump.tar"), root, "v1")
    got = [(r.member_name, r.year, r.month, r.size_bytes, r.sha256) for r in first.orderBy("number").collect()]
    full = [m for m in kept if m[1]]
    assert got == [(n, int(n.split("/")[2]), int(n.split("/")[3].split(".")[0]), len(d), hashlib.sha256(d).hexdigest()) for n, d in full]
    for r in first.collect():
        assert hashlib.sha256((tmp_path / "shards" / "v1" / r.relative_path).read_bytes()).hexdigest() == r.sha256
    assert packed.shard_lines(spark, root, "v1").filter("month = 1").count() == 3000
    (tmp_path / "dump.tar").write_bytes(tar_of(full[:1]))
    assert packed.shard_files(spark, str(tmp_path / "dump.tar"), root, "v1").count() == 2
    assert packed.shard_files(spark, str(tmp_path / "dump.tar"), root, "v1", force=True).count() == 1
    assert len(list((tmp_path / "shards" / "v1").iterdir())) == 2
    assert packed.scheduled(first, 1).count() == 1


def test_failures_publish_nothing(spark, tmp_path, members):
    raw = tar_of(members)
    (tmp_path / "cut.tar").write_bytes(raw[: len(raw) * 2 // 3])
    (tmp_path / "twice.tar").write_bytes(tar_of([("a/listens/2020/1.listens", b"x"), ("b/listens/2020/01.listens", b"y")]))
    (tmp_path / "none.tar").write_bytes(tar_of([("a/other/2020/1.listens", b"x")]))
    for name in ("cut", "twice", "none"):
        with pytest.raises(Exception, match="(?s)early|one month|no monthly|unexpected end"):
            packed.shard_files(spark, str(tmp_path / f"{name}.tar"), str(tmp_path / name), "v1")
        assert [p for p in (tmp_path / name).rglob("*") if p.is_file()] == []
    (tmp_path / "cut.tar").write_bytes(raw)
    assert packed.shard_files(spark, str(tmp_path / "cut.tar"), str(tmp_path / "cut"), "v1").count() == 2


def test_pack(spark, tmp_path):
    rows = [("a", "m/1.json", 2, "é"), ("a", "m/1.json", 1, ""), ("a", "m/2.json", 1, "x" * 600), ("b", "n.json", 5, "y")]
    packed.pack(spark.createDataFrame(rows, "archive string, member string, line long, value string"), str(tmp_path / "out"))
    with tarfile.open(tmp_path / "out" / "a.tar") as archive:
        assert {m.name: archive.extractfile(m).read() for m in archive} == {"m/1.json": "\né\n".encode(), "m/2.json": b"x" * 600 + b"\n"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tar", "b.tar"]


def test_pack_in_parts_that_many_tasks_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "PART_BYTES", 3000)
    made, materialize = [], packed.materialize
    monkeypatch.setattr(packed, "materialize", lambda df, name: made.append(materialize(df, name)) or made[-1])
    rows = [("a", f"m/{k % 3}.json", k, f"é{k}" * (k % 5)) for k in range(600)]
    packed.pack(spark.createDataFrame(rows[::-1], "archive string, member string, line long, value string").repartition(3), str(tmp_path / "out"))
    assert made[0].select("task").distinct().count() > 8
    with tarfile.open(tmp_path / "out" / "a.tar") as archive:
        got = [(m.name, archive.extractfile(m).read().decode()) for m in archive]
    assert got == [(f"m/{j}.json", "".join(v + "\n" for _, _, k, v in rows if k % 3 == j)) for j in range(3)]
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.tar"]
    packed.pack(spark.createDataFrame([], "archive string, member string, line long, value string"), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_dispatch_of_a_prefix(spark):
    rows = [("r", k, "succeeded" if k == 1 else "pending", 1, 1) for k in range(1, 6)]
    shards = spark.createDataFrame(rows, "run string, key int, status string, session int, current int")
    assert sorted(r.key for r in orchestration.dispatch(shards, 9, max_shards=3).collect()) == [2, 3]
    assert sorted(r.key for r in orchestration.dispatch(shards, 2).collect()) == [2, 3]


def test_copy_fields(spark):
    from pyspark.sql import functions as F

    from cadenza.sources import archives

    rows = {"a\\tb\u0001": "a\tb\u0001", "\\\\n": "\\n", "\\x\\": "x\\", "\\N": None, "": "", "\\\\N": "\\N", "q\\\nr": "q\nr"}
    df = spark.createDataFrame([(k,) for k in rows], "value string")
    got = {r.value: r.f[0] for r in df.select("value", archives.copy_fields(F.col("value")).alias("f")).collect()}
    assert got == rows
