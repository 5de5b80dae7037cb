"""Streams: positions as offsets with carried counters, versioned tables, timers."""

import json

from pyspark.sql import functions as F

from cadenza.operators import ingest
from cadenza.sources import archives
from cadenza.streaming import listens, positions, versions


def line(k):
    if k % 7 == 3:
        return "{broken"
    if k % 7 == 5:
        return json.dumps({"user_name": f"u{k}", "payload": {"listens": [{"listened_at": k + j, "track_metadata": {"track_name": f"t{j}"}} for j in range(3)]}})
    return json.dumps({"user_name": f"u{k % 4}", "listened_at": k, "track_metadata": {"track_name": f"t{k}"} if k % 5 else None})


def at_once(spark, path):
    flat = ingest.flatten(archives.text_lines(spark, path))
    return ingest.parse(flat)


def key(rows):
    return sorted((r.origin.rpartition("/")[2], r.line, r.entry, r.reason or "", r.user or "") for r in rows.collect())


def test_goes_on_in_the_middle_of_a_file(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: positions.ingest_listens(spark, str(source), out, check, range_bytes=700)
    lines = [line(k) for k in range(90)]
    (source / "a.jsonl").write_text("\n".join(lines[:40]) + "\n")
    (source / "b.jsonl").write_text("\n".join(lines[40:60]) + "\n" + lines[60][:9])  # the last line is still being written
    run()
    assert positions.totals(spark, out).first().position.line == 20
    (source / "b.jsonl").write_text("\n".join(lines[40:70]) + "\n")
    run()
    run()
    (source / "b.jsonl").write_text("\n".join(lines[40:80]) + "\n")
    (source / "c.jsonl").write_text("\n".join(lines[80:]) + "\n")
    run()
    assert len(versions.numbers(spark, f"{out}/state")) == 2
    whole = at_once(spark, str(source)).cache()
    assert key(positions.rows(spark, out)) == key(whole)
    got = positions.totals(spark, out).first()
    assert got[1:] == ingest.counters(whole).first()[:]
    last = whole.agg(F.max(F.struct("origin", "line", "entry"))).first()[0]
    assert (got.position.origin.rpartition("/")[2], got.position.line, got.position.entry) == ("c.jsonl", last.line, last.entry)


def test_repeated_batch_counts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(line(k) for k in range(30)) + "\n")
    out = str(tmp_path / "out")
    positions.ingest_listens(spark, str(tmp_path / "in"), out, str(tmp_path / "c1"))
    before = positions.totals(spark, out).first()
    positions.ingest_listens(spark, str(tmp_path / "in"), out, str(tmp_path / "c2"))  # the checkpoint is lost, batch 0 comes again
    assert positions.totals(spark, out).first() == before


def test_start_after_a_position(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, part in (("a", range(30)), ("b", range(30, 60))):
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(line(k) for k in part) + "\n")
    out = str(tmp_path / "out")
    positions.ingest_listens(spark, str(tmp_path / "in"), out, str(tmp_path / "c"), start=("a.jsonl", 6, 1))
    whole = at_once(spark, str(tmp_path / "in"))
    later = whole.filter("not (origin like '%a.jsonl' and (line < 6 or (line = 6 and entry <= 1)))")
    assert key(positions.rows(spark, out)) == key(later) and later.count() < whole.count() - 5
    try:
        positions.ingest_listens(spark, str(tmp_path / "in"), str(tmp_path / "o2"), str(tmp_path / "c3"), start=("z.jsonl", 1, 0))
        raise AssertionError("an unknown file is an error")
    except Exception as e:
        assert "z.jsonl" in str(e)


def test_windows_table_is_always_there(spark, tmp_path):
    root, check, source = (str(tmp_path / x) for x in ("root", "check", "in"))
    rows = [(k, f"u{k % 3}", "i", f"2024-01-01 {k % 24:02d}:00:00") for k in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_name string, item string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(source)
        stream = listens.replay(spark, source, listens.LISTEN, 1)
        listens.run_to_table(listens.windows(stream, 60, "100000 hours"), root, check, ["user_name", "start"])
        assert versions.read(spark, root).agg(F.sum("plays")).first()[0] == 20 * (k + 1)
    assert len(list((tmp_path / "root").glob("v=*"))) == 2
    assert versions.read(spark, root).groupBy("user_name", "start").count().filter("count > 1").isEmpty()


def test_sessions_leave_no_empty_versions(spark, tmp_path):
    root, check, source = (str(tmp_path / x) for x in ("root", "check", "in"))
    for k in range(6):
        spark.createDataFrame([(f"s{k % 2}", "i", k)], "session_key string, item string, n int").withColumn("at", F.timestamp_seconds("n")).drop("n").write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_key string, item string, at timestamp").parquet(source)
        listens.upsert_session_items(stream, root, check, buckets=4)
    got = {r.session_key: r.plays for r in listens.newest(spark, root).collect()}
    assert got == {"s0": 3, "s1": 3}
    assert len(list((tmp_path / "root").glob("v=*"))) <= 4


def test_heartbeats_at_and_before_1970_are_not_late(spark):
    """A watermark begins at 0: a heartbeat of that second, or an earlier one, was dropped, and its run never failed."""
    from cadenza.streaming import heartbeats

    rows = [(-1, "running", -50), (0, "running", 0), (1, "running", 1199), (2, "running", 1200), (3, "completed", 0), (4, "running", 9000)]
    got = heartbeats.demo(spark, spark.createDataFrame(rows, "run long, status string, heartbeat long"), 3000, 1800).collect()
    assert {r["run"]: r["status"] for r in got} == {-1: "failed", 0: "failed", 1: "failed", 2: "running", 3: "completed", 4: "running"}
