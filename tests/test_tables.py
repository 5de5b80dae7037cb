"""Tables that are read, merged, swapped and trained in parts."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import bridge, catalog, cooccurrence, games, training, vectors
from cadenza.sources import served, sinks
from cadenza.streaming import heartbeats


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_point_reads_open_few_files(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 2000 AS item", "id AS neighbour", "cast(id AS double) AS pmi")
    served.write(rows, str(tmp_path), "v1", buckets=32)
    got = served.points(spark, str(tmp_path), [7, 11, 999_999], buckets=32)
    assert got.count() == 20 and {r.item for r in got.collect()} == {7, 11}
    assert "PartitionFilters: [isnotnull(bucket" in plan(got) or "PartitionFilters: [bucket" in plan(got)
    files = got.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 3 < len(list((tmp_path / "v1").glob("bucket=*")))
    scanned = got._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert scanned <= 3
    asked = spark.createDataFrame([(7,), (8,), (8,)], "item long")
    assert sorted(r.item for r in served.matching(spark, str(tmp_path), asked, buckets=32).collect()) == [7] * 10 + [8] * 10
    assert served.points(spark, str(tmp_path), []).count() == 0


def test_two_writers_lose_no_version(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: sinks.swap(spark.range(k + 1), root, f"v{k}"), range(6)))
    assert len(list((tmp_path / "pointers").glob("0*"))) == 6
    assert sinks.current(spark, root).count() in range(1, 7)
    sinks.swap(spark.range(99), root, "last")
    assert sinks.current(spark, root).count() == 99
    with pytest.raises(ValueError, match="no version"):
        sinks.current(spark, str(tmp_path / "none"))


def test_merge_writes_touched_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, k * 10, "abc"[k % 3]) for k in range(9)], "id int, v int, part string").write.partitionBy("part").parquet(path)
    names = lambda part: sorted(p.name for p in (tmp_path / "t" / f"part={part}").glob("*.parquet"))
    before = {p: names(p) for p in "abc"}
    new = spark.createDataFrame([(6, 5, "a"), (3, 99, "a"), (3, 98, "a"), (100, 1, "a"), (1, 0, "b"), (7, None, "d")], "id int, v int, part string")
    changed = sinks.merge(spark, path, new, ["id"], "part", F.col("new_v") > F.col("old_v"))
    assert sorted((r.action, r.id, r.v) for r in changed.collect()) == [("insert", 7, None), ("insert", 100, 1), ("update", 3, 99)]
    assert names("b") == before["b"] and names("c") == before["c"] and names("a") != before["a"]
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {k: k * 10 for k in range(9)} | {3: 99, 100: 1, 7: None}
    assert sinks.merge(spark, path, new.limit(0), ["id"], "part").count() == 0
    assert sinks.merge(spark, path, new.filter("id = 6"), ["id"], "part").count() == 1 and spark.read.parquet(path).filter("id = 6").first().v == 5


def test_training_goes_on_after_it_was_killed(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    plays = spark.createDataFrame([(s, r.randrange(40)) for s in range(200) for _ in range(5)], "session_key long, item long")
    baskets, root = cooccurrence.baskets(plays), str(tmp_path)
    whole = sorted(map(tuple, cooccurrence.pmi(baskets).collect()))
    usual, calls = cooccurrence.scored, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return usual(*args)

    monkeypatch.setattr(cooccurrence, "scored", dies)
    with pytest.raises(RuntimeError):
        training.train(baskets, root, buckets=10, at_once=2)
    monkeypatch.setattr(cooccurrence, "scored", usual)
    status = {r.bucket: r.status for r in training.ledger(spark, root, 10).collect()}
    assert sorted(b for b, s in status.items() if s == "succeeded") == [0, 1, 2, 3]
    assert len(training.pairs(spark, root).collect()) < len(whole)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "pairs").rglob("bucket=0/*.parquet")}
    assert training.train(baskets.limit(0), root, buckets=10, at_once=3) == list(range(4, 10))
    assert sorted(map(tuple, training.pairs(spark, root).collect())) == whole
    assert kept == {p: p.stat().st_mtime_ns for p in (tmp_path / "pairs").rglob("bucket=0/*.parquet")}
    assert training.train(baskets, root, buckets=10) == []
    assert {r.bucket for r in training.ledger(spark, str(tmp_path / "new"), 4, start=2).filter("status = 'assumed'").collect()} == {0, 1}


def near_by_hand(rows, asked, k):
    def like(a, b):
        dot, na, nb = 0.0, 0.0, 0.0
        for x, y in zip(a, b, strict=True):
            dot += x * y
        for x in a:
            na += x * x
        for y in b:
            nb += y * y
        return vectors.rounded(np.array([dot / (na**0.5 * nb**0.5)]))[0] / 100

    out = {}
    for i in asked:
        if any(rows[i]):
            found = sorted((-like(rows[j], rows[i]), j) for j in rows if j != i and any(rows[j]))
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest_vectors_without_all_pairs(spark, spread):
    r = np.random.default_rng(5)
    places = r.standard_normal((12, 8)) * 4
    rows = {i: [float(x) for x in places[i % 12 if i % 3 else 0] + spread * r.standard_normal(8)] for i in range(900)}
    rows |= {1000: rows[0], 1001: [0.0] * 8, 1002: [-x for x in rows[3]]}
    df = spark.createDataFrame(list(rows.items()), "item long, vector array<double>")
    odd = spark.createDataFrame([(2000, None), (2001, [1.0]), (2002, [float("nan")] * 8)], df.schema)
    asked = [i for i in rows if i % 20 == 0 or i > 999]
    found, work = vectors.nearest(df.filter(F.col("item").isin(asked)), df.unionAll(odd), 7, cells=24)
    got = {}
    for x in sorted(found.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.request, []).append((x.item, x.likeness))
    assert got == near_by_hand(rows, asked, 7)
    compared, pairs = work.first()
    assert compared <= pairs and (spread > 1 or compared < 0.5 * pairs)


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "item long, vector array<float>")
    assert vectors.nearest(df.limit(0), df)[0].count() == 0 and vectors.nearest(df, df.limit(0))[0].count() == 0
    assert vectors.nearest(df, df)[0].count() == 0


def test_rounding_is_sparks(spark):
    values = [0.125, 0.135, 0.145, 0.005, 0.015, 0.994999999999999, 0.995, -0.3, 1.2, 0.285, 0.575]
    want = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "v")), 2)).collect()]
    assert (vectors.rounded(np.array(values)) / 100).tolist() == want


def test_hexagons(spark):
    points = [(1, 0.0, 180.0), (2, 0.0, -180.0), (3, 90.0, 77.0), (4, 90.0, -120.0), (5, -90.0, 10.0), (6, -90.0, 179.0), (7, 0.0, 0.0), (8, 0.1, 0.1)]
    df = spark.createDataFrame([(i, a, b, 1.0) for i, a, b in points], "id int, lat double, lng double, weight double")
    got = catalog.hexes(df, 24).collect()
    assert sorted(x.n for x in got) == [2, 2, 2, 2]
    # Every point lies in the hexagon whose centre is nearest, with the row's shift and the wrap taken into account.
    r, size = random.Random(1), 360 / (24 * 3**0.5)
    for _ in range(200):
        lat, lng = r.uniform(-80, 80), r.uniform(-180, 180)
        x = catalog.hexes(spark.createDataFrame([(1, lat, lng, 1.0)], df.schema), 24).first() if _ < 5 else None
        if x:
            best = min(((lat - 1.5 * size * b) ** 2 + min(abs(lng - 15 * (c + (b % 2) / 2) + 360 * w) for w in (-1, 0, 1, 2)) ** 2, b, c) for b in range(-8, 9) for c in range(24))
            assert (x["row"], x["col"]) == best[1:]


def test_fuzzy_ratio_is_mostly_decided_natively(spark):
    from difflib import SequenceMatcher

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeghilmnorst é", k=r.randint(1, 14)))
    rows = []
    for k in range(1500):
        a = word()
        b = a if k % 10 == 0 else "".join(c for c in a if r.random() < 0.8) + word()[:2] if k % 3 == 0 else word()
        rows.append((k, a, b))
    rows += [(2000, None, "x"), (2001, "", ""), (2002, "😀a", "😀b"), (2003, " ab ", "AB")]

    def want(a, b):
        if not a or not b:
            return False
        a, b = a.lower().strip(), b.lower().strip()
        return bool(a) and bool(b) and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.7)

    df = spark.createDataFrame(rows, "id int, guess string, answer string")
    assert {x.id: x.correct for x in games.matched(df, "guess", "answer").collect()} == {k: want(a, b) for k, a, b in rows}
    assert games.undecided(df, "guess", "answer").filter("__g is not null").count() < 0.5 * len(rows)


def test_silent_runs_expire_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def send(*events):
        spark.createDataFrame(list(events), "run long, status string, heartbeat long").coalesce(1).write.mode("append").parquet(source)
        heartbeats.run_available(spark, source, out, check, 100)
        return sorted((r.run, r.heartbeat) for r in spark.read.schema(heartbeats.EXPIRED).parquet(out).collect())

    assert send((1, "running", 1000), (2, "running", 1000), (3, "running", 1000)) == []
    assert send((1, "running", 1050), (3, "completed", 1060), (9, "running", 1100)) == []
    assert send((2, "running", 1000), (9, "running", 1101)) == [(2, 1000)]
    assert send((9, "running", 1300)) == [(1, 1050), (2, 1000)]


def test_winners_need_a_target(spark):
    pairs = spark.createDataFrame([("a", "x", 9), ("a", "y", 1), ("b", "z", 9), ("b", "x", 1), ("c", "x", 5)], "msid string, mbid string, shards int")
    items = spark.createDataFrame([("recording_mbid:x",), ("recording_mbid:y",), (None,), ("recording_mbid:x",)], "key string")
    assert [(r.msid, r.mbid) for r in bridge.winners(pairs, items, 2, 0.9).collect()] == [("a", "x")]


def test_fan_out_keeps_what_has_none(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = catalog.fan_out(
        frame([(1, 10), (2, 20), (3, 99)], "item int, track int"), frame([(10, "A"), (20, "B")], "track int, album string"),
        frame([("A", 5), ("A", 6)], "album string, artist int"), frame([(5, "g"), (5, "h")], "artist int, genre string"),
    )
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "A", 5, "g"), (1, "A", 5, "h"), (1, "A", 6, None), (2, "B", None, None)]))


def test_attribute_values_and_fingerprints(spark, tmp_path):
    rows = ['{"b": "Two Words", "a": ["X", "y", null], "n": 3, "o": {"k": "v"}, "l": []}', "[1]", None, "{}"]
    df = spark.createDataFrame([(j,) for j in rows], "j string")
    assert [r[0] for r in df.select(X.attribute_values(F.col("j"))).collect()] == [["Two Words", "X", "y"], [], [], []]
    data = random.Random(1).randbytes((1 << 20) + 500)
    (tmp_path / "f").write_bytes(data)
    assert sinks.file_fingerprint(str(tmp_path / "f"), "1") == sinks.fingerprint(data[: 1 << 20], data[-(1 << 20) :], len(data), "1")


def test_blocks_in_splits_meet_all_requests(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(r.normal(size=(400, 4)).round(2))]
    df = spark.createDataFrame(rows, "item long, vector array<double>")
    want = sorted(map(tuple, vectors.nearest(df.filter("item % 5 = 0"), df, 6, cells=3)[0].collect()))
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(vectors, "ASKED", 16)
    monkeypatch.setattr(vectors, "SPLIT", 2)
    found = vectors.nearest(df.filter("item % 5 = 0"), df, 6, cells=3)[0]
    assert sorted(map(tuple, found.collect())) == want and len(want) == 480
    # Pairs of blocks and requests go on to their comparison without an exchange.
    text = found._jdf.queryExecution().executedPlan().toString()
    compared = text.partition("MapInArrow")[2]
    assert re.search(r"(Exchange|Join)\b", compared)[1] == "Join"
