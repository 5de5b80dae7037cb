"""Closed-form cases of the operators."""

import io
import math
import random
import tarfile
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import bridge, catalog, cooccurrence, evaluation, games, gates, identity, ingest, rankers
from cadenza.sources import archives, packed, sinks


def baskets(spark, lists):
    rows = [(str(i), x) for i, items in enumerate(lists) for x in items]
    return spark.createDataFrame(rows, "session_key string, item string")


def pmi(spark, lists):
    return {(r.item_a, r.item_b): (r.co_count, r.pmi) for r in cooccurrence.pmi(cooccurrence.baskets(baskets(spark, lists))).collect()}


def test_pmi_closed_forms(spark):
    assert pmi(spark, [["a", "b"]]) == {("a", "b"): (1, 0.0)}
    got = pmi(spark, [["a", "b"], ["a", "b"], ["a", "c"], ["c", "d"], ["c", "d"]])
    assert got["a", "b"] == (2, round(math.log2(5 / 3), 9))
    assert got["a", "c"] == (1, round(math.log2(5 / 9), 9))
    got = pmi(spark, [["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"]])
    assert ("a", "b") not in got and got["a", "c"][1] == 0
    assert len(pmi(spark, [["a", "b", "c"]])) == 3
    assert pmi(spark, [["a", "a", "a", "b"]]) == {("a", "b"): (1, 0.0)}
    assert pmi(spark, [["a"]]) == {}


def test_basket_report_counts_small_ones(spark):
    r = cooccurrence.basket_report(baskets(spark, [["a"], ["a", "b"]])).first()
    assert (r.sessions, r.used, r.too_small, r["items"]) == (2, 1, 1, 2)


def test_dataset_hash_ignores_order(spark):
    a, b = baskets(spark, [["a", "b"], ["c", "d"]]), baskets(spark, [["b", "a"], ["d", "c"]])
    assert cooccurrence.dataset_hash(a).first() == cooccurrence.dataset_hash(b.orderBy(F.desc("item"))).first()


def test_list_metrics(spark):
    rows = [(1, ["x"], ["x"]), (2, ["a", "b", "x"], ["x"]), (3, ["x", "b", "y"], ["x", "y"]), (4, [], ["x"]), (5, ["x"], []), (6, ["x"], ["x", "q"])]
    lists = spark.createDataFrame(rows, "id int, ranked array<string>, relevant array<string>")
    got = {r.id: (r.recall, r.ndcg) for r in evaluation.list_metrics(lists, 3).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (1.0, 0.5) and got[4] == (0.0, 0.0) and got[5] == (0.0, 0.0)
    assert got[3][1] == pytest.approx(1.5 / (1 + 1 / math.log2(3))) and got[6][0] == 0.5
    assert {r.id: r.recall for r in evaluation.list_metrics(lists, 2).collect()}[2] == 0.0


def test_trials_hold_out_each_item(spark):
    got = evaluation.trials(baskets(spark, [["a", "b", "c"], ["z"]])).collect()
    assert sorted((r.held_out, r.seeds) for r in got) == [("a", ["b", "c"]), ("b", ["a", "c"]), ("c", ["a", "b"])]


def test_metadata_ranker(spark):
    features = spark.createDataFrame([(1, 10, 100, 5), (2, 11, 100, 6), (3, 10, 101, 6), (4, 12, 102, 5), (5, 13, 103, 9)], "item int, album int, artist int, genre int")
    got = rankers.metadata(spark.createDataFrame([("r", 1)], "request string, item int"), features).collect()
    assert [(r["item"], r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1.0), (3, 0.8), (4, 0.5)]


def test_cooccurrence_ranker_sums_and_excludes(spark):
    near = spark.createDataFrame([("a", "x", 1, 0.5), ("b", "x", 2, 0.5), ("a", "y", 1, -2.0), ("a", "b", 1, 9.0), ("a", "z", 1, 3.0)], "item string, neighbour string, co_count long, pmi double")
    seeds = spark.createDataFrame([("r", "a"), ("r", "b")], "request string, item string")
    exclude = spark.createDataFrame([("r", "z")], "request string, item string")
    got = rankers.cooccurrence(seeds, near, exclude).orderBy("rank").collect()
    assert [(r["item"], r.score, r.co_count) for r in got] == [("x", 1.0, 3), ("y", -2.0, 1)]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "item int, vector array<float>")
    got = rankers.similar_vectors(rows.filter("item = 1"), rows).collect()
    assert sorted((r["item"], r.likeness) for r in got) == [(2, 1.0), (3, 0.0)]
    assert spark.range(1).select(X.padded(F.array(F.lit(1.0).cast("float")), 3)).first()[0] == [1.0, 0.0, 0.0]


def test_gates_float_rule_and_missing(spark):
    rows = [("new", "ndcg", 0.42, "h", 1), ("old", "ndcg", 0.40, "h", 1), ("new", "recall", 0.1, "h", 1), ("old", "recall", 0.0, "h", 1), ("new", "coverage", 0.3, "h", 1)]
    got = {r.gate: r.passed for r in gates.judge(spark.createDataFrame(rows, "label string, metric string, value double, dataset string, created long"), "old").collect()}
    assert got == {"ndcg_lift": False, "recall_lift": True, "cold_regression": False, "coverage_floor": True}


def test_redirect_chain_and_cycle(spark):
    redirects = spark.createDataFrame([("a", "b", "active"), ("b", "c", "active"), ("c", "d", "active"), ("x", "y", "active"), ("y", "x", "active"), ("q", "a", "retired")], "from_id string, to_id string, status string")
    got = {r["item"]: (r.target, r.depth, r.cycle) for r in identity.follow(spark.createDataFrame([("a",), ("x",), ("q",)], "item string"), redirects).collect()}
    assert got == {"a": ("d", 3, False), "x": ("y", 1, True), "q": ("q", 0, False)}


def test_redirect_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "b", "active"), ("c", "d", "retired")], "from_id string, to_id string, status string")
    new = spark.createDataFrame([("a", "z"), ("c", "d"), ("e", "e"), ("f", "g")], "from_id string, to_id string")
    once = identity.upsert_redirects(old, new)
    want = {("a", "b", "conflict"), ("c", "d", "active"), ("f", "g", "active")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in identity.upsert_redirects(once, new).collect()} == want


def test_dominance(spark):
    pairs = spark.createDataFrame([("m", "a", 20), ("m", "b", 1), ("n", "a", 1), ("n", "b", 1), ("o", "a", 9)], "msid string, mbid string, shards long")
    got = {r.msid: (r.mbid, r.promoted) for r in bridge.dominant(pairs).collect()}
    assert got == {"m": ("a", True), "n": ("a", False)}


def test_identifiers(spark):
    df = spark.createDataFrame([("track:abc",)], "k string")
    row = df.select(X.uuid5(F.col("k")), X.safe_uuid(F.lit("{6BA7B811-9DAD-11D1-80B4-00C04FD430C8}")), X.safe_uuid(F.lit("no"))).first()
    assert row[0] == str(uuid.uuid5(uuid.UUID(X.UUID_NAMESPACE), "track:abc"))
    assert row[1] == "6ba7b811-9dad-11d1-80b4-00c04fd430c8" and row[2] is None


def test_listens_malformed_and_envelopes(spark):
    lines = [
        ("f", 1, '{"user_name":"u","listened_at":5,"track_metadata":{"track_name":"t"}}'), ("f", 2, "{broken"), ("f", 3, "[1]"), ("f", 4, "  "),
        ("f", 5, '{"user_name":"u","payload":{"listens":[{"timestamp":7,"track_metadata":{"track_name":"t"}},{"listened_at":8}]}}'),
    ]
    flat = ingest.flatten(spark.createDataFrame(lines, "origin string, line long, value string"))
    got = {(r.line, r.entry): (r.user, r.epoch, r.reason) for r in ingest.parse(flat).collect()}
    assert got == {(1, 0): ("u", 5, None), (2, 0): (None, None, "malformed"), (3, 0): (None, None, "malformed"), (5, 0): ("u", 7, None), (5, 1): ("u", 8, "metadata")}
    assert {(r.line, r.entry) for r in ingest.resume(flat, "f", 5, 0).collect()} == {(5, 1)}
    with pytest.raises(ValueError):
        ingest.resume(flat, "g", 1, 0)


def test_fuzzy_ratio(spark):
    rows = spark.createDataFrame([("bohemian rapsody", "Bohemian Rhapsody"), ("abba", "queen"), ("", "x"), ("e", "queen")], "g string, a string")
    got = [r.correct for r in games.matched(rows, "g", "a").collect()]
    assert got == [SequenceMatcher(None, "bohemian rapsody", "bohemian rhapsody").ratio() >= 0.7, False, False, True]


def test_capacity(spark):
    have = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "list int, item string, position long")
    new = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "d", 3), (2, "z", 1)], "list int, item string, ordinal long")
    assert {tuple(r) for r in catalog.append_with_capacity(have, new, 3).collect()} == {(1, "c", 3), (2, "z", 1)}


def test_containers(spark, tmp_path):
    import gzip

    import zstandard

    data = b"one\ntwo\n"
    for mode, name in (("w", "a.tar"), ("w:gz", "b.tar.gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member in ("dump/listens/2020/1.listens", "dump/readme.txt"):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (tmp_path / "c.tar.zst").write_bytes(zstandard.ZstdCompressor().compress((tmp_path / "a.tar").read_bytes()))
    rows = packed.tar_lines(spark, str(tmp_path))
    assert sorted((r.origin.split("/")[-1], r.line, r.value) for r in rows.collect()) == sorted(("1.listens", i, v) for i, v in ((1, "one"), (2, "two")) for _ in range(3))
    manifest = archives.shard_manifest(rows).collect()
    assert {(r.year, r.month, r.rows, r.bytes) for r in manifest} == {(2020, 1, 2, 6)} and len({r.digest for r in manifest}) == 1
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "x.jsonl.gz").write_bytes(gzip.compress(data))
    (tmp_path / "text" / "y.jsonl").write_bytes(data)
    assert sorted((r.line, r.value) for r in archives.text_lines(spark, str(tmp_path / "text")).collect()) == [(1, "one")] * 2 + [(2, "two")] * 2


def test_members_and_fingerprints():
    with pytest.raises(ValueError, match="b, c"):
        archives.require_members({"a": None}, ("a", "b", "c"))
    assert sinks.manifest_fingerprint({"a": 1, "b": 2}) == sinks.manifest_fingerprint({"b": 2, "a": 1})
    assert sinks.fingerprint(b"a", b"b", 2, "v1") != sinks.fingerprint(b"a", b"b", 2, "v2")


def test_metric_file(spark, tmp_path):
    df = spark.createDataFrame([('a"b\\',)], "s string").select(X.metric_line("m", F.lit(1), l=F.col("s")).alias("line"))
    sinks.metric_file(df, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ['m{l="a\\"b\\\\"} 1']


def test_stream_resume(spark, tmp_path):
    from cadenza.streaming import listens

    base = spark.createDataFrame([("u", "a", "2024-01-01 00:00:00")], "user_name string, item string, at string").withColumn("at", F.col("at").cast("timestamp"))
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    base.write.parquet(src)
    for expected in (1, 2):
        listens.upsert_session_items(listens.replay(spark, src, "user_name string, item string, at timestamp").withColumnRenamed("user_name", "session_key"), out, check)
        assert listens.newest(spark, out).first().plays == expected
        base.write.mode("append").parquet(src)


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    from cadenza.streaming import listens

    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "session_key string, item string, at timestamp"
    plays = lambda *keys: spark.createDataFrame([(k, "a") for k in keys], "session_key string, item string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    for keys in (("u", "v", "w"), ("u",), ("u",), ("u", "x")):
        plays(*keys).write.mode("append").parquet(src)
        listens.upsert_session_items(listens.replay(spark, src, schema, 100), out, check)
    assert {r.session_key: r.plays for r in listens.newest(spark, out).collect()} == {"u": 4, "v": 1, "w": 1, "x": 1}
    bucket = plays("u").select(F.pmod(F.xxhash64("session_key"), F.lit(64)).cast("int")).first()[0]
    found = listens._buckets(spark, out)
    assert found[bucket] == [2, 3]  # the two newest versions
    assert sorted(v for b, versions in found.items() if b != bucket for v in versions) == [0, 0, 3]


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"row {k}\u2028x\x85y" + "z" * (k % 50) for k in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), newline="\n")
    (tmp_path / "b.jsonl").write_text("one\r\ntwo\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = archives.text_lines(spark, str(tmp_path))
        got = {(r.origin[-7:], r.line): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.jsonl", k + 1): x for k, x in enumerate(lines)} | {("b.jsonl", 1): "one", ("b.jsonl", 2): "two"}


def test_members_of_archives(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    import zstandard

    data = "one\u2028still one\r\ntwo\n\nfour".encode()
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as archive:
        for name in ("d/listens/2020/1.listens", "d/readme.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    (tmp_path / "a.tar").write_bytes(raw.getvalue())
    (tmp_path / "b.tar.zst").write_bytes(zstandard.compress(raw.getvalue()))
    got = sorted((r.origin[-33:], r.line, r.value) for r in packed.tar_lines(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got] == [(1, "one\u2028still one"), (2, "two"), (3, ""), (4, "four")] * 2
    assert {(r.bytes, r.sha256) for r in packed.tar_members(spark, str(tmp_path)).collect()} == {(len(data), hashlib.sha256(data).hexdigest())}


def test_partition_index(spark):
    import hashlib

    df = spark.createDataFrame([(b"k1", "item", b"s"), (b"k2", None, b"s"), (b"k3", "", b"t")], "k binary, item string, s binary")
    got = [r[0] for r in df.select(X.partition_index(F.col("k"), F.col("item"), F.col("s"), 128)).collect()]
    whole = (b"k1item", b"k2s", b"k3t")
    assert got == [int.from_bytes(hashlib.sha256(x).digest()[:8], "big") % 128 for x in whole]


def test_small_helpers(spark):
    from cadenza.operators import rankers

    df = spark.createDataFrame([("us-a b1", 100)], "code string, n long")
    assert df.select(X.isrc_alnum(F.col("code")), archives.required_bytes(F.col("n"), 5, 7)).first()[:] == ("USAB1", 107)
    names = spark.createDataFrame([("Ann",), ("Bob",), (None,)], "name string")
    assert [r.name for r in rankers.without_names(names, spark.createDataFrame([("ANN",)], "name string")).collect()] == ["Bob", None]


def test_casefold_is_python_s(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ", "İstanbul", "ﬁne ﬀ 😀ß", "ABC", "", "Ꭰꭰ", "\U00010400x", "ŉ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.casefold(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [None if t is None else t.casefold() for t in texts]


def test_metadata_fills_from_lower_tiers(spark):
    """Requests with too few items of an artist go on to albums and genres; excludes never return."""
    features = spark.createDataFrame([(i, f"b{i // 4}", f"a{i // 2}", f"g{i // 16}") for i in range(64)], "item long, album string, artist string, genre string")
    seeds = spark.createDataFrame([(r, r) for r in range(64)] + [(7, 9)], "request long, item long")
    gone = spark.createDataFrame([(r, r ^ 1) for r in range(0, 64, 3)], "request long, item long")
    got = {(r.request, r.item): (r.score, r.rank) for r in rankers.metadata(seeds, features, 5, gone).collect()}
    want = {}
    for r in range(64):
        mine = [r, 9] if r == 7 else [r]
        barred = set(mine) | ({r ^ 1} if r % 3 == 0 else set())
        scores = {i: max(1.0 if i // 2 == s // 2 else 0.8 if i // 4 == s // 4 else 0.5 if i // 16 == s // 16 else 0.0 for s in mine) for i in range(64) if i not in barred}
        for n, i in enumerate(sorted((i for i in scores if scores[i]), key=lambda i: (-scores[i], i))[:5], 1):
            want[r, i] = (scores[i], n)
    assert got == want


def test_token_vector_shares_its_hashes(spark):
    """The hashes and the norm were part of every place's expression: 32 norms of 20 sums each a row."""
    from cadenza.functions import exprs

    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>").select(exprs.token_vector(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    assert [round(sum(x * x for x in r["v"]), 9) for r in df.collect()] == [1.0, 1.0]


def test_related_compares_classes_of_equal_groups(spark):
    """Nodes of the same groups met each other one by one; the result is that of all pairs."""
    import random
    from collections import Counter

    from cadenza.operators import catalog

    random.seed(5)
    rows = [(n, g) for n in range(60) for g in random.sample(range(4), random.randint(1, 3))] + [(1, None), (None, 2)]
    has = {n: {g for m, g in rows if m == n and g is not None} for n in range(60)}
    want = []
    for n in range(60):
        shared = Counter({m: len(has[n] & has[m]) for m in range(60) if m != n and has[n] & has[m]})
        want += [(n, m, s, at + 1) for at, (m, s) in enumerate(sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:5])]
    members = spark.createDataFrame(rows, "node long, genre int")
    assert sorted(map(tuple, catalog.related(members, "node", "genre").collect())) == sorted(want)
    # 20,000 nodes of one group have 400 million pairs
    many = catalog.related(spark.range(20_000).selectExpr("id AS node", "1 AS genre"), "node", "genre")
    assert many.count() == 100_000


def test_metadata_looks_deeper_where_the_first_items_are_gone(spark):
    """Lists are cut to a few more items than k; a request that has or excludes all of these goes on, and pairs of requests and
    groups, which were made and shuffled before, are not needed."""
    features = spark.range(400).selectExpr("id AS item", "'a' AS album", "CAST(id % 2 AS INT) AS artist", "CAST(NULL AS INT) AS genre")
    seeds = spark.createDataFrame([("even", 0), ("far", 0), ("all", 1)], "request string, item long")
    gone = spark.createDataFrame([("far", i) for i in range(0, 300, 2)] + [("all", i) for i in range(1, 400, 2)], "request string, item long")
    got = {}
    for r in sorted(rankers.metadata(seeds, features, 3, gone).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["request"], []).append((r["item"], r["score"]))
    assert got == {"even": [(2, 1.0), (4, 1.0), (6, 1.0)], "far": [(300, 1.0), (302, 1.0), (304, 1.0)], "all": [(0, 0.8), (2, 0.8), (4, 0.8)]}
    lists = rankers._first_items(seeds, features, "artist", 9)
    assert {r["request"]: r["list"] for r in lists.collect()} == {"even": list(range(0, 18, 2)), "far": list(range(0, 18, 2)), "all": list(range(1, 19, 2))}


def test_url_evidence_reduces_relations_before_they_are_dealt_out(spark):
    """Relations were dealt out by the few link types and ranked in a window; now each pair keeps its smallest type first."""
    urls = spark.createDataFrame([(1, "https://youtu.be/a"), (2, "https://youtu.be/a"), (3, None)], "url_id long, url string")
    relations = spark.createDataFrame([(7, 1, 10), (7, 1, 11), (7, 2, 12), (7, 3, 10), (8, 1, 99)], "recording_id long, url_id long, link_id long")
    links = spark.createDataFrame([(10, 3), (11, 2), (12, 1)], "link_id long, type_id int")
    kinds = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "type_id int, link_type string")
    found = bridge.url_evidence(urls, relations, links, kinds, spark.createDataFrame([(7, "m")], "recording_id long, mbid string"))
    assert {(r.mbid, r.url, r.link_type) for r in found.collect()} == {("m", "https://youtu.be/a", "one"), ("m", None, None)}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cooccurrence_sums_where_the_neighbours_lie(spark, monkeypatch):
    """With many blocks: the same as one sum over all hits, and the settings are as before. Hits were dealt out by request."""
    from collections import Counter

    monkeypatch.setattr(rankers, "HITS", 10, raising=True)
    near = [(a, b, 1, float((a * b) % 7)) for a in range(12) for b in range(12) if a != b]
    seeds, gone = [("r", 1), ("r", 2), ("q", 5)], {("r", 3), ("r", 1), ("r", 2), ("q", 5)}
    sums = Counter()
    for request, item in seeds:
        for a, b, _, pmi in near:
            if a == item and (request, b) not in gone:
                sums[request, b] += pmi
    want = {(q, i, s) for r in "rq" for (q, i), s in sorted((x for x in sums.items() if x[0][0] == r), key=lambda x: (-x[1], x[0][1]))[:4]}
    keys = [rankers.ALL_KEYS, "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(key) for key in keys]
    asked, barred = (spark.createDataFrame(rows, "request string, item long") for rows in (seeds, [("r", 3)]))
    found = rankers.cooccurrence(asked, spark.createDataFrame(near, "item long, neighbour long, co_count long, pmi double"), barred, 4)
    assert {(x.request, x.item, x.score) for x in found.collect()} == want
    assert [spark.conf.get(key) for key in keys] == before


def test_baskets_have_as_many_tasks_as_their_plays_need(spark, monkeypatch):
    plays = spark.range(900).selectExpr("id % 100 session_key", "if(id % 100 < 30, id % 7, id) item").unionAll(spark.sql("SELECT null, 1L UNION ALL SELECT 1L, null"))
    assert cooccurrence.tasks(plays) is None
    monkeypatch.setattr(cooccurrence, "PLAYS", 100)
    assert cooccurrence.tasks(plays) == 10
    for least, most in ((2, 8), (1, None)):
        few, many = cooccurrence.baskets(plays, least, most), cooccurrence.baskets(plays, least, most, tasks=10)
        assert many.rdd.getNumPartitions() == 10 and sorted(few.collect()) == sorted(many.collect()) != []
    assert cooccurrence.item_counts(cooccurrence.baskets(plays, tasks=10)).count() == evaluation.frequencies(cooccurrence.baskets(plays)).count()


def shuffled(spark, stages=()):
    """Ids of the finished stages, and the rows that those not in `stages` have dealt out."""
    jvm = spark._jvm
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}
    return set(rows), sum(n for k, n in rows.items() if k not in stages)


def test_leave_one_out_deals_out_lists_not_hits(spark, monkeypatch):
    r = random.Random(8)
    near = {(a, b): (r.choice([1, 2]), r.choice([-1.0, 0.5, 0.5, 2.25])) for a in range(60) for b in range(60) if r.random() < 0.8}  # self-pairs too
    neighbours = spark.createDataFrame([(a, b, n, v) for (a, b), (n, v) in near.items()], "item long, neighbour long, co_count long, pmi double")
    baskets = [(s, x) for s in range(80) for x in r.sample(range(63), r.randint(1, 6))]  # 60 to 62 have no neighbours
    rows = spark.createDataFrame(baskets, "session_key long, item long")
    want = []
    for s in range(80):
        basket = {x for t, x in baskets if t == s}
        for held in basket if len(basket) > 1 else ():
            sums = {}
            for (a, b), (n, v) in near.items():
                if a in basket - {held} and b not in basket - {held}:
                    exact, count = sums.get(b, (0, 0))
                    sums[b] = exact + v, count + n
            best = sorted(sums, key=lambda x: (-sums[x][0], x))[:7]
            want += [(f"{s}-{held}", x, sums[x][0], sums[x][1], k) for k, x in enumerate(best, 1)]
    hits = sum((x, b) in near for _, x in baskets for b in range(60))
    before = shuffled(spark)[0]
    assert sorted(map(tuple, rankers.leave_one_out(rows, neighbours, 7).collect())) == sorted(want)
    assert shuffled(spark, before)[1] < hits
    monkeypatch.setattr(rankers, "COMPARED", 200)  # lists in pieces
    monkeypatch.setattr(rankers, "DEALT", 2000)
    assert sorted(map(tuple, rankers.leave_one_out(rows, neighbours, 7).collect())) == sorted(want)
    words = rows.selectExpr("session_key", "concat('é', item) item"), neighbours.selectExpr("concat('é', item) item", "concat('é', neighbour) neighbour", "co_count", "pmi")
    assert rankers.leave_one_out(*words, 7).count() == len(want)
    assert rankers.leave_one_out(rows.limit(0), neighbours).count() == 0 == rankers.leave_one_out(rows, neighbours.limit(0)).count()


def test_cooccurrence_deals_out_requests_by_blocks_of_neighbours(spark, monkeypatch):
    """Seeds were dealt out to as many blocks as there were hits for, so what was dealt out went by the hits."""
    r = random.Random(4)
    near = {(a, b): (r.choice([1, 2]), r.choice([-1.0, 0.5, 0.5, 2.25])) for a in range(60) for b in range(60) if r.random() < 0.9}  # self-pairs too
    seeds = [(q, x) for q in range(40) for x in r.sample(range(63), 30)] + [(40, 61), (41, 5), (41, 5)]  # 60 to 62 have no neighbours; one seed twice
    gone = [(q, x) for q in range(43) for x in r.sample(range(63), 3)]
    want = []
    for q in range(42):
        sums, own = {}, [x for t, x in seeds if t == q]
        for x in own:
            for b in range(60):
                if (x, b) in near and b not in own and (q, b) not in gone:
                    count, exact = sums.get(b, (0, 0))
                    sums[b] = count + near[x, b][0], exact + near[x, b][1]
        best = sorted(sums, key=lambda b: (-sums[b][1], b))[:5]
        want += [(q, b, sums[b][1], sums[b][0], k) for k, b in enumerate(best, 1)]
    neighbours = spark.createDataFrame([(a, b, n, v) for (a, b), (n, v) in near.items()], "item long, neighbour long, co_count long, pmi double")
    asked, barred = (spark.createDataFrame(rows, "request long, item long") for rows in (seeds, gone))
    hits = sum((x, b) in near for _, x in seeds for b in range(60))
    monkeypatch.setattr(rankers, "HITS", hits // 30)
    before = shuffled(spark)[0]
    assert sorted(map(tuple, rankers.cooccurrence(asked, neighbours, barred, 5).collect())) == sorted(want)
    assert shuffled(spark, before)[1] < hits / 4
    monkeypatch.setattr(rankers, "NEAR", 300)  # about ten blocks, several tasks for each
    monkeypatch.setattr(rankers, "ASKED", 500)
    monkeypatch.setattr(rankers, "COMPARED", 100)
    monkeypatch.setattr(rankers, "BROADCAST_ITEMS", 10)
    assert sorted(map(tuple, rankers.cooccurrence(asked, neighbours, barred, 5).collect())) == sorted(want)
    word = "concat('é', item) item"
    words = asked.selectExpr("concat('r', request) request", word), neighbours.selectExpr(word, "concat('é', neighbour) neighbour", "co_count", "pmi"), barred.selectExpr("concat('r', request) request", word)
    assert rankers.cooccurrence(*words, 60).count() == rankers.cooccurrence(asked, neighbours, barred, 60).count() > len(want)
    assert rankers.cooccurrence(asked.limit(0), neighbours).count() == 0 == rankers.cooccurrence(asked, neighbours.limit(0)).count()


def test_cooccurrence_over_a_stored_table_deals_out_less_than_its_hits(spark, tmp_path, monkeypatch):
    from cadenza.sources import served

    rows = spark.range(2500).selectExpr("id % 50 item", "id div 50 neighbour", "1L co_count", "double(id % 7) pmi").filter("item <> neighbour")
    served.write(rows, str(tmp_path), "v1", buckets=4)
    seeds = spark.range(900).selectExpr("id % 30 request", "id div 30 item")  # 30 requests of the seeds 0 to 29
    monkeypatch.setattr(rankers, "HITS", 1000)
    before = shuffled(spark)[0]
    got = rankers.cooccurrence(seeds, served.matching(spark, str(tmp_path), seeds, buckets=4), k=3).collect()
    assert shuffled(spark, before)[1] < 900 * 49 / 4
    sums = {n: sum((n * 50 + i) % 7 for i in range(30)) for n in range(30, 50)}
    best = sorted(sums, key=lambda n: (-sums[n], n))[:3]
    assert sorted((x.request, x["item"], x.score, x["rank"]) for x in got) == [(q, n, float(sums[n]), k) for q in range(30) for k, n in enumerate(best, 1)]
