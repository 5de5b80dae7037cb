"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import bpe, decontaminate, graph, langid, licenses, minhash, quality, secrets, store, suffix, urls
from cadenza.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, copy int, __x string, component string"


def story(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = story(30_000, 5)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, story(80)), (5, story(80)), (5, story(80)), (6, long), (7, "a"), (8, "é日本 <|endoftext|> x"), (None, story(80, 9)), (10, "aaaa" * 500)]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, 1, 2, 3, "y", "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, story(30, 77)), (2, None), (3, "short")], "item_id int, text string")


def operators(spark, docs, benchmark):
    path = new_path(spark, "store")
    store.write(docs, path, PATH)
    yield "minhash", minhash.near_duplicates(docs)
    yield "suffix", suffix.remove_repeats(docs, with_kept=True)
    yield "bpe", bpe.encode(docs, PATH, with_ids=True)
    yield "secrets", secrets.find(docs)
    yield "redact", secrets.redact(docs)
    yield "langid", langid.identify(docs)
    yield "store", store.read_digests(spark, path)
    yield "licenses", licenses.scan(docs)
    yield "quality", quality.judge(docs)
    yield "decontaminate", decontaminate.contaminated(docs, benchmark)


def test_odd_rows(spark, docs, benchmark):
    for name, out in operators(spark, docs, benchmark):
        found = out.collect()
        assert len(found) == (0 if name == "decontaminate" else docs.count()), name


def test_empty_tables(spark, docs, benchmark):
    for name, out in operators(spark, docs.limit(0), benchmark.limit(0)):
        assert out.collect() == [], name


def test_minhash_ties_and_nulls(spark, docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got[1, 0] == (1, True) and got[4, 76] == (4, True) and got[5, 76] == (4, False)
    assert got[None, 76] == (None, False)


def test_near_copies_chain(spark):
    words = story(200).split()
    rows = []
    for i in range(6):  # each differs from the next in few words, the ends from each other in many
        words = words.copy()
        words[i * 30 + 5] = f"new{i}"
        words[i * 30 + 9] = f"other{i}"
        rows.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_large_group_of_straddling_copies(spark):
    from test_contracts import components

    r, base = random.Random(3), story(120).split()
    rows = {}
    for i in range(150):
        w = base.copy()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows[i] = " ".join(w)
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), k=3, percent=85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == components(rows, 3, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7), (3, 4)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_suffix_by_divided_groups_is_the_same(spark, docs, monkeypatch):
    extra = spark.createDataFrame([(20, "x" + story(200, 8) + "y"), (21, "z" + story(200, 8) + "w"), (22, story(300, 8)[100:900])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(extra)
    usual = sorted(map(tuple, suffix.remove_repeats(rows).collect()), key=repr)
    monkeypatch.setattr(suffix, "GROUP_BYTES", 0)
    assert sorted(map(tuple, suffix.remove_repeats(rows).collect()), key=repr) == usual


def test_store_keeps_repeated_ids_and_rejects_damage(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a a"), (1, "c"), (1, "c"), (None, "n")], "doc_id long, text string")
    path = new_path(spark, "store")
    store.write(rows, path, PATH)
    got = store.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2] and [r.start for r in got] == [0, 2, *[r.start for r in got[2:]]]
    assert store.joined_crc([(__import__("zlib").crc32(b"ab"), 2), (__import__("zlib").crc32(b"cde"), 3)]) == __import__("zlib").crc32(b"abcde")
    broken = new_path(spark, "broken")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{broken}/recipes")
    stored = store._stored(spark, path).withColumn("ids", F.when(F.col("is_chunk"), F.lit(store.pack(__import__("numpy").array([9], "<u4")))))
    stored.write.partitionBy("is_chunk").parquet(f"{broken}/rows")
    with pytest.raises(Exception, match="differs from its address"):
        store.read_digests(spark, broken).collect()


def test_bpe_is_the_librarys_on_odd_strings():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    splitter, memory = bpe.tools(PATH)
    r = random.Random(1)
    odd = ["don't I'll 'S   ", "　x\xa0y  \x85z\x1c\x1d a", "<|endoftext|><|endoftext|>\t\t x", "a<|endoftext|>'s"]
    odd += ["".join(r.choice("ab  \n\t'sd1½²\xa0​　\x1c\x85é日😀!<|") for _ in range(60)) for _ in range(500)]
    pieces, number, first = bpe.distinct_pieces(splitter, odd)
    for k, text in enumerate(odd):
        ids = [int(i) for p in number[first[k] : first[k + 1]] for i in memory[pieces[p]][1][1:].split(",")]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_secret_kinds():
    import zlib

    body = "Zz" * 15
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    good = f"x ghp_{body}{digits.rjust(6, '0')} "
    automaton = secrets._automaton()
    assert [secrets.KINDS[k] for _, _, k in secrets.scan(good, automaton)] == ["forge"]
    assert secrets.scan(good.replace("ZzZ", "ZzY", 1), automaton) == []
    assert secrets.scan("tokKen = abcdefgh ſecret=abcdefgh", automaton) == []
    assert secrets.scan("password=abc token=12345678", automaton) == [(13, 27, 0)]
    assert secrets._merged([(0, 5, 0), (3, 9, 2), (20, 21, 0)]) == [(0, 9), (20, 21)]


def test_reparameterised_questions(spark):
    item = "A train leaves the old station with Alice and travels 120 km in 3 hours before it stops near the river bridge to load 45 boxes"
    right = "Intro words here. " + item.replace("Alice", "Robert").replace("120", "77").replace("3 hours", "5 minutes") + " and more."
    equal = "A train leaves the old station with Alice and travels 9 km in 9 hours before it stops near the river bridge to load 45 boxes"
    wrong = item.replace("Alice", "Robert")  # below, the item has Alice twice, and this copy has two names for it
    rows = spark.createDataFrame([(1, right), (2, equal), (3, story(60)), (4, item), (4, item)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(rows, spark.createDataFrame([(7, item)], "item_id int, text string")).collect()}
    assert got == {1: [7], 2: [7], 4: [7]}
    apples = "Tom has 3 apples and 4 pears in the basket that he carries home"
    rows = spark.createDataFrame([(1, apples.replace("3", "4"))], "doc_id long, text string")
    assert decontaminate.contaminated(rows, spark.createDataFrame([(7, apples)], "item_id int, text string")).count() == 1
    twice = item + " for Alice and travels on"
    rows = spark.createDataFrame([(1, wrong + " for Alice and travels on"), (2, twice.replace("Alice", "Robert"))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(rows, spark.createDataFrame([(7, twice)], "item_id int, text string")).collect()] == [2]


def test_hot_template(spark):
    item = "A train leaves the old station at noon and travels 120 km before it stops"
    docs = spark.range(4000).selectExpr("id AS doc_id", f"concat('{item.split('120')[0]}', id, '{item.split('120')[1]}') AS text")
    items = spark.range(50).selectExpr("id AS item_id", f"concat('{item.split('120')[0]}', 900 + id, '{item.split('120')[1]}') AS text")
    got = decontaminate.contaminated(docs, items)
    assert got.count() == 4000 and got.selectExpr("min(size(item_ids))").first()[0] == 50


def test_aliases(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.com/en/1", '<link rel="canonical" href="http://b.org/x?y=1#z">'), (2, "http://b.org/x?y=1", ""),
            (3, "http://c.org/q", '<meta http-equiv="refresh" content="0; url=//b.org/x?y=1">'),
            (4, "http://d.org/q", '<link href="http://w.example.com/en/7a" rel=canonical>'), (5, None, None), (6, "nope", "x"), (7, "http://e.org/q", ""), (7, "http://e.org/q", ""),
        ],
        "page_id long, url string, html string",
    )
    from cadenza.llm.queries import URL_RULES

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    got = sorted((r.page_id, r.verdict, r.propagated) for r in urls.judge(pages, rules).collect())
    assert got == [(1, "block", False), (2, "block", True), (3, "block", True), (4, "allow", True), (5, "allow", False), (6, "allow", False), (7, "allow", False), (7, "allow", False)]
    more = spark.createDataFrame([("http://e.org/q", "http://a.com/en/1"), (None, "x")], "source string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, rules, more).collect()}[7] == "block"
    assert urls.judge(pages.limit(0), rules).count() == 0 and {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, story(30, 77))], "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), sf).count() == 0, name
        out = stage(spark, plain, sf)
        assert out.count() <= plain.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == plain.columns


def test_pipeline_run(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    leaked = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(ids) <= kept - leaked
