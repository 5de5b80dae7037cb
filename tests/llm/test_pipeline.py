"""The pipeline against a version of its own: SQL of the native stages, all pairs, the library's token ids."""

import hashlib

import duckdb
import public_tokenizers
import pyarrow as pa
from test_contracts import base_spans, components
from test_edges import story
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import queries
from cadenza.session import table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(rows: list[tuple], benchmark) -> dict[int, tuple]:
    con = duckdb.connect()
    con.register("benchmark", benchmark)

    def sql(name, rows):
        con.register("documents", pa.table({c.split()[0]: [r[k] for r in rows] for k, c in enumerate(COLUMNS.split(", "))}))
        cur = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]

    kept = {r["doc_id"] for r in sql("op10_quality_rules", rows) if r["kept"]}
    rows = [r for r in rows if r[0] in kept]
    found = components({r[0]: r[1] or "" for r in rows}, 5, 80)
    rows = [r for r in rows if found[r[0]][2]]
    leaked = {r["doc_id"] for r in sql("op8_decontamination", rows)}
    out, library = {}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        if r[0] not in leaked:
            text, end = "", 0
            for s, e, _ in base_spans(r[1] or ""):
                if s >= end:
                    text += r[1][end:s] + "<secret>"
                end = max(end, e)
            ids = library.encode(text + (r[1] or "")[end:], add_special_tokens=False).ids
            out[r[0]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    return out


def test_all_stages_in_a_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    benchmark = table(spark, sf, "benchmark").toArrow()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got and got == by_hand(rows, benchmark)


def test_unlike_texts_of_one_id(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, story(30, 77))], "item_id int, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    passed = {r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, sf), sf).filter("lang = 'en'").collect()}
    good = [r.text for r in docs.filter("lang = 'en'").orderBy("doc_id").collect() if r.doc_id in passed][:4]
    leak = good[3] + " " + story(30, 77)
    texts = [(1, good[0]), (1, good[1]), (None, good[2]), (None, leak), (1, "bad"), (1, good[0]), (2, None)]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["quality_rules"](spark, rows, sf)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted((i or 0, t) for i, t in texts if t and t != "bad")
    left = stages["near_dedup"](spark, left, sf)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, good[0]), (1, good[1]), (0, good[2]), (0, leak)])
    left = stages["decontamination"](spark, left, sf)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, good[0]), (1, good[1]), (0, good[2])])
    assert stages["secret_scan"](spark, left.drop("n_chars"), sf).columns == ["doc_id", "text", "lang", "source"]
    assert stages["byte_bpe"](spark, left, sf).count() == 3
