"""The compression classifier: held-out quality, what it learns from, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import compression, queries
from cadenza.session import table

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = queries.QUERIES["op11_quality_classifier"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = (np.array([s for s, q in held if q == c]) for c in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (good >= 0.3).mean() > 0.98 and (bad >= 0.3).mean() < 0.15
    assert abs(np.mean([s for s, _ in held]) - np.mean([q for _, q in held])) < 0.02


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    usual, other = ({r.doc_id: r.score for r in compression.score(docs, x).collect()} for x in (labels, turned))
    assert usual == other
    plain = compression.score(docs.select("doc_id", "text"), labels)
    assert {r.doc_id: r.score for r in plain.collect()} == usual


def test_odd_rows(spark):
    long = "some words of a long text, " * 60_000
    rows = [(1, None), (2, ""), (3, "a"), (4, long), (4, long), (None, "b"), (6, "é" * 5000)]
    docs = spark.createDataFrame([(i, t, 1.0, True, 1) for i, t in rows], "doc_id long, text string, score double, held_out boolean, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (4, 0), (None, 1), (9, 7)], "doc_id long, quality int")
    got = compression.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.score for r in compression.score(docs, labels.limit(0)).collect()} == {0.5}
    assert compression.score(docs.limit(0), labels).collect() == []


def test_sizes_add_up_over_pieces():
    measure = compression.Sizes([b"", b""])
    text = np.random.default_rng(1).bytes(5000)
    difference, size = measure.features(text)
    assert difference == 0 and size > 1 and [len(p) for p in compression.pieces(text)] == [2048, 2048, 904]
