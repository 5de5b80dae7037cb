"""Notices of few words, which have too few word pairs for a comparison of pairs."""

from test_contracts import NOTICES, SF

from cadenza.llm import licenses
from cadenza.session import table

ALL = NOTICES | {"All rights reserved.": "proprietary"}
SHORT = {
    "All rights reserved.": "proprietary", "all rights reserved": "proprietary", "MIT License": "mit", "GNU GPL": "gpl", "BSD License": "bsd",
    "GNU LGPL": "lgpl", "Mozilla Public License": "mpl", "CC BY-SA 4.0": "cc-by-sa", "CC0 1.0": "cc0",
    "All seats reserved.": None, "No rights reserved today": None, "rights reserved": None, "MIT": None, "The driving License": None,
}


def test_every_planted_notice_is_found(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert any("All rights reserved." in t for t in texts.values())
    for r in licenses.scan(docs).collect():
        assert (r.licenses or "") == ",".join(sorted({f for n, f in ALL.items() if n in texts[r.doc_id]}))


def test_short_lines(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    lines = spark.createDataFrame([(-1 - k, f"Some words here\n{x}\nand more of them") for k, x in enumerate(SHORT)], docs.schema)
    got = {r.doc_id: r.licenses for r in licenses.scan(docs.unionAll(lines)).filter("doc_id < 0").collect()}
    assert [got[-1 - k] for k in range(len(SHORT))] == list(SHORT.values())
