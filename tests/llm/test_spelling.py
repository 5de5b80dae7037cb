"""Spelling variants against all pairs of words, on whole tables and odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from cadenza.llm import queries, spelling
from cadenza.session import table

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def expected(rows, least=6, least_n=5, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            if i is not None and (h := zlib.crc32(f"{i}:{word}".encode())) % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= least_n}
    near, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :], k].add(w)
            if (d := w[:k] + w[k + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    for group in shorter.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, f"/root/testdata/{sf}", "documents").collect()]
    got = queries.QUERIES["op13_spelling_variants"](spark, f"/root/testdata/{sf}")
    assert got.columns == COLUMNS and {tuple(r) for r in got.collect()} == expected(rows)


def small(spark, rows):
    return spelling.variants(spark.createDataFrame(rows, "doc_id long, text string, word string, n int")).collect()


def test_chains_ties_and_odd_rows(spark):
    long = "y" * 60_000
    texts = [
        ("kitten " * 150), ("kittens " * 30), ("kitens " * 6), ("sitten " * 30), ("Sitten " * 1), ("sittin " * 5), ("ÉLAN\u00D7ÉLAN " * 5), ("élan\u00F7élan " * 25),
        ("abcdef " * 5), ("fedcba " * 500), ("aaaaaa " * 5), ("aaaaaaa " * 25), ("aaaaaaaa " * 25), (long + " ") * 5, (long + "x ") * 25, None, "", "12 !?",
    ]
    rows = [(None if k == 3 else k, t, "w", 1) for k, t in enumerate(texts)]
    got = small(spark, rows + rows[:2])
    assert {tuple(r) for r in got} == expected([r[:2] for r in rows + rows[:2]])
    found = {r.word: r for r in got}
    assert (found["kitens"].form, found["kitens"].root) == ("kittens", "kitten")
    assert found[long].form == long + "x" and found["abcdef"].n_near == 0
    assert small(spark, []) == []


def test_every_run_may_lose_a_letter(spark):
    rows = [(i, "abcdefgh abcdefg") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(docs, every=3)
    assert {tuple(r) for r in got.collect()} == expected(rows, every=3)


def test_large_blocks_in_chunks(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    monkeypatch.setattr(spelling, "CHUNK_WORDS", 3)
    monkeypatch.setattr(spelling, "VERIFY_POINTS", 20)
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == expected(rows)
