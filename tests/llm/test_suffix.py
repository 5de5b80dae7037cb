"""Suffix arrays and repeated passages against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from test_contracts import WORD
from test_edges import story

from cadenza.llm import queries, suffix
from cadenza.session import table


@pytest.mark.parametrize("buckets", [0, 1024])
def test_suffix_arrays(monkeypatch, buckets):
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    r = random.Random(1)
    for _ in range(400):
        text = [r.randint(1, r.choice([1, 2, 5, 2000])) for _ in range(r.randint(1, 60))]
        text = text + text[: r.choice([0, 0, len(text)])]
        text = np.unique([*text, 0], return_inverse=True)[1]
        assert suffix.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("owned", [False, True])
def test_repeated_windows(owned):
    r = random.Random(2)
    for _ in range(300):
        w, k = r.randint(2, 5), r.choice([1, 2, 3])
        segments = [np.array([r.randint(2, 1 + k) for _ in range(r.randint(0, 25))], np.int64) for _ in range(r.randint(1, 5))]
        owners, places = [r.randint(0, 2) for _ in segments], defaultdict(list)
        for n, s in enumerate(segments):
            for i in range(len(s) - w + 1):
                places[tuple(s[i : i + w])].append(owners[n] if owned else (n, i))
        got = suffix.repeated(segments, w, owners if owned else None)
        for s, flags in zip(segments, got, strict=True):
            assert flags.tolist() == [len(set(places[tuple(s[i : i + w])])) > 1 for i in range(len(s) - w + 1)]


def passage_words(texts: list[str], n: int = 51) -> list[int]:
    words = [WORD.findall(t) for t in texts]
    where = defaultdict(set)
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(d)
    out = []
    for w in words:
        covered = set()
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                covered.update(range(i, i + n))
        out.append(len(covered))
    return out


def test_passages_of_the_corpus(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect())
    got = [r.n_passage_words for r in sorted(queries.op2_suffix_dedup(spark, sf).collect(), key=lambda r: r.doc_id)]
    assert got == passage_words([t for _, t in docs]) and any(got)


@pytest.mark.parametrize("limit", [1 << 19, 0])
def test_short_passages_in_many_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "GROUP_BYTES", limit)
    passage = " ".join(story(900, 4).split()[:55])[:330]
    passage = " ".join(w[:4] for w in story(56, 4).split())
    texts = [f"{story(40, k)} {passage} {story(30, 100 + k)}" for k in range(12)]
    texts += [story(300, 50), "to " * 400, "to " * 300, story(70, 60) + " " + story(70, 60), re.sub(" ", "\n ", texts[0]), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_passage_words, r.n_removed) for r in suffix.remove_repeats(rows).collect()}
    assert [got[k][0] for k in range(len(texts))] == passage_words(texts)
    assert len(passage) < 400 and got[3] == (56, 0)
