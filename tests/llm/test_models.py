"""Language models that are too large to broadcast give the same results."""

import pytest
from pyspark.sql import functions as F
from test_edges import docs as docs  # noqa: F401

from cadenza.llm import langid
from cadenza.session import table


def both(rows, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_GRAMS", 1 << 20)
    usual = sorted(map(tuple, langid.identify(rows).collect()), key=repr)
    monkeypatch.setattr(langid, "MODEL_GRAMS", 10)
    return usual, sorted(map(tuple, langid.identify(rows).collect()), key=repr)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3] and x[5] == y[5]
        assert x[3] == pytest.approx(y[3], abs=1e-5) and (x[4] is None) == (y[4] is None) and (x[4] is None or x[4] == pytest.approx(y[4], abs=1e-5))


def test_large_models(spark, monkeypatch):
    rows = table(spark, "/root/testdata/sf0.001", "documents").withColumn("text", F.substring("text", 1, 600))
    same(*both(rows, monkeypatch))


def test_large_models_of_odd_rows(docs, monkeypatch):  # noqa: F811
    same(*both(docs, monkeypatch))
