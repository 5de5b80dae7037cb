"""Notices in wordings that no template has, families that look alike, and the regression against steps by hand."""

import numpy as np

from cadenza.llm import licenses
from cadenza.session import table

WORDINGS = {
    "3-clause BSD license": "bsd", "under the terms of the MIT licence": "mit", "Released under the MIT licence.": "mit",
    "This program is licensed under the GNU Affero General Public License, version 3.": "agpl", "GNU Affero General Public Licence": "agpl",
    "GNU Lesser General Public License": "lgpl", "GNU General Public License": "gpl", "Licensed under the ISC License.": "isc", "ISC License": "isc",
    "Distributed under the Boost Software License, Version 1.0.": "boost", "Eclipse Public License 2.0": "epl", "The Unlicense": "unlicense",
    "The driver has a license to drive lorries.": None, "The public was free to go into the general software store.": None,
    "Permission to enter the house is granted to any person.": None, "": None,
}


def test_wordings(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    lines = spark.createDataFrame([(-1 - k, f"Some words here\n{x}\nand more of them") for k, x in enumerate(WORDINGS)], docs.schema)
    found = {r.doc_id: r.licenses for r in licenses.scan(docs.unionAll(lines)).filter("doc_id < 0").collect()}
    assert {x: found[-1 - k] for k, x in enumerate(WORDINGS)} == WORDINGS


def test_regression_by_dense_steps(monkeypatch):
    monkeypatch.setattr(licenses, "STEPS", 20)
    negatives = ["the cat sat on the mat", "a dog ran over the hill", "rain fell on the town all day", "we ate bread and drank tea"] * 3
    got = licenses.train(negatives)["weights"]
    texts, classes = licenses._examples(negatives)
    features, offsets = licenses._features(*licenses._bytes(texts))
    used, number = np.unique(features, return_inverse=True)
    x = np.zeros((len(texts), len(used)))
    for k, (s, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        np.add.at(x[k], number[s:e], 1 / max(e - s, 1))
    fit, y = np.arange(len(texts)) % 5 != 4, np.eye(len(licenses.FAMILIES) + 1)[classes]
    each = 1 / np.maximum(y[fit].sum(0), 1) / y.shape[1]
    w = np.zeros((len(used), y.shape[1]))
    for _ in range(20):
        z = 30.0 * x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = x[fit].T @ ((y - p) * each[classes][:, None])[fit]
        w += licenses.RATE * (30.0 * gradient - licenses.DECAY * w)
    assert np.allclose(got[used], 30.0 * w, atol=1e-3)
