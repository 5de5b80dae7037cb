"""The language models against Kneser-Ney by hand, letters of two symbols, and limits from texts that no model has seen."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import langid

SCHEMA = "doc_id long, text string, lang string"
TEXTS = [
    (1, "the cat sat on the mat", "en"), (3, "The cat, the hat!", "en"), (4, "a cat and a hat", "en"), (9, "that mat", "en"),
    (6, "der hut und der hund", "de"), (7, "Der Hund, die Katze", "de"), (10, "die katze und der Hut", "de"), (11, "\U00010428\U00010429\U0001042a abc", "x"),
    (12, "\U0001e922\U0001e923\U0001e924 abc", "y"), (2, "the hut", None), (5, "\U0001e922\U0001e923\U0001e924", None), (8, "\U00010428\U00010429\U0001042a", None),
]


def symbols(text):
    low = "".join(c.lower() if c.isalpha() else " " for c in text)
    units = (" " + " ".join(low.split()) + " ").encode("utf-16-le")
    return [units[i : i + 2] for i in range(0, len(units), 2)]


def grams(text, n=4):
    s = symbols(text)
    return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]


def model(texts):
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, types = defaultdict(int), defaultdict(int)
    for n, found in counts.items():
        for g, c in found.items():
            total[n, g[:-1]] += c
            types[n, g[:-1]] += 1

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 65536
        rest = p(g[1:])
        if not total[n, g[:-1]]:
            return rest
        seen = max(counts[n][g] - 0.75, 0)
        return (seen + 0.75 * types[n, g[:-1]] * rest) / total[n, g[:-1]]

    return p


def test_cross_entropy_by_hand(spark):
    learned = [t for t in TEXTS if t[2] and zlib.crc32(str(t[0]).encode()) % 4 != 2]
    models = {x: model([t for _, t, y in learned if x == y]) for x in sorted({y for *_, y in learned})}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(TEXTS, SCHEMA)).collect()}
    for doc_id, text, _ in TEXTS:
        want = {x: -sum(math.log(p(g)) for g in grams(text)) / len(grams(text)) for x, p in models.items()}
        assert got[doc_id].cross_entropy == pytest.approx(min(want.values()), abs=1e-4)
        assert want[got[doc_id].lang_pred] == pytest.approx(min(want.values()), abs=1e-4)


def test_letters_of_two_symbols_do_not_collide(spark):
    # The two texts have the same code points but for multiples of 65,536.
    rows = [(i, "".join(chr(c + (1 << 16) * (i % 2 + 1)) for c in range(0x0041, 0x0051)) * 3, "abc"[i % 2]) for i in range(40)]
    rows = [(i, t.replace(t[0], chr(0x20000 if i % 2 else 0x10428)), x) for i, t, x in rows]
    folded, offsets, letters = langid._folded([t for _, t, _ in rows])
    assert len(folded) == offsets[-1] + 1 and all(folded[offsets] == 32) and letters.min() > 0
    units = [bytes(folded[s + 1 : e].astype("<u2")) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    assert units[0] != units[1] and len(set(units)) == 2


def test_limits_come_from_texts_set_aside(spark):
    # Texts of one language that are set aside are unlike those of its model, so the limit must lie far above the model's own.
    crc = lambda i: zlib.crc32(str(i).encode())
    train = [i for i in range(2000) if crc(i) % 4 != 2][:400]
    aside = lambda i: crc(i) // 4 % langid.CALIBRATION == 0
    rows = [(i, "zebra quartz jumping" if aside(i) else "the cat sat on the mat", "en") for i in train]
    other = next(i for i in range(5000, 6000) if crc(i) % 4 == 2)
    out = langid.identify(spark.createDataFrame([*rows, (other, "zebra quartz jumping", None)], SCHEMA))
    assert not out.filter(F.col("doc_id") == other).first().rejected
    few = [r for r in rows if not aside(r[0])][: langid.CALIBRATE_FROM - 1]
    out = langid.identify(spark.createDataFrame([*few, (other, "zebra quartz jumping", None)], SCHEMA))
    assert out.filter(F.col("doc_id") == other).first().rejected
