"""A quality classifier that compares how well texts compress with dictionaries of good and of bad texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels

#: Bounds of what is learnt: labelled documents of each class for the dictionaries, and of all classes for the calibration;
#: a longer text (in bytes) is not learnt from. Every text is scored whole.
DICTIONARY_DOCS, CALIBRATION_DOCS, LEARNT_BYTES = 3000, 4000, 1 << 16
#: Texts are compressed in pieces of so many bytes, so that a long one is compared with the dictionary throughout.
PIECE, DICTIONARY_BYTES, LEVEL = 2048, 1 << 16, 3
#: One labelled document in so many is kept for the calibration.
SET_APART = 4
#: The least score of a document that is taken for good.
LIMIT = 0.3
#: Ranges outside of which a difference and a compressed size, as parts of the whole, say no more.
DIFFERENCES, SIZES = (-0.3, 0.2), (0.0, 1.2)


def held_out(doc_id: Column, every: int = 5) -> Column:
    """Whether `every` divides the unsigned crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts' pieces; of too few to train one, their last bytes as they are."""
    found = [p for s in samples for p in pieces(s) if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(found)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of texts with each class's dictionary."""

    def __init__(self, dictionaries: list[bytes]):
        self.with_ = []
        for data in dictionaries:
            trained = zstandard.ZstdCompressionDict(data) if data else None
            if trained:
                trained.precompute_compress(level=LEVEL)
            bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.with_.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, **bare))

    def features(self, text: bytes) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / their sum, and their mean as a part of the text's bytes."""
        cut = pieces(text)
        bad, good = (sum(len(c.compress(p)) for p in cut) for c in self.with_)
        return (bad - good) / (bad + good), (bad + good) / 2 / max(1, len(text))


def design(features: np.ndarray) -> np.ndarray:
    """Columns of the calibration: the clipped difference, and how far the text can be compressed at all, with its square."""
    difference, size = np.clip(features[:, 0], *DIFFERENCES), np.clip(features[:, 1], *SIZES)
    return np.stack([np.ones(len(features)), 10 * difference, 3 * size, 3 * size * size], 1)


def calibrate(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, halving steps that do not help; without rows all are 0."""
    x, y = design(features), labels.astype(float)
    weights = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w

    for _ in range(50):
        p = probability(x, weights)
        gradient = x.T @ (p - y) + ridge * weights
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights)), gradient)
        size = 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return weights


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """The dictionaries of bad and good texts and the calibration's weights.

    Learns from labelled documents that are not held out and have at most LEARNT_BYTES: per class DICTIONARY_DOCS of them,
    and CALIBRATION_DOCS of those set apart (one in SET_APART), chosen by a hash of the id. Labels other than 0 and 1 do not
    count, nor those of an id with both. A text of a dictionary calibrates nothing, and equal texts enter a dictionary once.
    """
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id is not null and __label in (0, 1)")
    marked = marked.filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__label").alias("__label"), F.max("__label").alias("__other"))
    marked = marked.filter("__label = __other").select("__id", "__label", F.xxhash64("__id").alias("__order"))
    apart = F.pmod(F.xxhash64(F.lit("apart"), "__id"), F.lit(SET_APART)) == 0
    parts = [marked.filter(~apart & (F.col("__label") == c)).orderBy("__order").limit(DICTIONARY_DOCS).withColumn("__use", F.lit(c)) for c in (0, 1)]
    parts.append(marked.filter(apart).orderBy("__order").limit(CALIBRATION_DOCS).withColumn("__use", F.lit(2)))
    # Bounded by the constants above, in rows and, with LEARNT_BYTES, in bytes: broadcast and collected.
    chosen = F.broadcast(parts[0].unionAll(parts[1]).unionAll(parts[2]))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    found = texts.filter(F.octet_length("__text") <= LEARNT_BYTES).join(chosen, "__id").select("__text", "__label", "__use", "__order").distinct()
    rows = sorted(((r["__use"], r["__order"], bytes(r["__text"]), r["__label"]) for r in found.collect()), key=lambda r: r[:3])
    used = [dict.fromkeys(r[2] for r in rows if r[0] == c) for c in (0, 1)]
    dictionaries = [dictionary(list(texts)) for texts in used]
    measure = Sizes(dictionaries)
    fresh = [r for r in rows if r[0] == 2 and r[2] not in used[0] and r[2] not in used[1]]
    features = np.array([measure.features(r[2]) for r in fresh]).reshape(len(fresh), 2)
    return dictionaries, calibrate(features, np.array([r[3] for r in fresh]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Every document's quality: (id_col, held_out, score, predicted, difference), one row for each input row.

    score is the calibrated probability of label 1, from the difference of the text's compressed sizes with a dictionary of
    bad and one of good texts and from these sizes themselves; predicted is 1 from LIMIT on. Null counts as the empty text,
    whose difference is 0; it has a score too. A text of any length is compressed whole, piece by piece. Without usable labels all scores
    are 0.5; a class without texts has an empty dictionary. Only the text is an input of a score. Repeated rows stay; a null
    id stays null and is not learnt from. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    dictionaries, weights = learn(docs, labels, id_col, text_col, label_col)
    names = [id_col, "held_out", "score", "predicted", "difference"]
    rows = docs.select(F.col(id_col).alias("__id"), held_out(F.col(id_col)).alias("__held"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]):
        measure = Sizes(dictionaries)
        for part in kernels.slices(batches, "__text"):
            data, at = kernels.flatten(kernels.column(part, "__text"))
            whole = data.tobytes()
            features = np.array([measure.features(whole[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]).reshape(part.num_rows, 2)
            found = probability(design(features), weights)
            columns = [kernels.column(part, "__id"), kernels.column(part, "__held"), pa.array(found), pa.array((found >= LIMIT).astype(np.int32)), pa.array(features[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, difference double")
