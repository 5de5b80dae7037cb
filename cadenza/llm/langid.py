"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kernels
from cadenza.session import materialize

ORDER = 4
DISCOUNT = 0.75
#: Models whose tables have at most so many rows in each order are broadcast as sorted arrays (8 bytes a gram and 4 for
#: each language); larger ones stay tables and are joined with the texts' grams, for the same results.
MODEL_GRAMS = 1 << 20
#: Cells of a table, one for each gram and language, that are held at most, 4 bytes each; with more the model is joined too.
MODEL_CELLS = 1 << 23
#: Different grams of a language that a counting task holds before it passes them on.
HELD_GRAMS = 1 << 20
#: Languages a model may have; more is an error.
MAX_LANGUAGES = 256
#: A text is rejected when its cross-entropy is so many standard deviations over the mean of its language's.
REJECT_SIGMA = 4.0
#: Slack of a limit, so that texts that are all alike are not over their own mean.
ROUNDING = 1e-9
UNKNOWN = "und"
#: One in so many training texts of a language is kept from its model and calibrates its limit, if the language has at
#: least CALIBRATE_FROM of them; the limit of a smaller language comes from the texts of its model.
CALIBRATION, CALIBRATE_FROM = 8, 80
#: Characters of evidence in the score; more of them are far from independent.
EVIDENCE = 40
#: Bits of a symbol: a UTF-16 unit, so a letter beyond the first 65,536 code points is two symbols.
_BITS = 16
_SYMBOLS = 1 << _BITS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its folded value (letters lower-cased, all else one blank) and whether it is a letter."""
    fold, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            fold[c], letter[c] = (ord(low) if len(low) == 1 else c), True
    return fold, letter


_cached: list = []


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded symbols with a blank before and after each text, its offsets, and each text's number of letters."""
    if not _cached:
        _cached.extend(_tables())
    fold, letter = _cached
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    letters = np.concatenate([[0], np.cumsum(letter[points])])
    n_letters = letters[offsets[1:]] - letters[offsets[:-1]]
    folded = fold[points]
    wide = folded >= _SYMBOLS
    if wide.any():
        offsets = offsets + np.concatenate([[0], np.cumsum(wide)])[offsets]
        folded = np.frombuffer(folded.astype("<u4").tobytes().decode("utf-32-le").encode("utf-16-le"), "<u2")
    return folded, offsets, n_letters


def _grams(points: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams of an order, 16 bits a character, and where each text's own begin and end; those that cross from one
    text into the next belong to none. A run of blanks counts as one."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[offsets] = True
    kept = np.flatnonzero(keep)
    last = kept[np.searchsorted(kept, offsets[1:]) - 1]  # a text's closing run is the blank after it
    keep[last[points[last] == 32]] = False
    keep[offsets] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    points = points[keep].astype(np.uint64)
    n = len(points) - order + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(order if n > 0 else 0):
        grams = grams << np.uint64(_BITS) | points[k : n + k]
    begins = np.clip(at[:-1], 0, len(grams))
    return grams, begins, np.clip(at[1:] + 2 - order, begins, np.maximum(begins, len(grams)))


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, number = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(number, np.concatenate(counts), len(found)).astype(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, g, c): how often each gram of the highest order occurs in each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(lang):
            keys, counts = _totals(*map(list, zip(*parts[lang], strict=True)))
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "g", "c"]
            )

        for part in kernels.slices(batches, "__text"):
            texts = [t or "" for t in kernels.column(part, "__text").to_pylist()]
            langs = np.array(kernels.column(part, "__lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                points, offsets, _ = _folded([t for t, x in zip(texts, langs, strict=True) if x == lang])
                grams, begins, ends = _grams(points, offsets, ORDER)
                inside = np.cumsum(np.bincount(begins, minlength=len(grams) + 1) - np.bincount(ends, minlength=len(grams) + 1))[: len(grams)] > 0
                keys, counts = np.unique(grams[inside], return_counts=True)
                mine = parts.setdefault(lang, [])
                mine.append((keys, counts))
                if len(mine) > 32:
                    mine[:] = [_totals(*map(list, zip(*mine, strict=True)))]
                if len(mine[0][0]) > HELD_GRAMS:
                    yield rows(lang)
                    mine.clear()
        for lang in sorted(parts):
            if parts[lang]:
                yield rows(lang)

    found = docs.filter("__lang is not null and __text is not null").mapInArrow(run, "lang string, g long, c long")
    return found.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def train(docs: DataFrame) -> tuple[list[str], dict[int, tuple[DataFrame, DataFrame]]]:
    """Kneser-Ney models of all languages in docs (__lang, __text): the languages, and for each order the grams'
    log-probabilities and the contexts' log back-off weights, as tables (lang, g, v).

    The lower orders count the different characters before a gram. Counts, sums and interpolation are Spark jobs over
    all rows; no gram is left out.
    """
    top = materialize(_counts(docs), "grams")
    langs = [r.lang for r in top.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    tables = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << (_BITS * n)) - 1
        tables[n] = tables[n + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count("*").alias("c"))
    lower, found = None, {}
    for n in range(1, ORDER + 1):
        context = F.shiftrightunsigned("g", _BITS) if n > 1 else F.lit(0).cast("long")
        here = tables[n].withColumn("h", context)
        sums = here.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        sums = materialize(sums.withColumn("weight", F.lit(DISCOUNT) * F.col("types") / F.col("total")), f"contexts{n}")
        here = here.join(sums, ["lang", "h"])
        if lower is None:
            here = here.withColumn("below", F.lit(1.0 / _SYMBOLS))
        else:
            mask = (1 << (_BITS * (n - 1))) - 1
            here = here.withColumn("s", F.col("g").bitwiseAND(F.lit(mask))).join(lower, ["lang", "s"])
        here = here.select("lang", "g", ((F.col("c") - DISCOUNT) / F.col("total") + F.col("weight") * F.col("below")).alias("p"))
        here = materialize(here, f"order{n}")
        lower = here.select("lang", F.col("g").alias("s"), F.col("p").alias("below"))
        log = lambda c: F.log(c).cast("float").alias("v")
        found[n] = (here.select("lang", "g", log("p")), sums.select("lang", F.col("h").alias("g"), log("weight")))
    return langs, found


def _arrays(langs: list[str], tables: dict[int, tuple[DataFrame, DataFrame]]) -> dict:
    """The models as sorted arrays: for each order the grams' hashes and log-probabilities, and the contexts' hashes and
    log back-off weights, one column for each language. At most MODEL_GRAMS rows of each table come to the driver."""
    model = {"langs": langs, "p": {}, "b": {}}
    for n, (grams, contexts) in tables.items():
        model["p"][n], model["b"][n] = _columns(grams, langs), _columns(contexts, langs)
    for n in range(1, ORDER + 1):  # a gram that some languages lack gets their backed-off value
        keys, values, grams = model["p"][n]
        gaps = np.isnan(values)
        if gaps.any():
            mask = np.uint64((1 << (_BITS * (n - 1))) - 1)
            below = _log_p(model, grams & mask, n - 1)
            values[gaps] = (_weights(model, grams >> np.uint64(_BITS), n) + below)[gaps]
        model["p"][n] = (keys, values)
    return model


def _columns(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, a column of values for each language (nan where it has none), and the grams."""
    found = rows.toPandas()
    grams, number = np.unique(found["g"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    keys = kernels.mix(grams)
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    values = np.full((len(grams), len(langs)), np.nan, np.float32)
    column = found["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(np.int64)
    values[place[number], column] = found["v"].to_numpy(np.float32)
    return keys[order], values, grams[order]


def _lookup(table: tuple, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = table[0]
    if not len(keys):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    wanted = kernels.mix(grams)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _weights(model: dict, contexts: np.ndarray, n: int) -> np.ndarray:
    at, hit = _lookup(model["b"][n], contexts)
    out = np.zeros((len(contexts), len(model["langs"])), np.float32)
    out[hit] = np.nan_to_num(model["b"][n][1][at[hit]], nan=0.0)
    return out


def _log_p(model: dict, grams: np.ndarray, n: int) -> np.ndarray:
    """Log-probability of each gram's last character in every language, backing off where no language has the gram."""
    if n == 0:
        return np.full((len(grams), len(model["langs"])), -np.log(_SYMBOLS), np.float32)
    at, hit = _lookup(model["p"][n], grams)
    out = np.empty((len(grams), len(model["langs"])), np.float32)
    out[hit] = model["p"][n][1][at[hit]]
    rest = grams[~hit]
    if len(rest):
        mask = np.uint64((1 << (_BITS * (n - 1))) - 1)
        out[~hit] = _weights(model, rest >> np.uint64(_BITS), n) + _log_p(model, rest & mask, n - 1)
    return out


def _predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(__id, __lang, __train, pred, entropy, score) of every text in docs."""
    langs, sent = model["langs"], docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for part in kernels.slices(batches, "__text"):
            texts = [t or "" for t in kernels.column(part, "__text").to_pylist()]
            points, offsets, letters = _folded(texts)
            grams, begins, ends = _grams(points, offsets, ORDER)
            rows = []
            if langs:
                logs = np.concatenate([np.zeros((1, len(langs))), np.cumsum(_log_p(known, grams, ORDER), 0, np.float64)])
                sums, sizes = logs[ends] - logs[begins], np.maximum(ends - begins, 1)
                entropy = -sums / sizes[:, None]
                best = entropy.argmin(1)
                odds = np.exp((entropy.min(1)[:, None] - entropy) * np.minimum(sizes, EVIDENCE)[:, None])
                score = odds.max(1) / odds.sum(1)
            for k in range(len(texts)):
                ok = bool(langs) and letters[k] > 0
                rows.append((langs[best[k]], float(entropy[k, best[k]]), float(score[k])) if ok else (UNKNOWN, None, 0.0))
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True)
            kept = [kernels.column(part, c) for c in ("__id", "__lang", "__train")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, t) for c, t in columns)], names=["__id", "__lang", "__train", "pred", "entropy", "score"]
            )

    return docs.mapInArrow(run, "__id long, __lang string, __train boolean, pred string, entropy double, score double")


def _predicted_by_join(docs: DataFrame, langs: list[str], tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """What _predicted returns, for models of any size: each different gram of the texts meets the tables once, and the
    texts' grams, counted before, meet the grams' values."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in kernels.slices(batches, "__text"):
            points, offsets, letters = _folded([t or "" for t in kernels.column(part, "__text").to_pylist()])
            grams, begins, ends = _grams(points, offsets, ORDER)
            own = [np.unique(grams[s:e].view(np.int64), return_counts=True) for s, e in zip(begins, ends, strict=True)]
            cuts = pa.array(np.cumsum([0, *(len(g) for g, _ in own)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([o[k] for o in own]).astype(np.int64))) for k in (0, 1)]
            kept = [kernels.column(part, c) for c in ("__row", "__id", "__lang", "__train")]
            counts = [pa.array(np.asarray(c).astype(np.int64)) for c in (letters, np.maximum(ends - begins, 1))]
            yield pa.RecordBatch.from_arrays([*kept, *counts, *lists], names=["__row", "__id", "__lang", "__train", "letters", "size", "g", "c"])

    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    schema = "__row long, __id long, __lang string, __train boolean, letters long, size long, g array<long>, c array<long>"
    texts = materialize(numbered.mapInArrow(run, schema), "text-grams")
    grams = texts.select("__row", F.explode(F.arrays_zip("g", "c")).alias("x")).select("__row", "x.g", "x.c")
    needed = {ORDER: materialize(grams.select("g").distinct(), "needed")}
    for n in range(ORDER - 1, 0, -1):
        needed[n] = needed[n + 1].select(F.col("g").bitwiseAND(F.lit((1 << (_BITS * n)) - 1)).alias("g")).distinct()
    below = None
    for n in range(1, ORDER + 1):
        by_lang = lambda t, key, name: t.groupBy(F.col("g").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias(name))
        context = F.shiftrightunsigned("g", _BITS) if n > 1 else F.lit(0).cast("long")
        rows = needed[n].withColumn("h", context).withColumn("s", F.col("g").bitwiseAND(F.lit((1 << (_BITS * (n - 1))) - 1)))
        rows = rows.join(by_lang(tables[n][0], "g", "p"), "g", "left").join(by_lang(tables[n][1], "h", "b"), "h", "left")
        if below is not None:
            rows = rows.join(below, "s")
        rest = lambda k: F.lit(-float(np.log(_SYMBOLS))).cast("float") if below is None else F.col("below")[k]  # noqa: E731, B023
        values = [F.coalesce(F.col("p")[x], F.coalesce(F.col("b")[x], F.lit(0.0).cast("float")) + rest(k)) for k, x in enumerate(langs)]
        below = materialize(rows.select(F.col("g").alias("s"), F.array(*values).alias("below")), f"values{n}")
    sums = grams.join(below.withColumnRenamed("s", "g"), "g").groupBy("__row").agg(
        F.array(*[F.sum(F.col("c") * F.col("below")[k].cast("double")) for k in range(len(langs))]).alias("sums")
    )
    found = texts.drop("g", "c").join(sums, "__row", "left")
    sums = F.coalesce("sums", F.array(*[F.lit(0.0)] * len(langs)))
    found = found.withColumn("all", F.transform(sums, lambda x: -x / F.col("size"))).withColumn("least", F.array_min("all"))
    odds = F.transform("all", lambda e: F.exp((F.col("least") - e) * F.least("size", F.lit(EVIDENCE))))
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    ok = F.col("letters") > 0
    names = F.array(*[F.lit(x) for x in langs])
    return found.select(
        "__id", "__lang", "__train", F.when(ok, names[(F.array_position("all", F.col("least")) - 1).cast("int")]).otherwise(UNKNOWN).alias("pred"),
        F.when(ok, F.col("least")).alias("entropy"), F.when(ok, F.array_max(odds) / total).otherwise(0.0).alias("score"),
    )


def _crc(id_col) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary"))


def held_out(id_col) -> F.Column:
    return _crc(id_col) % 4 == 2


def _set_aside(id_col) -> F.Column:
    """Whether a training text is one of those that calibrate the limit of a language with enough of them."""
    return F.shiftright(_crc(id_col), 2) % CALIBRATION == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict every text's language with models of the texts whose crc32(id) mod 4 is not 2 and whose lang is known:
    (id_col, held_out, lang_pred, score, cross_entropy, rejected), one row for each input row.

    The model with the lowest cross-entropy a character wins, the first in name order of equal ones; score is its share
    of the likelihood over at most EVIDENCE characters. A text is rejected when its cross-entropy is over the calibrated
    limit of its language: mean and REJECT_SIGMA deviations over training texts that the model gets right, which were kept
    from the model (one in CALIBRATION, from languages of CALIBRATE_FROM training texts and more). A text of one letter has no gram of its own: all languages are equal, and the first in name order is
    named. A null text, one without a letter, or an empty training set gives lang_pred 'und', score 0 and rejected. A null id
    is not held out, nor trained on. Repeated rows count as often as they occur; other columns are ignored.
    A text of any length is read whole, by one task with some ten 8-byte values a character. Ids must be numbers.
    """
    id_ = F.col(id_col).cast("long")
    docs = docs.select(
        id_.alias("__id"), F.col(lang_col).alias("__lang"), F.coalesce(~held_out(id_), F.lit(False)).alias("__train"), F.col(text_col).alias("__text")
    )
    sizes = docs.filter("__train and __lang is not null and __text is not null").groupBy("__lang").agg(
        F.count("*").alias("n"), F.count_if(~_set_aside(F.col("__id"))).alias("rest")
    )
    sizes = sizes.filter((F.col("n") >= CALIBRATE_FROM) & (F.col("rest") > 0)).orderBy("__lang")
    ample = [r[0] for r in sizes.limit(MAX_LANGUAGES + 1).collect()]
    aside = F.col("__lang").isin(ample) & _set_aside(F.col("__id")) if ample else F.lit(False)
    langs, tables = train(docs.filter(F.col("__train") & ~F.coalesce(aside, F.lit(False))))
    most = min(MODEL_GRAMS, MODEL_CELLS // max(1, len(langs)))
    large = langs and any(t.limit(most + 1).count() > most for both in tables.values() for t in both)
    found = materialize(_predicted_by_join(docs, langs, tables) if large else _predicted(docs, _arrays(langs, tables)), "predicted")
    judged = aside | ~F.col("pred").isin(ample) if ample else F.lit(True)
    right = found.filter("__train and pred = __lang").filter(judged).groupBy("pred").agg(
        (F.avg("entropy") + ROUNDING + REJECT_SIGMA * F.coalesce(F.stddev_samp("entropy"), F.lit(0.0))).alias("most")
    )
    limits = {r.pred: r.most for r in right.collect()}  # a row for each of at most MAX_LANGUAGES languages
    limit = F.lit(None).cast("double")
    for lang, most in limits.items():
        limit = F.when(F.col("pred") == lang, F.lit(most)).otherwise(limit)
    return found.select(
        F.col("__id").alias(id_col),
        F.coalesce(held_out(F.col("__id")), F.lit(False)).alias("held_out"),
        F.col("pred").alias("lang_pred"),
        "score",
        F.col("entropy").alias("cross_entropy"),
        F.coalesce(F.col("entropy") > limit, F.lit(True)).alias("rejected"),
    )
