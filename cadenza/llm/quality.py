"""Quality rules with DataFrame functions only: repetition counts and divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
STOPS = ".,;:!?'\"()-"
# Common function words of the languages of the corpus; each is a bin of the word histogram.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with",
    "de", "la", "le", "et", "les", "des", "en", "un", "que", "par",
    "der", "die", "und", "von", "mit", "den", "das", "zu",
    "el", "los", "y", "se", "del", "con", "para", "su",
)
#: Documents with fewer characters or words are not judged by that histogram: short texts stray from any reference.
MIN_CHARS, MIN_WORDS = 400, 100
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) that are kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.25
#: References are broadcast when there are at most so many languages.
BROADCAST_LANGS = 10_000


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, from the hashes of all windows in order."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s, j):
        return (s["h"] == F.get(keyed_col, j - 1)["h"]) | (s["h"] == F.get(keyed_col, j + 1)["h"])

    keyed_col = F.col("keyed")
    starts = F.sort_array(F.transform(F.filter(keyed_col, lambda s, j: F.coalesce(twice(s, j), F.lit(False))), lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).cast("long").alias("n")),
    )["n"]
    return keyed, covered


def features(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every text in docs (__id, __lang, __text)."""
    text = F.coalesce("__text", F.lit(""))
    kept = [F.col("__id"), F.col("__lang")]
    df = docs.select(*kept, text.alias("t")).select(
        *kept,
        "t",
        F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.length("t").alias("chars"),
        F.length(_without(F.col("t"), SPACE)).alias("word_chars"),
        F.length(_without(F.col("t"), SYMBOLS)).alias("no_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.length(_without(x, SPACE)) > 0).alias("lines"),
    )
    letters, upper = (F.length(F.regexp_replace("t", f"[^\\p{{{c}}}]+", "")) for c in ("L", "Lu"))
    bins = F.create_map(*[F.lit(x) for k, w in enumerate(COMMON_WORDS) for x in (w, chr(0x100 + k))])
    marks = F.array_join(
        F.transform("words", lambda w: F.coalesce(F.try_element_at(bins, F.lower(F.rtrim(w, F.lit(STOPS)))), F.lit("-"))), ""
    )
    df = df.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        (F.col("chars") - F.col("no_symbols")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
        marks.alias("marks"),
        "chars",
        letters.alias("letters"),
        upper.alias("upper"),
        (F.col("chars") - F.length(_without(F.col("t"), "0123456789"))).alias("digits"),
        (F.col("chars") - F.length(_without(F.col("t"), STOPS))).alias("stops"),
    )
    at = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)).otherwise(
        F.array().cast("array<int>")
    )
    window = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("hashed"), i + k) for k in range(3)]))
    df = df.withColumn("windows", window)
    keyed, covered = _repeat_words(F.col("windows"))
    df = df.withColumn("some", F.size(F.array_distinct("windows")) < F.size("windows"))
    df = df.withColumn("keyed", F.when(F.col("some"), keyed))
    count = [F.length("marks") - F.length(F.replace("marks", F.lit(chr(0x100 + k)), F.lit(""))) for k in range(len(COMMON_WORDS))]
    lower, space = F.col("letters") - F.col("upper"), F.col("chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("stops")
    classes = F.array(lower, F.col("upper"), F.col("digits"), space, F.col("stops"), rest)
    return df.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("some"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform(classes, lambda x: x.cast("double")).alias("char_bins"),
        F.transform(F.array(*count), lambda x: x.cast("double")).alias("word_bins"),
    )


def _with_rest(bins: Column, total: Column) -> Column:
    """The histogram as shares, with the words that are in no bin as the last one."""
    got = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.concat(bins, F.array(total - got)), lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def half(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.sqrt(F.greatest(total / 2, F.lit(0.0))), 6)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Judge every document: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    js_chars, js_words, kept), one row for each input row.

    Base rules fail texts of fewer than 50 words or with over half their words in repeated 3-word windows. The rest
    are compared with the reference of their language: the histograms of character classes and of common words summed
    over all documents of that language. A Jensen-Shannon distance over the limit rejects, if the text is long enough
    for that histogram. Null or empty texts have no words and fail; without a language there is no reference (distances
    null) and the base rules decide. Repeated rows are judged alike; other columns are ignored.
    A text of any length is judged whole, by one task that holds its words.
    """
    docs = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    found = materialize(features(docs), "quality")

    def summed(name, n):
        return F.array(*[F.sum(F.col(name)[k]) for k in range(n)]).alias(f"ref_{name}")

    refs = found.filter("__lang is not null").groupBy("__lang").agg(
        summed("char_bins", 6),
        summed("word_bins", len(COMMON_WORDS)),
        F.sum(F.col("n_words").cast("double")).alias("ref_words"),
    )
    refs = materialize(refs, "references")
    if refs.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        refs = F.broadcast(refs)
    all_chars = lambda bins: F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)
    shares = lambda bins: _with_rest(bins, all_chars(bins))
    df = found.join(refs, "__lang", "left")
    known = F.col("ref_words").isNotNull()
    df = df.withColumns(
        {
            "js_chars": F.when(known, _distance(shares(F.col("char_bins")), shares(F.col("ref_char_bins")))),
            "js_words": F.when(
                known,
                _distance(
                    _with_rest(F.col("word_bins"), F.col("n_words").cast("double")),
                    _with_rest(F.col("ref_word_bins"), F.col("ref_words")),
                ),
            ),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    strays = (all_chars(F.col("char_bins")) >= MIN_CHARS) & (F.col("js_chars") > MAX_CHAR_DISTANCE)
    strays |= (F.col("n_words") >= MIN_WORDS) & (F.col("js_words") > MAX_WORD_DISTANCE)
    return df.select(
        F.col("__id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words"),
        (~F.col("base_failed") & ~F.coalesce(strays, F.lit(False))).alias("kept"),
    )
