"""Benchmark decontamination by canonical templates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import broadcast_up_to, materialize

# Words read as units of measure.
UNITS = (
    "km", "cm", "mm", "kg", "mg", "lb", "lbs", "oz", "ml", "mph", "kmh", "kwh", "hz", "usd", "eur",
    "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "feet", "yard", "yards",
    "gram", "grams", "pound", "pounds", "ton", "tons", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
)
#: Set before a capital that does not begin a sentence: the word is then read as a name.
MARK = "\u0001"
WINDOW = 10
#: Words of a window that must be literal; with fewer, templates say too little.
LITERAL = 6
#: A table of at most so many windows (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The ids of documents with hits (8 bytes each) likewise: up to so many, the texts are read again without a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts into which the hits of each template are dealt.
SALTS = 16


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers in order; a name keeps MARK before it."""
    marked = F.lower(F.regexp_replace(text, r"([\p{L},;] )(\p{Lu}\p{Ll})", f"$1{MARK}$2"))
    return F.regexp_extract_all(marked, F.lit(MARK + r"?\p{L}+|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def canonical(words: Column) -> Column:
    """The tokens with numbers, names and units replaced by typed placeholders."""
    return F.transform(
        words,
        lambda t: F.when(t < ":", F.when(t.startswith(MARK), "<name>").otherwise("<num>"))
        .when(t.isin(*UNITS), "<unit>")
        .otherwise(t),
    )


def plain(words: Column) -> Column:
    """The tokens without marks, which depend on what stands before a copy."""
    return F.transform(words, lambda t: F.translate(t, MARK, ""))


def _starts(size: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size("canon") >= size, F.sequence(F.lit(1), F.size("canon") - size + 1)).otherwise(none)


def _hash_at(column: str, size: int):
    return lambda i: F.xxhash64(F.slice(column, i, size))


def _windows(df: DataFrame, kinds: list[tuple[int, bool]]) -> DataFrame:
    """One row for each window of each kind, (size, exact): (key, size, exact, at, hash)."""
    hashes = []
    for size, exact in kinds:
        column = "plain" if exact else "canon"
        found = F.transform(_starts(F.lit(size)), _hash_at(column, size))
        hashes.append(F.struct(F.lit(size).alias("size"), F.lit(exact).alias("exact"), found.alias("hashes")))
    if len(kinds) == 1:
        size, exact = kinds[0]
        return df.select("key", F.lit(size).alias("size"), F.lit(exact).alias("exact"), F.posexplode(found).alias("at", "h"))
    df = df.select("key", F.explode(F.array(*hashes)).alias("k"))
    return df.select("key", "k.size", "k.exact", F.posexplode("k.hashes").alias("at", "h"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    literal: int = LITERAL,
) -> DataFrame:
    """Documents that hold a benchmark item or a re-parameterised form of it: (id_col, item_ids, n_windows, n_slots, n_tokens).

    Numbers, names and units become placeholders; a window of `window` tokens of a document counts when its template is
    one of the item's and at least `literal` of its tokens are literal. Over all windows that a document shares with an
    item each slot value of the item must keep one value in the document, within a run of windows at one distance (a copy
    of the item); a run that fails this is dropped. Two values of the item may become equal in the copy. A window of the item with fewer
    literal tokens counts where all its tokens are the same, and an item of fewer tokens than a window is one window of
    its own, which counts where its tokens are the same or, with `literal` of them literal, as a template. Only contaminated documents are
    returned, one row for each id (repeated rows are one): item_ids ascending, n_windows the windows counted, n_slots
    the filled slots compared (none in windows whose tokens are the same), n_tokens the most tokens that one window of them
    has: the evidence, which is small where an item has few tokens ("Paris" is found in every text with the word), so that
    the caller can ask for more. Null texts and items without a token match
    nothing; an empty benchmark gives an empty result. Other columns are ignored; rows without an id are not reported.
    A text of any length is searched whole, by one task that holds its tokens. Ids must be numbers.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("__text")).filter("key is not null")
    items = benchmark.select(F.col(item_col).alias("key"), tokens(F.col(item_text)).alias("words"))
    items = items.withColumn("canon", canonical(F.col("words")))
    items = items.withColumn("plain", plain(F.col("words"))).filter("size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    items = items.select("*", F.explode(_starts(F.col("size"))).alias("start"))
    cut = {c: F.slice(c, F.col("start"), F.col("size")) for c in ("words", "canon", "plain")}
    enough = F.size(F.filter("template", lambda t: ~t.startswith("<"))) >= literal
    exact = F.when(~enough, F.array(F.lit(True))).when(F.col("size") < window, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    templates = items.select(
        F.col("key").alias("item"),
        (F.col("start") - 1).alias("item_at"),
        "size",
        cut["words"].alias("item_words"),
        cut["canon"].alias("template"),
        cut["plain"].alias("item_plain"),
    )
    templates = templates.select("*", F.explode(exact).alias("exact"))
    templates = templates.withColumn("h", F.when(F.col("exact"), F.xxhash64("item_plain")).otherwise(F.xxhash64("template")))
    templates = materialize(templates.dropDuplicates(["item", "item_at", "h", "exact"]), "templates")
    # At most two kinds for each size up to a window's.
    kinds = sorted((r["size"], r["exact"]) for r in templates.select("size", "exact").distinct().collect()) or [(window, False)]
    keys = broadcast_up_to(templates.select("h", "size", "exact").distinct(), BROADCAST_ROWS)
    canon = docs.select("key", canonical(tokens(F.col("__text"))).alias("canon"))
    if any(exact for _, exact in kinds):
        canon = docs.select("key", tokens(F.col("__text")).alias("words"))
        canon = canon.select("key", canonical(F.col("words")).alias("canon"), plain(F.col("words")).alias("plain"))
    hits = materialize(_windows(canon, kinds).join(keys, ["h", "size", "exact"]).distinct(), "hits")
    found = broadcast_up_to(materialize(hits.select("key").distinct(), "found"), BROADCAST_IDS)
    texts = docs.join(found, "key", "left_semi").dropDuplicates()
    texts = texts.select("key", tokens(F.col("__text")).alias("words"))
    doc_words = F.slice("words", F.col("at") + 1, F.col("size")).alias("doc_words")
    pairs = hits.join(texts, "key").select("key", "at", "h", "size", "exact", doc_words)
    same = F.when(F.col("exact"), plain(F.col("doc_words")) == F.col("item_plain")).otherwise(canonical(F.col("doc_words")) == F.col("template"))
    # A template that many documents hold is dealt out by document to SALTS tasks; templates, of the benchmark alone, are repeated.
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
    copies = templates.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = pairs.join(copies, ["h", "size", "exact", "salt"]).filter(same)
    slots = F.filter(
        F.arrays_zip(F.col("template").alias("kind"), F.col("item_words").alias("mine"), F.col("doc_words").alias("theirs")),
        lambda s: s["kind"].startswith("<"),
    )
    found = pairs.select("key", "item", (F.col("at") - F.col("item_at")).alias("shift"), "at", "exact", "size", slots.alias("slots"))
    run = ["key", "item", "shift"]
    copied = found.filter("exact").select(*run, "at", "size").distinct()
    found = found.filter("not exact")
    filled = found.select(*run, F.explode("slots").alias("s")).select(*run, "s.kind", "s.mine", "s.theirs").distinct()
    forward = filled.groupBy(*run, "kind", "mine").count().groupBy(*run).agg(F.max("count").alias("most"), F.sum("count").alias("n_slots"))
    judged = found.groupBy(*run).agg(F.countDistinct("at").alias("n"), F.max("size").alias("most_tokens")).join(forward, run, "left")
    judged = judged.filter("coalesce(most, 1) = 1")
    if any(exact for _, exact in kinds):
        counted = found.join(judged, run, "left_semi").select(*run, "at")
        copied = copied.join(counted, [*run, "at"], "left_anti").groupBy(*run).agg(F.count("*").alias("n"), F.max("size").alias("most_tokens"))
        judged = judged.select(*run, "n", "n_slots", "most_tokens").unionByName(copied, allowMissingColumns=True)
    return judged.groupBy("key").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"),
        F.sum("n").alias("n_windows"),
        F.sum(F.coalesce("n_slots", F.lit(0))).cast("long").alias("n_slots"),
        F.max("most_tokens").alias("n_tokens"),
    ).withColumnRenamed("key", id_col)
