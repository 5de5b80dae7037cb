"""The corpus pipeline: each stage works on what the one before it kept.

Decisions belong to rows. A row's key is its doc_id; where an id is null or several rows have it, it is a hash of id and
text, so that unlike texts of one id are judged apart. Rows with one id and one text are copies of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, minhash, quality, secrets
from cadenza.session import broadcast_up_to, materialize, table

#: Keys of a stage's decisions (8 bytes each) are broadcast up to this number; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
KEY = "__pipeline_row"
#: Tokens of one window that a document must share with a benchmark item to go: shorter items are words of any text.
EVIDENCE = 4


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with their keys."""
    plain = F.col("doc_id").cast("long")
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("__odd"), F.lit(True).alias("__is_odd"))
    odd = materialize(odd, "odd-ids")
    if not odd.limit(1).count():
        return docs.withColumn(KEY, plain)
    marked = docs.join(broadcast_up_to(odd, BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("__odd")), "left")
    own = F.when(F.col("__is_odd"), F.xxhash64(F.coalesce(plain.cast("string"), F.lit("null")), F.coalesce("text", F.lit("")), F.col("text").isNull()))
    return marked.withColumn(KEY, F.coalesce(own, plain)).select(*docs.columns, KEY)


def _chosen(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return rows.join(broadcast_up_to(keys, BROADCAST_IDS), KEY, how)


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the quality rules go; null and empty texts fail them. Each row is judged by its own text and
    language: copies that have unlike languages are one document, which stays if any of them passes."""
    rows = _keyed(docs)
    judged = quality.judge(rows.select(KEY, "text", "lang"), id_col=KEY)
    kept = materialize(judged.filter("kept").select(KEY).distinct(), "kept")
    return _chosen(rows, kept, "left_semi").select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Rows of one id and one text are copies too: the least of them by its columns stays. Null and wordless texts have no
    copies but those. Which document stays follows from the keys alone, so a repeated task finds the same.
    """
    rows = _keyed(docs)
    found = minhash.near_duplicates(rows.select(KEY, "text"), id_col=KEY, k=5, percent=80)
    kept = materialize(found.filter("kept").groupBy(KEY).count(), "kept")
    out = _chosen(rows, kept.select(KEY), "left_semi")
    if kept.filter("count > 1").limit(1).count():
        out = out.groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return out.select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold EVIDENCE tokens or more of benchmark items in a row go. Null and empty texts hold none; without items all documents stay."""
    rows = _keyed(docs)
    found = decontaminate.contaminated(rows.select(KEY, "text"), table(spark, sf_dir, "benchmark"), id_col=KEY)
    found = materialize(found.filter(F.col("n_tokens") >= EVIDENCE).select(KEY).distinct(), "leaked")
    return _chosen(rows, found, "left_anti").select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """Secrets in the texts are replaced by a mark, row by row; n_chars follows, if there is such a column. Null stays null."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def byte_bpe(spark, docs, sf_dir):
    """The token ids of every text that is left, row by row, repeated ones too; a null or empty text has none, and an empty table
    no rows. A text of any length is encoded whole."""
    found = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each one's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
