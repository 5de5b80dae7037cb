"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from cadenza.llm import bpe, compression, decontaminate, langid, licenses, minhash, quality, secrets, spelling, store, suffix, urls, whiten
from cadenza.llm.oracles import ORACLE_SQL as ORACLE_SQL
from cadenza.llm.rules import URL_RULES
from cadenza.session import new_path, table


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), window=400)


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secret_scan(spark, sf_dir):
    return secrets.find(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_store(spark, sf_dir):
    path = new_path(spark, "store")
    store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return store.read_digests(spark, path)


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark, sf_dir):
    return compression.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bpe": op4_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_token_store": op7_token_store,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
