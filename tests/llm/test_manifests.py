"""Recipes that were lost or replaced do not agree with their manifest."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cadenza.llm import store
from cadenza.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def path(spark):
    path = new_path(spark, "store")
    store.write(spark.createDataFrame([(k, f"text {k} " * 9) for k in range(40)], "doc_id long, text string"), path, PATH)
    return path


def changed(spark, path, recipes=None, manifests=None):
    out = new_path(spark, "changed")
    for name, table in (("rows", None), ("recipes", recipes), ("manifests", manifests)):
        table = spark.read.parquet(f"{path}/{name}") if table is None else table
        (table.write.partitionBy("is_chunk") if name == "rows" else table.write).parquet(f"{out}/{name}")
    return out


def damaged(spark, path):
    recipes, manifests = (spark.read.parquet(f"{path}/{name}") for name in ("recipes", "manifests"))
    other = recipes.filter("doc_id = 7").select(F.col("chunks").alias("c"), F.col("root").alias("r"))
    swap = lambda old, new: F.when(F.col("doc_id") == 5, F.col(new)).otherwise(F.col(old)).alias(old)
    replaced = recipes.crossJoin(other).select("file", "doc_id", "start", "n_tokens", swap("chunks", "c"), swap("root", "r"))
    last = recipes.agg(F.max("file")).first()[0]
    yield "a row", changed(spark, path, recipes.filter("doc_id <> 5"))
    yield "a file", changed(spark, path, recipes.filter(F.col("file") != last))
    yield "all", changed(spark, path, recipes.limit(0))
    yield "replaced", changed(spark, path, replaced)
    yield "a manifest", changed(spark, path, None, manifests.filter(F.col("file") != last))


def test_whole_stores_are_read(spark, path):
    again = changed(spark, path)
    assert store.read_digests(spark, again).count() == store.read_ids(spark, again).count() == 40


@pytest.mark.parametrize("read", [store.read_digests, store.read_ids])
def test_lost_recipes_are_noticed(spark, path, read):
    for name, out in damaged(spark, path):
        with pytest.raises(Exception, match="differ from their manifest"):
            print(name, read(spark, out).count())
