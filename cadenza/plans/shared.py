"""Inputs that queries and their DuckDB equivalents have in common: SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import table

INPUTS: dict[str, str] = {
    # session baskets
    "plays": "SELECT l_orderkey AS session_key, l_partkey AS item FROM {lineitem}",
    # items with album, artist and genre
    "features": """SELECT DISTINCT l.l_partkey AS item, p.p_brand AS album, l.l_suppkey AS artist, s.s_nationkey AS genre
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    # observations of one identifier for another in shards
    "observations": """SELECT CAST(o_custkey AS VARCHAR(20)) AS msid, o_orderpriority AS mbid,
        CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS shard FROM {orders}""",
    # items, aliases and redirects
    "items": "SELECT p_partkey AS item, CAST(p_partkey AS VARCHAR(20)) AS skey, p_brand AS kind, p_size AS track FROM {part}",
    "aliases": """SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN 'isrc' ELSE 'spotify' END AS source, 'track' AS kind,
        substr(md5(p_name), 1, 6) AS skey, CASE WHEN p_partkey % 7 = 0 THEN 'conflict' WHEN p_partkey % 11 = 0 THEN 'retired' ELSE 'active' END AS status FROM {part}""",
    "redirects": """SELECT p_partkey AS from_id, CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey - 1 END AS to_id,
        CASE WHEN p_size % 9 = 0 THEN 'retired' ELSE 'active' END AS status FROM {part} WHERE p_partkey % 10 <> 2""",
    "metrics": """SELECT event_type AS label, CASE WHEN user_id % 4 = 0 THEN 'recall' WHEN user_id % 4 = 1 THEN 'ndcg' WHEN user_id % 4 = 2 THEN 'coverage' ELSE 'cold' END AS metric,
        value, 'h' || CAST(event_id % 5 AS VARCHAR(2)) AS dataset, event_id AS created FROM {events}""",
    "manifest": """SELECT d.doc_id, d.source, CASE WHEN d.doc_id % 6 = 0 THEN NULL WHEN d.doc_id % 6 = 1 THEN 'cc0' WHEN d.doc_id % 6 = 2 THEN 'cc-by-nc'
        WHEN d.doc_id % 6 = 3 THEN 'proprietary' ELSE 'cc-by' END AS license, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 'production,research' ELSE 'research' END AS envs
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "isrcs": """SELECT p_partkey AS item, CASE WHEN p_partkey % 13 = 0 THEN 'bad-code' WHEN p_partkey % 5 = 0 THEN 'us-abc-' || lpad(CAST(p_size AS VARCHAR(10)), 7, '0')
        ELSE 'US' || upper(substr(md5(p_brand), 1, 3)) || lpad(CAST(p_size AS VARCHAR(10)), 7, '0') END AS isrc FROM {part}""",
    "listens": """SELECT event_id, CAST(user_id AS VARCHAR(20)) AS user_name, event_type AS item, ts, value FROM {events}""",
}

_NAMES = re.compile(r"\{(\w+)\}")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the driver's tables named in braces."""
    names = set(_NAMES.findall(sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names}) if names else spark.sql(sql)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, INPUTS[name])


def plain(sql: str) -> str:
    """The same text for DuckDB."""
    return _NAMES.sub(r"\1", sql)


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL with the named inputs as common table expressions; sql may begin with RECURSIVE or more of them."""
    parts = [f"{n} AS ({plain(INPUTS[n])})" for n in names]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
