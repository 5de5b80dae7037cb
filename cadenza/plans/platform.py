"""Queries on the catalog, games, run bookkeeping, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import catalog as C
from cadenza.operators import games as M
from cadenza.operators import orchestration as O
from cadenza.plans.shared import frame, oracle, plain, run
from cadenza.session import new_path
from cadenza.sources import archives as A
from cadenza.sources import packed as P
from cadenza.sources import sinks as K
from cadenza.streaming import heartbeats as H
from cadenza.streaming import listens as L

POINTS = "SELECT c_custkey AS id, CAST(c_custkey % 180 AS DOUBLE) - 90.0 AS lat, CAST((c_custkey * 7) % 360 AS DOUBLE) - 180.0 AS lng, greatest(0.0, least(1.0, c_acctbal / 10000.0)) AS weight FROM {customer}"
GUESSES = "SELECT event_id AS id, CAST(event_id % 50 AS BIGINT) AS game, user_id AS player, event_type = 'view' AS song, value > 50 AS artist, CASE WHEN user_id % 3 = 0 THEN event_type = 'click' END AS trivia FROM {events}"
PLAYERS = "SELECT DISTINCT CAST(event_id % 50 AS BIGINT) AS game, user_id AS player, CASE WHEN user_id % 4 <> 0 THEN user_id END AS user, (event_id % 50) % 2 = 0 AS party FROM {events}"
SHARDS = "SELECT o_orderkey AS id, o_orderpriority AS run, CASE o_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS status, CAST(o_custkey AS BIGINT) AS rows, CAST(o_orderkey AS BIGINT) AS bytes, CAST(o_orderkey AS BIGINT) AS key, o_custkey % 3 AS session, 2 AS current FROM {orders}"
QUEUE = "SELECT o_orderkey AS id, CAST(o_custkey % 3 AS INT) AS priority, CASE o_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS next_at, o_orderkey AS lease_until, CAST(o_custkey % 16 AS INT) AS attempts FROM {orders}"
COPY = "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'short' ELSE CAST(p_partkey AS VARCHAR(20)) || chr(9) || CASE WHEN p_partkey % 3 = 0 THEN chr(92) || 'N' WHEN p_partkey % 3 = 1 THEN 'a' || chr(92) || chr(92) || 'n' || p_brand ELSE 'b' || chr(92) || 't' || p_brand END || chr(9) || p_type END AS value FROM {part}"
MEMBERS = """SELECT event_type AS archive, 'dump/listens/' || CAST(EXTRACT(YEAR FROM ts) AS VARCHAR(4)) || '/' || CAST(EXTRACT(MONTH FROM ts) AS VARCHAR(2)) || '.listens' AS member, event_id,
    '[' || CAST(event_id AS VARCHAR(20)) || ',' || CAST(user_id AS VARCHAR(20)) || ',"' || event_type || '"]' AS value FROM {events}"""
NAMES = "SELECT 'listens-dump-' || CAST(o_orderkey AS VARCHAR(20)) || CASE WHEN o_orderkey % 9 = 0 THEN '-x' ELSE '-' || lpad(CAST(20200101 + o_orderkey % 28 AS VARCHAR(8)), 8, '0') || '-0' || CAST(o_orderkey % 6 AS VARCHAR(1)) || '0000-' || CASE WHEN o_custkey % 5 = 0 THEN 'full' ELSE 'incremental' END END AS name FROM {orders}"


def top_by_popularity(spark, d):
    rows = run(spark, d, "SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '{{}}' ELSE '{{\"popularity\":' || CAST(p_size AS VARCHAR(10)) || '}}' END AS attributes FROM {part}".replace("{{", "\u0002").replace("}}", "\u0003"))
    rows = rows.withColumn("attributes", F.translate("attributes", "\u0002\u0003", "{}"))
    return C.top_by_attribute(rows, "p_brand", "popularity", "p_partkey").select("p_brand", "p_partkey", "number", "rank")


def related_suppliers(spark, d):
    return C.related(run(spark, d, "SELECT s_suppkey AS artist, s_nationkey AS genre FROM {supplier}"), "artist", "genre")


def newest_orders(spark, d):
    return C.newest(run(spark, d, "SELECT o_custkey, o_orderdate, o_orderkey FROM {orders}"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


def completeness(spark, d):
    albums = run(spark, d, "SELECT c_custkey AS artist, o_orderkey AS album, CAST(2 + o_orderkey % 4 AS INT) AS expected FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey")
    return C.completeness(albums, run(spark, d, "SELECT l_orderkey AS album, l_linenumber AS track FROM {lineitem}"))


def name_search(spark, d):
    return C.search(run(spark, d, "SELECT p_partkey, p_name, p_brand FROM {part}"), ["p_name", "p_brand"], "AN", "p_partkey")


def map_points(spark, d):
    return C.on_map(run(spark, d, POINTS), -45.0, -90.0, 45.0, 90.0, 7)


def map_cells(spark, d):
    return C.cells(run(spark, d, POINTS), 15.0)


def map_hexes(spark, d):
    return C.hexes(run(spark, d, POINTS), 24)


def catalog_features(spark, d):
    items = run(spark, d, "SELECT p_partkey * 2 AS item, p_partkey AS track FROM {part}")
    tracks = run(spark, d, "SELECT p_partkey AS track, p_brand AS album FROM {part} WHERE p_size % 7 <> 0")
    artists = run(spark, d, "SELECT DISTINCT p_brand AS album, p_size AS artist FROM {part} WHERE p_size < 9 AND p_brand NOT LIKE '%2'")
    genres = run(spark, d, "SELECT DISTINCT p_size AS artist, p_type AS genre FROM {part} WHERE p_size % 2 = 0 AND p_size < 9")
    return C.fan_out(items, tracks, artists, genres)


def pending_batches(spark, d):
    tracks = run(spark, d, "SELECT l_suppkey AS artist, l_orderkey AS album, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS track FROM {lineitem}")
    return C.pending_batches(tracks, run(spark, d, "SELECT l_orderkey * 10 + l_linenumber AS track FROM {lineitem} WHERE l_partkey % 2 = 0"))


def stream_stale_runs(spark, d):
    rows = run(spark, d, "SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'completed' END AS status, CAST(o_orderkey AS BIGINT) AS heartbeat FROM {orders}")
    return H.demo(spark, rows, 3000, 1800)


def conditional_upsert(spark, d):
    path = new_path(spark, "merged")
    run(spark, d, "SELECT o_orderkey AS id, o_custkey AS v, o_orderpriority AS part FROM {orders} WHERE o_orderkey % 3 <> 0").write.partitionBy("part").parquet(path)
    new = run(spark, d, "SELECT o_orderkey AS id, CAST(700 AS BIGINT) AS v, o_orderpriority AS part FROM {orders} WHERE o_orderkey % 2 = 0 AND o_orderpriority < '4'")
    changed = K.merge(spark, path, new, ["id"], "part", F.col("new_v") > F.col("old_v"))
    after = spark.read.parquet(path).select("id", "v", "part", F.lit("table").alias("action"))
    return after.unionByName(changed.select("id", "v", "part", "action"))


def attribute_values(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, p_brand, p_name, p_size FROM {part}")
    json = F.to_json(F.struct(F.col("p_brand").alias("z"), F.split("p_name", " ").alias("b"), F.col("p_size").alias("n")))
    return rows.select("id", F.array_join(X.attribute_values(json), "|").alias("tokens"))


def release_times(spark, d):
    return A.releases(run(spark, d, NAMES)).select("name", X.utc_text(F.col("released")).alias("released"), F.unix_seconds("released").alias("epoch"))


def second_page(spark, d):
    return C.page(run(spark, d, "SELECT p_partkey, p_name FROM {part}"), "p_partkey", 1)


def artist_names(spark, d):
    return C.joined_names(run(spark, d, "SELECT l_partkey AS track, s_name AS name FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey"), "track", "name")


def visible_lists(spark, d):
    return C.visible(run(spark, d, "SELECT o_custkey AS owner, o_orderkey AS list FROM {orders}"), run(spark, d, "SELECT l_suppkey AS user, l_orderkey AS list FROM {lineitem}"))


def capacity_append(spark, d):
    have = run(spark, d, "SELECT l_orderkey AS list, min(l_partkey) AS item, max(l_linenumber) AS position FROM {lineitem} WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber")
    new = run(spark, d, "SELECT l_orderkey AS list, l_partkey AS item, l_suppkey AS ordinal FROM {lineitem} WHERE l_linenumber > 1")
    return C.append_with_capacity(have, new, 4)


def online_users(spark, d):
    return C.online(run(spark, d, "SELECT user_id AS user, event_id AS expires FROM {events}"), run(spark, d, "SELECT c_custkey AS user, c_name AS name FROM {customer}"), 500)


def genre_sync(spark, d):
    have = run(spark, d, "SELECT 'genre:' || lower(p_brand) AS genre_id, 'x' AS name FROM {part} WHERE p_size % 2 = 0 UNION ALL SELECT 'genre:none', upper(p_type) FROM {part} WHERE p_size % 3 = 0")
    return C.sync_genres(run(spark, d, "SELECT ' ' || p_brand || ' ' AS name FROM {part} UNION ALL SELECT p_type FROM {part}"), have)


def featured_genres(spark, d):
    return C.newest(run(spark, d, "SELECT s_nationkey AS genre, s_acctbal AS popularity, s_suppkey AS artist FROM {supplier} WHERE s_nationkey IN (1, 3, 5, 7, 9)"), "genre", "popularity", "artist", 3)


def pending_features(spark, d):
    tracks = run(spark, d, "SELECT l_suppkey AS artist, l_orderkey AS album, l_linenumber AS number, l_orderkey * 10 + l_linenumber AS track FROM {lineitem}")
    return C.pending_features(tracks, run(spark, d, "SELECT l_orderkey * 10 + l_linenumber AS track FROM {lineitem} WHERE l_partkey % 2 = 0"))


def seeded_profiles(spark, d):
    return C.seeded_profiles(spark, 50_000, [("paris", 3.0), ("lagos", 5.0), ("lima", 2.0)]).groupBy("city").agg(F.count("*").alias("n"))


def partial_dates(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '1999' WHEN 1 THEN '2001-07' WHEN 2 THEN ' 2010-02-28 ' ELSE 'unknown' END AS v FROM {part}")
    return rows.select("id", X.partial_date(F.col("v")).cast("string").alias("released"))


def slugs(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '!!' ELSE ' ' || p_type || ' & ' || p_name END AS v FROM {part}")
    return rows.select("id", X.slug(F.col("v")).alias("slug"))


def token_vectors(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, lower(p_name) AS v FROM {part}")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # few bytes but much work a row: a file of one block would be one task
    out = rows.select("id", X.token_vector(F.split("v", " ")).alias("v"))
    return out.select("id", F.posexplode("v").alias("place", "x")).select("id", "place", F.round("x", 6).alias("x"))


def normalized_lists(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, p_type || ', ' || p_brand || ',,' || p_type AS v FROM {part}")
    return rows.select("id", F.array_join(X.normalized_list(F.split("v", ",")), "|").alias("v"))


def rounded_places(spark, d):
    rows = run(spark, d, "SELECT c_custkey AS id, c_acctbal AS v FROM {customer}")
    return rows.select("id", X.unit(F.col("v") / 1000).alias("clout"), X.place(F.col("id") / 8.0).alias("lat"))


def round_scores(spark, d):
    return M.scores(run(spark, d, GUESSES))


def leaderboard(spark, d):
    return M.leaderboard(run(spark, d, GUESSES), run(spark, d, PLAYERS))


def fuzzy_matches(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, p_type AS guess, p_name AS answer FROM {part}")
    return M.matched(rows, "guess", "answer")


def contained_matches(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN ' ' || upper(substr(p_name, 2, 3)) WHEN p_partkey % 3 = 1 THEN '' ELSE p_type END AS guess, p_name AS answer FROM {part}")
    return rows.select("id", M.contained(F.col("guess"), F.col("answer")).alias("correct"))


def hydration_seeds(spark, d):
    return O.hydration_seeds(run(spark, d, "SELECT p_partkey AS item, p_name AS isrc FROM {part}"), run(spark, d, "SELECT l_partkey AS item FROM {lineitem} WHERE l_quantity < 5"), run(spark, d, "SELECT p_partkey AS item FROM {part} WHERE p_size < 10"))


def claimed_items(spark, d):
    return O.claim(run(spark, d, QUEUE), 900, 100).select("id", "priority", "status")


def hydration_outcomes(spark, d):
    return O.hydration_outcomes(run(spark, d, "SELECT p_partkey AS item FROM {part}"), run(spark, d, "SELECT l_partkey AS item, l_suppkey AS track FROM {lineitem} WHERE l_quantity < 4"), run(spark, d, "SELECT s_suppkey AS track, s_suppkey * 2 AS item FROM {supplier} WHERE s_suppkey % 2 = 0"))


def retry_times(spark, d):
    return O.retries(run(spark, d, QUEUE), 1000)


def run_progress(spark, d):
    return O.progress(run(spark, d, SHARDS))


def run_eta(spark, d):
    rows = run(spark, d, "SELECT o_orderkey AS id, o_custkey AS done, CAST(2000 AS BIGINT) AS total, CAST(o_orderkey % 7 AS DOUBLE) AS elapsed FROM {orders}")
    return O.eta(rows, "elapsed").select("id", "rate", "eta_s")


def partition_states(spark, d):
    return run(spark, d, SHARDS).groupBy("status").agg(F.count("*").alias("n"))


def shard_reconciliation(spark, d):
    return O.reconcile(run(spark, d, SHARDS).filter("key % 3 <> 0"), run(spark, d, "SELECT o_orderkey AS key FROM {orders} WHERE o_orderkey % 2 = 0"))


def shard_dispatch(spark, d):
    return O.dispatch(run(spark, d, SHARDS), 1000)


def shard_skips(spark, d):
    shards = run(spark, d, "SELECT o_orderkey AS shard, md5(o_orderpriority) AS sha FROM {orders}")
    done = run(spark, d, "SELECT o_orderkey AS shard, CASE WHEN o_custkey % 2 = 0 THEN md5(o_orderpriority) ELSE 'old' END AS sha, CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CAST(1 + o_custkey % 3 AS INT) AS schema FROM {orders}")
    return O.skippable(shards, done)


def version_backlog(spark, d):
    rows = run(spark, d, "SELECT o_orderkey AS version, CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'full' ELSE 'incremental' END AS mode FROM {orders}")
    return O.backlog(rows, run(spark, d, "SELECT l_orderkey AS version FROM {lineitem} WHERE l_linenumber > 4"), 30)


def latest_runs(spark, d):
    return O.latest_run(run(spark, d, "SELECT o_orderpriority AS source, o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'completed' ELSE 'running' END AS status, o_custkey % 3 = 0 AS has_manifest, o_orderdate AS finished FROM {orders}"))


def stale_runs(spark, d):
    return O.stale(run(spark, d, "SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'completed' END AS status, o_orderkey AS heartbeat FROM {orders}"), 3000)


def alias_inventory(spark, d):
    return O.inventory(frame(spark, d, "aliases"))


def inventory_lines(spark, d):
    return O.inventory_lines(frame(spark, d, "aliases"))


def evaluation_history(spark, d):
    return O.history(frame(spark, d, "metrics"))


def copy_dump(spark, d):
    return A.copy_table(run(spark, d, COPY), ["id", "name", "kind"], ("name",))


def _packed(spark, d):
    """Archives of the events' lines, one for each event type, a member for each month."""
    path = new_path(spark, "archives")
    P.pack(run(spark, d, MEMBERS).withColumn("line", F.col("event_id")), path)
    return path


def archive_lines(spark, d):
    rows = P.tar_lines(spark, _packed(spark, d), range_bytes=1 << 16)
    file, member = F.substring_index("origin", "!", 1), F.substring_index("origin", "!", -1)
    return rows.select(F.substring_index(F.substring_index(file, "/", -1), ".", 1).alias("archive"), member.alias("member"), "line", "value")


def archive_members(spark, d):
    return P.tar_members(spark, _packed(spark, d)).select(F.substring_index("origin", "/", -4).alias("origin"), "bytes", "sha256")


def shard_files(spark, d):
    path = new_path(spark, "archives")
    P.pack(run(spark, d, MEMBERS).select(F.lit("all").alias("archive"), "member", F.col("event_id").alias("line"), "value"), path)
    return P.shard_files(spark, f"{path}/all.tar", new_path(spark, "shards"), "v1").select("number", "member_name", "year", "month", "size_bytes", "sha256")


def scheduled_shards(spark, d):
    rows = run(spark, d, "SELECT o_orderkey AS number, CAST(o_custkey AS BIGINT) AS size_bytes FROM {orders}")
    return P.schedule_totals(rows, 40)


def release_list(spark, d):
    return A.releases(run(spark, d, NAMES), "2020-01-05").select("name", "number", "mode", F.date_format("released", "yyyy-MM-dd HH:mm:ss").alias("released"))


def latest_releases(spark, d):
    return A.latest_release(A.releases(run(spark, d, NAMES)))


def page_links(spark, d):
    return A.index_links(run(spark, d, "SELECT html FROM {pages}")).groupBy("name").agg(F.count("*").alias("n"))


def checksum_lines(spark, d):
    return A.checksums(run(spark, d, "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'noise' ELSE md5(p_name) || md5(p_brand) || '  ' || p_name END AS value FROM {part}"))


def unique_pairs(spark, d):
    return frame(spark, d, "observations").dropDuplicates(["shard", "msid", "mbid"])


def csv_round_trip(spark, d):
    path = new_path(spark, "csv")
    K.csv_chunks(run(spark, d, "SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS c FROM {orders}"), path, "o_orderkey", 16, 500)
    return K.read_csv_chunks(spark, path, "o_orderkey long, o_orderpriority string, c long")


def partition_rerun(spark, d):
    path, rows = new_path(spark, "parts"), run(spark, d, "SELECT o_orderkey, o_orderpriority AS run FROM {orders}")
    K.overwrite_partitions(rows, path, ["run"])
    K.overwrite_partitions(rows.filter("run = '1-URGENT' and o_orderkey % 2 = 0"), path, ["run"])
    return spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"))


def table_upsert(spark, d):
    old = run(spark, d, "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS v FROM {orders} WHERE o_orderkey % 3 <> 0")
    new = run(spark, d, "SELECT o_orderkey AS id, -o_orderkey AS v FROM {orders} WHERE o_orderkey % 2 = 0")
    parts = [K.upsert(old, new, ["id"], r).withColumn("rule", F.lit(r)) for r in ("nothing", "update", "fill")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def table_swap(spark, d):
    root = new_path(spark, "swap")
    K.swap(run(spark, d, "SELECT 1 AS o_orderkey"), root, "v1")
    K.swap(run(spark, d, "SELECT o_orderkey FROM {orders}"), root, "v2")
    return K.current(spark, root)


def _stream_events(spark, d):
    rows = frame(spark, d, "listens")
    return rows.select("event_id", "user_name", "item", F.col("ts").cast("timestamp").alias("at"))


def stream_windows(spark, d):
    return L.demo(spark, _stream_events(spark, d), "windows").withColumn("start", F.unix_seconds("start"))


def stream_once(spark, d):
    return L.demo(spark, _stream_events(spark, d), "once")


def stream_session_items(spark, d):
    return L.demo(spark, _stream_events(spark, d), "items").select("session_key", "item", F.unix_seconds("first_at").alias("first_at"), F.unix_seconds("last_at").alias("last_at"), "plays")


def attribute_tokens(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, p_brand, p_name FROM {part}")
    tokens = X.attribute_tokens(F.create_map(F.lit("b"), F.split("p_name", " "), F.lit("a"), F.array("p_brand")))
    return rows.select("id", F.array_join(tokens, "|").alias("tokens"))


def merged_props(spark, d):
    more = F.create_map(F.lit("kind"), F.col("event_type"))
    out = run(spark, d, "SELECT event_id, event_type, props FROM {events}").select("event_id", X.merged_json(F.col("props"), more).alias("j"))
    return out.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.get_json_object("j", "$.kind").alias("kind"))


def favourite_words(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name END AS v FROM {part}")
    return rows.select("id", X.first_or(F.split("v", " "), "other").alias("favourite"))


def tier_sizes(spark, d):
    return O.sizes(run(spark, d, "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'hot' ELSE 'cold' END AS tier, o_orderkey AS bytes FROM {orders}"))


def unordered_parts(spark, d):
    return O.missing_members(run(spark, d, "SELECT p_partkey AS item FROM {part}"), run(spark, d, "SELECT l_partkey AS item FROM {lineitem} WHERE l_quantity > 10"), "item")


QUERIES = {f.__name__: f for f in (
    attribute_tokens, merged_props, favourite_words, tier_sizes, unordered_parts,
    top_by_popularity, related_suppliers, newest_orders, completeness, name_search, map_points, map_cells, second_page, artist_names, visible_lists,
    capacity_append, online_users, genre_sync, featured_genres, pending_features, seeded_profiles, partial_dates, slugs, token_vectors, normalized_lists, rounded_places,
    round_scores, leaderboard, fuzzy_matches, contained_matches, hydration_seeds, claimed_items, hydration_outcomes, retry_times, run_progress, run_eta, partition_states,
    shard_reconciliation, shard_dispatch, shard_skips, version_backlog, latest_runs, stale_runs, alias_inventory, inventory_lines, evaluation_history, copy_dump,
    map_hexes, catalog_features, pending_batches, stream_stale_runs, conditional_upsert, attribute_values, release_times,
    archive_lines, archive_members, shard_files, scheduled_shards, release_list, latest_releases, page_links, checksum_lines, unique_pairs, csv_round_trip, partition_rerun, table_upsert, table_swap, stream_windows, stream_once,
    stream_session_items,
)}

_SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_POINTS_OF = "(CASE WHEN song THEN 100 ELSE 0 END + CASE WHEN artist THEN 50 ELSE 0 END + CASE WHEN trivia THEN 50 ELSE 0 END)"
_RELEASES = f"rel AS (SELECT name, CAST(regexp_extract(name, 'dump-(\\d+)-', 1) AS INT) AS number, regexp_extract(name, '(full|incremental)$', 1) AS mode, strptime(regexp_extract(name, '-(\\d{{8}}-\\d{{6}})-', 1), '%Y%m%d-%H%M%S') AS released FROM ({plain(NAMES)}) WHERE name NOT LIKE '%-x')"

ORACLE_SQL = {
    "attribute_tokens": "SELECT p_partkey AS id, lower(p_brand || '|' || replace(p_name, ' ', '|')) AS tokens FROM part",
    "merged_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events",
    "favourite_words": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE 'other' END AS favourite FROM part",
    "tier_sizes": "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS tables, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders GROUP BY 1",
    "unordered_parts": "SELECT count(*) AS missing, count(*) = 0 AS complete FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)",
    "top_by_popularity": "SELECT * FROM (SELECT p_brand, p_partkey, CAST(n AS BIGINT) AS number, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC NULLS FIRST, p_partkey) AS INT) AS rank FROM (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS n FROM part)) WHERE rank <= 5",
    "related_suppliers": "SELECT * FROM (SELECT a.s_suppkey AS node, b.s_suppkey AS other, CAST(1 AS BIGINT) AS shared, CAST(row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_suppkey) AS INT) AS rank FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey) WHERE rank <= 5",
    "newest_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 5",
    "completeness": """SELECT *, albums = complete AS hydrated FROM (SELECT c_custkey AS artist, count(DISTINCT o_orderkey) AS albums, count(DISTINCT o_orderkey) FILTER (WHERE coalesce(n, 0) >= 2 + o_orderkey % 4) AS complete
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)""",
    "name_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') ORDER BY 1 LIMIT 10",
    "map_points": f"SELECT * FROM ({plain(POINTS)}) WHERE lat BETWEEN -45 AND 45 AND lng BETWEEN -90 AND 90 AND weight >= 0.2::DOUBLE ORDER BY weight DESC, id LIMIT 10000",
    "map_cells": f'SELECT CAST(floor(lat / 15) AS BIGINT) AS "row", CAST(floor(lng / 15) AS BIGINT) AS col, count(*) AS n, round(sum(weight), 6) AS weight, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM ({plain(POINTS)}) GROUP BY floor(lat / 15), floor(lng / 15)',
    "second_page": "SELECT p_partkey, p_name FROM part ORDER BY 1 LIMIT 20 OFFSET 20",
    "artist_names": "SELECT track, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT l_partkey AS track, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY 1",
    "visible_lists": 'SELECT o_custkey AS "user", o_orderkey AS list FROM orders UNION SELECT l_suppkey, l_orderkey FROM lineitem',
    "capacity_append": """WITH have AS (SELECT l_orderkey AS list, min(l_partkey) AS item, max(l_linenumber) AS position FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber),
        size AS (SELECT list, max(position) AS last, count(*) AS size FROM have GROUP BY 1),
        fresh AS (SELECT n.* FROM (SELECT l_orderkey AS list, l_partkey AS item, min(l_suppkey) AS ordinal FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2) n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.list = n.list AND h.item = n.item)),
        placed AS (SELECT f.list, f.item, row_number() OVER (PARTITION BY f.list ORDER BY f.ordinal, f.item) AS n, coalesce(s.last, 0) AS last, coalesce(s.size, 0) AS size FROM fresh f LEFT JOIN size s ON s.list = f.list)
        SELECT list, item, CAST(last + n AS BIGINT) AS position FROM placed WHERE size + n <= 4""",
    "online_users": 'SELECT c_custkey AS "user", c_name AS name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_id > 500)',
    "genre_sync": f"""WITH fresh AS (SELECT DISTINCT trim(p_brand) AS name FROM part UNION SELECT DISTINCT trim(p_type) FROM part), f AS (SELECT name, 'genre:' || substr({_SLUG.format('name')}, 1, 24) AS genre_id FROM fresh)
        SELECT name, genre_id, CASE WHEN genre_id IN (SELECT 'genre:' || lower(p_brand) FROM part WHERE p_size % 2 = 0) THEN 'updated' WHEN lower(name) IN (SELECT lower(p_type) FROM part WHERE p_size % 3 = 0) OR lower(name) = 'x' THEN 'renamed' ELSE 'created' END AS outcome FROM f""",
    "featured_genres": "SELECT * FROM (SELECT s_nationkey AS genre, s_acctbal AS popularity, s_suppkey AS artist, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank FROM supplier WHERE s_nationkey IN (1, 3, 5, 7, 9)) WHERE rank <= 3",
    "pending_features": "SELECT l_suppkey AS artist, l_orderkey * 10 + l_linenumber AS track, CAST((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 50 AS BIGINT) AS batch FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey % 2 = 0 AND x.l_orderkey * 10 + x.l_linenumber = l.l_orderkey * 10 + l.l_linenumber)",
    "partial_dates": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '1999-01-01' WHEN 1 THEN '2001-07-01' WHEN 2 THEN '2010-02-28' END AS released FROM part",
    "slugs": f"SELECT id, CASE WHEN s <> '' THEN substr(s, 1, 24) ELSE substr(sha1(v), 1, 24) END AS slug FROM (SELECT id, v, {_SLUG.format('v')} AS s FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '!!' ELSE ' ' || p_type || ' & ' || p_name END AS v FROM part))",
    "token_vectors": """WITH t AS (SELECT p_partkey AS id, sha1(unnest(string_split(lower(p_name), ' '))) AS h FROM part), s AS (SELECT id, i AS place, CAST(sum(CASE WHEN i < 20 THEN CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INT) ELSE 0 END) AS DOUBLE) AS x FROM t, (SELECT CAST(r AS INT) AS i FROM range(32) q(r)) GROUP BY 1, 2)
        SELECT id, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM s""",
    "normalized_lists": "SELECT p_partkey AS id, CASE WHEN p_type = p_brand THEN p_type ELSE least(p_type, p_brand) || '|' || greatest(p_type, p_brand) END AS v FROM part",
    "rounded_places": "SELECT c_custkey AS id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 1000)) AS clout, round_even(c_custkey / 8.0::DOUBLE, 2) AS lat FROM customer",
    "round_scores": f"SELECT game, player, CAST(sum({_POINTS_OF}) AS BIGINT) AS score FROM ({plain(GUESSES)}) GROUP BY 1, 2",
    "leaderboard": f"""SELECT p."user", CAST(sum({_POINTS_OF}) AS BIGINT) AS score, count(DISTINCT g.game) AS games, count(*) FILTER (WHERE song) AS songs, count(*) FILTER (WHERE artist) AS artists, count(*) FILTER (WHERE trivia) AS trivia
        FROM ({plain(GUESSES)}) g JOIN ({plain(PLAYERS).replace('AS user,', 'AS "user",')}) p ON p.game = g.game AND p.player = g.player WHERE p."user" IS NOT NULL AND p.party GROUP BY 1""",
    "contained_matches": "SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 = 0 THEN contains(lower(p_name), trim(lower(substr(p_name, 2, 3)))) AND trim(substr(p_name, 2, 3)) <> '' WHEN p_partkey % 3 = 1 THEN false ELSE contains(lower(p_name), lower(p_type)) OR contains(lower(p_type), lower(p_name)) END, false) AS correct FROM part",
    "hydration_seeds": "SELECT p_partkey AS item, p_name AS isrc FROM part WHERE p_size >= 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)",
    "claimed_items": f"SELECT id, priority, status FROM ({plain(QUEUE)}) WHERE (status IN ('pending', 'retry') AND coalesce(next_at <= 900, true)) OR (status = 'running' AND lease_until < 900) ORDER BY priority, id LIMIT 100",
    "hydration_outcomes": """WITH c AS (SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS track FROM lineitem WHERE l_quantity < 4 GROUP BY 1),
        j AS (SELECT p_partkey AS item, c.track, CASE WHEN c.n IS NULL THEN 'no_match' WHEN c.n > 1 THEN 'ambiguous' WHEN s_suppkey IS NOT NULL AND s_suppkey * 2 <> p_partkey THEN 'ambiguous' ELSE 'matched' END AS outcome
            FROM part LEFT JOIN c ON c.item = p_partkey LEFT JOIN supplier ON s_suppkey = c.track AND s_suppkey % 2 = 0) SELECT item, outcome, CASE WHEN outcome = 'matched' THEN track END AS track FROM j""",
    "retry_times": f"SELECT id, attempts + 1 AS attempts, 1000 + CAST(least(3600, pow(2, attempts + 1)) AS BIGINT) AS next_at FROM ({plain(QUEUE)})",
    "run_progress": f"""SELECT run, count(*) AS shards, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'succeeded') AS succeeded,
        count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(rows) AS BIGINT) AS rows, CAST(coalesce(sum(bytes) FILTER (WHERE status = 'succeeded'), 0) AS BIGINT) AS done_bytes FROM ({plain(SHARDS)}) GROUP BY 1""",
    "run_eta": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_custkey / CAST(o_orderkey % 7 AS DOUBLE), 6) END AS rate, CASE WHEN o_orderkey % 7 <> 0 AND o_custkey <> 0 THEN round(greatest(2000 - o_custkey, 0) / (o_custkey / CAST(o_orderkey % 7 AS DOUBLE)), 6) END AS eta_s FROM orders",
    "partition_states": f"SELECT status, count(*) AS n FROM ({plain(SHARDS)}) GROUP BY 1",
    "shard_reconciliation": f"SELECT key, CASE WHEN status = 'running' THEN 'refuse' ELSE 'delete' END AS action FROM ({plain(SHARDS)}) WHERE key % 3 <> 0 AND key % 2 <> 0 UNION ALL SELECT o_orderkey, 'insert' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0",
    "shard_dispatch": f"""WITH s AS ({plain(SHARDS)}), r AS (SELECT s.run, s.key, row_number() OVER (PARTITION BY s.run ORDER BY s.key) AS n, (SELECT count(*) FROM s x WHERE x.run = s.run AND x.status = 'running') AS busy FROM s
        WHERE status = 'pending' OR (status = 'failed' AND session < current)) SELECT run, key FROM r WHERE n <= 1000 - busy""",
    "shard_skips": "SELECT o_orderkey AS shard, md5(o_orderpriority) AS sha FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_custkey % 5 <> 0 AND 1 + o_custkey % 3 >= 2)",
    "version_backlog": "SELECT o_orderkey AS version, 'succeeded' AS status, 'incremental' AS mode FROM orders WHERE o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4) ORDER BY 1 LIMIT 30",
    "latest_runs": "SELECT source, run FROM (SELECT o_orderpriority AS source, o_orderkey AS run, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 3 = 0 DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_custkey % 2 = 0) WHERE n = 1",
    "stale_runs": "SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 <> 0 THEN 'completed' WHEN o_orderkey < 1200 THEN 'failed' ELSE 'running' END AS status FROM orders",
    "alias_inventory": oracle("SELECT source, status, count(*) AS n FROM aliases GROUP BY GROUPING SETS ((source), (source, status))", "aliases"),
    "inventory_lines": oracle("""SELECT 'aliases_total{source="' || source || '",status="' || status || '"} ' || count(*) AS line FROM aliases GROUP BY source, status""", "aliases"),
    "evaluation_history": oracle("""SELECT label, dataset, max(value) FILTER (WHERE metric = 'recall') AS recall, max(value) FILTER (WHERE metric = 'ndcg') AS ndcg, max(value) FILTER (WHERE metric = 'coverage') AS coverage,
        max(value) FILTER (WHERE metric = 'cold') AS cold, max(created) AS created FROM metrics GROUP BY 1, 2""", "metrics"),
    "copy_dump": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 1 THEN 'a' || chr(92) || 'n' || p_brand ELSE 'b' || chr(9) || p_brand END AS name, p_type AS kind FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 3 <> 0",
    "map_hexes": f"""WITH p AS (SELECT *, (CASE WHEN abs(lat) >= 90 THEN 0.0 ELSE lng END * sqrt(3.0::DOUBLE) / 3 - lat / 3) / s AS q, lat * 2 / 3 / s AS r FROM ({plain(POINTS)}), (SELECT 360 / (24 * sqrt(3.0::DOUBLE)) AS s)),
        c AS (SELECT *, floor(q + 0.5) AS a, floor(r + 0.5) AS b, floor(-q - r + 0.5) AS c FROM p), e AS (SELECT *, abs(a - q) AS da, abs(b - r) AS db, abs(c + q + r) AS dc FROM c),
        h AS (SELECT *, CASE WHEN da > db AND da > dc THEN -b - c ELSE a END AS ha, CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END AS hb FROM e)
        SELECT CAST(hb AS BIGINT) AS "row", CAST(((ha + floor(hb / 2)) % 24 + 24) % 24 AS BIGINT) AS col, count(*) AS n, round(sum(weight), 6) AS weight, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM h GROUP BY 1, 2""",
    "catalog_features": """SELECT p.p_partkey * 2 AS item, p.p_brand AS album, artist, genre FROM part p LEFT JOIN (SELECT DISTINCT p_brand AS album, p_size AS artist FROM part WHERE p_size < 9 AND p_brand NOT LIKE '%2') a ON a.album = p.p_brand
        LEFT JOIN (SELECT DISTINCT p_size AS g_artist, p_type AS genre FROM part WHERE p_size % 2 = 0 AND p_size < 9) g ON g_artist = artist WHERE p_size % 7 <> 0""",
    "pending_batches": "SELECT l_orderkey * 10 + l_linenumber AS track, CAST((row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber) - 1) // 50 AS BIGINT) AS batch FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey % 2 = 0 AND x.l_orderkey * 10 + x.l_linenumber = l.l_orderkey * 10 + l.l_linenumber)",
    "stream_stale_runs": "SELECT o_orderkey AS run, CASE WHEN o_custkey % 2 <> 0 THEN 'completed' WHEN o_orderkey < 1200 THEN 'failed' ELSE 'running' END AS status FROM orders",
    "conditional_upsert": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS v, o_orderpriority AS part FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, o_orderpriority AS part FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '4'),
        j AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.part, n.part) AS part, CASE WHEN n.id IS NOT NULL AND coalesce(700 > o.v, true) THEN 700 ELSE o.v END AS v, CASE WHEN n.id IS NULL OR 700 <= o.v THEN NULL WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM o FULL JOIN n ON n.id = o.id AND n.part = o.part)
        SELECT id, v, part, 'table' AS action FROM j UNION ALL SELECT id, v, part, action FROM j WHERE action IS NOT NULL""",
    "attribute_values": "SELECT p_partkey AS id, p_brand || '|' || replace(p_name, ' ', '|') AS tokens FROM part",
    "release_times": f"WITH {_RELEASES} SELECT name, strftime(released, '%Y-%m-%dT%H:%M:%SZ') AS released, CAST(epoch(released) AS BIGINT) AS epoch FROM rel",
    "archive_lines": f"SELECT archive, member, row_number() OVER (PARTITION BY archive, member ORDER BY event_id) AS line, value FROM ({plain(MEMBERS)})",
    "archive_members": f"SELECT regexp_extract(archive || '.tar!' || member, '[^/]*/[^/]*/[^/]*/[^/]*$') AS origin, CAST(sum(length(value) + 1) AS BIGINT) AS bytes, sha256(string_agg(value || chr(10), '' ORDER BY event_id)) AS sha256 FROM ({plain(MEMBERS)}) GROUP BY archive, member",
    "shard_files": f"""SELECT row_number() OVER (ORDER BY member) - 1 AS number, member AS member_name, CAST(split_part(member, '/', 3) AS INT) AS year, CAST(regexp_extract(member, '(\\d+)[.]', 1) AS INT) AS month, size_bytes, sha256
        FROM (SELECT member, CAST(sum(length(value) + 1) AS BIGINT) AS size_bytes, sha256(string_agg(value || chr(10), '' ORDER BY event_id)) AS sha256 FROM ({plain(MEMBERS)}) GROUP BY member)""",
    "scheduled_shards": "SELECT count(*) AS shard_count, count(*) FILTER (WHERE n <= 40) AS scheduled_shard_count, CAST(sum(c) AS BIGINT) AS total_uncompressed_bytes, CAST(sum(c) FILTER (WHERE n <= 40) AS BIGINT) AS scheduled_uncompressed_bytes FROM (SELECT o_custkey AS c, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)",
    "release_list": f"WITH {_RELEASES} SELECT name, number, mode, strftime(released, '%Y-%m-%d %H:%M:%S') AS released FROM rel WHERE released > TIMESTAMP '2020-01-05'",
    "latest_releases": f"WITH {_RELEASES} SELECT mode, name FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY released DESC, number DESC, name DESC) AS n FROM rel) WHERE n = 1",
    "page_links": "SELECT regexp_replace(x, '/$', '') AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS x FROM pages) GROUP BY 1",
    "checksum_lines": "SELECT p_name AS file, md5(p_name) || md5(p_brand) AS sha256 FROM part WHERE p_partkey % 5 <> 0",
    "unique_pairs": oracle("SELECT DISTINCT msid, mbid, shard FROM observations", "observations"),
    "csv_round_trip": "SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS c, 'p' || lpad(CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT % 16 AS VARCHAR), 3, '0') AS part FROM orders",
    "partition_rerun": "SELECT o_orderpriority AS run, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 2 = 0 GROUP BY 1",
    "table_upsert": """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS v, true AS was FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, -o_orderkey AS v, true AS now FROM orders WHERE o_orderkey % 2 = 0),
        j AS (SELECT coalesce(o.id, n.id) AS id, o.v AS a, n.v AS b, was, now FROM o FULL JOIN n ON n.id = o.id)
        SELECT id, CASE WHEN was THEN a ELSE b END AS v, 'nothing' AS rule FROM j UNION ALL SELECT id, CASE WHEN now THEN b ELSE a END, 'update' FROM j UNION ALL SELECT id, coalesce(a, b), 'fill' FROM j""",
    "table_swap": "SELECT o_orderkey FROM orders",
    "stream_windows": oracle('SELECT user_name, CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS "start", count(*) AS plays FROM listens GROUP BY 1, 2', "listens"),
    "stream_once": oracle("SELECT DISTINCT user_name, item FROM listens", "listens"),
    "stream_session_items": oracle("SELECT user_name AS session_key, item, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_at, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at, count(*) AS plays FROM listens GROUP BY 1, 2", "listens"),
}
