"""Queries on identities, aliases, redirects, bridges and listen ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import bridge as B
from cadenza.operators import identity as I
from cadenza.operators import ingest as N
from cadenza.plans.shared import frame, oracle, plain, run
from cadenza.session import new_path
from cadenza.streaming import positions as T

# The stand-ins of several queries; both engines read them alike.
OLD_REDIRECTS = "SELECT from_id, to_id, status FROM redirects WHERE from_id % 2 = 0"
NEW_REDIRECTS = "SELECT p_partkey AS from_id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 1 WHEN p_partkey % 6 = 0 THEN p_partkey ELSE p_partkey + 2 END AS to_id FROM {part} WHERE p_partkey % 5 <> 0"
INCOMING = "SELECT l_orderkey * 10 + l_linenumber AS ordinal, l_partkey AS item, l_shipmode AS source, l_returnflag AS kind, CAST(l_suppkey AS VARCHAR(20)) AS skey FROM {lineitem}"
INCOMING = INCOMING.replace("l_shipmode", "l_linestatus")
EXISTING = "SELECT 'O' AS source, 'N' AS kind, CAST(s_suppkey AS VARCHAR(20)) AS skey, s_suppkey AS item FROM {supplier} WHERE s_suppkey % 3 = 0"
REQUESTS = """SELECT CASE WHEN p_partkey % 17 = 0 THEN 'deezer' WHEN p_partkey % 3 = 0 THEN 'isrc' ELSE 'spotify' END AS source, 'track' AS kind,
    CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 23 = 0 THEN 'nothing' ELSE substr(md5(p_name), 1, 6) END AS skey FROM {part}"""
GRAPH_ITEMS = """SELECT DISTINCT 'recording_mbid:' || o_orderpriority AS key FROM {orders} WHERE o_orderpriority <> '1-URGENT'
    UNION SELECT 'recording_msid:' || CAST(c_custkey AS VARCHAR(20)) FROM {customer} WHERE c_custkey % 2 = 0"""
LINES = """SELECT 'part-' || CAST(event_id % 4 AS VARCHAR(2)) AS origin, event_id AS line, CASE
    WHEN event_id % 31 = 0 THEN '  ' WHEN event_id % 29 = 0 THEN '{{broken'
    WHEN event_id % 11 = 0 THEN '{{"user_name":"u' || CAST(user_id AS VARCHAR(20)) || '","payload":{{"listens":[{{"listened_at":' || CAST(1700000000 + event_id AS VARCHAR(20)) || ',"track_metadata":{{"track_name":"' || event_type || '"}}}},{{"user_name":"other","listened_at":"","timestamp":"' || CAST(1700000000 + event_id AS VARCHAR(20)) || '","track_metadata":{{"recording_msid":"' || md5(event_type) || '"}}}}]}}}}'
    WHEN event_id % 7 = 0 THEN '{{"user_name":" ","user_id":"id' || CAST(user_id AS VARCHAR(20)) || '","listened_at":' || CAST(1700000000 + event_id AS VARCHAR(20)) || ',"track_metadata":{{"mbid_mapping":{{"recording_mbid":"' || md5(CAST(user_id AS VARCHAR(20))) || '"}}}}}}'
    WHEN event_id % 5 = 0 THEN '{{"user_name":"u1","listened_at":"soon","track_metadata":{{"track_name":"x"}}}}'
    WHEN event_id % 13 = 0 THEN '{{"user_name":"u1","listened_at":1700000000}}'
    WHEN event_id % 17 = 0 THEN '{{"user_name":"u1","listened_at":1700000000,"track_metadata":{{"artist_name":"a"}}}}'
    ELSE '{{"user_name":"u' || CAST(user_id AS VARCHAR(20)) || '","listened_at":' || CAST(1700000000 + event_id AS VARCHAR(20)) || ',"track_metadata":{{"track_name":"' || event_type || '","artist_name":" A ","additional_info":{{"spotify_id":"https://x.example/track/' || substr(md5(event_type), 1, 22) || '"}}}}}}'
    END AS value FROM {events}"""


def _lines(spark, d):
    return run(spark, d, LINES.replace("{{", "\u0002").replace("}}", "\u0003")).withColumn("value", F.translate("value", "\u0002\u0003", "{}"))


def _lines_sql() -> str:
    return plain(LINES.replace("{{", "\u0002").replace("}}", "\u0003")).replace("\u0002", "{").replace("\u0003", "}")


def canonical_identities(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN md5(p_name) END AS mbid, CASE WHEN p_size % 2 = 0 THEN p_brand END AS provider, CAST(p_partkey AS VARCHAR(20)) AS own FROM {part}")
    key = I.canonical_key(I.track_identity(X.safe_uuid(F.col("mbid")), F.col("provider"), F.col("own")))
    return rows.select("id", key.alias("key")).select("id", "key", X.uuid5(F.col("key")).alias("item_id"), X.md5_uuid(F.col("key")).alias("alias_id"))


def alias_keys(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, ' ' || p_brand AS source, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE upper(p_type) || ' ' END AS kind, p_name AS skey FROM {part}")
    return rows.select("id", X.alias_key(F.col("source"), F.col("kind"), F.col("skey")).alias("k")).select("id", "k.source", "k.kind", "k.key")


def provider_ids(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'spotify:track:' WHEN 1 THEN 'https://open.example/track/' WHEN 2 THEN '' ELSE 'bad/' END || substr(md5(p_name), 1, 22) || CASE WHEN p_partkey % 8 = 1 THEN '?si=1' ELSE '' END AS v FROM {part}")
    return rows.select("id", X.track_id(F.col("v")).alias("track_id"))


def safe_uuids(spark, d):
    rows = run(spark, d, "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN upper(md5(p_name)) WHEN 2 THEN 'urn:uuid:' || md5(p_name) WHEN 3 THEN '(' || md5(p_name) || ')' ELSE 'x' || md5(p_name) END AS v FROM {part}")
    return rows.select("id", X.safe_uuid(F.col("v")).alias("uuid"))


def canonical_upsert(spark, d):
    old = run(spark, d, "SELECT p_brand AS key, CASE WHEN max(p_size) % 2 = 0 THEN max(p_size) END AS track FROM {part} WHERE p_partkey % 2 = 0 GROUP BY 1")
    new = run(spark, d, "SELECT p_type AS key, p_size AS track FROM {part} UNION ALL SELECT p_brand, p_size FROM {part} WHERE p_partkey % 3 = 0")
    return I.upsert_items(old, new)


def alias_conflicts(spark, d):
    return I.alias_conflicts(run(spark, d, INCOMING), run(spark, d, EXISTING))


def self_aliases(spark, d):
    items = frame(spark, d, "items").select("item", "kind", "skey")
    have = items.filter("item % 4 = 0").select("kind", "skey", F.when(F.col("item") % 8 == 0, F.col("item")).otherwise(F.lit(-1)).alias("item"))
    return I.self_aliases(items, have, 10)


def redirect_upsert(spark, d):
    return I.upsert_redirects(frame(spark, d, "redirects").filter("from_id % 2 = 0"), run(spark, d, NEW_REDIRECTS))


def redirect_retirement(spark, d):
    return I.retire_missing(frame(spark, d, "redirects"), run(spark, d, NEW_REDIRECTS))


def redirect_chains(spark, d):
    return I.follow(run(spark, d, "SELECT p_partkey AS item FROM {part}"), frame(spark, d, "redirects"))


def expanded_seeds(spark, d):
    return I.expand_seeds(run(spark, d, "SELECT l_orderkey AS request, l_partkey AS item FROM {lineitem}"), frame(spark, d, "redirects"))


def redirected_plays(spark, d):
    rows = I.redirected(frame(spark, d, "plays"), frame(spark, d, "redirects"))
    return rows.groupBy("item").agg(F.count("*").alias("n"))


def resolved_requests(spark, d):
    return I.resolve(run(spark, d, REQUESTS), frame(spark, d, "aliases"), frame(spark, d, "redirects"))


def first_plays(spark, d):
    rows = run(spark, d, "SELECT l_suppkey AS seed, l_partkey AS item, l_orderkey * 10 + l_linenumber AS ordinal FROM {lineitem}")
    return I.first_occurrences(rows, ["seed", "item"], "ordinal")


def key_page(spark, d):
    return I.page_after(run(spark, d, "SELECT p_partkey, p_name FROM {part}"), "p_partkey", 40, 20)


def identity_mappings(spark, d):
    return B.classify(B.mappings(frame(spark, d, "observations")))


def dominant_mappings(spark, d):
    return B.dominant(B.mappings(frame(spark, d, "observations")), 2, 0.5)


def resolved_conflicts(spark, d):
    items = run(spark, d, "SELECT DISTINCT 'recording_mbid:' || o_orderpriority AS key FROM {orders} WHERE o_orderpriority NOT LIKE '3%'")
    return B.winners(B.mappings(frame(spark, d, "observations")), items, 2, 0.4)


def observation_report(spark, d):
    return B.observation_report(frame(spark, d, "observations"))


def clean_isrcs(spark, d):
    return B.clean_isrcs(frame(spark, d, "isrcs"))


def isrc_report(spark, d):
    return B.isrc_report(frame(spark, d, "isrcs"))


def unambiguous_isrcs(spark, d):
    return B.unambiguous_isrcs(frame(spark, d, "isrcs"))


def isrc_aliases(spark, d):
    codes = frame(spark, d, "isrcs")
    have = codes.filter("item % 9 = 0").select(X.isrc_strip(F.col("isrc")).alias("skey"))
    return B.isrc_aliases(codes, run(spark, d, "SELECT p_partkey AS item FROM {part} WHERE p_partkey % 3 = 0"), have)


def url_evidence(spark, d):
    urls = run(spark, d, "SELECT page_id AS url_id, CASE page_id % 4 WHEN 0 THEN 'https://open.spotify.com/' WHEN 1 THEN 'https://youtu.be/' WHEN 2 THEN 'https://Music.Apple.com/' ELSE '' END || url AS url FROM {pages}")
    relations = run(spark, d, "SELECT l_suppkey AS recording_id, l_partkey % 200 AS url_id, l_linenumber AS link_id FROM {lineitem}")
    links = run(spark, d, "SELECT DISTINCT l_linenumber AS link_id, CAST(l_linenumber % 3 AS INT) AS type_id FROM {lineitem}")
    kinds = run(spark, d, "SELECT r_regionkey AS type_id, r_name AS link_type FROM {region}")
    return B.url_evidence(urls, relations, links, kinds, run(spark, d, "SELECT s_suppkey AS recording_id, md5(s_name) AS mbid FROM {supplier}"))


def graph_expansion(spark, d):
    return B.expand_graph(B.mappings(frame(spark, d, "observations")), run(spark, d, GRAPH_ITEMS))


def parsed_listens(spark, d):
    return N.parse(N.flatten(_lines(spark, d))).drop("artist_mbids")


def listen_counters(spark, d):
    return N.counters(N.parse(N.flatten(_lines(spark, d))))


def stream_counters(spark, d):
    source, out, check = (new_path(spark, f"lines-{x}") for x in ("in", "out", "check"))
    rows = _lines(spark, d)
    for k in range(2):  # the second run goes on after the position of the first
        rows.filter(F.col("line") % 2 == k).select("value").write.text(f"{source}/run={k}")
        T.ingest_listens(spark, source, out, check, suffixes=(".txt",))
    return T.totals(spark, out).drop("position")


def hashed_listens(spark, d):
    out = N.hashed(N.parse(N.flatten(_lines(spark, d))), "salt")
    return out.select("origin", "line", "entry", "session_key", "signature", I.canonical_key(F.col("identity")).alias("key"), X.partition_label(F.col("signature"), 128).alias("part"))


def resumed_listens(spark, d):
    return N.resume(N.flatten(_lines(spark, d)).select("origin", "line", "entry"), "part-1", 100, 0)


def _events(spark, d):
    rows = frame(spark, d, "listens")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.select("event_id", "item", "user_name", epoch.alias("at"), X.session_key(F.col("user_name"), epoch, 86400).alias("session_key"))


def session_items(spark, d):
    return N.session_items(_events(spark, d))


def merged_session_items(spark, d):
    e = _events(spark, d)
    return N.merge_session_items(N.session_items(e.filter("event_id % 2 = 0")), N.session_items(e.filter("event_id % 2 = 1")))


def first_events(spark, d):
    e = _events(spark, d)
    return N.first_events(e.select(X.event_signature(F.col("user_name"), F.col("item")).alias("signature"), F.col("event_id").alias("ref"), "at"))


QUERIES = {f.__name__: f for f in (
    canonical_identities, alias_keys, provider_ids, safe_uuids, canonical_upsert, alias_conflicts, self_aliases, redirect_upsert,
    redirect_retirement, redirect_chains, expanded_seeds, redirected_plays, resolved_requests, first_plays, key_page, identity_mappings,
    dominant_mappings, resolved_conflicts, observation_report, clean_isrcs, isrc_report, unambiguous_isrcs, isrc_aliases, url_evidence, graph_expansion,
    parsed_listens, listen_counters, stream_counters, hashed_listens, resumed_listens, session_items, merged_session_items, first_events,
)}



def _dash(x: str) -> str:
    return f"regexp_replace({x}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _safe(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9a-f]{{32}}$') THEN {_dash(x)} END"


_NS = "from_hex('9f291c3dbb5c4fd7a1cd730f4f9dc9b7')"
_U5 = _dash("substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT & 3 AS INT) + 1, 1) || substr(h, 18, 15)")
_PARSED = f"""flat AS (
    SELECT origin, line, 0 AS entry, value, value AS listen, NULL AS envelope FROM lines WHERE trim(value) <> '' AND coalesce(NOT json_exists(TRY_CAST(value AS JSON), '$.payload'), true)
    UNION ALL SELECT origin, line, CAST(i AS INT), value, CAST(json_extract(value, '$.payload.listens[' || i || ']') AS VARCHAR), json_extract_string(value, '$.user_name') FROM lines, range(2) t(i)
        WHERE TRY_CAST(value AS JSON) IS NOT NULL AND json_exists(TRY_CAST(value AS JSON), '$.payload')),
    fields AS (SELECT origin, line, entry, TRY_CAST(listen AS JSON) AS j, envelope FROM flat),
    raw AS (SELECT origin, line, entry, j IS NULL AS malformed,
        coalesce(nullif(trim(j->>'$.user_name'), ''), envelope, nullif(trim(j->>'$.user_id'), '')) AS user,
        TRY_CAST(coalesce(nullif(j->>'$.listened_at', ''), nullif(j->>'$.timestamp', '')) AS BIGINT) AS epoch,
        j->>'$.track_metadata.mbid_mapping.recording_mbid' AS m0, j->>'$.track_metadata.recording_msid' AS s0,
        nullif(regexp_extract(j->>'$.track_metadata.additional_info.spotify_id', '/track/([0-9A-Za-z]{{22}})$', 1), '') AS provider_id,
        j->>'$.track_metadata.track_name' AS track, trim(j->>'$.track_metadata.artist_name') AS artist, CAST(NULL AS VARCHAR) AS release, NOT coalesce(json_exists(j, '$.track_metadata'), false) AS no_metadata FROM fields),
    parsed AS (SELECT origin, line, entry, "user", epoch, {_safe('m0')} AS mbid, {_safe('s0')} AS msid, provider_id, track, artist, release,
        CASE WHEN malformed THEN 'malformed' WHEN "user" IS NULL THEN 'user' WHEN epoch IS NULL THEN 'time' WHEN no_metadata THEN 'metadata' WHEN coalesce(m0, s0, track) IS NULL THEN 'identity' END AS reason FROM raw)"""


def _parsed(sql: str) -> str:
    return f"WITH lines AS ({_lines_sql()}), {_PARSED} {sql}"


_DAY = "sha256(user_name || ':' || CAST(CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS VARCHAR))"
_SESSIONS = f"SELECT {_DAY} AS session_key, item, CAST(min(floor(epoch(ts))) AS BIGINT) AS first_at, CAST(max(floor(epoch(ts))) AS BIGINT) AS last_at, count(*) AS plays FROM listens GROUP BY 1, 2"
_CLEAN = "clean AS (SELECT item, upper(regexp_replace(isrc, '[-\\s]', '', 'g')) AS isrc, regexp_matches(upper(regexp_replace(isrc, '[-\\s]', '', 'g')), '^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') AS valid FROM isrcs)"
_MAPS = """maps AS (SELECT msid, mbid, count(*) AS shards, min(shard) AS first_shard, max(shard) AS last_shard FROM (SELECT DISTINCT shard, msid, mbid FROM observations) GROUP BY 1, 2),
    classed AS (SELECT *, count(*) OVER (PARTITION BY msid) AS candidates FROM maps)"""
_EDGES = "edge AS (SELECT from_id, min(to_id) AS to_id FROM redirects WHERE status = 'active' AND from_id <> to_id GROUP BY 1)"
_CHAIN = """chain(item, target, depth, path, cycle) AS (SELECT p_partkey, p_partkey, 0, [p_partkey], false FROM part
    UNION ALL SELECT item, CASE WHEN list_contains(path, to_id) THEN target ELSE to_id END, CASE WHEN list_contains(path, to_id) THEN depth ELSE depth + 1 END,
        list_append(path, to_id), list_contains(path, to_id) FROM chain JOIN edge ON from_id = target WHERE NOT cycle AND (depth < 8)),
    ends AS (SELECT item, arg_max(target, len(path)) AS target, CAST(max(depth) AS INT) AS depth, bool_or(cycle) AS cycle FROM chain GROUP BY 1)"""

ORACLE_SQL = {
    "canonical_identities": f"""SELECT id, key, {_U5} AS item_id, {_dash('md5(key)')} AS alias_id FROM (SELECT id, key, sha1({_NS} || encode(key)) AS h FROM (SELECT p_partkey AS id,
        CASE WHEN p_size % 3 = 0 THEN 'recording_mbid:' || {_dash('md5(p_name)')} WHEN p_size % 2 = 0 THEN 'spotify_track:' || p_brand ELSE 'catalog_track:' || p_partkey END AS key FROM part))""",
    "alias_keys": "SELECT p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN lower(p_brand) END AS source, CASE WHEN p_size % 5 <> 0 THEN lower(p_type) END AS kind, CASE WHEN p_size % 5 <> 0 THEN trim(p_name) END AS key FROM part",
    "provider_ids": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 3 THEN substr(md5(p_name), 1, 22) END AS track_id FROM part",
    "safe_uuids": f"SELECT p_partkey AS id, CASE WHEN p_partkey % 5 IN (1, 2) THEN {_dash('md5(p_name)')} END AS uuid FROM part",
    "canonical_upsert": """WITH old AS (SELECT p_brand AS key, CASE WHEN max(p_size) % 2 = 0 THEN max(p_size) END AS track FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
        new AS (SELECT key, min(track) AS track FROM (SELECT p_type AS key, p_size AS track FROM part UNION ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 3 = 0) GROUP BY 1)
        SELECT coalesce(o.key, n.key) AS key, coalesce(o.track, n.track) AS track, CASE WHEN o.key IS NULL THEN 'created' WHEN o.track IS NULL AND n.track IS NOT NULL THEN 'filled' ELSE 'unchanged' END AS status
        FROM old o FULL JOIN new n ON n.key = o.key""",
    "alias_conflicts": f"""WITH inc AS ({plain(INCOMING)}), have AS ({plain(EXISTING)})
        SELECT i.*, CASE WHEN row_number() OVER (PARTITION BY i.source, i.kind, i.skey ORDER BY ordinal) > 1 THEN 'incoming_duplicate' WHEN h.item IS NULL THEN 'created' WHEN h.item = i.item THEN 'existing' ELSE 'existing_mapping' END AS outcome
        FROM inc i LEFT JOIN have h ON h.source = i.source AND h.kind = i.kind AND h.skey = i.skey""",
    "self_aliases": oracle(f"""SELECT item, kind, skey, {_dash("md5('canonical-alias:' || kind || ':' || skey)")} AS alias_id, CASE WHEN item % 8 = 0 THEN 'existing' WHEN item % 4 = 0 THEN 'conflict' ELSE 'created' END AS outcome FROM items WHERE item > 10""", "items"),
    "redirect_upsert": oracle(f"""SELECT coalesce(o.from_id, n.from_id) AS from_id, coalesce(o.to_id, n.to_id) AS to_id, CASE WHEN o.to_id IS NULL THEN 'active' WHEN n.to_id IS NULL THEN o.status WHEN n.to_id = o.to_id THEN 'active' ELSE 'conflict' END AS status
        FROM ({OLD_REDIRECTS}) o FULL JOIN (SELECT * FROM ({plain(NEW_REDIRECTS)}) WHERE from_id <> to_id) n ON n.from_id = o.from_id""", "redirects"),
    "redirect_retirement": oracle(f"SELECT r.from_id, r.to_id, CASE WHEN n.from_id IS NULL THEN 'retired' ELSE r.status END AS status FROM redirects r LEFT JOIN ({plain(NEW_REDIRECTS)}) n ON n.from_id = r.from_id AND n.to_id = r.to_id", "redirects"),
    "redirect_chains": "WITH RECURSIVE " + oracle(f"SELECT item, target, depth, cycle FROM ends", "redirects")[5:].replace(") SELECT item", f"), {_EDGES}, {_CHAIN} SELECT item"),
    "expanded_seeds": oracle("""SELECT DISTINCT l_orderkey AS request, l_partkey AS item FROM lineitem UNION SELECT l_orderkey, r.from_id FROM lineitem JOIN redirects r ON r.to_id = l_partkey AND r.status = 'active'""", "redirects"),
    "redirected_plays": oracle("SELECT coalesce(r.to_id, p.item) AS item, count(*) AS n FROM plays p LEFT JOIN redirects r ON r.from_id = p.item AND r.status = 'active' GROUP BY 1", "plays", "redirects"),
    "resolved_requests": "WITH RECURSIVE " + oracle("SELECT status FROM ends", "aliases", "redirects")[5:].replace(") SELECT status FROM ends", f"""), {_EDGES}, {_CHAIN},
        asked AS (SELECT DISTINCT * FROM ({plain(REQUESTS)})), have AS (SELECT source, kind, skey, min(item) FILTER (WHERE status = 'active') AS owner, bool_or(status = 'conflict') AS bad FROM aliases WHERE status <> 'retired' GROUP BY 1, 2, 3),
        judged AS (SELECT a.*, e.target, CASE WHEN a.source = 'deezer' OR a.skey = '' THEN 'invalid' WHEN h.bad THEN 'conflict' WHEN h.owner IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status
            FROM asked a LEFT JOIN have h ON h.source = a.source AND h.kind = a.kind AND h.skey = a.skey LEFT JOIN ends e ON e.item = h.owner)
        SELECT source, kind, skey, status, CASE WHEN status = 'resolved' THEN target END AS item FROM judged"""),
    "first_plays": "SELECT l_suppkey AS seed, l_partkey AS item, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2",
    "key_page": "SELECT p_partkey, p_name FROM part WHERE p_partkey > 40 ORDER BY 1 LIMIT 20",
    "identity_mappings": oracle(f"SELECT * FROM (WITH {_MAPS} SELECT *, CASE WHEN candidates > 1 THEN 'conflict' ELSE 'active' END AS status FROM classed)", "observations"),
    "dominant_mappings": oracle(f"""SELECT * FROM (WITH {_MAPS}, r AS (SELECT msid, mbid, shards AS winner_count, CAST(sum(shards) OVER (PARTITION BY msid) AS BIGINT) AS total, candidates, row_number() OVER (PARTITION BY msid ORDER BY shards DESC, mbid) AS n FROM classed)
        SELECT msid, mbid, winner_count, total, candidates, round(winner_count / CAST(total AS DOUBLE), 9) AS winner_share, winner_count >= 2 AND winner_count / CAST(total AS DOUBLE) >= 0.5::DOUBLE AS promoted FROM r WHERE n = 1 AND candidates > 1)""", "observations"),
    "resolved_conflicts": oracle(f"""SELECT * FROM (WITH {_MAPS}, r AS (SELECT msid, mbid, shards AS winner_count, CAST(sum(shards) OVER (PARTITION BY msid) AS BIGINT) AS total, candidates, row_number() OVER (PARTITION BY msid ORDER BY shards DESC, mbid) AS n FROM classed)
        SELECT msid, mbid, winner_count, total, candidates, round(winner_count / CAST(total AS DOUBLE), 9) AS winner_share FROM r
        WHERE n = 1 AND candidates > 1 AND winner_count >= 2 AND winner_count / CAST(total AS DOUBLE) >= 0.4::DOUBLE AND mbid IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '3%'))""", "observations"),
    "observation_report": oracle(f"""SELECT * FROM (WITH {_MAPS} SELECT (SELECT count(*) FROM observations) AS rows, (SELECT count(*) FROM observations) AS mapped, (SELECT count(*) FROM (SELECT DISTINCT shard, msid, mbid FROM observations)) AS shard_pairs,
        count(*) AS pairs, count(DISTINCT msid) AS msids, count(DISTINCT msid) FILTER (WHERE candidates > 1) AS conflicting FROM classed)""", "observations"),
    "clean_isrcs": oracle(f"SELECT * FROM (WITH {_CLEAN} SELECT * FROM clean)", "isrcs"),
    "isrc_report": oracle(f"SELECT *, valid - pairs AS repeats FROM (WITH {_CLEAN} SELECT count(*) AS rows, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid) AS valid, count(DISTINCT (item, isrc)) FILTER (WHERE valid) AS pairs FROM clean)", "isrcs"),
    "unambiguous_isrcs": oracle(f"""SELECT * FROM (WITH {_CLEAN} SELECT isrc, min(item) AS item, {_dash("md5('isrc:recording:' || isrc)")} AS alias_id FROM clean WHERE valid GROUP BY isrc HAVING count(DISTINCT item) = 1)""", "isrcs"),
    "isrc_aliases": oracle(f"""SELECT * FROM (WITH {_CLEAN}, by_code AS (SELECT isrc, count(DISTINCT item) AS n, min(item) AS item FROM clean WHERE valid GROUP BY 1)
        SELECT isrc, CASE WHEN isrc IN (SELECT isrc FROM clean WHERE item % 9 = 0) THEN 'existing' WHEN n > 1 THEN 'ambiguous' WHEN item % 3 = 0 THEN 'created' ELSE 'unresolved' END AS outcome FROM by_code)""", "isrcs"),
    "url_evidence": """WITH u AS (SELECT page_id AS url_id, CASE page_id % 4 WHEN 0 THEN 'https://open.spotify.com/' WHEN 1 THEN 'https://youtu.be/' WHEN 2 THEN 'https://Music.Apple.com/' ELSE '' END || url AS url, CASE page_id % 4 WHEN 0 THEN 'spotify' WHEN 1 THEN 'youtube' WHEN 2 THEN 'apple_music' ELSE 'other' END AS provider FROM pages),
        j AS (SELECT md5(s_name) AS mbid, url, md5(url) AS url_md5, provider, r_name AS link_type, row_number() OVER (PARTITION BY md5(s_name), md5(url) ORDER BY r_regionkey, r_name) AS n
            FROM lineitem JOIN u ON u.url_id = l_partkey % 200 JOIN region ON r_regionkey = l_linenumber % 3 JOIN supplier ON s_suppkey = l_suppkey)
        SELECT mbid, url, url_md5, provider, link_type FROM j WHERE n = 1""",
    "graph_expansion": oracle(f"""SELECT * FROM (WITH {_MAPS}, graph_items AS ({plain(GRAPH_ITEMS)}) SELECT DISTINCT 'recording_msid:' || msid AS key FROM classed WHERE candidates = 1
        AND 'recording_mbid:' || mbid IN (SELECT key FROM graph_items) AND 'recording_msid:' || msid NOT IN (SELECT key FROM graph_items))""", "observations"),
    "parsed_listens": _parsed("SELECT * FROM parsed"),
    "listen_counters": _parsed("""SELECT count(*) AS rows, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason = 'malformed') AS no_malformed, count(*) FILTER (WHERE reason = 'user') AS no_user,
        count(*) FILTER (WHERE reason = 'time') AS no_time, count(*) FILTER (WHERE reason = 'metadata') AS no_metadata, count(*) FILTER (WHERE reason = 'identity') AS no_identity,
        count(*) FILTER (WHERE reason IS NULL AND mbid IS NOT NULL) AS by_mbid, count(*) FILTER (WHERE reason IS NULL AND mbid IS NULL AND msid IS NOT NULL) AS by_msid,
        count(*) FILTER (WHERE reason IS NULL AND coalesce(mbid, msid, provider_id) IS NULL) AS unresolved FROM parsed"""),
    "hashed_listens": _parsed("""SELECT origin, line, entry, session_key, signature, key, 'p' || lpad(CAST(('0x' || substr(sha256(signature), 1, 16))::UBIGINT % 128 AS VARCHAR), 3, '0') AS part FROM (SELECT origin, line, entry,
        sha256(uh || ':' || CAST(epoch // 1800 AS VARCHAR)) AS session_key,
        sha256(concat_ws(chr(31), uh, CAST(epoch AS VARCHAR), coalesce(mbid, ''), coalesce(msid, ''), lower(coalesce(provider_id, '')), lower(coalesce(track, '')), lower(coalesce(artist, '')), '')) AS signature,
        CASE WHEN mbid IS NOT NULL THEN 'recording_mbid:' || mbid WHEN msid IS NOT NULL THEN 'recording_msid:' || msid WHEN provider_id IS NOT NULL THEN 'spotify_track:' || provider_id END AS key
        FROM (SELECT *, sha256('salt:' || "user") AS uh FROM parsed WHERE reason IS NULL))"""),
    "resumed_listens": _parsed("SELECT origin, line, entry FROM parsed WHERE origin > 'part-1' OR (origin = 'part-1' AND (line > 100 OR (line = 100 AND entry > 0)))"),
    "session_items": oracle(_SESSIONS, "listens"),
    "merged_session_items": oracle(_SESSIONS, "listens"),
    "first_events": oracle("SELECT sha256(concat_ws(chr(31), lower(user_name), lower(item))) AS signature, min(event_id) AS ref, arg_min(CAST(floor(epoch(ts)) AS BIGINT), event_id) AS at FROM listens GROUP BY 1", "listens"),
}
ORACLE_SQL["stream_counters"] = ORACLE_SQL["listen_counters"]
