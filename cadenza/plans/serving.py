"""Queries on source policy, progress over phases, track dictionaries and served requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import cooccurrence as C
from cadenza.operators import gates as G
from cadenza.operators import identity as I
from cadenza.operators import orchestration as O
from cadenza.operators import rankers as R
from cadenza.plans.recommend import PAIRS, _baskets
from cadenza.plans.shared import INPUTS, frame, plain, run
from cadenza.session import materialize, new_path
from cadenza.sources import served as V

MANIFEST = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'listenbrainz' WHEN 2 THEN source END AS source,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' ELSE 'cc0' END AS license,
    CASE doc_id % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'research' WHEN 2 THEN 'both' WHEN 3 THEN '' END AS allowed_envs FROM {documents}"""
SHARDS = """SELECT o_orderpriority AS run, CASE o_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN NULL ELSE 'succeeded' END AS status,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS bytes, CAST(o_custkey AS BIGINT) AS source_row_count, CAST(o_custkey % 90 AS BIGINT) AS imported_row_count,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 8 AS BIGINT) END AS duplicate_row_count, CAST(o_custkey % 70 AS BIGINT) AS canonicalized_row_count,
    CAST(o_custkey % 6 AS BIGINT) AS unresolved_row_count, CAST(o_custkey % 3 AS BIGINT) AS malformed_row_count FROM {orders}"""
BASE = "SELECT l_suppkey AS phase, CAST(l_partkey AS BIGINT) AS done, CAST(l_linenumber AS BIGINT) AS failed FROM {lineitem} WHERE l_suppkey % 3 <> 0"
DELTA = "SELECT s_suppkey AS phase, CAST(s_nationkey AS BIGINT) AS done, CAST(1 AS BIGINT) AS failed FROM {supplier}"
TYPED = "SELECT p_brand AS type, p_partkey AS id, p_name FROM {part}"
FINISHED = "SELECT p_brand AS type, CAST(avg(p_partkey) AS BIGINT) AS last FROM {part} WHERE p_size % 2 = 0 AND p_brand NOT LIKE '%1' GROUP BY 1"
RUNS = "SELECT event_type AS candidate_label, 'h' || CAST(event_id % 5 AS VARCHAR(2)) AS dataset_hash, user_id AS training_run_id, value FROM {events}"
LABELS = "SELECT DISTINCT event_type AS candidate_label, 'h' || CAST(event_id % 3 AS VARCHAR(2)) AS dataset_hash, user_id AS training_run_id, 'l' || CAST(user_id AS VARCHAR(20)) AS label FROM {events}"
EVENTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS mbid, CASE WHEN o_orderkey % 5 = 0 THEN 'm' END AS msid,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR(20)) END AS provider_id FROM {orders}"""
BY_MBID = "SELECT o_orderpriority AS mbid, o_custkey AS track, o_orderkey AS ordinal FROM {orders} WHERE o_orderpriority <> '1-URGENT'"
BY_PROVIDER = "SELECT CAST(c_custkey AS VARCHAR(20)) AS provider_id, c_custkey + 7 AS track, c_custkey AS ordinal FROM {customer} WHERE c_custkey % 4 <> 0"
TRACKS = """SELECT p_partkey AS track, p_partkey * 2 AS item, CASE WHEN p_size % 2 = 0 THEN md5(p_name) END AS mbid,
    CASE WHEN p_size % 3 = 0 THEN ' ' || p_brand WHEN p_size % 3 = 1 THEN '' END AS spotify, p_partkey AS catalog FROM {part}"""
EXTERNAL = "SELECT l_partkey AS track, CASE WHEN l_suppkey % 2 = 0 THEN 'Spotify' ELSE 'isrc' END AS source, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR(20)) END AS external_id FROM {lineitem}"
ASKED = """SELECT s_suppkey AS request, CASE WHEN l_linenumber = 5 THEN 'exclude' ELSE 'seed' END AS role, CASE WHEN l_partkey % 3 = 0 THEN 'isrc' ELSE 'spotify' END AS source, 'track' AS kind,
    'k' || CAST(l_partkey AS VARCHAR(20)) AS skey FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey"""
ALIASES = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'isrc' ELSE 'spotify' END AS source, 'track' AS kind, 'k' || CAST(p_partkey AS VARCHAR(20)) AS skey, p_partkey AS item, CASE WHEN p_partkey % 10 = 0 THEN 'conflict' ELSE 'active' END AS status FROM {part} WHERE p_partkey % 7 <> 0"
MOVED = "SELECT p_partkey AS from_id, p_partkey + 1 AS to_id, 'active' AS status FROM {part} WHERE p_partkey % 4 = 0"
KEYS = "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'recording_mbid:' ELSE 'spotify_track:' END || p_brand AS key FROM {part}"


def source_policy_decisions(spark, d):
    m = run(spark, d, MANIFEST)
    modes = [(mode, closed) for mode in ("production", "research", "both") for closed in (True, False)]
    parts = [G.decide_by_source(m, mode, closed).select("doc_id", "allowed", "reason", "classification", F.lit(mode).alias("mode"), F.lit(closed).alias("closed")) for mode, closed in modes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_policy_eligible(spark, d):
    m = run(spark, d, MANIFEST)
    parts = [G.eligible_by_source(m, mode).select("doc_id", F.lit(mode).alias("mode")) for mode in ("production", "research", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dataset_progress(spark, d):
    return O.dataset_progress(run(spark, d, SHARDS))


def phase_progress(spark, d):
    return O.accumulated(run(spark, d, BASE), run(spark, d, DELTA), "phase", ["done", "failed"])


def resumed_types(spark, d):
    return O.resume_by_type(run(spark, d, TYPED), run(spark, d, FINISHED))


def labelled_metrics(spark, d):
    return O.labelled(run(spark, d, RUNS), run(spark, d, LABELS))


def matched_tracks(spark, d):
    by_mbid, by_provider = (I.dictionary(run(spark, d, sql), key, "track", "ordinal") for sql, key in ((BY_MBID, "mbid"), (BY_PROVIDER, "provider_id")))
    return I.matched_tracks(run(spark, d, EVENTS), by_mbid, by_provider)


def track_assignments(spark, d):
    return I.track_assignments(run(spark, d, TRACKS), run(spark, d, EXTERNAL))


def key_suffixes(spark, d):
    return run(spark, d, KEYS).select("id", X.key_suffix(F.col("key"), "recording_mbid:").alias("source_id"))


def _served(spark, d, rank):
    out = I.serve(run(spark, d, ASKED), run(spark, d, ALIASES), run(spark, d, MOVED), rank)
    return out.select("request", "requested_seed_count", "resolved_seed_count", F.size("unresolved_seeds").alias("unresolved"), F.size("unresolved_excludes").alias("unresolved_excludes"), F.explode_outer("items").alias("i")).select(
        "request", "requested_seed_count", "resolved_seed_count", "unresolved", "unresolved_excludes", "i.item", "i.score", "i.rank"
    )


def served_cooccurrence(spark, d):
    near = C.neighbours(materialize(C.pmi(C.baskets(frame(spark, d, "plays"))), "pmi"))
    return _served(spark, d, lambda seeds, gone: R.cooccurrence(seeds, near, gone))


def stored_cooccurrence(spark, d):
    root = new_path(spark, "neighbours")
    V.write(C.neighbours(materialize(C.pmi(C.baskets(frame(spark, d, "plays"))), "pmi")), root, "v1")
    return _served(spark, d, lambda seeds, gone: R.cooccurrence(seeds, V.matching(spark, root, seeds), gone))


def served_metadata(spark, d):
    features = frame(spark, d, "features")
    return _served(spark, d, lambda seeds, gone: R.metadata(seeds, features, exclude=gone))


QUERIES = {f.__name__: f for f in (
    source_policy_decisions, source_policy_eligible, dataset_progress, phase_progress, resumed_types, labelled_metrics, matched_tracks, track_assignments,
    key_suffixes, served_cooccurrence, stored_cooccurrence, served_metadata,
)}


def _decisions(mode: str, closed: bool) -> str:
    """One mode of the policy: missing metadata, then the source, then the environment."""
    kind = f"CASE WHEN source IN ('musicbrainz', 'listenbrainz') THEN 'production_approved' ELSE '{'blocked' if closed else 'research_only'}' END"
    steps = ["WHEN license IS NULL OR license = '' THEN 'missing license metadata'", "WHEN allowed_envs IS NULL OR allowed_envs = '' THEN 'missing allowed_envs'",
             "WHEN kind = 'blocked' THEN 'source ''' || coalesce(source, '') || ''' not approved'"]
    if mode == "production":
        steps.append("WHEN kind = 'research_only' THEN 'source ''' || coalesce(source, '') || ''' not production_approved'")
    if mode != "both":
        steps.append(f"WHEN allowed_envs <> '{mode}' AND allowed_envs <> 'both' THEN 'row env ''' || allowed_envs || ''' excludes {mode}'")
    return f"""SELECT doc_id, reason = 'compliant' AS allowed, reason, CASE WHEN reason LIKE 'missing %' THEN 'blocked' ELSE kind END AS classification, '{mode}' AS mode, {str(closed).lower()} AS closed
        FROM (SELECT *, CASE {' '.join(steps)} ELSE 'compliant' END AS reason FROM (SELECT *, {kind} AS kind FROM ({plain(MANIFEST)})))"""


_SERVED = f"""asked AS ({plain(ASKED)}), alias AS ({plain(ALIASES)}), moved AS ({plain(MOVED)}),
    known AS (SELECT a.request, a.role, a.skey, coalesce(m.to_id, l.item) AS item FROM asked a LEFT JOIN (SELECT * FROM alias WHERE status = 'active') l ON l.skey = a.skey LEFT JOIN moved m ON m.from_id = l.item),
    seeds AS (SELECT DISTINCT request, item FROM known WHERE role = 'seed' AND item IS NOT NULL), gone AS (SELECT DISTINCT request, item FROM known WHERE item IS NOT NULL),
    heads AS (SELECT request, count(*) FILTER (WHERE role = 'seed') AS requested_seed_count, count(*) FILTER (WHERE role = 'seed' AND item IS NOT NULL) AS resolved_seed_count,
        CAST(count(DISTINCT skey) FILTER (WHERE role = 'seed' AND item IS NULL) AS INT) AS unresolved, CAST(count(DISTINCT skey) FILTER (WHERE role = 'exclude' AND item IS NULL) AS INT) AS unresolved_excludes FROM known GROUP BY 1)"""
_TOP = "SELECT h.*, r.item, r.score, r.rank FROM heads h LEFT JOIN ranked r ON r.request = h.request"

ORACLE_SQL = {
    "source_policy_decisions": " UNION ALL ".join(_decisions(m, c) for m in ("production", "research", "both") for c in (True, False)),
    "source_policy_eligible": f"""WITH m AS (SELECT * FROM ({plain(MANIFEST)}) WHERE license <> '') SELECT doc_id, 'production' AS mode FROM m WHERE source IN ('musicbrainz', 'listenbrainz') AND allowed_envs IN ('production', 'both')
        UNION ALL SELECT doc_id, 'research' FROM m WHERE source IN ('musicbrainz', 'listenbrainz') AND allowed_envs IN ('research', 'both') UNION ALL SELECT doc_id, 'both' FROM m""",
    "dataset_progress": f"""SELECT run, count(*) AS shard_count, count(*) FILTER (WHERE status = 'succeeded') AS completed_shards, count(*) FILTER (WHERE status = 'running') AS running_shards, count(*) FILTER (WHERE status = 'failed') AS failed_shards,
        count(*) FILTER (WHERE status IS NULL OR status = 'queued') AS pending_shards, CAST(coalesce(sum(bytes) FILTER (WHERE status = 'succeeded'), 0) AS BIGINT) AS completed_uncompressed_bytes,
        {', '.join(f'CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}' for c in O.COUNTERS)} FROM ({plain(SHARDS)}) GROUP BY 1""",
    "phase_progress": f"SELECT phase, CAST(sum(done) AS BIGINT) AS done, CAST(sum(failed) AS BIGINT) AS failed FROM ({plain(BASE)} UNION ALL {plain(DELTA)}) GROUP BY 1",
    "resumed_types": f"WITH f AS (SELECT p_brand AS type, avg(p_partkey) AS a FROM part WHERE p_size % 2 = 0 AND p_brand NOT LIKE '%1' GROUP BY 1) SELECT t.type, t.id, t.p_name FROM ({plain(TYPED)}) t LEFT JOIN f ON f.type = t.type WHERE f.a IS NULL OR t.id > floor(f.a)",
    "labelled_metrics": f"SELECT m.candidate_label, m.dataset_hash, m.training_run_id, m.value, l.label FROM ({plain(RUNS)}) m, ({plain(LABELS)}) l WHERE l.candidate_label = m.candidate_label AND l.dataset_hash = m.dataset_hash AND l.training_run_id = m.training_run_id",
    "matched_tracks": f"""WITH e AS ({plain(EVENTS)}), last AS (SELECT mbid, arg_max(track, ordinal) AS track FROM ({plain(BY_MBID)}) GROUP BY 1), p AS ({plain(BY_PROVIDER)})
        SELECT e.*, CASE WHEN e.mbid IS NOT NULL THEN 'recording_mbid' WHEN e.msid IS NOT NULL THEN 'recording_msid' WHEN e.provider_id IS NOT NULL THEN 'spotify_track' ELSE 'none' END AS candidate_type,
        CASE WHEN e.mbid IS NOT NULL THEN last.track WHEN e.msid IS NULL THEN p.track END AS track FROM e LEFT JOIN last ON last.mbid = e.mbid LEFT JOIN p ON p.provider_id = e.provider_id""",
    "track_assignments": f"""WITH t AS ({plain(TRACKS)}) SELECT item, 'musicbrainz' AS source, 'track' AS kind, mbid AS skey FROM t WHERE mbid IS NOT NULL UNION SELECT item, 'spotify', 'track', trim(spotify) FROM t WHERE trim(spotify) <> ''
        UNION SELECT item, 'catalog', 'track', CAST(catalog AS VARCHAR) FROM t UNION SELECT t.item, lower(x.source), 'track', x.external_id FROM t JOIN ({plain(EXTERNAL)}) x ON x.track = t.track WHERE x.external_id IS NOT NULL""",
    "key_suffixes": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand END AS source_id FROM part",
    "served_cooccurrence": f"""WITH plays AS ({plain(INPUTS['plays'])}), {_baskets()}, {PAIRS}, {_SERVED}, hits AS (SELECT s.request, n.neighbour AS item, sum(CAST(n.pmi AS DECIMAL(20, 9))) AS exact FROM seeds s JOIN neighbours n ON n.item = s.item
        WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.request = s.request AND g.item = n.neighbour) GROUP BY 1, 2),
        ranked AS (SELECT request, item, CAST(round(exact, 6) AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY request ORDER BY exact DESC, item) AS INT) AS rank FROM hits QUALIFY rank <= 10) {_TOP}""",
    "served_metadata": f"""WITH f AS ({plain(INPUTS['features'])}), {_SERVED}, hits AS (SELECT s.request, b.item, 1.0::DOUBLE AS score FROM seeds s JOIN f a ON a.item = s.item JOIN f b ON b.artist = a.artist
        UNION SELECT s.request, b.item, 0.8::DOUBLE FROM seeds s JOIN (SELECT DISTINCT item, album FROM f) a ON a.item = s.item JOIN (SELECT DISTINCT item, album FROM f) b ON b.album = a.album
        UNION SELECT s.request, b.item, 0.5::DOUBLE FROM seeds s JOIN (SELECT DISTINCT item, genre FROM f) a ON a.item = s.item JOIN (SELECT DISTINCT item, genre FROM f) b ON b.genre = a.genre),
        best AS (SELECT request, item, max(score) AS score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.request = h.request AND g.item = h.item) GROUP BY 1, 2),
        ranked AS (SELECT request, item, score, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS INT) AS rank FROM best QUALIFY rank <= 10) {_TOP}""",
}
ORACLE_SQL["stored_cooccurrence"] = ORACLE_SQL["served_cooccurrence"]
