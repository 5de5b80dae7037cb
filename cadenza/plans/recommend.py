"""Queries on co-occurrence, ranking, evaluation, gates and corpus policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import cooccurrence as C
from cadenza.operators import evaluation as E
from cadenza.operators import gates as G
from cadenza.operators import rankers as R
from cadenza.operators import training as T
from cadenza.plans.shared import frame, oracle, run
from cadenza.session import materialize, new_path

# --- SQL that several oracles share ---------------------------------------------------------------------------------
BUCKET = "CAST(('0x' || substr(sha256(CAST(session_key AS VARCHAR)), 1, 16))::UBIGINT % 10 AS INT)"


def _baskets(part: str = "all", least: int = 2, most: int = 20) -> str:
    where = {"all": "true", "train": f"{BUCKET} <> 0", "test": f"{BUCKET} = 0"}[part]
    return f"""baskets AS (SELECT DISTINCT session_key, item FROM plays WHERE {where} AND session_key IN
        (SELECT session_key FROM plays WHERE {where} GROUP BY 1 HAVING count(DISTINCT item) BETWEEN {least} AND {most}))"""


PAIRS = """counts AS (SELECT item, count(*) AS n FROM baskets GROUP BY 1),
    pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS co_count FROM baskets a JOIN baskets b ON a.session_key = b.session_key AND a.item < b.item GROUP BY 1, 2),
    scored AS (SELECT item_a, item_b, co_count, round(log2(co_count * (SELECT CAST(count(DISTINCT session_key) AS DOUBLE) FROM baskets) / (CAST(x.n AS DOUBLE) * y.n)), 9) AS pmi
        FROM pairs JOIN counts x ON x.item = item_a JOIN counts y ON y.item = item_b),
    neighbours AS (SELECT item_a AS item, item_b AS neighbour, co_count, pmi FROM scored UNION ALL SELECT item_b, item_a, co_count, pmi FROM scored)"""
TRIALS = """tests AS (SELECT DISTINCT session_key, item FROM plays WHERE {bucket} = 0 AND session_key IN (SELECT session_key FROM plays WHERE {bucket} = 0
        GROUP BY 1 HAVING count(DISTINCT item) BETWEEN 2 AND 20)),
    trials AS (SELECT CAST(session_key AS VARCHAR) || '-' || CAST(item AS VARCHAR) AS request, session_key, item AS held_out FROM tests),
    seeds AS (SELECT t.request, b.item FROM trials t JOIN tests b ON b.session_key = t.session_key AND b.item <> t.held_out)""".format(bucket=BUCKET)
RANKED = """hits AS (SELECT s.request, n.neighbour AS item, sum(CAST(n.pmi AS DECIMAL(20, 9))) AS exact, CAST(sum(n.co_count) AS BIGINT) AS co_count
        FROM seeds s JOIN neighbours n ON n.item = s.item GROUP BY 1, 2),
    ranked AS (SELECT * FROM (SELECT request, item, CAST(round(exact, 6) AS DOUBLE) AS score, co_count, CAST(row_number() OVER (PARTITION BY request ORDER BY exact DESC, item) AS INT) AS rank
        FROM hits h WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.request = h.request AND s.item = h.item)) WHERE rank <= 10)"""


def _all(spark, d, part="all"):
    plays = frame(spark, d, "plays")
    return C.baskets(C.split(plays, part), tasks=C.tasks(plays))


def _train(spark, d):
    return _all(spark, d, "train")


def _test(spark, d):
    return _all(spark, d, "test")


def pmi_pairs(spark, d):
    return C.pmi(_all(spark, d))


def bucketed_pmi(spark, d):
    root, baskets = new_path(spark, "training"), _all(spark, d)
    T.train(baskets, root, buckets=8, at_once=2, most=4)  # a run that ends early, and one that goes on
    T.train(baskets, root, buckets=8, at_once=4)
    return T.pairs(spark, root)


def evaluated_baskets(spark, d):
    pairs = materialize(C.pmi(_train(spark, d)), "pmi")
    return E.evaluate(_test(spark, d), run(spark, d, "SELECT p_partkey AS item FROM {part}"), neighbours=C.neighbours(pairs))


def pmi_train_pairs(spark, d):
    return C.pmi(_train(spark, d))


def basket_report(spark, d):
    return C.basket_report(frame(spark, d, "plays"))


def split_report(spark, d):
    plays = frame(spark, d, "plays")
    parts = [C.basket_report(C.split(plays, p)).withColumn("part", F.lit(p)) for p in ("train", "test", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def item_counts(spark, d):
    return C.item_counts(_all(spark, d))


def neighbour_lists(spark, d):
    return C.neighbours(C.pmi(_all(spark, d)))


def dataset_hash(spark, d):
    return C.dataset_hash(_all(spark, d))


def bucket_ledger(spark, d):
    done = run(spark, d, "SELECT DISTINCT CAST(o_custkey % 97 AS INT) AS bucket FROM {orders} WHERE o_custkey % 97 < 60 AND o_custkey % 3 = 0")
    return C.bucket_ledger(done, 128)


def loo_trials(spark, d):
    return E.trials(_test(spark, d)).select("request", "held_out", F.size("seeds").cast("bigint").alias("n_seeds"))


def _loo(spark, d):
    test = _test(spark, d)
    found = E.trials(test)
    pairs = materialize(C.pmi(_train(spark, d)), "pmi")
    return test, found, materialize(R.leave_one_out(test, C.neighbours(pairs)), "ranked")


def rank_cooccurrence(spark, d):
    return _loo(spark, d)[2]


def loo_report(spark, d):
    test, found, ranked = _loo(spark, d)
    return E.report(found, ranked, test, run(spark, d, "SELECT p_partkey AS item FROM {part}"))


def _requests(spark, d):
    return run(spark, d, "SELECT s_suppkey AS request, l_partkey AS item FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey").distinct()


def rank_metadata(spark, d):
    return R.metadata(_requests(spark, d), frame(spark, d, "features"))


def similar_vectors(spark, d):
    vectors = run(spark, d, "SELECT vec_id AS item, embedding AS vector FROM {embeddings}")
    return R.similar_vectors(vectors.filter("item % 50 = 0"), vectors)


def basket_sample(spark, d):
    return E.sample_baskets(_all(spark, d), 1000).groupBy("session_key").agg(F.count("*").alias("items"))


def list_metrics(spark, d):
    plays = frame(spark, d, "plays")
    lists = plays.groupBy(F.col("session_key").alias("id")).agg(F.array_sort(F.collect_set("item")).alias("ranked"))
    lists = lists.withColumn("relevant", F.filter("ranked", lambda x: x % 3 == 0))
    return E.list_metrics(lists, 3)


def promotion_gates(spark, d):
    return G.judge(frame(spark, d, "metrics"), "view")


def latest_metrics(spark, d):
    return G.latest(frame(spark, d, "metrics"))


def latest_shared_dataset(spark, d):
    return G.latest_shared(frame(spark, d, "metrics"), "click", "view")


def promotion_states(spark, d):
    rows = run(spark, d, "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'blocked' ELSE 'approved' END AS state, o_custkey % 2 = 0 AS ok, CASE WHEN o_custkey % 3 = 0 THEN 'check' WHEN o_custkey % 3 = 1 THEN 'approve' ELSE 'reject' END AS action FROM {orders}")
    return rows.select("id", G.transition(F.col("state"), F.col("ok"), F.col("action")).alias("next"))


def readiness(spark, d):
    sample = E.sample_baskets(_all(spark, d), 500)
    baskets = sample.agg(F.countDistinct("session_key").alias("baskets"))
    found = baskets.crossJoin(C.pair_counts(sample).agg(F.count("*").alias("pairs"))).crossJoin(E.trials(sample).agg(F.count("*").alias("trials")))
    return found.withColumn("ready", (F.col("baskets") > 0) & (F.col("pairs") > 0) & (F.col("trials") > 0))


def policy_decisions(spark, d):
    m = frame(spark, d, "manifest")
    return G.decide(m, "production").unionAll(G.decide(m, "research")).unionAll(G.decide(m, "both"))


def policy_eligible(spark, d):
    m = frame(spark, d, "manifest")
    parts = [G.eligible(m, mode).groupBy("source").agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode)) for mode in ("production", "research", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def corpus_promotable(spark, d):
    return G.promotable(frame(spark, d, "manifest"))


QUERIES = {f.__name__: f for f in (
    pmi_pairs, pmi_train_pairs, bucketed_pmi, evaluated_baskets, basket_report, split_report, item_counts, neighbour_lists, dataset_hash, bucket_ledger, loo_trials,
    rank_cooccurrence, loo_report, rank_metadata, similar_vectors, basket_sample, list_metrics, promotion_gates, latest_metrics,
    latest_shared_dataset, promotion_states, readiness, policy_decisions, policy_eligible, corpus_promotable,
)}

_REPORT = """SELECT count(*) AS sessions, count(*) FILTER (WHERE n BETWEEN 2 AND 20) AS used, count(*) FILTER (WHERE n < 2) AS too_small, count(*) FILTER (WHERE n > 20) AS too_large,
    (SELECT count(DISTINCT item) FROM plays WHERE {w} AND session_key IN (SELECT session_key FROM plays WHERE {w} GROUP BY 1 HAVING count(DISTINCT item) BETWEEN 2 AND 20)) AS items
    {extra} FROM (SELECT session_key, count(DISTINCT item) AS n FROM plays WHERE {w} GROUP BY 1)"""
_DECIDE = """SELECT doc_id, '{mode}' AS mode, reason = 'allowed' AS allowed, reason, coalesce(class, 'unknown') AS license_class FROM (SELECT doc_id, class,
    CASE WHEN license IS NULL THEN 'missing_license' WHEN envs IS NULL THEN 'missing_environment' WHEN class IS NULL THEN 'unknown_license'
    WHEN {bad} THEN 'license_class' WHEN NOT ({listed}) THEN 'environment' ELSE 'allowed' END AS reason
    FROM (SELECT *, CASE WHEN license IN ('cc0', 'cc-by') THEN 'production' WHEN license = 'cc-by-nc' THEN 'research' END AS class FROM manifest))"""
_P, _R = "',' || envs || ',' LIKE '%,production,%'", "',' || envs || ',' LIKE '%,research,%'"
_GATE = """cur AS (SELECT label, dataset, metric, arg_max(value, created) AS value FROM metrics GROUP BY 1, 2, 3),
    wide AS (SELECT label, dataset, max(value) FILTER (WHERE metric = 'ndcg') AS ndcg, max(value) FILTER (WHERE metric = 'recall') AS recall,
        max(value) FILTER (WHERE metric = 'cold') AS cold, max(value) FILTER (WHERE metric = 'coverage') AS coverage FROM cur GROUP BY 1, 2),
    both_ AS (SELECT n.label, n.dataset,
        coalesce(CASE WHEN o.ndcg = 0 THEN n.ndcg > 0 ELSE (n.ndcg - o.ndcg) / o.ndcg >= 0.05::DOUBLE END, false) AS g1,
        coalesce(CASE WHEN o.recall = 0 THEN n.recall > 0 ELSE (n.recall - o.recall) / o.recall >= 0.03::DOUBLE END, false) AS g2,
        coalesce(CASE WHEN o.cold = 0 THEN n.cold >= 0 ELSE (o.cold - n.cold) / o.cold <= 0.02::DOUBLE END, false) AS g3,
        coalesce(n.coverage >= 0.3::DOUBLE, false) AS g4 FROM wide n LEFT JOIN wide o ON o.dataset = n.dataset AND o.label = 'view' WHERE n.label <> 'view')"""
_ALL = "g1 AND g2 AND g3 AND g4 AS promoted FROM both_"

ORACLE_SQL = {
    "bucketed_pmi": oracle(f"SELECT * FROM (WITH {_baskets()}, {PAIRS} SELECT * FROM scored)", "plays"),
    "pmi_pairs": oracle(f"SELECT * FROM (WITH {_baskets()}, {PAIRS} SELECT * FROM scored)", "plays"),
    "pmi_train_pairs": oracle(f"SELECT * FROM (WITH {_baskets('train')}, {PAIRS} SELECT * FROM scored)", "plays"),
    "basket_report": oracle(_REPORT.format(w="true", extra=""), "plays"),
    "split_report": oracle(" UNION ALL ".join(_REPORT.format(w=w, extra=f", '{p}' AS part") for p, w in (("train", f"{BUCKET} <> 0"), ("test", f"{BUCKET} = 0"), ("all", "true"))), "plays"),
    "item_counts": oracle(f"SELECT * FROM (WITH {_baskets()} SELECT item, count(*) AS n FROM baskets GROUP BY 1)", "plays"),
    "neighbour_lists": oracle(f"SELECT * FROM (WITH {_baskets()}, {PAIRS} SELECT * FROM neighbours)", "plays"),
    "dataset_hash": oracle(f"""SELECT * FROM (WITH {_baskets()}, lines AS (SELECT session_key, sha256(CAST(session_key AS VARCHAR) || ':' || string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR))) AS h FROM baskets GROUP BY 1),
        groups AS (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM lines GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS baskets, sha256(string_agg(h, chr(10) ORDER BY g)) AS dataset_hash FROM groups)""", "plays"),
    "bucket_ledger": """WITH done AS (SELECT DISTINCT CAST(o_custkey % 97 AS INT) AS bucket FROM orders WHERE o_custkey % 97 < 60 AND o_custkey % 3 = 0)
        SELECT CAST(b AS INT) AS bucket, CASE WHEN b IN (SELECT bucket FROM done) THEN 'succeeded' WHEN b < (SELECT max(bucket) FROM done) THEN 'assumed' ELSE 'pending' END AS status FROM range(128) t(b)""",
    "loo_trials": oracle(f"SELECT * FROM (WITH {TRIALS} SELECT t.request, t.held_out, count(*) AS n_seeds FROM trials t JOIN seeds s ON s.request = t.request GROUP BY 1, 2)", "plays"),
    "rank_cooccurrence": oracle(f"SELECT * FROM (WITH {_baskets('train')}, {PAIRS}, {TRIALS}, {RANKED} SELECT * FROM ranked)", "plays"),
    "loo_report": oracle(f"""SELECT * FROM (WITH {_baskets('train')}, {PAIRS}, {TRIALS}, {RANKED},
        freq AS (SELECT item, count(DISTINCT session_key) AS n FROM tests GROUP BY 1),
        judged AS (SELECT t.request, f.n, CASE WHEN r.rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, CASE WHEN r.rank <= 10 THEN 1.0::DOUBLE / log2(r.rank + 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS gain
            FROM trials t JOIN freq f ON f.item = t.held_out LEFT JOIN ranked r ON r.request = t.request AND r.item = t.held_out)
        SELECT count(*) AS trials, count(*) FILTER (WHERE n <= 1) AS cold_trials, round(coalesce(avg(hit), 0), 9) AS recall, round(coalesce(avg(gain), 0), 9) AS ndcg,
            round(coalesce(avg(hit) FILTER (WHERE n <= 1), 0), 9) AS cold_recall,
            round((SELECT CAST(count(DISTINCT item) AS DOUBLE) FROM ranked) / (SELECT count(DISTINCT p_partkey) FROM part), 9) AS coverage FROM judged)""", "plays"),
    "rank_metadata": oracle("""SELECT * FROM (WITH seeds AS (SELECT DISTINCT s_suppkey AS request, l_partkey AS item FROM supplier JOIN lineitem ON l_suppkey = s_suppkey),
        mine AS (SELECT s.request, f.album, f.artist, f.genre FROM seeds s JOIN features f ON f.item = s.item),
        hits AS (SELECT DISTINCT m.request, f.item, 1.0::DOUBLE AS score FROM (SELECT DISTINCT request, artist FROM mine) m JOIN features f ON f.artist = m.artist
            UNION ALL SELECT DISTINCT m.request, f.item, 0.8::DOUBLE FROM (SELECT DISTINCT request, album FROM mine) m JOIN features f ON f.album = m.album
            UNION ALL SELECT DISTINCT m.request, f.item, 0.5::DOUBLE FROM (SELECT DISTINCT request, genre FROM mine) m JOIN features f ON f.genre = m.genre),
        best AS (SELECT request, item, max(score) AS score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.request = h.request AND s.item = h.item) GROUP BY 1, 2)
        SELECT * FROM (SELECT request, item, score, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, item) AS INT) AS rank FROM best) WHERE rank <= 10)""", "features"),
    "similar_vectors": """WITH v AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        n AS (SELECT item, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
        s AS (SELECT q.item AS request, n.item, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(q.e, n.e) / (q.norm * n.norm))), 2) AS likeness
            FROM n q JOIN n ON q.item <> n.item WHERE q.item % 50 = 0 AND q.norm > 0 AND n.norm > 0)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request ORDER BY likeness DESC, item) AS INT) AS rank FROM s) WHERE rank <= 10""",
    "basket_sample": oracle(f"SELECT * FROM (WITH {_baskets()} SELECT session_key, count(*) AS items FROM baskets GROUP BY 1 ORDER BY 1 LIMIT 1000)", "plays"),
    "list_metrics": oracle("""SELECT id, round(CASE WHEN rel = 0 THEN 0 ELSE hits / rel END, 9) AS recall, round(CASE WHEN rel = 0 THEN 0 ELSE gain / (1.0::DOUBLE + CASE WHEN rel >= 2 THEN 1.0::DOUBLE / log2(3.0::DOUBLE) ELSE 0 END + CASE WHEN rel >= 3 THEN 0.5::DOUBLE ELSE 0 END) END, 9) AS ndcg FROM
        (SELECT session_key AS id, CAST(count(*) FILTER (WHERE item % 3 = 0) AS DOUBLE) AS rel, CAST(count(*) FILTER (WHERE item % 3 = 0 AND pos <= 3) AS DOUBLE) AS hits,
            coalesce(sum(1.0::DOUBLE / log2(pos + 1.0::DOUBLE)) FILTER (WHERE item % 3 = 0 AND pos <= 3), 0) AS gain
        FROM (SELECT session_key, item, row_number() OVER (PARTITION BY session_key ORDER BY item) AS pos FROM (SELECT DISTINCT session_key, item FROM plays)) GROUP BY 1)""", "plays"),
    "promotion_gates": oracle(f"""SELECT * FROM (WITH {_GATE} SELECT label, dataset, 'ndcg_lift' AS gate, g1 AS passed, {_ALL} UNION ALL SELECT label, dataset, 'recall_lift', g2, {_ALL}
        UNION ALL SELECT label, dataset, 'cold_regression', g3, {_ALL} UNION ALL SELECT label, dataset, 'coverage_floor', g4, {_ALL})""", "metrics"),
    "latest_metrics": oracle("SELECT label, dataset, metric, arg_max(value, created) AS value FROM metrics GROUP BY 1, 2, 3", "metrics"),
    "latest_shared_dataset": oracle("SELECT arg_max(dataset, created) AS dataset, max(created) AS created FROM (SELECT dataset, max(created) AS created FROM metrics WHERE label IN ('click', 'view') GROUP BY 1 HAVING count(DISTINCT label) = 2) HAVING max(created) IS NOT NULL", "metrics"),
    "promotion_states": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'approved' WHEN o_custkey % 3 = 2 THEN 'rejected' WHEN o_custkey % 2 <> 0 THEN 'blocked'
        WHEN o_custkey % 3 = 1 THEN 'approved' ELSE 'pending' END AS next FROM orders""",
    "readiness": oracle(f"""SELECT * FROM (WITH {_baskets()}, keys AS (SELECT DISTINCT session_key FROM baskets ORDER BY 1 LIMIT 500), s AS (SELECT * FROM baskets WHERE session_key IN (SELECT session_key FROM keys)),
        r AS (SELECT count(DISTINCT session_key) AS baskets, (SELECT count(*) FROM (SELECT DISTINCT a.item, b.item FROM s a JOIN s b ON a.session_key = b.session_key AND a.item < b.item)) AS pairs, count(*) AS trials FROM s)
        SELECT *, baskets > 0 AND pairs > 0 AND trials > 0 AS ready FROM r)""", "plays"),
    "policy_decisions": oracle(" UNION ALL ".join((_DECIDE.format(mode="production", bad="class <> 'production'", listed=_P), _DECIDE.format(mode="research", bad="false", listed=_R), _DECIDE.format(mode="both", bad="class <> 'production'", listed=f"{_P} AND {_R}"))), "manifest"),
    "policy_eligible": oracle(f"""SELECT source, count(*) AS n, 'production' AS mode FROM manifest WHERE license IN ('cc0', 'cc-by') AND {_P} GROUP BY 1
        UNION ALL SELECT source, count(*), 'research' FROM manifest WHERE license IN ('cc0', 'cc-by', 'cc-by-nc') AND {_R} GROUP BY 1
        UNION ALL SELECT source, count(*), 'both' FROM manifest WHERE license IN ('cc0', 'cc-by') AND {_P} AND {_R} GROUP BY 1""", "manifest"),
    "corpus_promotable": oracle(f"""SELECT *, not_approved = 0 AND research_only = 0 AS promotable FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(license IN ('cc0', 'cc-by') AND {_P}, false)) AS not_approved,
        count(*) FILTER (WHERE envs = 'research') AS research_only FROM manifest)""", "manifest"),
}
ORACLE_SQL["evaluated_baskets"] = ORACLE_SQL["loo_report"]
