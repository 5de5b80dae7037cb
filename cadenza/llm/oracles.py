"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import string

from cadenza.llm import decontaminate, quality, urls
from cadenza.llm.rules import URL_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _listed(values) -> str:
    return ", ".join(map(_text, values))


_LOWER = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WITHOUT = "length(regexp_replace({0}, '{1}', '', 'g'))"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS words FROM documents),
s AS (SELECT doc_id, CASE
    WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 85 * (i.n + j.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least_of ON a = doc_id"""

_RULES = ", ".join(f"({_text(a)}, {_text(h)}, {_text(p)})" for a, h, p in URL_RULES)
_REST = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"

URLS = f"""
WITH RECURSIVE raw AS (
    SELECT url AS source, replace(unnest(list_concat(
        list_transform(regexp_extract_all(html, {_text(urls.LINK)}), lambda t: regexp_extract(t, {_text(urls.HREF)}, 1)),
        list_transform(regexp_extract_all(html, {_text(urls.REFRESH)}), lambda t: regexp_extract(t, {_text(urls.REFRESH_URL)}, 1)))), '&amp;', '&') AS t
    FROM pages WHERE url IS NOT NULL AND (contains(html, 'canonical') OR regexp_matches(html, '(?i)refresh'))),
links AS (SELECT source, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN split_part(source, '://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(source, '^.*?://[^/?#]*') || t END AS target FROM raw),
parsed AS (SELECT url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {_LOWER.format("split_part(url, '://', 1)")} AS scheme, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
    FROM (SELECT url, {_REST} AS rest FROM (SELECT url FROM pages UNION SELECT source FROM links UNION SELECT target FROM links WHERE target IS NOT NULL) WHERE url IS NOT NULL)),
ruled AS (SELECT host, path, arg_max(action, (length(rh || rp), action = 'allow')) AS action, arg_max(rh || rp, (length(rh || rp), action = 'allow')) AS "rule"
    FROM (SELECT DISTINCT host, path FROM parsed) JOIN (VALUES {_RULES}) r(action, rh, rp)
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2),
urls AS (SELECT url, p.host, p.path, action, "rule", CASE WHEN p.host <> '' THEN scheme || '://' || p.host || CASE WHEN tail = '' THEN '/' ELSE tail END END AS k
    FROM parsed p LEFT JOIN ruled r ON r.host = p.host AND r.path = p.path),
one_way AS (SELECT s.k AS a, t.k AS b FROM links l JOIN urls s ON s.url = l.source JOIN urls t ON t.url = l.target WHERE s.k <> t.k),
edges AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
follows AS (SELECT a, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS verdict FROM reach JOIN urls ON k = b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, "rule", coalesce(action, f.verdict, 'allow') AS verdict,
    action IS NULL AND f.verdict IS NOT NULL AS propagated
FROM pages LEFT JOIN urls ON urls.url = pages.url LEFT JOIN follows f ON f.a = k"""

_TOKENS = r"""regexp_extract_all(lower(regexp_replace(text, '([\p{L},;] )(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g')), chr(1) || '?\p{L}+|[0-9]+(?:[.,][0-9]+)*')"""
_CANON = f"list_transform(words, lambda t: CASE WHEN t < ':' THEN CASE WHEN t[1] = chr(1) THEN '<name>' ELSE '<num>' END WHEN t IN ({_listed(decontaminate.UNITS)}) THEN '<unit>' ELSE t END)"
_W = decontaminate.WINDOW


def _cut(key: str, table: str) -> str:
    """All template windows of a table's texts."""
    words = f"SELECT {key} AS id, {_TOKENS} AS words FROM {table}"
    canon = f"SELECT *, {_CANON} AS canon FROM ({words})"
    places = f"SELECT *, unnest(range(1, len(words) - {_W - 2})) AS pos FROM ({canon})"
    return f"SELECT id, pos, words[pos:pos + {_W - 1}] AS words, canon[pos:pos + {_W - 1}] AS template FROM ({places})"


DECONTAMINATION = f"""
WITH d AS ({_cut("doc_id", "documents")}),
i AS (SELECT * FROM ({_cut("item_id", "benchmark")}) WHERE len(list_filter(template, lambda t: NOT starts_with(t, '<'))) >= {decontaminate.LITERAL}),
found AS (SELECT d.id AS doc_id, i.id AS item, d.pos - i.pos AS shift, d.pos, d.template, d.words AS theirs, i.words AS mine FROM d JOIN i ON d.template = i.template),
filled AS (SELECT DISTINCT doc_id, item, shift, kind, mine, theirs FROM (SELECT doc_id, item, shift, unnest(template) AS kind, unnest(mine) AS mine, unnest(theirs) AS theirs FROM found) WHERE starts_with(kind, '<')),
forward AS (SELECT doc_id, item, shift, max(c) AS most, sum(c) AS n_slots FROM (SELECT doc_id, item, shift, kind, mine, count(*) AS c FROM filled GROUP BY ALL) GROUP BY ALL),
runs AS (SELECT doc_id, item, shift, count(DISTINCT pos) AS n FROM found GROUP BY ALL)
SELECT doc_id, list_sort(list_distinct(list(item))) AS item_ids, CAST(sum(n) AS BIGINT) AS n_windows, CAST(coalesce(sum(n_slots), 0) AS BIGINT) AS n_slots, {_W} AS n_tokens
FROM runs LEFT JOIN forward USING (doc_id, item, shift) WHERE coalesce(forward.most, 1) = 1 GROUP BY 1"""

_STOPS = "[" + "".join("\\" + c for c in quality.STOPS) + "]"
_BINS = _listed(quality.COMMON_WORDS)
_HALF = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"

QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, t, {_WORDS.format("t")} AS words, list_filter(string_split(t, chr(10)), lambda x: {_WITHOUT.format("x", r"[\x20\x09-\x0D]")} > 0) AS lines
    FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
f AS (SELECT doc_id, lang, len(words) AS n_words, length(t) AS chars, {_WITHOUT.format("t", r"[\x20\x09-\x0D]")} AS word_chars, length(t) - {_WITHOUT.format("t", "[#*$%&|<>]")} AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t) - {_WITHOUT.format("t", r"\p{L}")} AS letters, length(t) - {_WITHOUT.format("t", r"\p{Lu}")} AS upper,
    length(t) - {_WITHOUT.format("t", "[0-9]")} AS digits, length(t) - {_WITHOUT.format("t", _STOPS.replace("'", "''"))} AS stops FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 2]) AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE c > 1) GROUP BY 1),
v AS (SELECT doc_id, CASE WHEN x IN ({_BINS}) THEN x ELSE '-' END AS bin, count(*) AS n FROM (SELECT doc_id, lower(rtrim(unnest(words), {_text(quality.STOPS)})) AS x FROM w) GROUP BY ALL),
counts AS (SELECT doc_id, lang, 'c' AS kind, unnest(['lower', 'upper', 'digit', 'space', 'stop', 'rest']) AS bin,
        unnest([letters - upper, upper, digits, chars - word_chars, stops, word_chars - letters - digits - stops]) AS n FROM f
    UNION ALL SELECT f.doc_id, f.lang, 'w', b.bin, coalesce(v.n, 0) FROM f CROSS JOIN (SELECT unnest([{_BINS}, '-']) AS bin) b LEFT JOIN v ON v.doc_id = f.doc_id AND v.bin = b.bin),
q AS (SELECT lang, kind, bin, sum(n) / nullif(sum(sum(n)) OVER (PARTITION BY lang, kind), 0)::DOUBLE AS q FROM counts WHERE lang IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT doc_id, lang, kind, bin, coalesce(n / nullif(sum(n) OVER (PARTITION BY doc_id, kind), 0)::DOUBLE, 0) AS p FROM counts),
js AS (SELECT doc_id, kind, round(sqrt(greatest(sum({_HALF.format("p", "q")} + {_HALF.format("q", "p")}) / 2, 0)), 6) AS js
    FROM (SELECT doc_id, kind, p, coalesce(q, 0) AS q FROM p JOIN q USING (lang, kind, bin)) GROUP BY 1, 2),
j AS (SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, chars, c.js AS js_chars, d.js AS js_words,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
    FROM f LEFT JOIN r USING (doc_id) LEFT JOIN js c ON c.doc_id = f.doc_id AND c.kind = 'c' LEFT JOIN js d ON d.doc_id = f.doc_id AND d.kind = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, js_chars, js_words,
    NOT base_failed AND NOT coalesce((chars >= {quality.MIN_CHARS} AND js_chars > {quality.MAX_CHAR_DISTANCE}) OR (n_words >= {quality.MIN_WORDS} AND js_words > {quality.MAX_WORD_DISTANCE}), false) AS kept
FROM j"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_url_filter": URLS,
    "op8_decontamination": DECONTAMINATION,
    "op10_quality_rules": QUALITY,
}
