"""URL rules whose decisions follow redirects and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.graph import connected_components
from cadenza.session import materialize

#: Rules up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: The prefix form of rel that the SQL knows; CANONICAL takes the word anywhere in the value.
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
#: What a reader of the page does not follow.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
#: The rest of a tag; a > within quotes does not end it.
_TAG = r"""\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
LINKS, METAS, BASES = (rf"(?is)<{name}{_TAG}" for name in ("link", "meta", "base"))
CANONICAL = r"""(?is)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
REFRESHES = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Equal for urls that differ in the case of scheme and host, in the scheme's own port or in the fragment; null where
    there is no host."""
    scheme = _lower(F.substring_index(url, "://", 1))
    host = F.regexp_replace(host_of(url), F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":$"), F.lit(""))
    rest = F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest)))


def _without_dots(path: Column) -> Column:
    """A path from / on with its . and .. segments followed."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array(F.lit("")),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.array_append(done, s)),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def _attribute(tag: Column, pattern: str, groups: int) -> Column:
    """The value of a tag's attribute, whichever quotes it has, without blanks around it and with ampersands read."""
    value = F.concat(*[F.regexp_extract(tag, pattern, k + 1) for k in range(groups)])
    return F.trim(F.replace(F.regexp_replace(value, r"[\t\n\r\f]", " "), F.lit("&amp;"), F.lit("&")))


def _targets(found: Column, url: Column) -> Column:
    """The absolute urls of an array of targets, read from the url of their page or base; null for other schemes and no target."""
    scheme = F.substring_index(url, "://", 1)
    site, folder = F.concat(scheme, F.lit("://"), host_of(url)), F.regexp_extract(path_of(url), r"(?s)\A.*/", 0)

    def resolved(t: Column) -> Column:
        path, tail = F.regexp_extract(t, r"\A[^?#]*", 0), F.regexp_extract(t, r"(?s)\A[^?#]*(.*)", 1)
        return (
            F.when((t == "") | (host_of(url) == ""), F.lit(None))
            .when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
            .when(t.startswith("/"), F.concat(site, _without_dots(path), tail))
            .when(t.startswith("?"), F.concat(site, path_of(url), t))
            .when(~t.startswith("#") & ~t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"),
                  F.concat(site, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), tail))
        )

    return F.transform(found, resolved)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) of the canonical links and immediate redirects that pages declare, outside comments and scripts.

    Targets are read from the page's first base, or its url. A page of any length is searched as one value; null html has none."""
    html = F.col(html_col)
    found = pages.filter(html.rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("source"), F.regexp_replace(html, UNSEEN, " ").alias("html"))
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    href = lambda t: _attribute(t, HREF, 3)
    bases = F.filter(F.transform(tags(BASES), href), lambda t: t != "")
    found = found.withColumn("base", F.coalesce(F.get(_targets(F.slice(bases, 1, 1), F.col("source")), F.lit(0)), "source"))
    canonical = F.transform(F.filter(tags(LINKS), lambda t: t.rlike(CANONICAL)), href)
    refresh = F.transform(F.filter(tags(METAS), lambda t: t.rlike(REFRESHES)), lambda t: _attribute(t, REFRESH_URL, 1))
    found = found.select("source", F.explode(_targets(F.concat(canonical, refresh), F.col("base"))).alias("target"))
    return found.filter("target is not null and source is not null")


def _decided(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, action, rule) of the longest fitting rule for each distinct place that has one."""
    rules = rules.filter("action in ('allow', 'block')").select(
        "action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule")
    )
    lengths = [r.n for r in rules.select(F.length("rule_path").alias("n")).distinct().orderBy("n").collect()]
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    places = places.select("host", "path").distinct().filter("host <> ''")
    if not lengths:
        return places.limit(0).selectExpr("host", "path", "'' as action", "'' as rule")
    candidates = places.select("host", "path", F.explode(suffixes).alias("rule_host"), starts.alias("starts"))
    candidates = candidates.select("host", "path", "rule_host", F.explode("starts").alias("rule_path"))
    fit = candidates.join(rules, ["rule_host", "rule_path"])
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action"))
    return fit.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.action", "best.rule")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """Judge every page's url: (id_col, host, path, rule, verdict, propagated), one row for each input row.

    rules has (action, host, path); a rule fits its host and all subdomains where the url's path starts with the
    rule's, and the longest (host and path) decides, allow before block among equal ones. Urls that redirects (source,
    target), canonical links or immediate refreshes connect are aliases: in a component of them a url without a rule is
    allowed if any member is explicitly allowed, else blocked if any is blocked; all others are allowed. propagated
    marks verdicts that came from an alias. A null url or one without :// has an empty host and path, no rule and no
    aliases, and is allowed. Repeated rows are judged alike; no rules or no pages are no error; other columns are ignored.
    """
    judged = pages.select(
        F.col(id_col).cast("long").alias("__id"), F.col(url_col).alias("__url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    found = redirects.select("source", "target") if redirects is not None else None
    if html_col:
        own = links(pages, url_col, html_col)
        found = own if found is None else found.unionAll(own)
    edges = None
    if found is not None:
        edges = found.select("source", "target", key_of(F.col("source")).alias("a"), key_of(F.col("target")).alias("b"))
        edges = materialize(edges.filter("a is not null and b is not null and a <> b"), "links")
        edges = edges if edges.limit(1).count() else None
    places = judged.select("host", "path")
    if edges is not None:
        # A node is judged as its key is written, so without a scheme's own port, whichever of its spellings a page has.
        ends = edges.select(F.col("a").alias("node")).unionAll(edges.select("b"))
        ends = ends.distinct().select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
        places = places.unionAll(ends.select("host", "path"))
    decided = materialize(_decided(places, rules), "decided")
    judged = judged.join(decided, ["host", "path"], "left")
    if edges is None:
        judged = judged.withColumns({"allowed": F.lit(False), "blocked": F.lit(False)})
    else:
        roots = connected_components(edges, "a", "b")
        verdicts = ends.join(decided, ["host", "path"]).join(roots, "node").groupBy("component").agg(
            F.bool_or(F.col("action") == "allow").alias("allowed"), F.bool_or(F.col("action") == "block").alias("blocked")
        )
        by_node = roots.join(verdicts, "component").select(F.col("node").alias("__key"), "allowed", "blocked")
        judged = judged.withColumn("__key", key_of(F.col("__url"))).join(by_node, "__key", "left")
    follows = F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block"))
    return judged.select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("action", follows, F.lit("allow")).alias("verdict"),
        (F.col("action").isNull() & follows.isNotNull()).alias("propagated"),
    )
