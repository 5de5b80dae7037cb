"""Canonical links and refreshes in the forms that real pages have."""

from cadenza.llm import urls

HERE = "http://A.org/d/e/page?x=1"
TARGETS = {
    '<LINK REL="Canonical" HREF="http://b.org/q">': "http://b.org/q", '<link rel="alternate canonical" href="/q">': "http://a.org/q",
    "<link rel='nofollow canonical x' href='page.html'>": "http://a.org/d/e/page.html", '<link href="?id=1" rel=canonical>': "http://a.org/d/e/page?id=1",
    '<link rel="canonical" href="../x?y=../z#t">': "http://a.org/d/x?y=../z#t", '<link rel="canonical" href="../../../x/./y/..">': "http://a.org/x/",
    '<link rel=canonical href="./">': "http://a.org/d/e/", '<link rel=canonical href="//c.org/q">': "http://c.org/q",
    '<link rel=canonical href="/login?next=http://c.org/">': "http://a.org/login?next=http://c.org/", '<meta http-equiv="Refresh" content="0; URL=n.html">': "http://a.org/d/e/n.html",
    '<link rel="canonical" href="mailto:x@y.org">': None, '<link rel="canonical" href="#part">': None,
    '<link rel="not-canonical" href="/q">': None, '<link rel="stylesheet" href="/canonical.css">': None, "canonical": None,
}


def test_targets(spark):
    for url, expected in ((HERE, TARGETS), ("http://a.org", {"<link rel=canonical href=q>": "http://a.org/q", "<link rel=canonical href='?q'>": "http://a.org?q"})):
        pages = spark.createDataFrame([(url, html) for html in expected], "url string, html string")
        for html, target in expected.items():
            got = [r.target for r in urls.links(pages.filter(pages.html == html)).collect()]
            assert got == ([target] if target else []), html


def test_relative_aliases_follow_a_block(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.com/en/1", '<LINK HREF="../x" REL="Canonical">'), (2, "http://a.com/x", ""), (3, "http://a.com/y", "<link rel='x canonical' href=x>")],
        "page_id long, url string, html string",
    )
    rules = spark.createDataFrame([("block", "a.com", "/en/")], "action string, host string, path string")
    got = sorted((r.page_id, r.verdict, r.propagated) for r in urls.judge(pages, rules).collect())
    assert got == [(1, "block", False), (2, "block", True), (3, "block", True)]


HIDDEN = {
    '<!-- <link rel="canonical" href="http://b.org/q"> -->': None, "<script>var x = '<link rel=canonical href=http://b.org/q>';</script>": None,
    '<!-- x --><link rel="canonical" href="/q"><!-- <link rel=canonical href=/r>': "http://a.org/q", "<SCRIPT>a</SCRIPT ><link rel=canonical href=/q>": "http://a.org/q",
    '<base href="http://c.org/z/"><link rel=canonical href="q">': "http://c.org/z/q", '<base target="_top"><base href="/z/x"><link rel=canonical href="q">': "http://a.org/z/q",
    '<link rel="canonical" href=" http://b.org/q\n">': "http://b.org/q", '<link title="a>b" rel="canonical" href="/q">': "http://a.org/q",
    "<link title='rel' href='/x' rel='next'><link rel=canonical title=\"it's\" href='/q'>": "http://a.org/q", "<linked rel=canonical href=/q>": None,
    '<base href="mailto:x"><link rel=canonical href="q">': "http://a.org/d/e/q",
}


def test_only_what_a_reader_follows(spark):
    pages = spark.createDataFrame([(HERE + f"&k={k}", html) for k, html in enumerate(HIDDEN)], "url string, html string")
    got = {r.source: r.target for r in urls.links(pages).collect()}
    assert {html: got.get(HERE + f"&k={k}") for k, html in enumerate(HIDDEN)} == HIDDEN


def test_random_links_against_union_find(spark):
    import random

    r, n = random.Random(9), 1500
    url = lambda k: f"http{'s' * (k % 2)}://h{k % 40}.{('com', 'net', 'org')[k % 3]}/{('en', 'de', 'es', 'fr')[k % 4]}/{k}"
    forms = (
        lambda t: f'<link rel="canonical" href="{t}">', lambda t: f"<LINK HREF=' {t} ' REL='x Canonical'>", lambda t: f'<meta http-equiv=refresh content="0; url={t}">',
        lambda t: f"<!-- <link rel=canonical href={t}> -->", lambda t: f'<base href="{t}"><link rel=canonical href="">',
    )
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = []
    for k in range(n):
        html = "<p>"
        if r.random() < 0.5:
            form, to = r.randrange(len(forms)), r.randrange(n)
            target = url(to).replace("://", "://" + "W" * 0).replace("/h", "/H") if r.random() < 0.3 else url(to)
            target = target.replace("/" + ("en", "de", "es", "fr")[to % 4], (":443" if to % 2 else ":80") + "/" + ("en", "de", "es", "fr")[to % 4], 1) if r.random() < 0.3 else target
            html += forms[form](target)
            if form < 3:
                parent[root(k)] = root(to)
        rows.append((k, url(k), html))
    from test_contracts import judged_url

    from cadenza.llm.queries import URL_RULES

    own = {}
    for k in range(n):
        *_, rule, verdict = judged_url(url(k))
        if rule:
            own[k] = verdict
    group = {}
    for k, v in own.items():
        group.setdefault(root(k), set()).add(v)
    want = {k: own.get(k) or ("allow" if "allow" in group.get(root(k), ()) else "block" if "block" in group.get(root(k), ()) else "allow") for k in range(n)}
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    got = {x.page_id: x.verdict for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == want and len({root(k) for k in range(n)}) < n - 300


def test_clashing_columns_and_long_pages(spark):
    html = "<p>" + "word <b>x</b> " * 200_000 + '<link rel="canonical" href="http://a.com/en/1">'
    rows = [(1, "http://b.org/x", html, "h", "p", "r", "v"), (1, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame([("block", "a.com", "/en/")], "action string, host string, path string")
    assert sorted((x.host, x.verdict) for x in urls.judge(pages, rules).collect()) == [("", "allow"), ("b.org", "block")]
