"""Queries that call the extractors as functions of SQL, and selectors with combinators and places."""

from __future__ import annotations

from gleaner.functions import tables
from gleaner.operators import html as H
from gleaner.plans import queries_extract  # noqa: F401  (its SQL gives the same rows)
from gleaner.plans.registry import ORACLES, Tables, query


def _lateral(t: Tables, table: str, sql: str):
    t.views(table)
    tables.register(t.spark)
    return t.spark.sql(sql)


@query("lateral_emails", ORACLES["extract_emails"])
def _(t: Tables):
    return _lateral(t, "documents", "SELECT d.doc_id, e.pos, e.email FROM (SELECT doc_id, extract_emails(text) AS found FROM documents) d, LATERAL inline(d.found) e")


@query("lateral_emails_strict", ORACLES["extract_emails_strict"])
def _(t: Tables):
    return _lateral(t, "documents", "SELECT d.doc_id, e.pos, e.email FROM (SELECT doc_id, extract_emails_strict(text) AS found FROM documents) d, LATERAL inline(d.found) e")


@query("lateral_phones", ORACLES["extract_phones"])
def _(t: Tables):
    return _lateral(t, "documents", "SELECT d.doc_id, p.pos, p.phone FROM (SELECT doc_id, extract_phones(text) AS found FROM documents) d, LATERAL inline(d.found) p")


@query("lateral_recognize", ORACLES["recognize_patterns"])
def _(t: Tables):
    return _lateral(t, "documents", "SELECT d.doc_id, r.* FROM (SELECT doc_id, recognize(text) AS found FROM documents) d, LATERAL inline(d.found) r")


@query("lateral_html_links", ORACLES["html_links"])
def _(t: Tables):
    return _lateral(t, "pages", "SELECT p.page_id, p.url, l.* FROM pages p, LATERAL html_links(p.url, p.html, 'a') l")


@query("lateral_html_select", """
    SELECT page_id, len(regexp_extract_all(html, '<nav>.*?</nav>')) AS navs, len(l) AS links, l[1] AS first, l[-1] AS last
    FROM (SELECT page_id, html, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)""")
def _(t: Tables):
    return _lateral(t, "pages", """
        SELECT p.page_id, size(s.navs) AS navs, size(s.links) AS links, s.links[0] AS first, element_at(s.links, -1) AS last
        FROM pages p, LATERAL html_select(p.html, 'navs: body > nav; links: nav > ul > li > a[href^="/"]') s""")


@query("html_select_combinators", """
    WITH p AS (SELECT page_id, html, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)
    SELECT page_id, 'odd' AS field, i // 2 AS pos, l[i + 1] AS value FROM (SELECT page_id, l, unnest(range(0, len(l), 2)) AS i FROM p)
    UNION ALL SELECT page_id, 'third', 0, l[3] FROM p WHERE len(l) >= 3
    UNION ALL SELECT page_id, 'last', 0, l[-1] FROM p WHERE len(l) > 0
    UNION ALL SELECT page_id, 'after_second', i - 2, l[i + 1] FROM (SELECT page_id, l, unnest(range(2, len(l))) AS i FROM p)
    UNION ALL SELECT page_id, 'ends', generate_subscripts(m, 1) - 1, unnest(m) FROM (
        SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*n">([^<]*)</a>', 1) AS m FROM p)
    UNION ALL SELECT page_id, 'beside', 0, title FROM (
        SELECT page_id, trim(replace(replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '&amp;', '&'), '&lt;', '<')) AS title
        FROM p WHERE regexp_matches(html, '</nav>(<!--.*?-->)?<div class="ad">'))""")
def _(t: Tables):
    return H.select_fields(t.pages, "page_id", "html", {
        "odd": "nav li:nth-child(2n+1) > a", "third": "nav ul > li:nth-child(3) a", "last": "nav li:last-child > a", "after_second": "nav li:nth-child(2) ~ li > a",
        "ends": "nav a[href$='n']", "beside": "nav + div.ad"})
