"""Table functions of SQL next to the operators, and selectors on literal pages."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner.functions import tables
from gleaner.operators import contacts, html, patterns

PAGE = """<html><body><nav id=top class="menu main"><ul><li><a href="/a" lang=en-GB>A</a></li><li><a href="http://b/x.pdf">B</a></li><li><a>C</a></li></ul></nav>
<div class=lead><p>one</p><p class="x y">two<b>!</b></p><span>three</span><p data-k="v,w">four</p></div><div><p>five</p></div></body></html>"""

SELECTORS = {
    "div > p": ["one", "two!", "four", "five"], "nav > a": [], "nav > ul > li > a": ["A", "B", "C"], "body p": ["one", "two!", "four", "five"],
    "p + p": ["two!"], "p ~ p": ["two!", "four"], "span + p": ["four"], "nav + div p": ["one", "two!", "four"], "div ~ div > p": ["five"],
    "li:nth-child(2n+1) a": ["A", "C"], "li:nth-child(odd) a": ["A", "C"], "li:nth-child(even) a": ["B"], "li:nth-child( -n + 2 ) a": ["A", "B"], "li:nth-child(3) a": ["C"],
    "li:nth-last-child(1) a": ["C"], "li:first-child > a": ["A"], "li:last-child > a": ["C"], "p:only-child": ["five"], "li:nth-child(n) a": ["A", "B", "C"], "li:nth-child(9) a": [],
    'a[href^="/"]': ["A"], "a[href$='.pdf']": ["B"], "a[href*=b]": ["B"], "a[href]": ["A", "B"], "a[lang|=en]": ["A"], "p[class~=y]": ["two!"], 'p[data-k="v,w"]': ["four"], 'a[href^=""]': [],
    "#top .x, p.x.y , span": ["two!", "three"], "div.lead>p.x>b": ["!"], "div b": ["!"], "*:first-child > b": [], "nav.menu.main a[lang]": ["A"], "P.x": ["two!"],
}


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors(selector):
    assert [n.text() for n in html.select(html.parse_page(PAGE), html.parse_selector(selector))] == SELECTORS[selector]


@pytest.mark.parametrize("selector", ["", "div >", "> p", "a,,b", "a >> b", "p:nth-child(x)", "p:nth-child()", "p:hover", "a[href", "a + , b", "p!"])
def test_selectors_that_are_none(selector):
    with pytest.raises(ValueError):
        html.parse_selector(selector)


def test_wide_and_deep_pages():
    wide = html.parse_page("<ul>" + "<li><a href=/x>y</a></li>" * 20_000 + "</ul>")
    assert sum(1 for _ in html.select(wide, html.parse_selector("ul > li:nth-child(2n) > a[href^='/']"))) == 10_000
    deep = html.parse_page("<div>" * 3000 + "<p>x</p>")
    assert sum(1 for _ in html.select(deep, html.parse_selector("div p"))) == 1


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "mail a@b.com, A@B.com and c@d.org; call (555) 123-4567 or 555.123.4567"), (2, None), (3, ""), (4, "it's x@y.co 'quoted' \\ back"), (4, "it's x@y.co 'quoted' \\ back"),
            (5, "Card 4111-1111-1111-1111, due 2024-01-31, 123 Main Street, Springfield, IL 62701, 10.0.0.1, INV-12345 of Best Tools Inc."), (None, "n@u.ll")]
    df = spark.createDataFrame(rows, "id long, text string")
    df.createOrReplaceTempView("texts")
    tables.register(spark)
    return df


def test_table_functions_give_the_rows_of_the_operators(spark, texts):
    def same(sql, operator):
        got = sorted(map(tuple, spark.sql(sql).collect()), key=str)
        assert got == sorted(map(tuple, operator.collect()), key=str) and got

    def rows(function):
        return f"SELECT t.id, e.* FROM (SELECT id, {function}(text) AS found FROM texts) t, LATERAL inline(t.found) e"

    same(rows("extract_emails"), contacts.extract_emails(texts, "id", "text"))
    same(rows("extract_emails_strict"), contacts.extract_emails(texts, "id", "text", strict=True))
    same(rows("extract_phones"), contacts.extract_phones(texts, "id", "text"))
    same(rows("extract_addresses"), contacts.extract_addresses(texts, "id", "text"))
    same(rows("recognize"), patterns.recognize(texts, "id", "text"))
    assert spark.sql("SELECT extract_emails('a@b.de') AS x").first().x == [(0, "a@b.de")]


@pytest.mark.parametrize("function", ["extract_emails", "recognize"])
def test_functions_run_in_the_row(spark, texts, function, capsys):
    spark.sql(f"SELECT t.id, e.* FROM (SELECT id, {function}(text) AS found FROM texts) t, LATERAL inline(t.found) e").explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Python" not in plan and "Exchange" not in plan and "Join" not in plan


def test_sql_text_of_expressions(spark, texts):
    """Any column function of the library can be written as SQL."""
    for column in (contacts.email_array("text"), contacts.phone_array("text"), F.when((F.col("id") >= 1) & ~F.col("text").isNull() | (F.col("id") % 2 != 0), F.lit("it's = (a) and (b)")).otherwise("-(\\n)")):
        assert spark.sql(f"SELECT {tables.sql_text(column)} AS x FROM texts").collect() == texts.select(column.alias("x")).collect()


def test_html_table_functions(spark):
    pages = spark.createDataFrame([(1, "http://h/p", PAGE), (2, "http://h/q", None), (3, "http://h/r", "")], "id long, url string, html string")
    pages.createOrReplaceTempView("literal_pages")
    tables.register(spark)
    rows = spark.sql("SELECT p.id, s.* FROM literal_pages p, LATERAL html_select(p.html, 'paragraphs: div > p; last: li:last-child a') s ORDER BY p.id")
    assert rows.columns == ["id", "paragraphs", "last"]
    assert [tuple(r) for r in rows.collect()] == [(1, ["one", "two!", "four", "five"], ["C"]), (2, [], []), (3, [], [])]
    links = spark.sql("SELECT p.id, p.url, l.* FROM literal_pages p, LATERAL html_links(p.url, p.html, 'a') l")
    with pytest.raises(ValueError):
        tables.sql_text(contacts.visible_text("url"))
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, html.links(pages, "id", "url", "html").collect())) == [(1, "http://h/p", 0, "/a", "http://h/a"), (1, "http://h/p", 1, "http://b/x.pdf", "http://b/x.pdf")]
    for wrong in ("p.html", "'no selector'", "'a: p >'"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT s.* FROM literal_pages p, LATERAL html_select(p.html, {wrong}) s").collect()
