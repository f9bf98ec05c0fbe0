"""Small literal inputs with known results."""

from pyspark.sql import functions as F

from gleaner.functions import features as X
from gleaner.functions import text as C
from gleaner.functions import validate as V
from gleaner.operators import contacts, html, patterns, quality, shaping, structure
from gleaner.plans.etl import Etl
from gleaner.sources import json_api, sinks


def values(spark, items, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PRODUCT = """<div class="product"><h2>Product Title</h2><span class="price">$99.99</span>
<div class="description">This is a sample product description.</div></div>"""
TWO = "".join(f'<div class="product"><h3>Product {n}</h3><span class="price">${p}</span></div>' for n, p in ((1, "99.99"), (2, "149.99")))


def test_product_fields(spark):
    df = spark.createDataFrame([(1, PRODUCT)], "id int, html string")
    got = html.select_fields(df, "id", "html", {"title": "h2", "price": ".price", "description": ".description"})
    assert {r["field"]: r["value"] for r in got.collect()} == {
        "title": "Product Title", "price": "$99.99", "description": "This is a sample product description."}


def test_containers_give_missing_fields_as_null(spark):
    df = spark.createDataFrame([(1, TWO)], "id int, html string")
    got = html.containers(df, "id", "html", ".product", {"title": "h3", "price": ".price", "stock": ".stock"})
    assert rows(got) == [(1, 0, "Product 1", "$99.99", None), (1, 1, "Product 2", "$149.99", None)]


def test_broken_markup(spark):
    pages = ["<p>a<p>b</div><b>c", "", "<ul><li>x<li>y</ul><ol><li>z</ol>", "<script>var a='<li>no</li>'</script><li>&lt;ok&gt;</li>"]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = html.select_fields(df, "id", "html", {"p": "p", "li": "li"})
    by_page = {}
    for r in got.orderBy("id", "field", "pos").collect():
        by_page.setdefault((r["id"], r["field"]), []).append(r["value"])
    # Open paragraphs and items nest, as nothing closes them.
    assert by_page == {(0, "p"): ["abc", "bc"], (2, "li"): ["xy", "y", "z"], (3, "li"): ["<ok>"]}


def test_selectors():
    root = html.parse_page('<div id="a" class="x y"><p data-k="1"><b>t</b></p></div><p><b>u</b></p>')
    find = lambda s: [n.text() for n in html.select(root, html.parse_selector(s))]
    assert find("div b") == ["t"] and find(".x.y b") == ["t"] and find("#a p b") == ["t"]
    assert find("b") == ["t", "u"] and find("p[data-k]") == ["t"] and find("p[data-k='2']") == []
    assert find("div, p") == ["t", "t", "u"] and find("* > b" .replace(" > ", " ")) == ["t", "u"]


def test_table_with_short_row(spark):
    page = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert rows(html.table_cells(df, "id", "html")) == [(1, 0, 0, "A", "1"), (1, 0, 1, "B", "2")]


def test_json_paths(spark):
    doc = '{"items": [{"id": 1, "name": "Item 1"}, {"id": 2, "name": "Item 2"}, {"id": 3, "name": "Item 3"}], "data": {"products": [{"id": 1, "name": "Test Product"}]}}'
    df = spark.createDataFrame([(doc,)], "doc string")
    assert df.select(json_api.json_path("doc", "items[*].name")).first()[0] == ["Item 1", "Item 2", "Item 3"]
    assert rows(json_api.explode_items(df, "doc", "data.products", "struct<id:bigint,name:string>")) == [(1, "Test Product")]
    assert json_api.explode_items(df, "doc", "items", "struct<id:bigint>").count() == 3


def test_cleaners(spark):
    assert values(spark, ["  Hello  World  "], C.normalize_whitespace) == ["Hello World"]
    assert values(spark, ["$1,299.99", "none"], C.extract_number) == [1299.99, None]
    assert values(spark, ["HELLO world!"], C.normalize_text) == ["hello world"]
    assert values(spark, ["$99.99", "free"], C.parse_money) == [99.99, None]
    assert values(spark, [None, "<p>Ａ&amp;B</p> “x”"], C.clean_text) == ["", 'A&B "x"']
    assert values(spark, ["it's 'quoted' – ok, naïve_1"], C.remove_punctuation) == ["it's quoted ok naïve_1"]
    assert values(spark, ["a b\x1cc　d"], C.normalize_whitespace) == ["a b c d"]
    assert values(spark, ["", "  ", "a  b"], C.word_count) == [0, 0, 2]
    assert values(spark, ["", " a  b "], C.words) == [[], ["a", "b"]]


def test_cleaning_twice_changes_nothing(spark):
    texts = ["<b>x</b>  y", "“a” – b", " tail ", "a & b", "tab\there"]
    once = values(spark, texts, C.clean_text)
    assert values(spark, once, C.clean_text) == once


def test_dates(spark):
    written = ["2024-01-05", "01/02/2024", "25/12/2024", "12.25.2024", "January 5, 2024", "Sept 9 2020", "Foo 1, 2020", "1/2/24", "2024-13-45"]
    assert values(spark, written, V.iso_date) == [
        "2024-01-05", "2024-01-02", "2024-12-25", "2024-12-25", "2024-01-05", "2020-09-09", "Foo 1, 2020", "1/2/24", "2024-13-45"]


def test_validators(spark):
    assert values(spark, ["4111 1111 1111 1111", "4111111111111112", "411"], V.is_card_number) == [True, False, False]
    assert values(spark, ["1.2.3.255", "1.2.3.256", "::1", "x"], V.is_ip_address) == [True, False, True, False]
    assert values(spark, ["a@b.co", "a@b", "a@b.co\n"], V.is_email) == [True, False, False]
    assert values(spark, ["+1 (415) 555-2671", "911", "(200) 911-1234"], V.format_us_phone) == ["+1 415-555-2671", "911", "(200) 911-1234"]


def test_cache_key_is_that_of_sorted_json(spark):
    import hashlib
    import json

    params = {"b": 'x"\\\n', "a": "é😀"}
    df = spark.createDataFrame([(params,)], "p map<string,string>")
    want = hashlib.md5(f"GET:http://x:{json.dumps(params, sort_keys=True)}:".encode()).hexdigest()
    assert df.select(C.cache_key(F.lit("GET"), F.lit("http://x"), F.col("p"))).first()[0] == want


def test_strict_emails_and_long_dotted_names(spark):
    texts = ['"odd.name"@example.com and a+b@x.example.org.', "u@[192.168.0.1]", ".".join(["a"] * 20000) + "@x.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = contacts.extract_emails(df, "id", "text", strict=True).orderBy("id", "pos").collect()
    assert [r["email"] for r in got] == ['"odd.name"@example.com', "a+b@x.example.org", "u@[192.168.0.1]", texts[2]]


def test_emails_follow_each_other(spark):
    import re

    texts = ["a@b.com_x@y.org", "a@@b.com c@d.e f@g.hi", "x" * 5000 + " a.b@c-d.info,A.B@C-D.INFO"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = contacts.extract_emails(df, "id", "text").orderBy("id", "pos").collect()
    want = []
    for i, text in enumerate(texts):
        seen = set()
        for m in re.findall(V.EMAIL, text, re.I):
            if m.lower() not in seen:
                seen.add(m.lower())
                want.append((i, m))
    assert [(r["id"], r["email"]) for r in got] == want


def test_long_url_needs_no_stack(spark):
    url = "http://" + "%41" * 30000 + ".com/" + "a" * 90000
    df = spark.createDataFrame([(1, url)], "id int, text string")
    assert patterns.recognize(df, "id", "text", patterns.DEFAULT.select(["url"])).first()["match"] == url


def test_spans_equal_finditer(spark):
    import re

    texts = ["é John Smith met Jane  Doe and John Smith", "12 Main St, Ann Lee 2024-01-05", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = patterns.recognize_spans(df, "id", "text", patterns.DEFAULT.select(["person_name", "date"]))
    for r in got.collect():
        text = texts[r["id"]]
        assert r["context"] == text[max(0, r["start"] - 20): r["stop"] + 20]
        if r["pattern"] == "person_name":
            assert text[r["start"]: r["stop"]] == r["match"]
            assert any(m.span() == (r["start"], r["stop"]) for m in re.finditer(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", text))
    names = {r["match"] for r in got.filter("pattern = 'person_name'").collect()}
    assert names == {"John Smith", "Jane  Doe", "Main St", "Ann Lee"}


def test_registry_is_immutable():
    more = patterns.DEFAULT.add(patterns.Pattern("x", ("x",)))
    assert "x" in more.patterns and "x" not in patterns.DEFAULT.patterns
    assert [p.name for p in patterns.DEFAULT.select(["ssn", "email"])] == ["email"]
    assert [p.name for p in patterns.preset("business_document")] == ["date", "address", "company_name", "invoice_number"]


def test_rename_and_transform(spark):
    df = spark.createDataFrame([("value", 123)], "old_name string, another_field bigint")
    assert shaping.rename_fields(df, {"old_name": "new_name", "gone": "x"}).first().asDict() == {"new_name": "value", "another_field": 123}
    raw = spark.createDataFrame([("$99.99", "  Product Title  ", "yes")], "price string, title string, in_stock string")
    done = shaping.apply_transformations(raw, {"price": C.parse_money, "title": F.trim, "in_stock": C.parse_bool_word, "x": F.lower})
    assert tuple(done.first()) == (99.99, "Product Title", True)


SCHEMA = quality.Schema(("id", "name", "price"), {"id": "bigint", "name": "string", "price": "double"})


def test_json_schema(spark):
    bodies = ['{"id": 1, "name": "Test Product", "price": 99.99}', '{"id": 1, "name": "Test Product"}',
              '{"id": "1", "name": "Test Product", "price": "99.99"}', '{"id": true, "name": null, "price": 5}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    errors = quality.json_schema_errors(quality.json_fields("body"), SCHEMA)
    got = [[e["field"] for e in r["e"]] for r in df.select("i", errors.alias("e")).orderBy("i").collect()]
    # A truth value is a whole number, a whole number is no fraction, a NULL is of no type.
    assert got == [[], ["price"], ["id", "price"], ["name", "price"]]


RULES = [quality.Rule("name", lambda c: F.length(c) > 3, "Name too short"), quality.Rule("price", lambda c: c > 0, "Price must be positive")]


def test_rules_collect_all_failures(spark):
    df = spark.createDataFrame([("Test Product", 99.99), ("Tst", -5.0), ("Good", None)], "name string, price double")
    checked = quality.check(df, RULES)
    assert quality.valid_rows(checked).count() == 1
    bad = {r["name"]: [e["message"] for e in r["validation_errors"]] for r in quality.invalid_rows(checked).collect()}
    assert bad == {"Tst": ["Name too short", "Price must be positive"], "Good": ["Price must be positive"]}


def products(spark):
    return spark.createDataFrame([("1", "Product 1", "$99.99", "yes"), ("2", "Product 2", "$149.99", "no"), ("3", "Product 3", "Not a price", "yes")],
                                 "id string, name string, price string, in_stock string")


def shop(spark, **sinks_of):
    return Etl(
        extract=lambda: products(spark),
        transforms=[lambda df: shaping.apply_transformations(df, {"id": lambda c: c.try_cast("bigint"), "price": C.parse_money, "in_stock": C.parse_bool_word})],
        schema=quality.Schema(("id", "name", "price", "in_stock"), {"id": "bigint", "name": "string", "price": "double", "in_stock": "boolean"}),
        **sinks_of)


def test_run_splits_and_loads(spark, tmp_path):
    done = shop(spark, load=lambda df: sinks.write_csv(df, f"{tmp_path}/ok"), quarantine=lambda df: sinks.write_json(df, f"{tmp_path}/bad")).run()
    assert (done.success, done.records_processed, done.records_valid, done.records_invalid, done.records_loaded) == (True, 3, 2, 1, 2)
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/ok").select("id", "price")) == [("1", "99.99"), ("2", "149.99")]
    assert spark.read.json(f"{tmp_path}/bad").first()["name"] == "Product 3"
    assert done.duration > 0


def test_dry_run_loads_nothing(spark):
    loaded = []
    done = shop(spark, load=loaded.append).dry_run()
    assert done.success and done.records_valid == 2 and done.records_loaded == 0 and not loaded


def test_failure_is_reported(spark):
    def broken():
        raise RuntimeError("Extraction failed")

    done = Etl(extract=broken).run()
    assert not done.success and done.error_message == "Extraction failed"


def test_sections(spark):
    text = "intro\n\nTITLE\nline one\n  line two \n\n## Sub\ntext\n1.2 Numbered\nmore\n\nShort heading\n\nbody.\n####### seven\n# EMPTY\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "only text.")], "id int, text string")
    got = [(r["title"], r["level"], r["start_line"], r["end_line"], r["content"]) for r in structure.sections(df.filter("id = 1"), "id", "text").orderBy("section_no").collect()]
    assert got[:2] == [("", 0, None, 0, "intro"), ("TITLE", 1, 2, 4, "line one\nline two")]
    assert ("Sub", 2, 6, 7, "text") in got and ("1.2 Numbered", 2, 8, 8 + 1, "more") in got
    assert got[-1] == ("Short heading", 3, 11, 14, "body.\n####### seven")
    # A heading without content is a heading, but no section.
    titles = [r["title"] for r in structure.headings(df, "id", "text").orderBy("id", "line_no").collect()]
    assert titles == ["TITLE", "Sub", "1.2 Numbered", "Short heading", "# EMPTY"]
    summary = {r["id"]: tuple(r)[1:] for r in structure.structure_summary(df, "id", "text").collect()}
    assert summary[2] == (0, 0, 0, False) and summary[3] == (0, 1, 0, False)


def test_tables(spark):
    text = "x\n| a | b |\n|---|---|\n| 1 |  |\nend\n\np\tq\tr\n1\t2\t3\nend\nName      City      Age\nAnn       Oslo      3\nBob       Rome      4\nlast"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    cells = {}
    for r in structure.split_table_cells(df, "id", "text").unionByName(structure.aligned_table_cells(df, "id", "text")).orderBy("table_no", "row_no", "col_no").collect():
        cells.setdefault((r["table_no"], r["row_no"]), []).append(r["cell"])
    # A ruler is skipped only if it has one column; empty cells at both ends count as the border.
    assert cells == {(0, 0): ["a", "b"], (0, 1): ["---", "---"], (0, 2): ["1", ""], (1, 0): ["p", "q", "r"], (1, 1): ["1", "2", "3"],
                     (2, 0): ["Name", "City", "Age"], (2, 1): ["Ann", "Oslo", "3"], (2, 2): ["Bob", "Rome", "4"]}


def test_weak_labels(spark):
    assert values(spark, ["My Article", "short", "x" * 60, "y" * 501], X.infer_category) == ["article", "name", "description", "article"]
    assert values(spark, ["Short Title", "short"], lambda c: X.infer_category(c, lowered_title=False)) == ["title", "name"]
    assert values(spark, ["Hello World", "hello", "HELLO", "1", "It's"], X.is_title) == [True, False, False, False, False]


def test_empty_csv_writes_nothing(spark, tmp_path):
    assert sinks.write_csv(products(spark).limit(0), f"{tmp_path}/none") is False
    assert not (tmp_path / "none").exists()
