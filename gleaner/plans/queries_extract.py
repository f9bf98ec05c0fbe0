"""Extraction: contacts, typed patterns and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import contacts as C
from gleaner.operators import html as H
from gleaner.operators import patterns as P
from gleaner.operators.profile import column_matches
from gleaner.plans.queries_text import customer_phone, luhn_sql, messy_dates, _MESSY_DATE, _PHONE
from gleaner.plans.registry import Tables, query
from gleaner.session import spread
from gleaner.sources import sinks

# -- e-mail addresses -------------------------------------------------------------------------------

_EMAIL = "(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
_ATOM = "[a-z0-9!#$%&''*+/=?^_`{|}~-]"
_STRICT = f"(?i){_ATOM}+(?:\\.{_ATOM}+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"


def _hits(table: str, key: str, array: str) -> str:
    return f"""SELECT {key}, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {array} AS l FROM {table})"""


def _firsts(table: str, key: str, array: str, norm: str, where: str = "true") -> str:
    """Rows ``key, pos, v``: the first hit per normal form, numbered in order."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, v FROM (
        SELECT *, row_number() OVER (PARTITION BY {key}, {norm} ORDER BY i) AS r FROM ({_hits(table, key, array)}) WHERE {where}) WHERE r = 1"""


_DOC_EMAILS = _firsts("documents", "doc_id", f"regexp_extract_all(text, '{_EMAIL}')", "lower(v)")


@query("extract_emails", f"SELECT doc_id, pos, v AS email FROM ({_DOC_EMAILS})")
def _(t: Tables):
    return C.extract_emails(t.documents, "doc_id", "text")


@query("extract_emails_strict", f"""
    SELECT doc_id, pos, v AS email FROM ({_firsts("documents", "doc_id", f"regexp_extract_all(text, '{_STRICT}')", "lower(v)")})""")
def _(t: Tables):
    return C.extract_emails(t.documents, "doc_id", "text", strict=True)


@query("case_insensitive_first", f"""
    WITH c AS (SELECT c_custkey, lower(c_mktsegment) || '@Example.com, ' || c_mktsegment || '@example.COM; k' || c_nationkey || '@example.org' AS text FROM customer)
    SELECT c_custkey, pos, v AS email FROM ({_firsts("c", "c_custkey", f"regexp_extract_all(text, '{_EMAIL}')", "lower(v)")})""")
def _(t: Tables):
    text = F.concat(F.lower("c_mktsegment"), F.lit("@Example.com, "), "c_mktsegment", F.lit("@example.COM; k"),
                    F.col("c_nationkey").cast("string"), F.lit("@example.org"))
    return C.extract_emails(t.customer.select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("extract_emails_html", f"""
    WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') || ' info' || page_id || '@example.com' AS text FROM pages)
    SELECT page_id, pos, v AS email FROM ({_firsts("p", "page_id", f"regexp_extract_all(text, '{_EMAIL}')", "lower(v)")})""")
def _(t: Tables):
    # Every page gets an address hidden behind a numeric reference and split by a tag.
    hidden = F.concat("html", F.lit("<p>info"), F.col("page_id").cast("string"), F.lit("&#64;example&#x2e;com</p>"))
    return C.extract_emails_html(t.pages.select("page_id", hidden.alias("html")), "page_id", "html")


_BY_DOMAIN = f"SELECT doc_id, pos, v AS email, lower(string_split(v, '@')[2]) AS domain FROM ({_DOC_EMAILS})"


@query("emails_by_domain", f"""
    SELECT doc_id, domain, string_agg(email, ', ' ORDER BY pos) AS emails FROM ({_BY_DOMAIN}) GROUP BY doc_id, domain""")
def _(t: Tables):
    grouped = C.group_by_domain(t.documents, "doc_id", "text")
    return grouped.select("doc_id", "domain", F.array_join("emails", ", ").alias("emails"))


@query("emails_by_domain_corpus", f"""
    SELECT domain, count(*) AS emails, count(DISTINCT lower(email)) AS distinct_emails FROM ({_BY_DOMAIN}) GROUP BY domain""")
def _(t: Tables):
    return C.count_by_domain(C.extract_emails(t.documents, "doc_id", "text"))


_DOMAINS = ["mail1.example.com", "5.example.com", "example.org"]
_ENDS = " OR ".join(f"ends_with(domain, '{d}')" for d in _DOMAINS)


@query("domain_semi_join", f"SELECT doc_id, pos, email FROM ({_BY_DOMAIN}) WHERE {_ENDS}")
def _(t: Tables):
    return C.filter_domains(C.extract_emails(t.documents, "doc_id", "text"), _DOMAINS)


@query("domain_anti_join", f"SELECT doc_id, pos, email FROM ({_BY_DOMAIN}) WHERE NOT ({_ENDS})")
def _(t: Tables):
    return C.filter_domains(C.extract_emails(t.documents, "doc_id", "text"), _DOMAINS, exclude=True)


_ALL_EMAILS = f"""SELECT 'd' || doc_id AS id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS email FROM documents
    UNION ALL SELECT 'p' || page_id, unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{_EMAIL}')) FROM pages
    UNION ALL SELECT 'c' || conv_id || ':' || turn, unnest(regexp_extract_all(text, '{_EMAIL}')) FROM conversations"""


def _email_sources(t: Tables):
    # A spelling once per text; distinct removes the rest.
    return [
        C.extract_emails(t.documents, "doc_id", "text"),
        C.extract_emails_html(t.pages, "page_id", "html"),
        C.extract_emails(t.conversations.withColumn("k", F.concat_ws(":", "conv_id", "turn")), "k", "text"),
    ]


@query("union_sources", f"SELECT lower(email) AS email, count(DISTINCT id) AS texts FROM ({_ALL_EMAILS}) GROUP BY 1")
def _(t: Tables):
    first, *rest = [s.select("email") for s in _email_sources(t)]
    for s in rest:
        first = first.unionAll(s)
    return first.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("texts"))


@query("distinct_emails", f"SELECT DISTINCT email FROM ({_ALL_EMAILS})")
def _(t: Tables):
    return sinks.distinct_emails(*_email_sources(t))


# -- phone numbers and addresses --------------------------------------------------------------------

_PHONE_ALL = """list_concat(list_concat(regexp_extract_all(x, '\\b(?:\\+\\d{1,3}[- ]?)?\\(?\\d{3}\\)?[- ]?\\d{3}[- ]?\\d{4}\\b'),
    regexp_extract_all(x, '\\b\\d{3}[- ]?\\d{3}[- ]?\\d{4}\\b')), regexp_extract_all(x, '\\b(?:\\+\\d{1,3}[- ]?)?\\d{5,}\\b'))"""
# RE2 has ASCII word boundaries; letters beyond ASCII become an underscore, which is a word character.
ASCII = "regexp_replace({}, '[À-ÖØ-öø-ÿ]', '_', 'g')"


def _phones(source: str, key: str) -> str:
    return _firsts(source, key, _PHONE_ALL, "regexp_replace(v, '[^0-9]', '', 'g')", "length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7")


@query("extract_phones", f"""
    WITH d AS (SELECT doc_id, {ASCII.format('text')} AS x FROM documents)
    SELECT doc_id, pos, v AS phone FROM ({_phones("d", "doc_id")})""")
def _(t: Tables):
    return C.extract_phones(t.documents, "doc_id", "text")


@query("extract_phones_html", f"""
    WITH d AS (SELECT page_id, {ASCII.format("regexp_replace(html || '<i>212</i>-<b>555 ' || lpad(page_id::VARCHAR, 4, '0') || '</b><u>3125550' || lpad(page_id::VARCHAR, 3, '0') || '</u>', '<[^>]*>', ' ', 'g')")} AS x FROM pages)
    SELECT page_id, pos, v AS phone FROM ({_phones("d", "page_id")})""")
def _(t: Tables):
    n = F.col("page_id").cast("string")
    html = F.concat("html", F.lit("<i>212</i>-<b>555 "), F.lpad(n, 4, "0"), F.lit("</b><u>3125550"), F.lpad(n, 3, "0"), F.lit("</u>"))
    return C.extract_phones_html(t.pages.select("page_id", html.alias("html")), "page_id", "html")


@query("extract_phones_typed", f"""
    WITH p AS (SELECT c_custkey, {_PHONE} AS phone, regexp_replace({_PHONE}, '[^0-9]', '', 'g') AS d FROM customer),
    v AS (SELECT * FROM p WHERE regexp_full_match(d, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}') AND substring(d, 2, 2) <> '11' AND substring(d, 5, 2) <> '11')
    SELECT c_custkey, '+1 ' || d[1:3] || '-' || d[4:6] || '-' || d[7:10] AS number, '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] AS "national",
        '+1' || d AS e164, 1 AS country_code FROM v""")
def _(t: Tables):
    text = F.concat(F.lit("call x"), customer_phone(), F.lit(", order "), F.col("c_nationkey").cast("string"))
    return C.extract_phones_typed(t.customer.select("c_custkey", text.alias("text")), "c_custkey", "text")


_STREET_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Main  Street' WHEN 'MACHINERY' THEN 'Park Ave' WHEN 'FURNITURE' THEN 'Old Mill Road' ELSE 'Cedar Ln' END"
_US_SQL = f"(c_custkey + 1) || ' ' || {_STREET_SQL} || ', Springfield, CA ' || lpad((c_custkey * 13 % 100000)::VARCHAR, 5, '0')"


def us_address():
    s, k = F.col("c_mktsegment"), F.col("c_custkey")
    street = F.when(s == "BUILDING", "Main  Street").when(s == "MACHINERY", "Park Ave").when(s == "FURNITURE", "Old Mill Road").otherwise("Cedar Ln")
    return F.concat((k + 1).cast("string"), F.lit(" "), street, F.lit(", Springfield, CA "), F.lpad((k * 13 % 100000).cast("string"), 5, "0"))


_US_TEXT = f"c_name || '; ' || {_US_SQL} || '. P.O. Box ' || (c_custkey + 5) || ', Rivertown, NY ' || lpad((c_custkey * 17 % 100000)::VARCHAR, 5, '0')"


def address_text():
    k = F.col("c_custkey")
    return F.concat("c_name", F.lit("; "), us_address(), F.lit(". P.O. Box "), (k + 5).cast("string"), F.lit(", Rivertown, NY "),
                    F.lpad((k * 17 % 100000).cast("string"), 5, "0"))


_SUFFIX = "Avenue|Ave|Boulevard|Blvd|Circle|Cir|Court|Ct|Drive|Dr|Lane|Ln|Place|Pl|Plaza|Plz|Road|Rd|Square|Sq|Street|St|Way|Terrace|Ter|Trail|Trl"
_US_ALL = f"""list_concat(list_concat(
    regexp_extract_all(x, '(?i)\\d+\\s+[A-Za-z0-9\\s,\\.]+(?:{_SUFFIX})\\.?(?:\\s*,\\s*|\\s+)[A-Za-z\\s]+(?:,\\s*|\\s+)[A-Z]{{2}}(?:\\s*,\\s*|\\s+)\\d{{5}}(?:-\\d{{4}})?'),
    regexp_extract_all(x, '(?i)\\d+\\s+[A-Za-z0-9\\s,\\.]+(?:{_SUFFIX})')),
    regexp_extract_all(x, '(?i)P\\.?O\\.?\\s*Box\\s+\\d+(?:\\s*,\\s*|\\s+)[A-Za-z\\s]+(?:,\\s*|\\s+)[A-Z]{{2}}(?:\\s*,\\s*|\\s+)\\d{{5}}(?:-\\d{{4}})?'))"""
_US_NORMAL = f"list_transform({_US_ALL}, lambda a: trim(regexp_replace(a, '\\s+', ' ', 'g')))"


@query("extract_addresses", f"""
    WITH d AS (SELECT 'c' || c_custkey AS id, {_US_TEXT} AS x FROM customer UNION ALL SELECT 'd' || doc_id, text FROM documents)
    SELECT id, pos, v AS address FROM ({_firsts("d", "id", _US_NORMAL, "v")})""")
def _(t: Tables):
    derived = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), address_text().alias("text"))
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return C.extract_addresses(derived.unionAll(docs), "id", "text")


def _abroad(country: str, tail: str) -> str:
    return f"list_transform(regexp_extract_all(x, '(?i)\\d+\\s+[A-Za-z0-9\\s,\\.]+(?:,\\s*|\\s+)[A-Za-z\\s]+(?:,\\s*|\\s+){tail}'), lambda a: trim(regexp_replace(a, '\\s+', ' ', 'g')))"


for _country, _tail, _code in (
    ("UK", "[A-Z]{1,2}\\d{1,2}[A-Z]?\\s+\\d[A-Z]{2}", "SW1A 1AA"),
    ("CA", "[A-Z]{1}\\d{1}[A-Z]{1}\\s+\\d{1}[A-Z]{1}\\d{1}", "K1A 0B1"),
):
    @query(f"extract_addresses_{_country.lower()}", f"""
        WITH d AS (SELECT c_custkey AS id, c_name || ': ' || c_custkey || ' High  Street, London, {_code}!' AS x FROM customer)
        SELECT id, pos, v AS address FROM ({_firsts("d", "id", _abroad(_country, _tail), "v")})""")
    def _(t: Tables, country=_country, code=_code):
        text = F.concat("c_name", F.lit(": "), F.col("c_custkey").cast("string"), F.lit(f" High  Street, London, {code}!"))
        return C.extract_addresses(t.customer.select(F.col("c_custkey").alias("id"), text.alias("text")), "id", "text", country)


@query("address_context", f"""
    WITH d AS (SELECT c_custkey AS id, {_US_TEXT} AS x FROM customer),
    f AS (SELECT id, v FROM ({_firsts("d", "id", _US_NORMAL, "v")}))
    SELECT id, v AS address, CASE WHEN contains(x, v) THEN substring(x, greatest(strpos(x, v) - 10, 1),
        least(strpos(x, v) - 1, 10) + length(v) + 10) ELSE '' END AS context FROM f JOIN d USING (id)""")
def _(t: Tables):
    return C.address_context(t.customer.select(F.col("c_custkey").alias("id"), address_text().alias("text")), "id", "text", window=10)


@query("address_components", f"""
    SELECT c_custkey, (c_custkey + 1)::VARCHAR AS number, regexp_replace({_STREET_SQL}, '\\s+', ' ', 'g') AS street, 'Springfield' AS city, 'CA' AS state,
        lpad((c_custkey * 13 % 100000)::VARCHAR, 5, '0') AS zip, true AS valid FROM customer
    UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, false FROM customer""")
def _(t: Tables):
    flat = F.regexp_replace(us_address(), " +", " ")
    both = t.customer.select("c_custkey", flat.alias("a")).unionAll(t.customer.select("c_custkey", F.col("c_name").alias("a")))
    return both.select("c_custkey", C.address_parts("a").alias("p")).select("c_custkey", "p.*")


# -- typed patterns ---------------------------------------------------------------------------------

_D = f"(SELECT doc_id, {ASCII.format('text')} AS x FROM documents)"
_STREETS = "Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Square|Sq"


def _all(*regexes: str) -> str:
    out = f"regexp_extract_all(x, '{regexes[0]}')"
    for rx in regexes[1:]:
        out = f"list_concat({out}, regexp_extract_all(x, '{rx}'))"
    return out


_V_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN_OK = f"length({_V_DIGITS}) BETWEEN 13 AND 19 AND {luhn_sql(_V_DIGITS)}"
_IP_OK = """CASE WHEN regexp_full_match(v, '([0-9]{1,3}\\.){3}[0-9]{1,3}') THEN len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0
    ELSE contains(v, ':') AND len(string_split(v, ':')) <= 8 END"""
_ISO = """CASE WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL AND regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN v ELSE coalesce(strftime(coalesce(
    CASE WHEN regexp_full_match(v, '.*[/.-][0-9]{4}') THEN coalesce(try_strptime(v, '%m/%d/%Y'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m-%d-%Y'),
    try_strptime(v, '%d-%m-%Y'), try_strptime(v, '%m.%d.%Y'), try_strptime(v, '%d.%m.%Y')) END), '%Y-%m-%d'), v) END"""

#: type: (array of raw hits, validity, written form, confidence)
_TYPES = {
    "email": (_all("\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"), "contains(string_split(v, '@')[2], '.')", "v", 0.95),
    "phone": (_all("\\+\\d{1,3}[-.\\s]?\\(?\\d{1,4}\\)?[-.\\s]?\\d{1,4}[-.\\s]?\\d{1,9}", "\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}", "\\b\\d{8,15}\\b"),
              "length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7", "regexp_replace(v, '[^0-9+]', '', 'g')", 0.85),
    "url": (_all("https?://(?:[-\\w.]|(?:%[\\da-fA-F]{2}))+[/\\w\\.-]*\\??[/\\w\\.-]*", "www\\.(?:[-\\w.]|(?:%[\\da-fA-F]{2}))+[/\\w\\.-]*\\??[/\\w\\.-]*"),
            "regexp_matches(lower(v), '\\.(com|org|net|edu|gov|io)')", "v", 0.9),
    "date": (_all("\\d{4}-\\d{2}-\\d{2}", "\\d{1,2}/\\d{1,2}/\\d{2,4}", "\\d{1,2}[-./]\\d{1,2}[-./]\\d{2,4}"),
             "regexp_matches(regexp_replace(v, '[/\\-\\s,.]', '', 'g'), '^[0-9]{6,8}$')", _ISO, 0.8),
    "ssn": (_all("\\d{3}[-]\\d{2}[-]\\d{4}", "\\b\\d{9}\\b"), "length(regexp_replace(v, '[^0-9]', '', 'g')) = 9", "v", 0.9),
    "credit_card": (_all("\\d{4}[-\\s]?\\d{4}[-\\s]?\\d{4}[-\\s]?\\d{4}", "\\d{13,16}"), _LUHN_OK, "regexp_replace(v, '[^0-9]', '', 'g')", 0.9),
    "ip_address": (_all("\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b", "\\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\\b"), _IP_OK, "v", 0.95),
    "address": (_all(f"\\d+\\s+[A-Za-z0-9\\s,.]+(?:{_STREETS})\\W+(?:[A-Za-z]+\\W+)?(?:[A-Z]{{2}})?\\W+\\d{{5}}(?:-\\d{{4}})?", "\\d+\\s+[A-Za-z0-9\\s,.]+"),
                "true", "v", 0.7),
    "person_name": (_all("\\b[A-Z][a-z]+\\s+[A-Z][a-z]+\\b", "\\b[A-Z][a-z]+\\s+[A-Z]\\.\\s+[A-Z][a-z]+\\b", "\\bDr\\.\\s+[A-Z][a-z]+\\b",
                         "\\bMr\\.\\s+[A-Z][a-z]+\\b", "\\bMs\\.\\s+[A-Z][a-z]+\\b", "\\bMrs\\.\\s+[A-Z][a-z]+\\b"), "true", "v", 0.7),
    "company_name": (_all("\\b[A-Z][A-Za-z0-9\\s]+(?:Inc|LLC|Ltd|Corp|Corporation|Company)\\b", "\\b[A-Z][A-Za-z0-9\\s]+(?:Inc\\.|LLC\\.|Ltd\\.|Corp\\.|Corporation)\\b"),
                     "true", "v", 0.75),
    "product_code": (_all("\\b[A-Z]{2,3}-\\d{4,6}\\b", "\\b[A-Z]{2,3}\\d{4,6}\\b"), "true", "v", 0.8),
    "invoice_number": (_all("\\bINV-\\d{5,9}\\b", "\\bINV\\d{5,9}\\b"), "true", "v", 0.9),
}


def matches_sql(kind: str, source: str = _D, key: str = "doc_id") -> str:
    """Rows ``key, pattern, ord, match, confidence`` of one type."""
    array, valid, written, confidence = _TYPES[kind]
    raw = f"SELECT {key}, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {array} AS l FROM {source} AS src)"
    formatted = f"SELECT {key}, i, {written} AS match FROM ({raw}) AS raw WHERE {valid}"
    first = f"SELECT {key}, match, min(i) AS i FROM ({formatted}) AS formatted GROUP BY {key}, match"
    return (f"SELECT {key}, '{kind}' AS pattern, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS ord, match, "
            f"{confidence}::DOUBLE AS confidence FROM ({first}) AS firsts")


def _union(kinds, source: str = _D, key: str = "doc_id") -> str:
    return " UNION ALL ".join(f"({matches_sql(k, source, key)})" for k in kinds)


_PLAIN = [p.name for p in P.DEFAULT.select()]


@query("recognize_patterns", _union(_PLAIN))
def _(t: Tables):
    return P.recognize(t.documents, "doc_id", "text")


@query("pattern_counts", f"SELECT pattern, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM ({_union(_PLAIN)}) GROUP BY pattern")
def _(t: Tables):
    # One row per text and type first, so that the second step only sums.
    per_text = P.recognize(t.documents, "doc_id", "text").groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))
    return per_text.groupBy("pattern").agg(F.sum("n").alias("matches"), F.count("*").alias("documents"))


# Sources of the types: the documents hold most; dates, URLs and numbers are written from the other tables.
_FROM_TABLES = {
    "url": ("(SELECT page_id AS id, 'see ' || url || ' or www.example.org/a%20b?q=' || page_id AS x FROM pages)",
            lambda t: t.pages.select(F.col("page_id").alias("id"), F.concat(F.lit("see "), "url", F.lit(" or www.example.org/a%20b?q="), F.col("page_id").cast("string")).alias("text"))),
    "date": (f"(SELECT o_orderkey AS id, 'Ordered ' || {_MESSY_DATE} || '; due ' || strftime(o_orderdate, '%m-%d-%Y') AS x FROM orders)",
             lambda t: t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Ordered "), messy_dates(), F.lit("; due "), F.date_format("o_orderdate", "MM-dd-yyyy")).alias("text"))),
    "ssn": ("(SELECT c_custkey AS id, c_name || ' ' || printf('%03d-%02d-%04d', c_custkey % 1000, c_nationkey, c_custkey % 10000) || ' ' || (100000000 + c_custkey) AS x FROM customer)",
            lambda t: t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" "), F.format_string(
                "%03d-%02d-%04d", F.col("c_custkey") % 1000, F.col("c_nationkey"), F.col("c_custkey") % 10000), F.lit(" "), (F.col("c_custkey") + 100000000).cast("string")).alias("text"))),
    "company_name": ("(SELECT s_suppkey AS id, 'by Best Tools ' || s_suppkey || ' Inc. and ' || s_name || ' Ltd, Big ' || s_nationkey || ' Corporation' AS x FROM supplier)",
                     lambda t: t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("by Best Tools "), F.col("s_suppkey").cast("string"), F.lit(" Inc. and "), "s_name",
                        F.lit(" Ltd, Big "), F.col("s_nationkey").cast("string"), F.lit(" Corporation")).alias("text"))),
    "ip_address": ("(SELECT event_id AS id, 'from ' || (user_id % 256) || '.1.2.' || (event_id % 400) || ' via 2001:db8:0:0:0:0:0:' || (event_id % 10) AS x FROM events)",
                   lambda t: t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("from "), (F.col("user_id") % 256).cast("string"), F.lit(".1.2."),
                      (F.col("event_id") % 400).cast("string"), F.lit(" via 2001:db8:0:0:0:0:0:"), (F.col("event_id") % 10).cast("string")).alias("text"))),
    "product_code": ("(SELECT p_partkey AS id, 'code AB-' || (1000 + p_partkey) || ' or XYZ' || (1000 + p_size) || ' old A-' || p_partkey AS x FROM part)",
                     lambda t: t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("code AB-"), (F.col("p_partkey") + 1000).cast("string"), F.lit(" or XYZ"),
                        (F.col("p_size") + 1000).cast("string"), F.lit(" old A-"), F.col("p_partkey").cast("string")).alias("text"))),
    "invoice_number": ("(SELECT o_orderkey AS id, 'invoice INV-' || (10000 + o_orderkey) || ' copy INV' || (20000 + o_custkey) AS x FROM orders)",
                       lambda t: t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("invoice INV-"), (F.col("o_orderkey") + 10000).cast("string"), F.lit(" copy INV"),
                          (F.col("o_custkey") + 20000).cast("string")).alias("text"))),
}
_REGISTRY = P.DEFAULT.add(*P.CONFIGURED)

for _kind in _TYPES:
    _source, _frame = _FROM_TABLES.get(_kind, ("(SELECT doc_id AS id, " + ASCII.format("text") + " AS x FROM documents)",
                                               lambda t: t.documents.select(F.col("doc_id").alias("id"), "text")))

    @query(f"pattern_{_kind}", matches_sql(_kind, _source, "id"))
    def _(t: Tables, kind=_kind, frame=_frame):
        return P.recognize(frame(t), "id", "text", [_REGISTRY.patterns[kind]])


@query("written_dates", f"""
    SELECT o_orderkey AS id, 'date' AS pattern, 0::BIGINT AS ord, strftime(o_orderdate, '%Y-%m-%d') AS match, 0.8::DOUBLE AS confidence FROM orders
    WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def _(t: Tables):
    # Written months fit the regex but not the default validity; this registry accepts them.
    from dataclasses import replace

    date = P.DEFAULT.patterns["date"]
    written = replace(date, regexes=date.regexes[3:], valid=None)
    texts = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Ordered "), messy_dates(), F.lit(".")).alias("text"))
    return P.recognize(texts, "id", "text", [written])


def _spans_sql(array_regex: str, kind: str, confidence: float) -> str:
    """Offsets from the texts between the matches, for one regex."""
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, text, {ASCII.format('text')} AS x FROM documents),
    h AS (SELECT doc_id, text, x, regexp_extract_all(x, '{array_regex}') AS m,
        string_split_regex(x, '{array_regex}') AS g FROM d),
    s AS (SELECT doc_id, text, unnest(m) AS match, generate_subscripts(m, 1) AS i,  m, g FROM h WHERE len(m) > 0),
    p AS (SELECT doc_id, text, match, i, CAST(list_sum(list_transform(g[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda q: length(q))), 0) AS BIGINT) AS start FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, match ORDER BY i) AS r FROM p)
    SELECT doc_id, '{kind}' AS pattern, match, start, start + length(match) AS stop, {confidence}::DOUBLE AS confidence,
        substring(text, greatest(start - 20, 0) + 1, start + length(match) + 20 - greatest(start - 20, 0)) AS context FROM f WHERE r = 1"""


@query("pattern_positions", _spans_sql("\\b[A-Z][a-z]+\\s+[A-Z][a-z]+\\b", "capitalised", 0.7))
def _(t: Tables):
    pair = P.Pattern("capitalised", (r"(?U)\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",), 0.7)
    return P.recognize_spans(t.documents, "doc_id", "text", [pair])


@query("pattern_positions_all")
def _(t: Tables):
    return P.recognize_spans(t.documents, "doc_id", "text", P.DEFAULT.select(include_sensitive=True))


@query("pattern_confidence", f"SELECT pattern, confidence, count(*) AS matches FROM ({_union(_PLAIN)}) WHERE confidence >= 0.75 GROUP BY 1, 2")
def _(t: Tables):
    sure = P.recognize(t.documents, "doc_id", "text", P.DEFAULT.select(min_confidence=0.75))
    return sure.groupBy("pattern", "confidence").agg(F.count("*").alias("matches"))


_CUSTOM_SOURCE = "(SELECT o_orderkey, 'INV-' || (10000 + o_orderkey) || ' PR' || (1000 + o_custkey) || ' #' || o_orderkey || '#' AS x FROM orders)"


@query("custom_patterns", f"""
    {matches_sql("product_code", _CUSTOM_SOURCE, "o_orderkey")} UNION ALL {matches_sql("invoice_number", _CUSTOM_SOURCE, "o_orderkey")}
    UNION ALL SELECT o_orderkey, 'ticket', 0, '#' || o_orderkey || '#', 0.75::DOUBLE FROM orders""")
def _(t: Tables):
    text = F.concat(F.lit("INV-"), (F.col("o_orderkey") + 10000).cast("string"), F.lit(" PR"), (F.col("o_custkey") + 1000).cast("string"),
                    F.lit(" #"), F.col("o_orderkey").cast("string"), F.lit("#"))
    registry = P.Registry({}).add(*P.CONFIGURED).add_json('{"ticket": {"patterns": ["#\\\\d+#"]}, "unused": {"patterns": ["x"]}}').remove("unused")
    return P.recognize(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text", registry.select())


@query("sensitive_patterns", f"SELECT pattern, count(*) AS matches FROM ({_union(['ssn', 'credit_card'])}) GROUP BY pattern")
def _(t: Tables):
    chosen = [p for p in P.DEFAULT.select(include_sensitive=True) if p.sensitive]
    return P.recognize(t.documents, "doc_id", "text", chosen).groupBy("pattern").agg(F.count("*").alias("matches"))


@query("redact_sensitive", """
    SELECT c_custkey, c_name || ' [redacted] and 12-3 and ' || printf('%09d', 100000000 + c_custkey) || '0123' AS redacted FROM customer""")
def _(t: Tables):
    ssn = F.format_string("%03d-%02d-%04d", F.col("c_custkey") % 1000, F.col("c_nationkey"), F.col("c_custkey") % 10000)
    # Nine digits inside a longer number are none of their own.
    longer = F.concat(F.format_string("%09d", 100000000 + F.col("c_custkey")), F.lit("0123"))
    text = F.concat(F.regexp_replace("c_name", "#0", "#"), F.lit(" "), ssn, F.lit(" and 12-3 and "), longer)
    masked = P.redact(text, [P.DEFAULT.patterns["ssn"]])
    # The customer number is nine digits; without its first one it is no identifier.
    return t.customer.select("c_custkey", F.regexp_replace(masked, "#", "#0").alias("redacted"))


@query("preset_select", f"SELECT pattern, count(*) AS matches FROM ({_union(['email', 'phone', 'url', 'person_name'])}) GROUP BY pattern")
def _(t: Tables):
    return P.recognize(t.documents, "doc_id", "text", P.preset("contact_extraction")).groupBy("pattern").agg(F.count("*").alias("matches"))


@query("column_regex_values", """
    WITH m AS (SELECT o_orderkey, unnest(l) AS match, generate_subscripts(l, 1) AS i FROM (SELECT o_orderkey, regexp_extract_all(o_orderpriority, '([A-Z]+)', 1) AS l FROM orders)),
    f AS (SELECT match, min((o_orderkey, i)) AS first FROM m GROUP BY match)
    SELECT match, first[1] AS first_seen, first[2] - 1 AS position FROM f""")
def _(t: Tables):
    return column_matches(t.orders, "o_orderpriority", "([A-Z]+)", "o_orderkey", group=1)


_FEATURES = ", ".join(
    f"coalesce(max(CASE WHEN pattern = '{k}' THEN n END), 0)::BIGINT AS {k}_count, coalesce(max(CASE WHEN pattern = '{k}' THEN n END), 0) > 0 AS has_{k}" for k in _PLAIN)


@query("entity_feature_columns", f"""
    WITH c AS (SELECT doc_id, pattern, count(*) AS n FROM ({_union(_PLAIN)}) GROUP BY 1, 2),
    f AS (SELECT d.doc_id, {_FEATURES} FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id)
    SELECT f.*, length(text) AS length, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS word_count
    FROM f JOIN documents USING (doc_id)""")
def _(t: Tables):
    return P.feature_columns(t.documents, "doc_id", "text")


@query("frame_patterns_column", f"""
    WITH c AS (SELECT doc_id, count(DISTINCT pattern) AS types, count(*) AS matches FROM ({_union(_PLAIN)}) GROUP BY 1)
    SELECT doc_id, coalesce(types, 0) AS types, coalesce(matches, 0) AS matches FROM documents LEFT JOIN c USING (doc_id)""")
def _(t: Tables):
    found = P.add_pattern_columns(t.documents.select("doc_id", "text"), ["text", "absent"])
    sizes = F.transform(F.map_values("text_patterns"), lambda m: F.size(m))
    return found.select("doc_id", F.size("text_patterns").alias("types"), F.aggregate(sizes, F.lit(0), lambda a, n: a + n).alias("matches"))


@query("process_documents", f"""
    WITH c AS (SELECT doc_id, count(DISTINCT pattern) AS types FROM ({_union(_PLAIN)}) GROUP BY 1)
    SELECT doc_id, coalesce(source, '') AS source, lang, CASE WHEN lang = 'es' THEN NULL ELSE coalesce(types, 0) END AS types,
        CASE WHEN lang = 'es' THEN 'No text content found' END AS error FROM documents LEFT JOIN c USING (doc_id)""")
def _(t: Tables):
    # Spanish documents lose their text, French ones have it in the fallback field.
    lang = F.col("lang")
    docs = t.documents.select("doc_id", "lang", "source", F.when(lang.isin("es", "fr"), "").otherwise(F.col("text")).alias("text"),
                              F.when(lang == "fr", F.col("text")).alias("content"))
    out = P.process_documents(docs, "doc_id", "text", "content", carry=["source", "lang"])
    return out.select("doc_id", "source", "lang", F.when(F.col("error").isNull(), F.size("patterns")).alias("types"), "error")


# -- HTML -------------------------------------------------------------------------------------------

_ENT = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query("html_list_items", f"""
    SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, trim({_ENT.format("regexp_replace(unnest(l), '<[^>]+>', '', 'g')")}) AS item
    FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)""")
def _(t: Tables):
    return H.list_items(t.pages, "page_id", "html", "nav ul")


@query("html_links", """
    SELECT page_id, url, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS href, array_to_string(string_split(url, '/')[1:3], '/') || unnest(l) AS target
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def _(t: Tables):
    return H.links(t.pages, "page_id", "url", "html")


@query("html_select_fields", f"""
    SELECT page_id, 'title' AS field, 0 AS pos, trim({_ENT.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS value FROM pages
    UNION ALL SELECT page_id, 'heading', 0, trim({_ENT.format("regexp_extract(html, '<article><h1>(.*?)</h1>', 1)")}) FROM pages
    UNION ALL SELECT page_id, 'ad', 0, trim({_ENT.format("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}) FROM pages""")
def _(t: Tables):
    return H.select_fields(t.pages, "page_id", "html", {"title": "title", "heading": "article h1", "ad": "div.ad"})


@query("html_containers", f"""
    SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, trim({_ENT.format("regexp_extract(unnest(l), '<a [^>]*>(.*?)</a>', 1)")}) AS label, NULL::VARCHAR AS price
    FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)""")
def _(t: Tables):
    return H.containers(t.pages, "page_id", "html", "nav li", {"label": "a", "price": ".price"})


def _customer_page():
    """A page with a list and a table per customer; the third table row is one cell short."""
    k = F.col("c_custkey").cast("string")
    return F.concat(
        F.lit("<html><body><ol><li>one</li></ol><table id='t1' class='data wide'><tr><th>Field</th><th> Value </th></tr><tr><td>name</td><td><b>"), "c_name",
        F.lit("</b></td></tr><tr><td>segment &amp; key</td><td>"), "c_mktsegment", F.lit(" / "), k,
        F.lit("</td></tr><tr><td>short</td></tr></table><table><tr><th>x</th></tr><tr><td>y</td></tr></table></body></html>"))


@query("html_table_rows", """
    SELECT c_custkey, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no, CASE col_no WHEN 0 THEN 'Field' ELSE 'Value' END AS header,
        CASE WHEN row_no = 0 AND col_no = 0 THEN 'name' WHEN row_no = 0 THEN c_name WHEN col_no = 0 THEN 'segment & key' ELSE c_mktsegment || ' / ' || c_custkey END AS cell
    FROM customer, (SELECT unnest([0, 1]) AS row_no), (SELECT unnest([0, 1]) AS col_no)""")
def _(t: Tables):
    return H.table_cells(spread(t.customer).select("c_custkey", _customer_page().alias("html")), "c_custkey", "html", "table.data#t1")


@query("html_table_wide", """
    SELECT c_custkey, 0::BIGINT AS row_no, 'name' AS "Field", c_name AS "Value" FROM customer
    UNION ALL SELECT c_custkey, 1, 'segment & key', c_mktsegment || ' / ' || c_custkey FROM customer""")
def _(t: Tables):
    cells = H.table_cells(spread(t.customer).select("c_custkey", _customer_page().alias("html")), "c_custkey", "html")
    return H.table_rows(cells, "c_custkey", ["Field", "Value"])


@query("html_auto_structure", """
    WITH s AS (SELECT s_suppkey, s_name, s_nationkey % 3 AS kind FROM supplier)
    SELECT s_suppkey, 'table' AS kind, 0 AS row_no, 0 AS col_no, 'Name' AS header, s_name AS value FROM s WHERE kind = 0
    UNION ALL SELECT s_suppkey, 'ul', 0, 0, 'Content', s_name FROM s WHERE kind = 1
    UNION ALL SELECT s_suppkey, 'ol', 0, 0, 'Content', 'first' FROM s WHERE kind = 2
    UNION ALL SELECT s_suppkey, 'ol', 1, 0, 'Content', s_name FROM s WHERE kind = 2""")
def _(t: Tables):
    kind = F.col("s_nationkey") % 3
    html = F.when(kind == 0, F.concat(F.lit("<ul><li>no</li></ul><table><tr><th>Name</th></tr><tr><td>"), "s_name", F.lit("</td></tr></table>"))).when(
        kind == 1, F.concat(F.lit("<table><tr><th>Name</th></tr></table><ul><li> "), "s_name", F.lit("</ul>"))).otherwise(
        F.concat(F.lit("<ol><li>first</li><li>"), "s_name", F.lit("</li></ol>")))
    return H.auto_structure(spread(t.supplier).select("s_suppkey", html.alias("html")), "s_suppkey", "html")


_CHAIN_PAGES = "SELECT 'https://shop.example.com/c/' || c_custkey AS url, 'https://shop.example.com/c/' || (c_custkey + 1) AS target, c_mktsegment <> 'BUILDING' AS links_on FROM customer"


@query("next_page_chain", f"""
    WITH RECURSIVE p AS ({_CHAIN_PAGES}),
    l AS (SELECT url, target FROM p WHERE links_on AND target IN (SELECT url FROM p)),
    c AS (SELECT url AS start, 0 AS depth, url FROM p UNION ALL SELECT c.start, c.depth + 1, l.target FROM c JOIN l USING (url) WHERE c.depth < 4)
    SELECT start, depth, url FROM c""")
def _(t: Tables):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://shop.example.com/c/"), k.cast("string"))
    more = F.concat(F.lit("<a href='/home'>home</a><a class='next' href='/c/"), (k + 1).cast("string"), F.lit("'>next</a>"))
    pages = t.customer.select("c_custkey", url.alias("url"), F.when(F.col("c_mktsegment") != "BUILDING", more).otherwise("<p>end</p>").alias("html"))
    found = H.links(pages, "c_custkey", "url", "html", "a.next").filter("pos = 0")
    known = found.join(pages.select(F.col("url").alias("target")), "target", "left_semi")
    return H.next_page_chains(known, pages.select("url"), max_pages=5)
