"""Scalar functions on texts, numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import features as X
from gleaner.functions import text as C
from gleaner.functions import validate as V
from gleaner.operators.words import drop_listed_words
from gleaner.plans.registry import Tables, query

# White space, letters and digits of the test corpus are ASCII and Latin-1, which the SQL spells out.
_SQL_WORD = r"[A-Za-z0-9_À-ÖØ-öø-ÿ]"

# A short stop word list for the queries.
STOPWORDS = ["the", "and", "of", "to", "is", "la", "de", "le", "der", "die", "und", "que"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def _entities(sql: str) -> str:
    """The references that occur in the pages; the ampersand last, so that nothing is decoded twice."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{char}')"
    return sql


@query("clean_text", f"""
    SELECT page_id, trim(regexp_replace(regexp_replace({_entities('html')}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned
    FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", C.clean_text("html").alias("cleaned"))


@query("clean_text_all_options", f"""
    SELECT page_id, lower(trim(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace({_entities('html')}, '<[^>]+>', ' ', 'g'), '[^A-Za-z0-9_À-ÖØ-öø-ÿ\\s'']', ' ', 'g'),
        '\\s''|''\\s', ' ', 'g'), '\\s+', ' ', 'g'))) AS cleaned
    FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", C.clean_text("html", punctuation=True, lowercase=True).alias("cleaned"))


@query("fix_unicode")
def _(t: Tables):
    # Full-width forms and ligatures need NFKC; the letters come from the customers.
    wide = F.translate("c_mktsegment", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    return t.customer.select("c_custkey", C.fix_unicode(F.concat(wide, F.lit(" ﬁ “x” – "), F.col("c_name"))).alias("fixed"))


@query("replace_typographic", """
    SELECT c_custkey, '"' || c_name || '" - ''' || c_mktsegment || '''--' || c_nationkey AS fixed FROM customer""")
def _(t: Tables):
    fancy = F.concat(F.lit("“"), "c_name", F.lit("” – ‘"), "c_mktsegment", F.lit("’—"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", C.replace_typographic(fancy).alias("fixed"))


@query("remove_html", f"""
    SELECT page_id, regexp_replace({_entities('html')}, '<[^>]+>', ' ', 'g') AS plain FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", C.remove_html("html").alias("plain"))


@query("normalize_whitespace", """
    SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", C.normalize_whitespace("text").alias("flat"))


@query("remove_punctuation", """
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_À-ÖØ-öø-ÿ\\s'']', ' ', 'g'),
        '\\s''|''\\s', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", C.remove_punctuation("text").alias("plain"))


@query("remove_numbers", """
    SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\\d+', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", C.remove_numbers("text").alias("plain"))


@query("remove_special", """
    SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\\s.\\-]', '', 'g'), '\\s+', ' ', 'g')) AS plain
    FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", C.remove_special_characters("text", ".-").alias("plain"))


_STOP_ORACLE = f"""
    SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '),
        lambda w: lower(w) NOT IN ({_STOP_SQL})), ' ') AS kept FROM documents"""


@query("remove_stopwords", _STOP_ORACLE)
def _(t: Tables):
    return t.documents.select("doc_id", C.remove_stopwords("text", STOPWORDS).alias("kept"))


@query("stopword_anti_join", f"""
    WITH listed AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w
        FROM benchmark) WHERE w <> ''),
    tokens AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS l FROM documents)),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM tokens
        WHERE w <> '' AND lower(w) NOT IN (SELECT word FROM listed) GROUP BY doc_id)
    SELECT doc_id, coalesce(kept, '') AS kept FROM documents LEFT JOIN kept USING (doc_id)""")
def _(t: Tables):
    # The list is the vocabulary of the benchmark passages, too long for an expression.
    listed = t.benchmark.select(F.explode(C.words("text")).alias("w")).select(F.lower("w").alias("word"))
    return drop_listed_words(t.documents, "doc_id", "text", listed).withColumnRenamed("text", "kept")


@query("replace_text", """
    SELECT doc_id, replace(regexp_replace(regexp_replace(text, 'the', 'a$1', 'gi'), 'and', '+', 'gi'), 'x', 'y') AS replaced
    FROM documents""")
def _(t: Tables):
    first = C.replace_text("text", {"the": "a$1", "and": "+"})
    return t.documents.select("doc_id", C.replace_text(first, {"x": "y"}, case_sensitive=True).alias("replaced"))


@query("clean_columns", """
    SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(trim(p_brand)) AS p_brand, p_type FROM part""")
def _(t: Tables):
    padded = t.part.select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("\t ")), F.lit(" ")).alias("p_name"),
                           F.concat("p_brand", F.lit("\n")).alias("p_brand"), "p_type")
    return C.clean_columns(padded, ["p_name", "p_brand", "absent"], lowercase=True)


@query("extract_numeric", """
    SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS amount FROM orders""")
def _(t: Tables):
    shown = F.concat(F.lit("Total: $"), F.format_number("o_totalprice", 2), F.lit(" incl. tax"))
    return t.orders.select("o_orderkey", C.extract_number(shown).alias("amount"))


@query("normalize_text", "SELECT c_custkey, lower(c_name) || ' hello world' AS normal FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", C.normalize_text(F.concat(F.upper("c_name"), F.lit("! HELLO world!"))).alias("normal"))


@query("parse_money_or_null", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE END AS price
    FROM orders""")
def _(t: Tables):
    shown = F.when(F.col("o_orderstatus") == "P", "Not a price").otherwise(
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return t.orders.select("o_orderkey", C.parse_money(shown).alias("price"))


@query("parse_bool_words", """
    SELECT p_partkey, p_size > 25 AS yes_no, p_size > 25 AS in_stock FROM part""")
def _(t: Tables):
    big = F.col("p_size") > 25
    return t.part.select("p_partkey", C.parse_bool_word(F.when(big, "Yes").otherwise("No")).alias("yes_no"),
                         C.parse_bool_word(F.when(big, "In Stock").otherwise("Sold out"), "in stock").alias("in_stock"))


@query("numeric_coerce", """
    SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS k FROM events""")
def _(t: Tables):
    return t.events.select("event_id", C.coerce_number("props").alias("k"))


_MESSY_DATE = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d.%m.%Y')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%b %-d, %Y') ELSE 'on ' || o_orderstatus END"""


def messy_dates():
    """Order dates written in the layout of their priority."""
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    return (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd")).when(p == "2-HIGH", F.date_format(d, "MM/dd/yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "dd.MM.yyyy")).when(p == "4-NOT SPECIFIED", F.date_format(d, "MMM d, yyyy"))
        .otherwise(F.concat(F.lit("on "), "o_orderstatus"))
    )


@query("format_date_iso", f"""
    SELECT o_orderkey, {_MESSY_DATE} AS written,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'on ' || o_orderstatus
             WHEN o_orderpriority = '3-MEDIUM' AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso
    FROM orders""")
def _(t: Tables):
    # A day up to 12 reads as a month: the layout with the month first is tried first.
    return t.orders.select("o_orderkey", messy_dates().alias("written"), V.iso_date(messy_dates()).alias("iso"))


@query("validate_date", f"""
    SELECT o_orderkey, {_MESSY_DATE} AS written,
        regexp_matches(regexp_replace({_MESSY_DATE}, '[/\\-\\s,.]', '', 'g'), '^[0-9]{{6,8}}$') AS is_date FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", messy_dates().alias("written"), V.is_numeric_date(messy_dates()).alias("is_date"))


_CARDS = "regexp_extract_all(text, '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}')"


def luhn_sql(digits: str) -> str:
    """Luhn check of a digit string, position by position from the right."""
    return f"""(list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substring({digits}, length({digits}) - i + 1, 1) AS INTEGER)
        ELSE CASE WHEN 2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INTEGER) > 9
             THEN 2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INTEGER) - 9
             ELSE 2 * CAST(substring({digits}, length({digits}) - i + 1, 1) AS INTEGER) END END)) % 10 = 0)"""


@query("validate_card_luhn", f"""
    SELECT doc_id, card, {luhn_sql("regexp_replace(card, '[^0-9]', '', 'g')")} AS is_card
    FROM (SELECT doc_id, unnest({_CARDS}) AS card FROM documents)""")
def _(t: Tables):
    shape = r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"
    cards = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(shape), F.lit(0))).alias("card"))
    return cards.select("doc_id", "card", V.is_card_number("card").alias("is_card"))


@query("validate_ip", """
    WITH a AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '2001:db8:0:0:0:0:0:' || to_hex(user_id)
        WHEN event_type = 'error' THEN 'host ' || user_id ELSE (event_id % 300) || '.' || (user_id % 260) || '.0.1' END AS ip FROM events)
    SELECT event_id, lower(ip) AS ip, CASE WHEN regexp_matches(ip, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$')
        THEN len(list_filter(string_split(ip, '.'), lambda o: CAST(o AS INTEGER) > 255)) = 0
        ELSE contains(ip, ':') AND len(string_split(ip, ':')) <= 8 END AS is_ip FROM a""")
def _(t: Tables):
    kind = F.col("event_type")
    v4 = F.concat_ws(".", (F.col("event_id") % 300).cast("string"), (F.col("user_id") % 260).cast("string"), F.lit("0"), F.lit("1"))
    ip = F.when(kind == "view", F.concat(F.lit("2001:db8:0:0:0:0:0:"), F.hex("user_id"))).when(
        kind == "error", F.concat(F.lit("host "), F.col("user_id").cast("string"))).otherwise(v4)
    return t.events.select("event_id", F.lower(ip).alias("ip"), V.is_ip_address(ip).alias("is_ip"))


_PHONE = "'(' || lpad((c_custkey % 800 + 200)::VARCHAR, 3, '0') || ') ' || lpad((c_custkey * 7 % 900 + 100)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')"


def customer_phone():
    """A number in US form derived from the customer key; some break the numbering rules."""
    k = F.col("c_custkey")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    return F.concat(F.lit("("), three(k % 800 + 200), F.lit(") "), three(k * 7 % 900 + 100), F.lit("-"),
                    F.lpad((k % 10000).cast("string"), 4, "0"))


@query("format_phone_digits", f"SELECT c_custkey, regexp_replace({_PHONE}, '[^0-9+]', '', 'g') AS digits FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", V.phone_digits(customer_phone()).alias("digits"))


@query("validate_phone_digits", """
    SELECT event_id, length(regexp_replace(props || user_id || ' ' || event_id, '[^0-9]', '', 'g')) >= 7 AS is_phone FROM events""")
def _(t: Tables):
    text = F.concat("props", F.col("user_id").cast("string"), F.lit(" "), F.col("event_id").cast("string"))
    return t.events.select("event_id", V.has_phone_digits(text).alias("is_phone"))


@query("validate_url_tld", """
    SELECT page_id, url, regexp_matches(lower(url), '\\.(com|org|net|edu|gov|io)') AS known FROM pages
    UNION ALL SELECT page_id, replace(replace(replace(url, '.com', '.fr'), '.org', '.de'), '.net', '.example') AS url, false AS known FROM pages""")
def _(t: Tables):
    foreign = F.replace(F.replace(F.replace("url", F.lit(".com"), F.lit(".fr")), F.lit(".org"), F.lit(".de")), F.lit(".net"), F.lit(".example"))
    both = t.pages.select("page_id", "url").unionAll(t.pages.select("page_id", foreign.alias("url")))
    return both.withColumn("known", V.has_known_domain("url"))


@query("validate_ssn", """
    SELECT c_custkey, printf('%03d-%02d-%04d', c_custkey % 1000, c_nationkey, c_custkey) AS ssn,
        length(regexp_replace(printf('%03d-%02d-%04d', c_custkey % 1000, c_nationkey, c_custkey), '[^0-9]', '', 'g')) = 9 AS is_ssn
    FROM customer""")
def _(t: Tables):
    ssn = F.format_string("%03d-%02d-%04d", F.col("c_custkey") % 1000, F.col("c_nationkey"), F.col("c_custkey"))
    return t.customer.select("c_custkey", ssn.alias("ssn"), V.is_ssn(ssn).alias("is_ssn"))


@query("validate_email", """
    WITH e AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name || '@example.com'
        WHEN 'MACHINERY' THEN 'k' || c_custkey || '@mail.example.org' WHEN 'FURNITURE' THEN 'k' || c_custkey || '@example'
        ELSE 'a.' || c_custkey || '@Example.NET ' END AS email FROM customer)
    SELECT c_custkey, email, regexp_full_match(email, '(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS is_email FROM e""")
def _(t: Tables):
    s, k = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    email = F.when(s == "BUILDING", F.concat("c_name", F.lit("@example.com"))).when(
        s == "MACHINERY", F.concat(F.lit("k"), k, F.lit("@mail.example.org"))).when(
        s == "FURNITURE", F.concat(F.lit("k"), k, F.lit("@example"))).otherwise(F.concat(F.lit("a."), k, F.lit("@Example.NET ")))
    return t.customer.select("c_custkey", email.alias("email"), V.is_email(email).alias("is_email"))


_DIGITS = f"regexp_replace({_PHONE}, '[^0-9]', '', 'g')"


@query("format_phone_us", f"""
    WITH p AS (SELECT c_custkey, {_PHONE} AS phone, {_DIGITS} AS d FROM customer),
    v AS (SELECT *, regexp_full_match(d, '[2-9][0-9]{{2}}[2-9][0-9]{{6}}') AND substring(d, 2, 2) <> '11' AND substring(d, 5, 2) <> '11' AS ok FROM p)
    SELECT c_custkey, phone,
        CASE WHEN ok THEN '+1 ' || d[1:3] || '-' || d[4:6] || '-' || d[7:10] ELSE phone END AS international,
        CASE WHEN ok THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE phone END AS "national",
        CASE WHEN ok THEN '+1' || d ELSE phone END AS e164 FROM v""")
def _(t: Tables):
    p = customer_phone()
    return t.customer.select("c_custkey", p.alias("phone"), *[
        V.format_us_phone(p, s).alias(s) for s in ("international", "national", "e164")])


@query("html_entity_decode_numeric", "SELECT c_custkey, c_name || '@' || lower(c_mktsegment) || '.com &amp;' AS decoded FROM customer")
def _(t: Tables):
    coded = F.concat("c_name", F.lit("&#64;"), F.lower("c_mktsegment"), F.lit("&#x2E;com &amp;"))
    return t.customer.select("c_custkey", C.decode_numeric_entities(coded).alias("decoded"))


_CATEGORY_SQL = """CASE WHEN contains(lower(text), 'article') THEN 'article' WHEN contains(lower(text), 'description') THEN 'description'
    WHEN contains(lower(text), 'title') THEN 'title' WHEN contains(lower(text), 'name') THEN 'name' WHEN contains(lower(text), 'comment') THEN 'comment'
    WHEN contains(lower(text), 'address') THEN 'address' WHEN length(text) < 50 THEN 'name' WHEN length(text) > 500 THEN 'article'
    ELSE 'description' END"""


@query("infer_text_category", f"SELECT doc_id, {_CATEGORY_SQL} AS category FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", X.infer_category("text").alias("category"))


@query("title_case_test", """
    SELECT conv_id, turn, regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ÿ]') AND NOT regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ÿ][A-ZÀ-ÖØ-Þ]')
        AND NOT regexp_matches(text, '(^|[^A-Za-zÀ-ÖØ-öø-ÿ])[a-zß-öø-ÿ]') AS is_title FROM conversations""")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", X.is_title("text").alias("is_title"))


_RATIOS = """round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 9) AS digit_ratio,
    round(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 9) AS alpha_ratio,
    round(length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) / greatest(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')), 1)::DOUBLE, 9) AS upper_ratio"""


@query("char_distribution", f"""
    SELECT doc_id, length(text)::DOUBLE AS length,
        len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))::DOUBLE AS words, {_RATIOS}
    FROM documents""")
def _(t: Tables):
    out = t.documents.select("doc_id", X.char_distribution("text").alias("d")).select("doc_id", "d.*")
    return out.select("doc_id", "length", "words", *[F.round(c, 9).alias(c) for c in ("digit_ratio", "alpha_ratio", "upper_ratio")])


@query("mixed_features", f"""
    SELECT conv_id, turn, length(text)::DOUBLE AS length, 0.0::DOUBLE AS is_number, 1.0::DOUBLE AS is_string, {_RATIOS},
        round(length(regexp_replace(text, '[^.,;:]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 9) AS punctuation_ratio,
        regexp_full_match(text, '[0-9.]*\\.[0-9.]*')::INT::DOUBLE AS dotted_number, contains(text, '@')::INT::DOUBLE AS has_at,
        (contains(text, '/') OR contains(text, '-'))::INT::DOUBLE AS has_separator FROM conversations""")
def _(t: Tables):
    out = t.conversations.select("conv_id", "turn", X.mixed_features("text").alias("m")).select("conv_id", "turn", "m.*")
    return out.select(*[F.round(c, 9).alias(c) if c.endswith("_ratio") else c for c in out.columns])


@query("numeric_features", """
    WITH v AS (SELECT event_id, value AS v, ln(1 + abs(value)) AS l, (value = floor(value))::INT::DOUBLE AS i FROM events)
    SELECT event_id, round((v - avg(v) OVER ()) / CASE WHEN stddev_pop(v) OVER () = 0 THEN 1 ELSE stddev_pop(v) OVER () END, 6) AS value_z,
        round((l - avg(l) OVER ()) / CASE WHEN stddev_pop(l) OVER () = 0 THEN 1 ELSE stddev_pop(l) OVER () END, 6) AS log_z,
        round((i - avg(i) OVER ()) / CASE WHEN stddev_pop(i) OVER () = 0 THEN 1 ELSE stddev_pop(i) OVER () END, 6) AS integer_z FROM v""")
def _(t: Tables):
    out = X.numeric_features(t.events, "value", "event_id")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("value_z", "log_z", "integer_z")])


@query("cache_key", """
    SELECT event_id, md5('GET:https://api.example.com/' || event_type || ':{"k": "' || json_extract_string(props, '$.k') || '", "user": "'
        || user_id || '"}:') AS cache_key FROM events""")
def _(t: Tables):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    url = F.concat(F.lit("https://api.example.com/"), "event_type")
    return t.events.select("event_id", C.cache_key(F.lit("GET"), url, params).alias("cache_key"))


@query("resolve_href", """
    WITH l AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '<a href="([^"]*)"', 1), [url])) AS href FROM pages)
    SELECT page_id, href, CASE WHEN starts_with(href, '/') THEN array_to_string(string_split(url, '/')[1:3], '/') || href ELSE href END AS target FROM l""")
def _(t: Tables):
    hrefs = F.concat(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.array("url"))
    return t.pages.select("page_id", "url", F.explode(hrefs).alias("href")).select("page_id", "href", C.resolve_href("url", "href").alias("target"))


@query("duration_seconds", """
    SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id""")
def _(t: Tables):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", C.duration_seconds("a", "b").alias("seconds"))
