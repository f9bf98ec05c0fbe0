"""Profiles, type inference, cleaning of tables, and learning from matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import patterns as P
from gleaner.operators import profile as R
from gleaner.plans.queries_extract import matches_sql, _D, _union
from gleaner.plans.queries_text import messy_dates, _MESSY_DATE
from gleaner.plans.registry import Tables, query


def _cells_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM {table}" for c in columns)


@query("table_info", """
    SELECT (SELECT count(*) FROM lineitem) AS rows, 3 AS columns, 'l_suppkey, l_returnflag, l_linestatus' AS column_names,
        (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem)) AS duplicates""")
def _(t: Tables):
    return R.table_info(t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus"))


def _gappy(t: Tables):
    """Orders with missing cells: no customer for open orders, no price below 50,000, no status for priority 5."""
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("o_orderstatus"),
    )


_GAPPY = """gappy AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS o_custkey, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS o_orderstatus FROM orders)"""


@query("missing_count", f"""WITH {_GAPPY}
    SELECT count(*) AS rows, 4 AS columns, (count(*) * 4 - count(o_orderkey) - count(o_custkey) - count(o_totalprice) - count(o_orderstatus))::BIGINT AS missing_cells FROM gappy""")
def _(t: Tables):
    return R.missing_counts(_gappy(t))


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count("*").alias("rows"))


_PROFILED = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "contact", "site"]


def _profiled(t: Tables):
    contact = F.when(F.col("c_nationkey") < 20, F.concat(F.lit("k"), F.col("c_custkey").cast("string"), F.lit("@example.com"))).otherwise("n/a")
    site = F.when(F.col("c_nationkey") > 10, F.lit("www.example.org/shop"))
    return t.customer.withColumns({"contact": contact, "site": site})


_PROFILED_SQL = """pc AS (SELECT *, CASE WHEN c_nationkey < 20 THEN 'k' || c_custkey || '@example.com' ELSE 'n/a' END AS contact,
    CASE WHEN c_nationkey > 10 THEN 'www.example.org/shop' END AS site FROM customer)"""
_KINDS = [p.name for p in P.DEFAULT.select()]
_PROFILE_CELLS = " UNION ALL ".join(f"SELECT '{c}:' || c_custkey AS id, coalesce({c}::VARCHAR, 'nan') AS x FROM pc" for c in _PROFILED)


def _type_sql(v: str = "value", group: str = "column_name") -> str:
    present = f"{v} IS NOT NULL AND lower({v}) NOT IN ('nan', 'null', 'none', '')"
    numeric = f"{present} AND regexp_full_match({v}, '-?[0-9]+(\\.[0-9]+)?')"
    return f"""CASE WHEN count(*) FILTER ({present}) = 0 THEN 'unknown'
        WHEN count(*) FILTER ({numeric}) / count(*) FILTER ({present}) > 0.9 AND count(*) FILTER ({numeric} AND contains({v}, '.')) = 0 THEN 'integer'
        WHEN count(*) FILTER ({numeric}) / count(*) FILTER ({present}) > 0.9 THEN 'float'
        WHEN count(*) FILTER ({present} AND regexp_full_match(regexp_replace({v}, '[/\\-\\s,.]', '', 'g'), '[0-9]{{6,8}}')) / count(*) FILTER ({present}) > 0.8 THEN 'date'
        WHEN count(*) FILTER ({present} AND lower({v}) NOT IN ('true', 'false', 'yes', 'no', '1', '0', 't', 'f', 'y', 'n')) = 0 THEN 'boolean' ELSE 'string' END"""


@query("column_profile", f"""WITH {_PROFILED_SQL}, cells AS ({_PROFILE_CELLS}),
    usable AS (SELECT * FROM cells WHERE lower(x) NOT IN ('nan', 'null', 'none', '')),
    found AS ({_union(_KINDS, "(SELECT * FROM usable)", "id")}),
    per AS (SELECT split_part(id, ':', 1) AS col, pattern, count(DISTINCT id) AS n FROM found GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, list_position({_KINDS!r}, pattern)) AS r FROM per),
    base AS (SELECT split_part(id, ':', 1) AS col, count(*) FILTER (x <> '') AS filled, {_type_sql("x")} AS inferred_type FROM cells GROUP BY 1)
    SELECT base.col AS "column", CASE WHEN n / filled >= 0.75 THEN pattern END AS primary_pattern, CASE WHEN n / filled >= 0.75 THEN n / filled ELSE 0.0 END::DOUBLE AS pattern_confidence,
        inferred_type, {", ".join(f"coalesce((SELECT sum(n) FROM per WHERE per.col = base.col AND pattern = '{k}'), 0)::BIGINT AS {k}_values" for k in _KINDS)}
    FROM base LEFT JOIN ranked ON ranked.col = base.col AND r = 1""")
def _(t: Tables):
    return R.column_profile(_profiled(t), columns=_PROFILED)


@query("column_sample_values", """
    WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)
    SELECT 'c_name' AS "column", string_agg(c_name, ' | ' ORDER BY c_custkey) AS sample_values FROM f
    UNION ALL SELECT 'c_nationkey', string_agg(c_nationkey::VARCHAR, ' | ' ORDER BY c_custkey) FROM f
    UNION ALL SELECT 'c_mktsegment', string_agg(c_mktsegment, ' | ' ORDER BY c_custkey) FROM f""")
def _(t: Tables):
    return R.first_values(t.customer, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


_TYPED = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "placed", "paid", "nothing"]


@query("infer_column_type", f"""
    WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS placed, CASE o_orderstatus WHEN 'O' THEN 'no' WHEN 'F' THEN 'Yes' END AS paid, CASE WHEN o_custkey >= 0 THEN 'None' END AS nothing FROM orders)
    SELECT column_name AS "column", {_type_sql()} AS inferred_type FROM ({_cells_sql("o", _TYPED)}) GROUP BY column_name""")
def _(t: Tables):
    paid = F.when(F.col("o_orderstatus") == "O", "no").when(F.col("o_orderstatus") == "F", "Yes")
    df = t.orders.withColumns({"placed": F.date_format("o_orderdate", "yyyy-MM-dd"), "paid": paid, "nothing": F.when(F.col("o_custkey") >= 0, "None")})
    return R.infer_types(df, _TYPED)


# -- cleaning recipe --------------------------------------------------------------------------------


@query("clean_column_names", """
    SELECT p_partkey AS part_key, p_name AS name, p_brand AS name_2, p_size AS size_cm FROM part""")
def _(t: Tables):
    return R.clean_column_names(t.part.select(F.col("p_partkey").alias(" Part-Key"), F.col("p_name").alias("Name"),
                                              F.col("p_brand").alias("name "), F.col("p_size").alias("Size (cm)")))


@query("drop_duplicate_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_shipdate::DATE AS shipped FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("shipped")).dropDuplicates()


@query("drop_sparse_rows", f"""WITH {_GAPPY}
    SELECT * FROM gappy WHERE (o_custkey IS NOT NULL)::INT + (o_totalprice IS NOT NULL)::INT + (o_orderstatus IS NOT NULL)::INT + 1 >= 3""")
def _(t: Tables):
    return R.drop_sparse_rows(_gappy(t))


@query("fill_numeric_mean", f"""WITH {_GAPPY}
    SELECT o_orderkey, round(coalesce(o_custkey, avg(o_custkey) OVER ()), 6) AS o_custkey, round(coalesce(o_totalprice, avg(o_totalprice) OVER ()), 6) AS o_totalprice, o_orderstatus FROM gappy""")
def _(t: Tables):
    # Keys of 17 digits and more have no gaps and keep every digit.
    wide = _gappy(t).withColumn("o_orderkey", F.col("o_orderkey") + F.lit(9007199254740993))
    out = R.fill_mean(wide)
    return out.select((F.col("o_orderkey") - F.lit(9007199254740993)).alias("o_orderkey"), F.round("o_custkey", 6).alias("o_custkey"), F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderstatus")


@query("fill_string_empty", f"WITH {_GAPPY} SELECT o_orderkey, o_custkey, o_totalprice, coalesce(o_orderstatus, '') AS o_orderstatus FROM gappy")
def _(t: Tables):
    return R.fill_empty(_gappy(t))


@query("fill_numeric_median", f"""WITH {_GAPPY}
    SELECT o_orderkey, o_custkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM gappy)), 6) AS o_totalprice, o_orderstatus FROM gappy""")
def _(t: Tables):
    out = R.fill_median(_gappy(t), ["o_totalprice"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("cleaning_recipe", """
    WITH g AS (SELECT DISTINCT CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS customer, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS total_price,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders),
    k AS (SELECT * FROM g WHERE (customer IS NOT NULL)::INT + (total_price IS NOT NULL)::INT + (status IS NOT NULL)::INT + 1 >= 3)
    SELECT round(coalesce(customer, avg(customer) OVER ()), 6) AS customer, round(coalesce(total_price, avg(total_price) OVER ()), 6) AS total_price,
        coalesce(status, '') AS status, priority FROM k""")
def _(t: Tables):
    raw = _gappy(t).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    named = raw.select(F.col("o_custkey").alias("Customer"), F.col("o_totalprice").alias("Total Price"), F.col("o_orderstatus").alias("STATUS"),
                       F.col("o_orderpriority").alias("priority "))
    out = R.cleaning_recipe(named)
    return out.withColumns({c: F.round(c, 6) for c in ("customer", "total_price")})


@query("random_sample")
def _(t: Tables):
    return R.random_sample(t.orders, 100, seed=7, key="o_orderkey")


# -- learning from matches --------------------------------------------------------------------------


@query("phone_length_histogram", f"""
    WITH h AS ({matches_sql("phone")}), u AS (SELECT DISTINCT match FROM h), g AS (SELECT count(*) AS n FROM u)
    SELECT length(regexp_replace(match, '[^0-9]', '', 'g')) AS digits, count(*) AS numbers FROM u
    WHERE (SELECT count(*) FROM h) >= 10 AND (SELECT n FROM g) >= 5
    GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT n FROM g) AND digits >= 7""")
def _(t: Tables):
    return R.phone_lengths(P.recognize(t.documents, "doc_id", "text", [P.DEFAULT.patterns["phone"]]), "match")


@query("email_domain_whitelist", f"""
    WITH h AS ({matches_sql("email")}), u AS (SELECT DISTINCT match FROM h), g AS (SELECT count(*) AS n FROM u)
    SELECT lower(split_part(match, '@', 2)) AS domain, count(*) AS emails FROM u WHERE (SELECT count(*) FROM h) >= 10 AND (SELECT n FROM g) >= 5
    GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT n FROM g)""")
def _(t: Tables):
    return R.domain_whitelist(P.recognize(t.documents, "doc_id", "text", [P.DEFAULT.patterns["email"]]), "match")


@query("date_format_histogram", f"""
    WITH h AS (SELECT {_MESSY_DATE} AS d FROM orders), u AS (SELECT DISTINCT d FROM h),
    l AS (SELECT CASE WHEN regexp_matches(d, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}') THEN 'MM/DD/YYYY' WHEN regexp_matches(d, '^[0-9]{{1,2}}\\.[0-9]{{1,2}}\\.[0-9]{{2,4}}') THEN 'MM.DD.YYYY'
        WHEN regexp_matches(d, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 'YYYY-MM-DD' END AS layout FROM u)
    SELECT layout, count(*) AS dates FROM l WHERE layout IS NOT NULL GROUP BY layout HAVING count(*) >= 0.2 * (SELECT count(*) FROM u) ORDER BY dates DESC, layout LIMIT 1""")
def _(t: Tables):
    return R.date_formats(t.orders.select(messy_dates().alias("d")), "d")


@query("char_characteristics", """
    SELECT ch AS "char", count(*) / (SELECT count(*) FROM part)::DOUBLE AS share FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ''))) AS ch FROM part)
    GROUP BY ch HAVING count(*) > 1""")
def _(t: Tables):
    return R.character_shares(t.part, "p_name")


def _common_sql(source: str) -> str:
    """``source`` has ``v, o``."""
    return f"""WITH s AS ({source}), m AS (SELECT min(length(v)) AS n, arg_min(v, o) AS sample FROM s),
    c AS (SELECT unnest(string_split(v, '')) AS ch, generate_subscripts(string_split(v, ''), 1) AS i FROM s),
    f AS (SELECT i, bool_and(regexp_matches(ch, '[0-9]')) AS digit, bool_and(regexp_matches(ch, '[A-Z]')) AS up, bool_and(regexp_matches(ch, '[a-z]')) AS low,
        bool_and(regexp_matches(ch, '[A-Za-z]')) AS letter, bool_and(ch IN ('@', '.', '_', '-', '+')) AS mark FROM c WHERE i <= (SELECT n FROM m) GROUP BY i)
    SELECT string_agg(CASE WHEN digit THEN '\\d' WHEN up THEN '[A-Z]' WHEN low THEN '[a-z]' WHEN letter THEN '[A-Za-z]' WHEN mark THEN
        CASE WHEN (SELECT sample FROM m)[i] IN ('@', '_') THEN (SELECT sample FROM m)[i] ELSE '\\' || (SELECT sample FROM m)[i] END ELSE '.' END, '' ORDER BY i) AS regex FROM f"""


@query("positional_pattern", _common_sql("SELECT (c_custkey + 100) || '.' || c_mktsegment || '@x' AS v, c_custkey AS o FROM customer"))
def _(t: Tables):
    v = F.concat((F.col("c_custkey") + 100).cast("string"), F.lit("."), "c_mktsegment", F.lit("@x"))
    return R.common_regex(t.customer.select(v.alias("v"), F.col("c_custkey").alias("o")), "v", "o")


@query("learn_pattern", """
    WITH h AS (SELECT p_partkey, match, min(i) AS ord FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS match, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY ALL),
    w AS (SELECT match FROM h WHERE ends_with(match, 't')),
    bad AS (SELECT ch FROM (SELECT unnest(list_distinct(string_split(match, ''))) AS ch FROM w) GROUP BY ch HAVING count(*) > 1 AND count(*) / (SELECT count(*) FROM w) > 0.5),
    kept AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM bad WHERE contains(match, ch)))
    SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY ord) - 1 AS ord, match FROM kept""")
def _(t: Tables):
    registry = P.Registry({}).add(P.Pattern("word", (r"\b[a-z]+\b",)))
    wrong = P.recognize(t.part, "p_partkey", "p_name", registry.select()).filter(F.col("match").endswith("t"))
    # One row per character of an alphabet comes to the driver.
    bad = [r["char"] for r in R.character_shares(wrong, "match").filter("share > 0.5").collect()]
    learnt = registry.forbid_characters("word", bad)
    return P.recognize(t.part, "p_partkey", "p_name", learnt.select()).select("p_partkey", "ord", "match")


@query("learn_missing_pattern", """
    SELECT c_custkey, 'account' AS pattern, c_name AS match FROM customer""")
def _(t: Tables):
    regex = R.common_regex(t.customer.select("c_name", "c_custkey"), "c_name", "c_custkey").first()["regex"]
    registry = P.Registry({}).add(P.Pattern("account", ("#none#",))).add_regex("account", regex)
    texts = t.customer.select("c_custkey", F.concat(F.lit("Dear "), "c_name", F.lit(", welcome")).alias("text"))
    return P.recognize(texts, "c_custkey", "text", registry.select()).select("c_custkey", "pattern", "match")
