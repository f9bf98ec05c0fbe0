"""Projections, filters, paging, set operations, and the SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as C
from gleaner.operators import dedup as D
from gleaner.operators import shaping as S
from gleaner.plans.registry import Tables, query
from gleaner.sources import json_api as J
from gleaner.sources.tables import query as run_sql

# -- projections ------------------------------------------------------------------------------------


@query("rename_fields", "SELECT p_partkey, p_brand AS p_name, p_type, p_size AS size, p_retailprice FROM part")
def _(t: Tables):
    return S.rename_fields(t.part, {"p_brand": "p_name", "absent": "p_type", "p_size": "size"})


@query("apply_transformations", """
    SELECT p_partkey, p_retailprice::DECIMAL(18, 2)::DOUBLE AS price, p_name AS title, p_size > 25 AS in_stock FROM part""")
def _(t: Tables):
    shown = t.part.select("p_partkey", F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("price"),
                          F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("title"), F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("in_stock"))
    return S.apply_transformations(shown, {"price": C.parse_money, "title": F.trim, "in_stock": C.parse_bool_word, "absent": F.upper})


_CONDITIONS = [("==", "c_mktsegment", "BUILDING"), ("!=", "segment", "BUILDING"), (">", "c_acctbal", 5000.0), ("<", "c_nationkey", 5),
               (">=", "c_acctbal", 9000.0), ("<=", "c_nationkey", 2), ("~", "c_name", "x"), ("==", "absent", "x")]


@query("filter_op", """
    WITH s AS (SELECT *, CASE WHEN c_nationkey < 20 THEN c_mktsegment END AS segment FROM customer)
    SELECT '==' AS op, 'c_mktsegment' AS field, c_custkey FROM s WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT '!=', 'segment', c_custkey FROM s WHERE segment IS DISTINCT FROM 'BUILDING'
    UNION ALL SELECT '>', 'c_acctbal', c_custkey FROM s WHERE c_acctbal > 5000 UNION ALL SELECT '<', 'c_nationkey', c_custkey FROM s WHERE c_nationkey < 5
    UNION ALL SELECT '>=', 'c_acctbal', c_custkey FROM s WHERE c_acctbal >= 9000 UNION ALL SELECT '<=', 'c_nationkey', c_custkey FROM s WHERE c_nationkey <= 2
    UNION ALL SELECT '~', 'c_name', c_custkey FROM s""")
def _(t: Tables):
    # "!=" keeps rows without a segment, an unknown operator keeps all, an unknown field keeps none.
    df = t.customer.withColumn("segment", F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")))
    parts = [S.filter_rows(df, c, v, op).select(F.lit(op).alias("op"), F.lit(c).alias("field"), "c_custkey") for op, c, v in _CONDITIONS]
    return S.union_all(*parts)


@query("filter_contains", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[13]7$')")
def _(t: Tables):
    return S.filter_rows(t.customer, "c_name", "[13]7$", "contains").select("c_custkey", "c_name")


def _nested(t: Tables):
    """Orders as an API would return them."""
    user = F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("code")).alias("state"))
    return t.orders.select(F.col("o_orderkey").alias("id"), user.alias("user"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.col("o_totalprice").alias("total"))


@query("project_fields", "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS user_state_code FROM orders")
def _(t: Tables):
    return J.project(_nested(t), ["id", "user.id", "user.state.code", "user.absent", "likes"])


@query("flatten_struct", """
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS user_state_code, '["' || o_orderpriority || '","' || o_orderstatus || '"]' AS tags, o_totalprice AS total FROM orders""")
def _(t: Tables):
    return J.flatten(_nested(t))


_ITEM = "struct<id:bigint,user:struct<id:bigint,state:struct<code:string>>,tags:array<string>,total:double>"


def _responses(t: Tables):
    """One response body per order."""
    item = F.struct("id", "user", "tags", "total")
    return _nested(t).select(F.col("user.id").alias("customer"), F.to_json(F.struct(F.array(item).alias("data"))).alias("body"))


@query("flatten_response", """
    SELECT o_custkey AS customer, o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS user_state_code, '["' || o_orderpriority || '","' || o_orderstatus || '"]' AS tags, o_totalprice AS total FROM orders""")
def _(t: Tables):
    return J.flatten(J.explode_items(_responses(t), "body", "data", _ITEM, ["customer"]))


@query("nested_passthrough", "SELECT o_custkey AS customer, o_orderkey AS id, o_orderstatus AS code, o_orderpriority AS first_tag FROM orders")
def _(t: Tables):
    rows = J.explode_items(_responses(t), "body", "data", _ITEM, ["customer"])
    return rows.select("customer", "id", F.col("user.state.code").alias("code"), F.col("tags")[0].alias("first_tag"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t: Tables):
    wrapped = F.concat(F.lit('{"items": ['), "props", F.lit('], "n": 1}'))
    return J.explode_items(t.events.withColumn("doc", wrapped), "doc", "items", "struct<k:bigint>", ["event_id"])


@query("json_path", """
    SELECT event_id, 'name' AS path, 'Item ' || user_id AS value FROM events UNION ALL SELECT event_id, 'name', 'Item ' || event_type FROM events
    UNION ALL SELECT event_id, 'meta', event_type FROM events""")
def _(t: Tables):
    doc = F.concat(F.lit('{"items": [{"name": "Item '), F.col("user_id").cast("string"), F.lit('"}, {"name": "Item '), "event_type",
                   F.lit('"}], "data": {"meta": "'), "event_type", F.lit('"}}'))
    docs = t.events.select("event_id", doc.alias("doc"))
    names = docs.select("event_id", F.lit("name").alias("path"), F.explode(J.json_path("doc", "items[*].name")).alias("value"))
    return names.unionAll(docs.select("event_id", F.lit("meta").alias("path"), F.explode(J.json_path("doc", "data.meta")).alias("value")))


# -- filters and searches ---------------------------------------------------------------------------


@query("time_range_filter", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-12' ORDER BY ts DESC, event_id LIMIT 200""")
def _(t: Tables):
    span = S.time_range(t.events, "ts", "2024-01-10", "2024-01-12")
    return S.newest(span, "ts", 200, "event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("time_filter_state", """
    SELECT 'upcoming' AS state, count(*) AS n FROM events WHERE ts > '2024-01-15' UNION ALL SELECT 'past', count(*) FROM events WHERE ts <= '2024-01-15'
    UNION ALL SELECT 'all', count(*) FROM events""")
def _(t: Tables):
    return S.union_all(*[S.time_state(t.events, "ts", "2024-01-15", s).agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
                         for s in ("upcoming", "past", "all")])


@query("keyword_search", """
    SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_brand = 'Brand#4' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 1""")
def _(t: Tables):
    hits = S.keyword_search(t.part, "RING", ["p_name", "p_type"], {"p_brand": "Brand#4", "p_size": None})
    return hits.orderBy("p_name", "p_partkey").offset(1).limit(20).select("p_partkey", "p_name", "p_brand")


@query("any_column_search", """
    SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_nationkey, c_mktsegment)), '7 build')""")
def _(t: Tables):
    return S.any_column_search(t.customer.drop("c_acctbal"), "7 BUILD").select("c_custkey", "c_name")


@query("filter_by_job", "SELECT event_id, value FROM events WHERE user_id = 7")
def _(t: Tables):
    return S.equals_or_all(t.events.withColumn("job", F.col("user_id").cast("string")), "job", "7").select("event_id", "value")


@query("filter_by_status", "SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def _(t: Tables):
    return S.equals_or_all(t.events, "event_type", "error").select("event_id", "event_type")


@query("filter_by_type", "SELECT doc_id, lang FROM documents")
def _(t: Tables):
    return S.equals_or_all(t.documents, "lang", "all").select("doc_id", "lang")


@query("skip_empty_documents", """
    SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE text END AS body, CASE WHEN lang = 'es' THEN 'No text content found' END AS error FROM documents""")
def _(t: Tables):
    lang = F.col("lang")
    docs = t.documents.select("doc_id", F.when(lang == "es", "").when(lang == "fr", F.lit(None)).otherwise(F.col("text")).alias("text"),
                              F.when(lang == "fr", F.col("text")).when(lang == "es", "").alias("content"))
    return S.skip_empty(docs, "doc_id", "text", "content")


# -- exact de-duplication, sorts and pages ----------------------------------------------------------


@query("dedup_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def _(t: Tables):
    return D.dedup_keep(t.part.select("p_partkey", "p_name"), ["p_name"], "p_partkey")


for _keep, _sql in (("first", "row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1"),
                    ("last", "row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) = 1"),
                    ("none", "count(*) OVER (PARTITION BY p_name, p_brand) = 1")):
    @query(f"dedup_subset_{_keep}", f"SELECT p_partkey, p_name, p_brand, p_size FROM part QUALIFY {_sql}")
    def _(t: Tables, keep=_keep):
        return D.dedup_keep(t.part.select("p_partkey", "p_name", "p_brand", "p_size"), ["p_name", "p_brand"], "p_partkey", keep)


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(t: Tables):
    return D.dedup_keep(t.documents.select("doc_id", "text"), ["text"], "doc_id")


@query("sort_ci_name", "SELECT p_name, p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 50")
def _(t: Tables):
    mixed = t.part.select(F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("shown"), "p_name", "p_partkey")
    return mixed.orderBy(F.lower("shown"), "p_partkey").limit(50).select("p_name", "p_partkey")


@query("head_n", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def _(t: Tables):
    return t.part.orderBy("p_partkey").limit(5)


@query("page_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250 OFFSET 100")
def _(t: Tables):
    return S.page_slice(t.orders, [F.desc("o_totalprice"), "o_orderkey"], start=100, count=500, max_results=250).select("o_orderkey", "o_totalprice")


@query("paged_collect", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 60")
def _(t: Tables):
    return S.paged_collect(t.orders, ["o_orderkey"], page_size=20, max_results=100, max_pages=2).select("o_orderkey")


@query("results_newest_first", """
    SELECT event_id, created_at FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created_at FROM events)
    ORDER BY coalesce(created_at, '') DESC, event_id LIMIT 100""")
def _(t: Tables):
    created = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select("event_id", created.alias("created_at")).orderBy(F.coalesce("created_at", F.lit("")).desc(), "event_id").limit(100)


# -- set operations and joins -----------------------------------------------------------------------


@query("union_chunks", """
    SELECT event_id, value, NULL::VARCHAR AS note FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, NULL, props FROM events WHERE event_type = 'click'""")
def _(t: Tables):
    views = t.events.filter("event_type = 'view'").select("event_id", "value")
    clicks = t.events.filter("event_type = 'click'").select("event_id", F.col("props").alias("note"))
    return S.union_all(views, clicks)


@query("compare_results", """
    WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS left_value, b.n AS right_value,
        CASE WHEN b.user_id IS NULL THEN 'only_left' WHEN a.user_id IS NULL THEN 'only_right' WHEN a.n = b.n THEN 'same' ELSE 'different' END AS status
    FROM a FULL JOIN b ON a.user_id = b.user_id""")
def _(t: Tables):
    per = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))
    return S.compare_results(per("view"), per("error"), "user_id", "n")


@query("result_job_lookup", """
    SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) c ON c_custkey = o_custkey""")
def _(t: Tables):
    jobs = t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(jobs, "o_custkey", "left")


# -- SQL surface ------------------------------------------------------------------------------------


def _same(name: str, sql: str, *tables: str, **params):
    """The statement runs unchanged on both sides."""
    literal = sql
    for key, value in params.items():
        literal = literal.replace(f":{key}", repr(value))

    @query(name, literal)
    def _(t: Tables):
        t.views(*tables)
        return run_sql(t.spark, sql, params)


_same("sql_inner_join_agg", """
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment HAVING count(*) > 10""", "orders", "customer")

_same("sql_left_semi_anti", """
    SELECT c.c_custkey, count(o.o_orderkey) AS orders, EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey) AS has_supplier
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
    WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c.c_custkey AND x.o_totalprice > 450000)
    GROUP BY c.c_custkey, c.c_nationkey""", "orders", "customer", "supplier")

_same("sql_rollup_cube", """
    SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    UNION ALL SELECT l_returnflag, l_linestatus, 2, 2, count(*) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    UNION ALL SELECT l_returnflag, l_linestatus, 3, 3, count(*) FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""", "lineitem")

_same("sql_windows", """
    SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
        lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous,
        round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders""", "orders")

_same("sql_set_ops", """
    (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
    (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION (SELECT n_nationkey FROM nation)""", "customer", "supplier", "orders", "nation")

_same("sql_params", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice >= :low ORDER BY o_orderkey LIMIT 5""", "orders", status="F", low=100000.0)

_same("sql_distinct_topk", """
    SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem ORDER BY l_suppkey DESC, l_returnflag LIMIT 25""", "lineitem")

_same("scan_sql_query", """
    SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM nation JOIN customer ON n_nationkey = c_nationkey
    WHERE c_mktsegment = :segment GROUP BY n_name""", "nation", "customer", segment="BUILDING")


@query("sql_range_join", """
    SELECT a.event_id AS purchase, count(*) AS views FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts
    WHERE a.event_type = 'purchase' AND b.event_type = 'view' GROUP BY 1""")
def _(t: Tables):
    # The interval becomes an equi-join on six-hour slots: a row meets its own slot and the one before.
    width = 6 * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    a = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", at.alias("t"))
    b = t.events.filter("event_type = 'view'").select("user_id", at.alias("u"), F.floor(at / width).alias("slot"))
    slots = a.withColumn("slot", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) - 1)))
    near = slots.join(b, ["user_id", "slot"]).filter((F.col("u") <= F.col("t")) & (F.col("u") >= F.col("t") - width))
    return near.groupBy("purchase").agg(F.count("*").alias("views"))
