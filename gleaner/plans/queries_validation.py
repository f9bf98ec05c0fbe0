"""Schema and quality rules, and whole extract-validate-load runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gleaner.functions import text as C
from gleaner.operators import quality as Q
from gleaner.operators import shaping as S
from gleaner.plans.etl import Etl, stats
from gleaner.plans.registry import Tables, query
from gleaner.sources.tables import key_is_unique

# -- schema -----------------------------------------------------------------------------------------

_RECORD = """SELECT p_partkey, '{"id": ' || CASE WHEN p_size < 5 THEN '"' || p_partkey || '"' ELSE p_partkey::VARCHAR END || CASE WHEN p_size BETWEEN 5 AND 9 THEN '' ELSE ', "name": "' || p_name || '"' END
    || ', "price": ' || CASE WHEN p_size BETWEEN 10 AND 14 THEN 'null' WHEN p_size BETWEEN 15 AND 19 THEN '12' ELSE '12.5' END || ', "in_stock": ' || CASE WHEN p_size > 40 THEN '1' ELSE 'true' END || '}' AS body, p_size FROM part"""


def _records(t: Tables):
    """Schemaless records whose faults depend on the size of the part."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    body = F.concat(
        F.lit('{"id": '), F.when(size < 5, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(key),
        F.when(size.between(5, 9), "").otherwise(F.concat(F.lit(', "name": "'), "p_name", F.lit('"'))),
        F.lit(', "price": '), F.when(size.between(10, 14), "null").when(size.between(15, 19), "12").otherwise("12.5"),
        F.lit(', "in_stock": '), F.when(size > 40, "1").otherwise("true"), F.lit("}"))
    return t.part.select("p_partkey", Q.json_fields(body).alias("record"), body.alias("body"))


_SCHEMA = Q.Schema(("id", "name", "price"), {"id": "bigint", "name": "string", "price": "double", "in_stock": "boolean"})


@query("require_fields", f"""
    WITH r AS ({_RECORD}) SELECT p_partkey, list_contains(json_keys(body), 'name') AND list_contains(json_keys(body), 'id') AND list_contains(json_keys(body), 'price') AS complete FROM r""")
def _(t: Tables):
    errors = Q.json_schema_errors("record", Q.Schema(_SCHEMA.required))
    return _records(t).select("p_partkey", (F.size(errors) == 0).alias("complete"))


@query("check_types", f"""
    WITH r AS ({_RECORD}) SELECT p_partkey, concat_ws(', ', CASE WHEN json_type(body, '$.id') NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 'id' END,
        CASE WHEN json_type(body, '$.name') <> 'VARCHAR' THEN 'name' END, CASE WHEN json_type(body, '$.price') <> 'DOUBLE' THEN 'price' END,
        CASE WHEN json_type(body, '$.in_stock') <> 'BOOLEAN' THEN 'in_stock' END) AS wrong FROM r""")
def _(t: Tables):
    errors = Q.json_schema_errors("record", Q.Schema(types=_SCHEMA.types))
    return _records(t).select("p_partkey", F.array_join(F.transform(errors, lambda e: e["field"]), ", ").alias("wrong"))


@query("check_types_frame", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'o_totalprice' ELSE '' END || CASE WHEN o_orderstatus = 'P' THEN ', ' ELSE '' END || 'o_custkey, missing' AS wrong FROM orders""")
def _(t: Tables):
    schema = Q.Schema(("missing",), {"o_totalprice": "double", "o_orderkey": "bigint", "o_custkey": "string", "absent": "string"})
    df = t.orders.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    checked = Q.check(df, schema=schema)
    fields = F.array_sort(F.transform(Q.ERRORS, lambda e: e["field"]))
    order = F.filter(F.array(*[F.when(F.array_contains(fields, f), F.lit(f)) for f in ("o_totalprice", "o_custkey", "missing")]), lambda f: f.isNotNull())
    return checked.select("o_orderkey", F.array_join(order, ", ").alias("wrong"))


# -- quality ----------------------------------------------------------------------------------------

RULES = (
    Q.Rule("p_name", lambda c: F.length(F.trim(c)) > 9, "Name is too short"),
    Q.Rule("p_retailprice", lambda c: c >= 905, "Price is too low"),
    Q.Rule("p_size", lambda c: c >= 2, "Size is too small"),
    Q.Rule("p_name", lambda c: c.rlike(r"\A[A-Za-z0-9 ]*\z"), "Name has special characters"),
    Q.Rule("absent", lambda c: c > 0, "never tested"),
)


def _parts(t: Tables):
    return t.part.withColumn("p_name", F.when(F.col("p_type") == "SMALL", F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))


_PARTS = """parts AS (SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_name || '!' ELSE p_name END AS p_name, p_retailprice, p_size FROM part),
    checked AS (SELECT *, list_filter([CASE WHEN NOT length(trim(p_name)) > 9 THEN 'p_name: Name is too short' END, CASE WHEN NOT p_retailprice >= 905 THEN 'p_retailprice: Price is too low' END,
        CASE WHEN NOT p_size >= 2 THEN 'p_size: Size is too small' END, CASE WHEN NOT regexp_full_match(p_name, '[A-Za-z0-9 ]*') THEN 'p_name: Name has special characters' END],
        lambda e: e IS NOT NULL) AS errors FROM parts)"""


def _messages(errors):
    return F.array_join(F.transform(errors, lambda e: F.concat_ws(": ", e["field"], e["message"])), "; ")


@query("quality_rules", f"WITH {_PARTS} SELECT p_partkey, array_to_string(errors, '; ') AS errors FROM checked")
def _(t: Tables):
    return Q.check(_parts(t), RULES).select("p_partkey", _messages(F.col(Q.ERRORS)).alias("errors"))


@query("quality_rule_udf", "SELECT p_partkey, p_name = reverse(p_name) OR length(p_name) % 2 = 0 AS passed FROM part")
def _(t: Tables):
    # A rule written in Python: same place, Arrow batches.
    @F.pandas_udf("boolean")
    def even_or_mirrored(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v == v[::-1] or len(v) % 2 == 0)

    checked = Q.check(t.part, [Q.Rule("p_name", even_or_mirrored, "odd")])
    return checked.select("p_partkey", (F.size(Q.ERRORS) == 0).alias("passed"))


@query("split_valid_invalid", f"""WITH {_PARTS}
    SELECT p_partkey, 'valid' AS part, '' AS errors FROM checked WHERE len(errors) = 0 UNION ALL SELECT p_partkey, 'invalid', array_to_string(errors, '; ') FROM checked WHERE len(errors) > 0""")
def _(t: Tables):
    checked = Q.check(_parts(t), RULES)
    good = Q.valid_rows(checked).select("p_partkey", F.lit("valid").alias("part"), F.lit("").alias("errors"))
    bad = Q.invalid_rows(checked).select("p_partkey", F.lit("invalid").alias("part"), _messages(F.col(Q.ERRORS)).alias("errors"))
    return good.unionAll(bad)


@query("product_rules_demo", """
    SELECT p_partkey, p_name <> '' AND p_retailprice >= 1 AND p_size / 10.0 >= 2 AND p_type <> 'SMALL' AS ok FROM (SELECT *, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_name END AS p_name FROM (SELECT p_partkey, p_name, p_retailprice, p_size, p_type, p_brand FROM part) x) y""".replace(
        "SELECT *, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_name END AS p_name", "SELECT p_partkey, p_retailprice, p_size, p_type, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_name END AS p_name"))
def _(t: Tables):
    name = F.when(F.col("p_brand") == "Brand#1", "").when(F.col("p_type") == "SMALL", F.concat("p_name", F.lit("@"))).otherwise(F.col("p_name"))
    rows = t.part.select("p_partkey", name.alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") / 10).alias("rating"))
    rules = [
        Q.Rule("name", lambda c: F.trim(c) != "", "Name cannot be empty"),
        Q.Rule("price", lambda c: c >= 1, "Price must be at least 1"),
        Q.Rule("rating", lambda c: c >= 2, "Rating must be at least 2"),
        Q.Rule("name", lambda c: c.rlike(r"\A[\p{L}\p{N} ]*\z"), "Name has special characters"),
    ]
    return Q.check(rows, rules).select("p_partkey", (F.size(Q.ERRORS) == 0).alias("ok"))


@query("row_error_capture", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 100.0 / (json_extract_string(props, '$.k')::INT + 1) END::DOUBLE AS result,
        CASE WHEN event_type = 'error' THEN 'no number: error' END AS error FROM events""")
def _(t: Tables):
    def share(item: str) -> float:
        if item == "error":
            raise ValueError(f"no number: {item}")
        return 100.0 / (int(item) + 1)

    item = F.when(F.col("event_type") == "error", "error").otherwise(F.get_json_object("props", "$.k"))
    return Q.capture_errors(t.events.select("event_id", item.alias("item")), "item", share, "double").select("event_id", "result", "error")


@query("key_uniqueness", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys, count(*) = count(DISTINCT o_custkey) AS is_unique FROM orders")
def _(t: Tables):
    return key_is_unique(t.orders, "o_custkey")


# -- whole runs -------------------------------------------------------------------------------------

_SHOP_SCHEMA = Q.Schema(("id", "name", "price", "in_stock"), {"id": "bigint", "name": "string", "price": "double", "in_stock": "boolean"})


def _shop(t: Tables, load=None, quarantine=None) -> Etl:
    """Scraped products: a price that is no number or a missing name makes a row invalid."""
    price = F.when(F.col("p_type") == "SMALL", "Not a price").otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")))
    raw = t.part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), price.alias("price"),
                        F.when(F.col("p_size") > 25, "In Stock").otherwise("Out of Stock").alias("in_stock"))
    return Etl(
        extract=lambda: raw,
        transforms=[
            lambda df: S.rename_fields(df, {"product_id": "id"}),
            lambda df: S.apply_transformations(df, {"id": lambda c: c.try_cast("bigint"), "price": C.parse_money,
                                                    "in_stock": lambda c: C.parse_bool_word(c, "in stock")}),
        ],
        schema=_SHOP_SCHEMA,
        rules=[Q.Rule("name", lambda c: F.length(c) > 8, "Name is too short")],
        load=load, quarantine=quarantine,
    )


_SHOP = "p_type <> 'SMALL' AND length(p_name) > 8"


@query("etl_stats", f"""
    SELECT count(*) AS records_processed, count(*) FILTER ({_SHOP}) AS records_valid, count(*) FILTER (NOT ({_SHOP})) AS records_invalid FROM part""")
def _(t: Tables):
    return stats(_shop(t).plan())


@query("etl_run", f"""
    SELECT p_partkey AS id, p_name AS name, p_retailprice::DECIMAL(18, 2)::DOUBLE AS price, p_size > 25 AS in_stock FROM part WHERE {_SHOP}""")
def _(t: Tables):
    from gleaner.streaming.streams import stream_folder

    folder = stream_folder(t.spark)
    done = _shop(t, load=lambda df: df.write.mode("overwrite").parquet(f"{folder}/loaded")).run()
    if not done.success:
        raise RuntimeError(done.error_message)
    return t.spark.read.parquet(f"{folder}/loaded")


@query("etl_dry_run", f"""
    SELECT count(*) AS processed, count(*) FILTER ({_SHOP}) AS valid, count(*) FILTER (NOT ({_SHOP})) AS invalid, 0 AS loaded, true AS success FROM part""")
def _(t: Tables):
    def never(_df):
        raise AssertionError("a dry run loads nothing")

    done = _shop(t, load=never, quarantine=never).dry_run()
    row = (done.records_processed, done.records_valid, done.records_invalid, done.records_loaded, done.success)
    return t.spark.createDataFrame([row], "processed bigint, valid bigint, invalid bigint, loaded bigint, success boolean")


@query("quarantine_sink", f"""
    SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'price: expected double' ELSE 'name: Name is too short' END AS errors FROM part WHERE NOT ({_SHOP})""")
def _(t: Tables):
    from gleaner.sources.sinks import write_quarantine
    from gleaner.streaming.streams import stream_folder

    folder = stream_folder(t.spark)
    write_quarantine(_shop(t).plan(), folder)
    shape = "id bigint, validation_errors array<struct<field:string,message:string>>"
    return t.spark.read.schema(shape).json(folder).select("id", _messages(F.col("validation_errors")).alias("errors"))
