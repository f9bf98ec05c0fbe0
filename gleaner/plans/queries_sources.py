"""Sources and sinks, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import slug_url
from gleaner.plans.registry import Tables, query
from gleaner.sources import files as S
from gleaner.sources import sinks as K
from gleaner.sources import tables as B
from gleaner.streaming.streams import stream_folder

_PART = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"


@query("scan_csv", "SELECT p_partkey, p_name || ' é' AS p_name, p_brand, p_size, p_retailprice FROM part")
def _(t: Tables):
    # One folder, four delimiters and two encodings: each file is read in its own dialect.
    folder = stream_folder(t.spark)
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name"), "p_brand", "p_size", "p_retailprice")
    for i, (sep, encoding) in enumerate([(",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8"), ("|", "ISO-8859-1")]):
        part = rows.where(F.col("p_partkey") % 4 == i)
        part.write.mode("append").option("header", True).option("sep", sep).option("encoding", encoding).csv(folder)
    return S.read_csv(t.spark, folder, schema=_PART, pattern="*.csv")


@query("csv_bad_lines", """
    SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 7 > 1""")
def _(t: Tables):
    # Lines with surplus fields are skipped, also behind empty ones; a cell that is no number is null and its row stays.
    folder = stream_folder(t.spark)
    nation = F.when(F.col("s_nationkey") < 20, F.col("s_nationkey").cast("string")).otherwise("not a number")
    kind = F.col("s_suppkey") % 7
    surplus = F.when(kind == 0, F.lit("one more")).when(kind == 1, F.lit(',,,"",bad')).when(kind == 2, F.lit(',,,""'))
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), nation, surplus)
    # Lines as they are, a header in each file.
    t.supplier.select(line.alias("s_suppkey,s_nationkey")).write.option("header", True).option("sep", "\x01").option("quote", "").csv(folder)
    return S.read_csv(t.spark, folder, schema="s_suppkey bigint, s_nationkey int", pattern="*.csv")


@query("csv_dialect", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ';' WHEN 'MACHINERY' THEN chr(9) WHEN 'FURNITURE' THEN '|' ELSE ',' END AS delimiter,
        CASE WHEN c_nationkey < 12 THEN 'utf-8' ELSE 'latin1' END AS encoding FROM customer""")
def _(t: Tables):
    # One file head per customer; a tie goes to the comma, a lone Latin-1 byte is no UTF-8.
    mark = F.col("c_mktsegment")
    d = F.when(mark == "BUILDING", ";").when(mark == "MACHINERY", "\t").when(mark == "FURNITURE", "|").when(mark == "HOUSEHOLD", ",;").otherwise("")
    head = F.concat(F.lit("key"), d, F.lit("name"), d, F.lit("note\n1"), d, F.lit("café"), d)
    content = F.when(F.col("c_nationkey") < 12, F.encode(head, "UTF-8")).otherwise(F.encode(head, "ISO-8859-1"))
    return t.customer.select("c_custkey", S.sniff_delimiter(F.decode(content, "ISO-8859-1")).alias("delimiter"), S.sniff_encoding(content).alias("encoding"))


@query("scan_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    t.views("nation")
    return B.read_table(t.spark, "nation")[0]


@query("list_tables", "SELECT unnest(['customer', 'nation', 'orders', 'region']) AS name")
def _(t: Tables):
    wanted = ("customer", "nation", "orders", "region")
    t.views(*wanted)
    t.spark.range(1).createOrReplaceTempView("sqlite_sequence")
    return B.list_tables(t.spark).filter(F.col("name").isin(*wanted) | F.col("name").startswith("sqlite_"))


@query("table_schema", """
    SELECT ordinal_position - 1 AS position, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'INTEGER' WHEN data_type = 'DOUBLE' THEN 'REAL'
        WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'TEXT' END AS type, true AS nullable, column_name = 'o_orderkey' AS pk
    FROM information_schema.columns WHERE table_name = 'orders'""")
def _(t: Tables):
    return B.table_schema(t.orders, "o_orderkey")


@query("scan_pages", "SELECT html, count(*) AS n FROM pages GROUP BY html")
def _(t: Tables):
    folder = stream_folder(t.spark)
    # Landed pages: one file each, rows of one page together. The files of a task share a folder, which is listed and put in place as a whole.
    pages = t.pages.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("html")), "\x00").alias("html"))
    rows = pages.select("html", F.spark_partition_id().alias("task"))
    rows.write.partitionBy("task").option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(folder)
    landed = S.read_pages(t.spark, f"{folder}/*", "*.txt")
    return landed.select(F.rtrim(F.replace("html", F.lit("\x00"), F.lit(""))).alias("html")).groupBy("html").agg(F.count("*").alias("n"))


@query("route_inputs", """
    WITH s AS (SELECT page_id, trim(CASE WHEN page_id % 3 = 1 THEN '  ' WHEN page_id % 3 = 2 THEN 'docs/' || page_id || '.pdf ' ELSE ' ' || url END) AS source FROM pages)
    SELECT source, 'first' AS mode, 'url' AS kind FROM s WHERE source <> '' UNION ALL SELECT source, 'row', CASE WHEN starts_with(source, 'http') THEN 'url' ELSE 'pdf' END FROM s WHERE source <> ''""")
def _(t: Tables):
    k = F.col("page_id")
    line = F.when(k % 3 == 1, "  ").when(k % 3 == 2, F.concat(F.lit("docs/"), k.cast("string"), F.lit(".pdf "))).otherwise(F.concat(F.lit(" "), "url"))
    lines = t.pages.select("page_id", line.alias("line"))
    first = S.route_inputs(lines, "line", "page_id").select("source", F.lit("first").alias("mode"), "kind")
    return first.unionAll(S.route_inputs(lines, "line", "page_id", per_row=True).select("source", F.lit("row").alias("mode"), "kind"))


@query("scan_files", """
    SELECT 'nation=' || n_nationkey AS folder, NULL::VARCHAR AS error, length(n_name)::BIGINT AS size FROM nation WHERE n_nationkey <> 3
    UNION ALL SELECT 'nation=3', 'unreadable', NULL""")
def _(t: Tables):
    folder = stream_folder(t.spark)
    t.nation.select(F.col("n_nationkey").alias("nation"), "n_name").repartition("nation").write.partitionBy("nation").text(folder)

    def size(path: str, content: bytes) -> str:
        if "nation=3/" in path:
            raise ValueError("unreadable")
        return str(len(content.strip()))

    found = S.map_files(t.spark, f"{folder}/*", "*.txt", size)
    return found.select(F.regexp_extract("path", r"(nation=\d+)/", 1).alias("folder"), "error", F.col("result").cast("bigint").alias("size"))


@query("document_pages_assemble", """
    SELECT conv_id, count(*) AS page_count, sum(length(text))::BIGINT AS char_count, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    return S.assemble_pages(t.conversations, "conv_id", "turn", "text")


@query("page_numbers", """
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number, text AS content, length(text) AS char_count FROM conversations""")
def _(t: Tables):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", number.alias("page_number"), F.col("text").alias("content"), F.length("text").alias("char_count"))


# -- sinks ------------------------------------------------------------------------------------------


@query("sink_json", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    folder = stream_folder(t.spark)
    K.write_json(t.events.select("event_id", "event_type", "value"), folder)
    return t.spark.read.schema("event_id bigint, event_type string, value double").json(folder)


@query("sink_csv", "SELECT event_id::VARCHAR AS event_id, event_type, props, '[\"' || event_type || '\"]' AS tags FROM events")
def _(t: Tables):
    folder = stream_folder(t.spark)
    K.write_csv(t.events.select("event_id", "event_type", "props", F.array("event_type").alias("tags")), folder)
    K.write_csv(t.events.limit(0), f"{folder}-empty")
    return t.spark.read.option("header", True).option("escape", '"').csv(folder)


def _table_name(t: Tables, stem: str) -> str:
    return f"gleaner_{stem}_{stream_folder(t.spark).rsplit('/', 1)[1]}"


def _external(t: Tables, name: str, df) -> None:
    """An empty table next to the checkpoints, so that no warehouse folder is needed."""
    df.limit(0).write.option("path", f"{stream_folder(t.spark)}").saveAsTable(name)


@query("sink_table", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    name = _table_name(t, "rows")
    rows = t.nation.select("n_nationkey", "n_name")
    _external(t, name, rows)
    K.write_table(rows, name)
    return t.spark.table(name)


@query("sink_table_modes", """
    SELECT 'append' AS mode, 2 * count(*) AS rows FROM region UNION ALL SELECT 'replace', count(*) FROM region UNION ALL SELECT 'fail', -1""")
def _(t: Tables):
    folder = stream_folder(t.spark)
    name = _table_name(t, "modes")
    rows = t.region.select("r_regionkey", "r_name")
    rows.write.option("path", folder).saveAsTable(name)
    K.write_table(rows, name, "append")
    appended = t.spark.table(name).count()
    replaced = K.write_table(rows, name, "replace")
    try:
        failed = K.write_table(rows, name, "fail")
    except Exception:  # the mode promises this
        failed = -1
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame([("append", appended), ("replace", replaced), ("fail", failed)], "mode string, rows bigint")


@query("export_query", "SELECT c_mktsegment, count(*)::VARCHAR AS n FROM customer WHERE c_nationkey < 10 GROUP BY 1")
def _(t: Tables):
    t.views("customer")
    folder = stream_folder(t.spark)
    K.export_query(t.spark, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey < :top GROUP BY 1", folder, {"top": 10})
    return t.spark.read.option("header", True).csv(folder)


@query("create_table_like", """
    SELECT 'o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL, o_orderdate TIMESTAMP, o_orderpriority TEXT' AS columns, 0 AS rows""")
def _(t: Tables):
    name = _table_name(t, "like")
    ddl = B.create_table_like(t.orders, name, "o_orderkey")
    rows = t.spark.table(name).count()
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.createDataFrame([(ddl.split("(", 1)[1].rstrip(")"), rows)], "columns string, rows bigint")


@query("run_sql_script", """
    SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(t: Tables):
    t.views("nation", "region")
    return B.run_script(t.spark, """
        CREATE OR REPLACE TEMP VIEW named AS SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey;
        ;
        SELECT r_name, count(*) AS nations FROM named GROUP BY r_name;
    """)


@query("save_results", "SELECT 'json' AS fmt, user_id, count(*) AS events FROM events GROUP BY user_id UNION ALL SELECT 'csv', user_id, count(*) FROM events GROUP BY user_id UNION ALL SELECT 'xlsx', -1, -1")
def _(t: Tables):
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("events"))
    out = None
    for fmt in ("json", "csv"):
        folder = stream_folder(t.spark)
        K.save_results(rows, folder, fmt)
        back = t.spark.read.schema("user_id bigint, events bigint").option("header", True).format(fmt).load(folder)
        part = back.select(F.lit(fmt).alias("fmt"), "user_id", "events")
        out = part if out is None else out.unionAll(part)
    try:
        K.save_results(rows, stream_folder(t.spark), "xlsx")
        return out
    except ValueError:  # an unknown format is an error
        return out.unionAll(t.spark.range(1).select(F.lit("xlsx"), F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint")))


@query("output_layout", "SELECT page_id, substring(replace(replace(replace(url, '://', '_'), '/', '_'), ':', '_'), 1, 100) AS slug FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", slug_url("url").alias("slug"))


@query("sink_distinct_emails", """
    SELECT DISTINCT lower(c_mktsegment) || c_nationkey || '@example.com' AS email FROM customer UNION SELECT DISTINCT 's' || s_nationkey || '@example.com' FROM supplier""")
def _(t: Tables):
    folder = stream_folder(t.spark)
    a = t.customer.select(F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("@example.com")).alias("email"))
    b = t.supplier.select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), F.lit("@example.com")).alias("email"))
    K.write_distinct_emails(folder, a, b)
    return t.spark.read.text(folder).withColumnRenamed("value", "email")
