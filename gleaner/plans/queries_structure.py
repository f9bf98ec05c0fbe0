"""Sections, headings and tables inside texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import structure as S
from gleaner.plans.registry import Tables, query
from gleaner.session import spread

# The documents have few headings and only pipe tables, so each customer gets a report with the others.
_REPORT = (
    ("Preface of ", "c_name"),
    (".\n\nINTRODUCTION\nHello ", "c_mktsegment"),
    (".\n\n## Account ", "c_nationkey"),
    ("\nBalance due\n\nsee below:\n####### no heading\n3.1 Terms\nPay ", "c_name"),
    ("\n  second line  \n\n\nA short title\n \nbody, of\n# EMPTY\n# Last one\nend ", "c_mktsegment"),
    ("\n", None),
)
_LEDGER = (
    ("text before\n\n| name | value |\n|---|:---:|\n| key | ", "c_name"),
    (" |\n\n| segment | ", "c_mktsegment"),
    (" |\nafter the table\nid\tname\tnation\n1\t", "c_name"),
    ("\t", "c_nationkey"),
    ("\nno tabs here\n\nItem    Amount    Note\ntool    12.50     new ", "c_mktsegment"),
    ("\nbolt    7.500     -\n   \nnut     1\nThe end\n----+----\na | b | ", "c_name"),
    ("", None),
)


def _written(parts):
    out = []
    for text, column in parts:
        out.append(F.lit(text))
        if column:
            out.append(F.col(column).cast("string"))
    return F.concat(*out)


def _written_sql(parts) -> str:
    out = []
    for text, column in parts:
        quoted = text.replace("'", "''")
        pieces = quoted.split("\n")
        lines = " || chr(10) || ".join(" || chr(9) || ".join(f"'{x}'" for x in p.split("\t")) for p in pieces)
        out.append(lines)
        if column:
            out.append(f"{column}::VARCHAR")
    return " || ".join(out)


def _texts(t: Tables, parts):
    # Customers may be a few files; cutting up their texts costs far more than reading them.
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return docs.unionAll(spread(t.customer).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), _written(parts).alias("text")))


def _texts_sql(parts) -> str:
    return f"SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || c_custkey, {_written_sql(parts)} FROM customer"


_LINES = """ln AS (SELECT id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS i, len(l) - 1 AS last FROM (SELECT id, string_split(text, chr(10)) AS l FROM src))"""
_UPPER = "(regexp_matches(line, '[A-ZÀ-ÖØ-Þ]') AND NOT regexp_matches(line, '[a-zß-öø-ÿ]') AND length(line) < 100)"
_HEADED = f"""src AS ({_texts_sql(_REPORT)}), {_LINES},
    nx AS (SELECT *, lead(raw) OVER (PARTITION BY id ORDER BY i) AS following, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM ln),
    lv AS (SELECT *, CASE WHEN {_UPPER} THEN 1 WHEN regexp_matches(line, '^#{{1,6}}\\s+') THEN length(regexp_extract(line, '^(#+)', 1))
        WHEN regexp_matches(line, '^[0-9]+\\.[0-9]*\\s+[A-Z]') THEN 2
        WHEN length(line) < 80 AND i < last AND trim(following) = '' AND regexp_matches(line, '^[A-ZÀ-ÖØ-Þ]') AND NOT regexp_matches(line, '[.,:;?!]$') THEN 3
        ELSE 0 END AS level FROM nx WHERE line <> ''),
    hd AS (SELECT id, i, level, CASE WHEN level > 0 AND NOT {_UPPER} THEN regexp_replace(line, '^#{{1,6}}\\s+', '') ELSE line END AS line,
        sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS section FROM lv)"""


@query("document_headings", f"WITH {_HEADED} SELECT id, i AS line_no, line AS title, level::BIGINT AS level FROM hd WHERE level > 0")
def _(t: Tables):
    return S.headings(_texts(t, _REPORT), "id", "text")


@query("document_sections", f"""WITH {_HEADED}
    SELECT id, section::BIGINT AS section_no, coalesce(max(CASE WHEN level > 0 THEN line END), '') AS title, max(level)::BIGINT AS level,
        max(CASE WHEN level > 0 THEN i END)::BIGINT AS start_line, max(i)::BIGINT AS end_line,
        string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY i) AS content
    FROM hd GROUP BY id, section HAVING count(CASE WHEN level = 0 THEN 1 END) > 0""")
def _(t: Tables):
    return S.sections(_texts(t, _REPORT), "id", "text")


@query("document_structure_summary", f"""WITH {_HEADED},
    s AS (SELECT id, section, max(level) AS level, max(CASE WHEN level = 0 THEN 1 ELSE 0 END) AS body FROM hd GROUP BY id, section),
    g AS (SELECT id, count(*) FILTER (level > 0) AS headings, sum(body)::BIGINT AS total_sections, max(level) AS max_level,
        count(DISTINCT level) FILTER (level > 0) > 1 AS has_hierarchy FROM s GROUP BY id)
    SELECT src.id, coalesce(headings, 0) AS headings, coalesce(total_sections, 0) AS total_sections, coalesce(max_level, 0)::BIGINT AS max_heading_level,
        coalesce(has_hierarchy, false) AS has_hierarchy FROM src LEFT JOIN g ON g.id = src.id""")
def _(t: Tables):
    return S.structure_summary(_texts(t, _REPORT), "id", "text")


_ISLANDS = f"""src AS ({_texts_sql(_LEDGER)}), {_LINES},
    cl AS (SELECT *, length(raw) - length(replace(raw, '|', '')) AS pipes, length(raw) - length(replace(raw, chr(9), '')) AS tabs,
        regexp_full_match(raw, '[\\s\\-+|]+') AS ruler, regexp_matches(raw, '\\s{{2,}}\\S') AND regexp_matches(raw, '\\S\\s{{2,}}') AS aligned,
        regexp_full_match(raw, '\\s*') AS blank FROM ln),
    op AS (SELECT *, ruler OR pipes > 1 OR tabs > 1 OR aligned AS opens, CASE WHEN pipes > 1 THEN 'pipe' WHEN tabs > 1 THEN 'tab' ELSE 'aligned' END AS fmt FROM cl),
    st AS (SELECT *, sum(CASE WHEN opens OR blank THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS stretch FROM op),
    s2 AS (SELECT *, min(CASE WHEN opens THEN i END) OVER (PARTITION BY id, stretch) AS start FROM st WHERE opens OR blank),
    s3 AS (SELECT *, count(*) FILTER (NOT blank) OVER (PARTITION BY id, stretch) AS filled,
        max(CASE WHEN i = start THEN fmt END) OVER (PARTITION BY id, stretch) AS format FROM s2 WHERE i >= start),
    tl AS (SELECT id, dense_rank() OVER (PARTITION BY id ORDER BY start) - 1 AS table_no, i, raw, format, blank FROM s3 WHERE filled >= 2)"""


@query("text_table_islands", f"""WITH {_ISLANDS}
    SELECT id, table_no, format, min(i) AS start_line, max(i) AS end_line, count(*) FILTER (NOT blank) AS n_lines FROM tl GROUP BY ALL""")
def _(t: Tables):
    return S.table_islands(_texts(t, _LEDGER), "id", "text")


@query("text_table_cells", f"""WITH {_ISLANDS},
    nl AS (SELECT *, row_number() OVER (PARTITION BY id, table_no ORDER BY i) AS n,
        format = 'pipe' AND regexp_full_match(raw, '\\s*\\|[\\s\\-+:]+\\|\\s*') AS rule FROM tl WHERE NOT blank AND format <> 'aligned'),
    md AS (SELECT *, max(CASE WHEN n = 2 AND rule THEN 1 ELSE 0 END) OVER (PARTITION BY id, table_no) = 1 AS markdown FROM nl),
    ce AS (SELECT id, table_no, n, format, list_transform(CASE WHEN format = 'pipe' THEN string_split(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '|') ELSE string_split(raw, chr(9)) END,
        lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')) AS c FROM md WHERE n = 1 OR NOT (markdown AND rule)),
    c1 AS (SELECT *, CASE WHEN format = 'pipe' AND c[1] = '' THEN c[2:] ELSE c END AS h FROM ce),
    c2 AS (SELECT *, CASE WHEN format = 'pipe' AND len(h) > 0 AND h[-1] = '' THEN h[1:len(h) - 1] ELSE h END AS k FROM c1),
    rn AS (SELECT *, row_number() OVER (PARTITION BY id, table_no ORDER BY n) - 1 AS row_no FROM c2 WHERE n = 1 OR len(k) > 0),
    ok AS (SELECT *, max(row_no) OVER (PARTITION BY id, table_no) AS top FROM rn)
    SELECT id, table_no, row_no, generate_subscripts(k, 1) - 1 AS col_no, unnest(k) AS cell FROM ok WHERE top > 0""")
def _(t: Tables):
    return S.split_table_cells(_texts(t, _LEDGER), "id", "text")


_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("text_table_cells_aligned", f"""WITH {_ISLANDS},
    al AS (SELECT id, table_no, list(raw ORDER BY i) AS l FROM tl WHERE NOT blank AND format = 'aligned' GROUP BY ALL),
    gp AS (SELECT *, list_transform(l[1:5], lambda r: list_filter(range(length(r)), lambda p: regexp_full_match(substr(r, p + 1, 2), '\\s\\s')
        AND (p = 0 OR NOT regexp_full_match(substr(r, p, 1), '\\s')))) AS g FROM al),
    br AS (SELECT id, table_no, l, list_reduce(list_concat([[]::BIGINT[]], g), lambda acc, f: CASE WHEN len(acc) > 0
        THEN list_filter(acc, lambda b: list_contains(f, b) OR list_contains(f, b - 1) OR list_contains(f, b + 1)) ELSE f END) AS b FROM gp),
    rw AS (SELECT id, table_no, b, list_concat([0::BIGINT], b) AS e, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS n FROM br WHERE len(b) > 0 AND len(l) > 1),
    wi AS (SELECT *, CASE WHEN n = 0 THEN len(b) ELSE len(list_filter(b, lambda x: x < length(raw))) END AS k, unnest(range(len(b) + 1)) AS j FROM rw)
    SELECT id, table_no, n AS row_no, j AS col_no, CASE WHEN j = len(b) THEN {_STRIPPED.format("substr(raw, e[k + 1] + 1)")}
        WHEN j < k THEN {_STRIPPED.format("substr(raw, e[j + 1] + 1, e[j + 2] - e[j + 1])")} ELSE '' END AS cell FROM wi""")
def _(t: Tables):
    return S.aligned_table_cells(_texts(t, _LEDGER), "id", "text")
