"""Similarity and fuzzy de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.similarity import similarity
from gleaner.operators import dedup as D
from gleaner.plans.registry import Tables, query


def lcs_sql(a: str, b: str) -> str:
    """LCS length of two string columns: one table row per character of ``a``, carried as a list."""
    return f"""list_last(list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)], list_transform(range(1, length({a}) + 1), lambda z: [z])),
        lambda prev, cur: list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length({b}) + 1), lambda z: [z])),
            lambda row, j: list_append(row, CASE WHEN {a}[cur[1]] = {b}[j[1]] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], row[j[1]]) END))))"""


def _pairs_sql(values: str, threshold: float) -> str:
    """``a, b, va, vb, similarity`` of distinct values ``id, v`` with a < b; edit distance rules most pairs out without loss."""
    return f"""vals AS MATERIALIZED ({values}),
    cand AS (SELECT x.id AS a, y.id AS b, x.v AS va, y.v AS vb FROM vals x JOIN vals y ON x.id < y.id
        WHERE levenshtein(x.v, y.v) <= (1 - {threshold}) * (length(x.v) + length(y.v)) + 1e-9),
    scored AS (SELECT *, 2.0::DOUBLE * {lcs_sql("va", "vb")} / (length(va) + length(vb)) AS similarity FROM cand),
    pairs AS MATERIALIZED (SELECT * FROM scored WHERE similarity >= {threshold} - 1e-12)"""


def _greedy_sql(values: str, threshold: float) -> str:
    """Adds ``kept`` (ids a greedy pass in id order keeps) and ``member`` (id, leader)."""
    return f"""{_pairs_sql(values, threshold)},
    numbered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM vals),
    before AS MATERIALIZED (SELECT b AS id, list(a) AS earlier FROM pairs GROUP BY b),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ids UNION ALL
        SELECT w.n + 1, CASE WHEN len(list_intersect(w.ids, coalesce(e.earlier, []))) = 0 THEN list_append(w.ids, x.id) ELSE w.ids END
        FROM walk w JOIN numbered x ON x.n = w.n + 1 LEFT JOIN before e ON e.id = x.id),
    kept AS (SELECT unnest(ids) AS id FROM walk WHERE n = (SELECT count(*) FROM vals)),
    member AS (SELECT b AS id, min(a) AS leader FROM pairs WHERE a IN (SELECT id FROM kept) AND b NOT IN (SELECT id FROM kept) GROUP BY b)"""


@query("similarity_score", f"""
    SELECT p_partkey, round(2.0::DOUBLE * {lcs_sql("a", "b")} / (length(a) + length(b)), 9) AS score FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type || ' ' || p_brand) AS b FROM part)""")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(similarity("p_name", F.concat_ws(" ", "p_type", "p_brand")), 9).alias("score"))


_NAMES = "SELECT min(p_partkey) AS id, lower(p_name) AS v FROM part GROUP BY 2"
_COPIES = "copies AS (SELECT lower(p_name) AS v, count(*) AS n FROM part GROUP BY 1)"


def _pair_rows(threshold: float) -> str:
    return f"""WITH {_pairs_sql(_NAMES, threshold)}, {_COPIES}
    SELECT least(va, vb) AS value_a, greatest(va, vb) AS value_b, round(similarity, 9) AS similarity, x.n AS copies_a, y.n AS copies_b
    FROM pairs JOIN copies x ON x.v = least(va, vb) JOIN copies y ON y.v = greatest(va, vb) UNION ALL SELECT v, v, 1.0, n, n FROM copies WHERE n > 1"""


for _name, _t in (("similar_pairs", 0.8), ("similarity_self_join", 0.9), ("similar_pairs_loose", 0.6)):
    @query(_name, _pair_rows(_t))
    def _(t: Tables, threshold=_t):
        return D.similar_pairs(t.part, "p_partkey", "p_name", threshold).withColumn("similarity", F.round("similarity", 9))


@query("fuzzy_dedup_list", f"""WITH RECURSIVE {_greedy_sql(_NAMES, 0.8)} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT id FROM kept)""")
def _(t: Tables):
    return D.fuzzy_dedup(t.part, "p_partkey", ["p_name"], 0.8).select("p_partkey", "p_name")


_ROWS = "SELECT min(p_partkey) AS id, lower(p_name || ' ' || p_type) AS v FROM part GROUP BY 2"
_LAST = "SELECT max(p_partkey) AS id, lower(p_name || ' ' || p_type) AS v FROM part GROUP BY 2"
_SINGLE = "SELECT min(p_partkey) AS id FROM part GROUP BY lower(p_name || ' ' || p_type) HAVING count(*) = 1"
_ROW = "p_partkey, p_name, p_type"


@query("fuzzy_dedup_rows_first", f"""WITH RECURSIVE {_greedy_sql(_ROWS, 0.85)} SELECT {_ROW} FROM part WHERE p_partkey IN (SELECT id FROM kept)""")
def _(t: Tables):
    return D.fuzzy_dedup(t.part, "p_partkey", ["p_name", "p_type"], 0.85).select("p_partkey", "p_name", "p_type")


@query("fuzzy_dedup_rows_last", f"""WITH {_pairs_sql(_LAST, 0.85)} SELECT {_ROW} FROM part WHERE p_partkey IN (SELECT id FROM vals) AND p_partkey NOT IN (SELECT a FROM pairs)""")
def _(t: Tables):
    return D.fuzzy_dedup(t.part, "p_partkey", ["p_name", "p_type"], 0.85, keep="last").select("p_partkey", "p_name", "p_type")


# Supplier names are distinct, so leaders without members exist.
_SUPPLIERS = "SELECT s_suppkey AS id, lower(s_name || ' ' || s_nationkey) AS v FROM supplier"


@query("fuzzy_dedup_rows_none", f"""WITH RECURSIVE {_greedy_sql(_SUPPLIERS, 0.95)} SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT id FROM kept) AND s_suppkey NOT IN (SELECT leader FROM member)""")
def _(t: Tables):
    return D.fuzzy_dedup(t.supplier, "s_suppkey", ["s_name", "s_nationkey"], 0.95, keep="none").select("s_suppkey", "s_name")


@query("similar_value_groups", f"""
    WITH RECURSIVE names AS (SELECT DISTINCT p_name AS o FROM part), keyed AS (SELECT row_number() OVER (ORDER BY o) AS id, o AS v FROM names),
    {_greedy_sql("SELECT id, v FROM keyed", 0.745).replace("similarity >= 0.745 - 1e-12", "round_even(similarity * 100, 0) >= 75")}
    SELECT l.v AS canonical, m.v AS member FROM member JOIN keyed l ON l.id = leader JOIN keyed m ON m.id = member.id""")
def _(t: Tables):
    return D.similar_value_groups(t.part, "p_name", 75)


@query("near_dup_candidates")
def _(t: Tables):
    return D.near_duplicate_texts(t.documents, "doc_id", "text", 0.9)
