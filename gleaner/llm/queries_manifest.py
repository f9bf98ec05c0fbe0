"""Queries on the integrity of a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.llm import merkle
from gleaner.llm.common import table
from gleaner.llm.registry import query

HASHED = ("doc_id", "source", "lang", "n_chars", "text")


@query("op12_merkle", r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, text,
             list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda r, x: CASE WHEN x < 0 THEN xor(r >> 1, 3988292384 * (r & 1)) ELSE xor(r, x) END) AS crc_inverse,
             concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END,
                    CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
                    CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
                    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head
      FROM documents
    ), hashed AS (
      SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
             -- The checksum is the complement, so it is even where this is odd.
             CASE WHEN crc_inverse & 1 = 1 THEN sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END)) END AS tampered
      FROM d
    ), l AS (
      SELECT doc_id, leaf, coalesce(tampered, leaf) AS carried, dense_rank() OVER (ORDER BY coalesce('=' || source, '')) - 1 AS src,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n
      FROM hashed
    ), lower_tree AS (
      SELECT src, 0 AS lv, p, n, leaf AS h FROM l
      UNION ALL
      SELECT src, lv + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM lower_tree WHERE n > 1 GROUP BY src, lv, p // 3, n
    ), subroots AS (SELECT src, lv AS depth, h AS subroot FROM lower_tree WHERE n = 1),
    upper_tree AS (
      SELECT -1 AS src, 0 AS lv, src AS p, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
      UNION ALL
      SELECT src, lv + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM upper_tree WHERE n > 1 GROUP BY src, lv, p // 3, n
    ), nodes AS (
      SELECT src, lv, p, n, h FROM lower_tree UNION ALL SELECT src, lv, p, n, h FROM upper_tree
    ), kin AS (
      SELECT a.src, a.lv, a.p, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS after
      FROM nodes a JOIN nodes b ON a.src = b.src AND a.lv = b.lv AND a.p // 3 = b.p // 3 WHERE a.n > 1 GROUP BY a.src, a.lv, a.p
    ), climb AS (
      SELECT src AS tree, p AS place, src, 0 AS lv, p, carried AS h, '' AS proof FROM l
      UNION ALL
      SELECT c.tree, c.place, CASE WHEN s.src IS NOT NULL THEN -1 ELSE c.src END, CASE WHEN s.src IS NOT NULL THEN 0 ELSE c.lv + 1 END,
             CASE WHEN s.src IS NOT NULL THEN c.src ELSE c.p // 3 END,
             CASE WHEN s.src IS NOT NULL THEN c.h ELSE sha256(k.before || c.h || k.after) END,
             CASE WHEN s.src IS NOT NULL THEN c.proof ELSE c.proof || k.before || k.after END
      FROM climb c LEFT JOIN subroots s ON s.src = c.src AND s.depth = c.lv LEFT JOIN kin k ON k.src = c.src AND k.lv = c.lv AND k.p = c.p
      WHERE s.src IS NOT NULL OR k.p IS NOT NULL
    ), top AS (SELECT lv AS depth, h AS root FROM upper_tree WHERE n = 1)
    SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.root AS verified
    FROM l JOIN subroots s USING (src) CROSS JOIN top t JOIN climb c ON c.tree = l.src AND c.place = l.p AND c.src = -1 AND c.lv = t.depth
""")
def op12_merkle(spark, folder):
    docs = table(spark, folder, "documents").select(*HASHED)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    rows = merkle.manifest(docs, HASHED, altered=altered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")
