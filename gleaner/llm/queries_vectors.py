"""Queries on embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.llm import rtree
from gleaner.llm.common import table
from gleaner.llm.registry import query


@query("op11_rtree", r"""
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), p AS (
      SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    ), n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11_rtree(spark, folder):
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: _floor(x.cast("double") * 256))
    return rtree.hard_negatives(rows.select("vec_id", label.alias("label"), scaled.alias("embedding")), F.col("id") % 100 == 0)


def _floor(x):
    """Spark's floor of a double is a long; what no long may hold is a whole number already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
