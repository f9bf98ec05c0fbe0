"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.llm import html_extract, warc
from gleaner.llm.common import bounded_batches, shared_folder, table
from gleaner.llm.registry import query


@query("op2_warc", """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages
    ), f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE bytes >= 100 GROUP BY digest)
    SELECT page_id, bytes AS payload_bytes, p.digest AS payload_digest,
           CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f ON p.digest = f.digest AND p.bytes >= 100
""")
def op2_warc(spark, folder):
    bounded_batches(spark)
    path = shared_folder(spark, "archive")
    warc.write_archive(table(spark, folder, "pages").select("page_id", "url", "html"), path)
    read = warc.read_archive(spark, path)
    # Lengths and digests of responses are those of the payloads read back; revisits have theirs in the header.
    return read.select(
        F.col("source_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@query("op9_html")
def op9_html(spark, folder):
    bounded_batches(spark)
    pages = table(spark, folder, "pages").select("page_id", "url", html_extract.main_text(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
