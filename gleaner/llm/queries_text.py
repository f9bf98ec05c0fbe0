"""Queries on token ids and languages."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gleaner.llm import bpe, brown, langid, quality
from gleaner.llm.common import bounded_batches, table
from gleaner.llm.registry import query

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/word_bpe_49k.json"


def bpe_digests(docs, vocabulary: str):
    """Digests of the ids and of the text decoded from them."""
    back = bpe.round_trip(docs.select("doc_id", "text"), vocabulary)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op1_bpe")
def op1_bpe(spark, folder):
    bounded_batches(spark)
    return bpe_digests(table(spark, folder, "documents"), VOCABULARY)



def fold(key, parts: int):
    """The remainder by which rows are dealt to learning and held-out parts."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


@query("op4_langid")
def op4_langid(spark, folder):
    bounded_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op7_quality", rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
    ), r AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
            SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)))
        WHERE n > 1) GROUP BY doc_id
    ), m AS (
      SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id
    ), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT
                + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed_bits,
           NOT (base_failed OR 4 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
    FROM f
""")
def op7_quality(spark, folder):
    rows = quality.ledger(table(spark, folder, "documents").select("doc_id", "text"))
    base_failed = ~quality.passes(quality.BASE)
    return rows.select(
        "doc_id", *quality.MEASURES, base_failed.alias("base_failed"), "failed_bits",
        (quality.passes(quality.BASE) & quality.passes(quality.STRICT)).alias("kept"),
    )


@query("op8_brown")
def op8_brown(spark, folder):
    bounded_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 10) == 0
    model = brown.fit(docs.where(~held_out))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return brown.score(rows, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
