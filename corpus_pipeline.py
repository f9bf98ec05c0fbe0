"""From raw documents to token ids: each stage works on what the one before it kept.

Every stage but the last returns the columns of ``documents``. The output of each is written as Parquet to the shared folder and
read again, so a lost executor costs no more than the tasks of one stage.

Results for odd input: null and empty texts have no language and go in the first stage; texts of any length are worked on whole; of repeated rows one
stays; rows with a null or repeated id are told apart by their texts; ties go to the smaller id, then the smaller digest of the text; an empty table
gives no rows; columns beyond those of ``documents`` are carried along by the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, langid, near_copies, queries_text, substring
from gleaner.llm.common import bounded_batches, set_apart, set_back, stored, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that the identifier, trained on a sample of the labelled rows, rejects."""
    bounded_batches(spark)
    model = langid.train(docs)
    return langid.only_accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id: components over links by SimHash and by a
    similarity of five-word shingles of 0.8 or more together."""
    bounded_batches(spark)
    return near_copies.one_of_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur more than once; a text that loses nothing stays as it is."""
    bounded_batches(spark)
    own = docs.columns
    docs, old, _ = set_apart(docs, ("n_words", "n_removed", "kept"))
    left = substring.cut(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = left.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return set_back(changed.drop("n_words", "n_removed", "kept"), old).select(*[F.col(f"`{c}`") for c in own])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests."""
    bounded_batches(spark)
    return queries_text.bpe_digests(docs, queries_text.VOCABULARY)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("benchmarks", drop_contaminated),
    ("tokens", encode),
]

#: Hashes of shingles, a trained model and a vocabulary are beyond SQL; the tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
