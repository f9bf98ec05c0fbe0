"""Word filters for lists too long for an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import words


def drop_listed_words(df: DataFrame, key: str, text: str, listed: DataFrame, word: str = "word") -> DataFrame:
    """``key, text`` without the words whose lowercase form is listed, in order, joined by one space."""
    tokens = df.select(F.col(key), F.posexplode(words(text)).alias("pos", "token"))
    gone = listed.select(F.col(word).alias("_listed")).distinct()
    kept = tokens.join(gone, F.lower("token") == F.col("_listed"), "left_anti")
    joined = kept.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "token")))["token"], " ").alias("kept")
    )
    return df.select(key).join(joined, key, "left").select(key, F.coalesce("kept", F.lit("")).alias(text))
