"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of ``window`` words (an item of fewer words is one window), every window into
shingles of ``shingle`` words. A text that holds a window holds all its shingles, so a window needs to be looked for only
where its rarest shingle occurs: that is the necessary prefix of an exact containment join. Steps:

1. the shingles of all texts meet the set of benchmark shingles; what matches is stored with the words around it
   (one pass over the texts, which are never shuffled; it counts the words of every text too);
2. the matches are counted per shingle, and each window keeps its rarest one; a window with a shingle that occurs
   nowhere is dropped;
3. matches meet the windows by that shingle; the position bound says where the window has to begin, the length
   bound that it fits into the text, and the words themselves are compared, so the result is exact;
4. hits are gathered per document.

Results for odd input: null, empty and word-less texts have no words, hits or items; repeated rows get a result each; items
without words are no windows; items with equal ids are one item, items with a null id hit but are not counted; ties in rarity go
to the first shingle; texts of any length are read whole; an empty table of either kind gives no hits; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, ascii_lower, same_row, set_apart, set_back, small_side, split_words, stored, text_key

#: What separates words once A to Z are lower-cased, and the same before that.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return split_words(ascii_lower(F.col(text)), SEPARATORS)


def _shingled(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def benchmark_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``item, words``: the windows of all items."""
    cut = items.select(F.col(item).cast("string").alias("item"), words_of(text).alias("all_words")).withColumn("n", F.size("all_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    return cut.where("n > 0").select("item", F.explode(F.transform(starts, lambda i: F.slice("all_words", i, window))).alias("words"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """``_key, _digest, spans, items`` per text with hits: spans are (begin, words) of the window occurrences."""
    return _contamination(docs, items, key, text, item, item_text, window, shingle)[0]


def _counted_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(*text_key(key, text), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD)).cast("long").alias("n_words"))


def _contamination(docs: DataFrame, items: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text",
                   window: int = 10, shingle: int = 5, all_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """The hits, and with ``all_rows`` a row ``_key, _digest, n_words`` for every row of ``docs``, whose texts are read once for both."""
    owned = stored(benchmark_windows(items, item, item_text, window).withColumn("window", F.concat_ws(" ", "words")), "windows")
    cut = owned.select("window", "words").distinct().withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    sizes = sorted(r[0] for r in cut.select("size").distinct().collect())  # at most ``shingle`` values
    if not sizes:
        empty = docs.select(*text_key(key, text)).limit(0)
        none = empty.withColumn("spans", F.array().cast("array<struct<begin:int,size:int>>")).withColumn("items", F.array().cast("array<string>"))
        return none, _counted_words(docs, key, text)

    pieces = stored(reduce(DataFrame.unionByName, [
        cut.where(F.col("size") == s).select("window", F.size("words").alias("n"), "size", F.posexplode(_shingled("words", s)).alias("offset", "hash"))
        for s in sizes
    ]), "shingles")
    looked_for = pieces.select("size", "hash").distinct()
    n_looked_for = pieces.count()

    around = window - 1
    read = docs.select(*text_key(key, text), words_of(text).alias("all_words")).withColumn("n_words", F.size("all_words"))
    # A place of its own, before the first word, carries the count of words of each row; in a join by a shuffle it would be a hot key.
    marked = sizes[0] if all_rows and n_looked_for <= BROADCAST_ROWS else None
    found = []
    for s in sizes:
        needles = small_side(looked_for.where(F.col("size") == s).select("hash"), n_looked_for)
        if s == marked:
            places = F.concat(F.array(F.lit(None).cast("bigint")), _shingled("all_words", s))
            rows = read.select("*", F.posexplode(places).alias("_place", "hash")).withColumn("at", F.col("_place") - 1)
            rows = rows.join(F.broadcast(needles.withColumn("_known", F.lit(True))), "hash", "left").where("_known OR at < 0")
        else:
            rows = read.select("*", F.posexplode(_shingled("all_words", s)).alias("at", "hash")).join(needles, "hash")
        begin = F.greatest(F.col("at") - around, F.lit(0))
        found.append(rows.select(
            "_key", "_digest", "n_words", F.lit(s).alias("size"), "hash", "at", begin.alias("from"),
            F.when(F.col("at") >= 0, F.slice("all_words", begin + 1, 2 * around + s)).alias("near"),
        ))
    written = stored(reduce(DataFrame.unionByName, found), "matches")
    matches = written.where("at >= 0")
    counted = written.where("at < 0").select("_key", "_digest", F.col("n_words").cast("long").alias("n_words"))
    if marked is None:
        counted = _counted_words(docs, key, text)

    counts = matches.groupBy("size", "hash").count()
    chosen = (
        pieces.join(counts, ["size", "hash"], "left")
        .groupBy("window", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "size", "hash")).alias("rarest"))
        .where("rarest.count > 0").select("window", "n", "rarest.offset", "rarest.size", "rarest.hash")
    )
    chosen = stored(chosen, "prefixes")
    begin = F.col("at") - F.col("offset")
    hits = matches.join(small_side(chosen, n_looked_for), ["size", "hash"]).where(
        (begin >= 0) & (begin + F.col("n") <= F.col("n_words"))
        & (F.concat_ws(" ", F.slice("near", begin - F.col("from") + 1, F.col("n"))) == F.col("window"))
    ).select("_key", "_digest", begin.alias("begin"), F.col("n").alias("size"), "window")
    hits = stored(hits, "hits")
    spans = hits.groupBy("_key", "_digest").agg(F.sort_array(F.collect_set(F.struct("begin", "size"))).alias("spans"))
    # Many items may have one text, so owners are counted on their own.
    owners = stored(owned.select("window", "item").distinct(), "owners")
    owners = small_side(owners, owners.count())
    named = (
        hits.select("_key", "_digest", "window").distinct().join(owners, "window")
        .groupBy("_key", "_digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    b = named.select(F.col("_key").alias("_k"), F.col("_digest").alias("_d"), "items")
    return spans.join(b, spans["_key"].eqNullSafe(b["_k"]) & (spans["_digest"] == b["_d"])).drop("_k", "_d"), counted


def covered(spans: Column) -> Column:
    """How many positions sorted (begin, size) spans cover together."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc, s):
        end = s["begin"].cast("long") + s["size"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["upto"], s["begin"].cast("long")))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, begin, add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: ``key, n_words, n_hit, spans, items, contaminated``."""
    hits, rows = _contamination(docs, items, key, text, all_rows=True, **settings)
    joined = rows.join(hits, same_row(rows, hits), "left").select(rows["_key"].alias(key), "n_words", "spans", "items")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(
        key, "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array()).alias("spans"),
        F.coalesce("items", F.array()).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns."""
    docs, old, (key, text) = set_apart(docs, ("_key", "_digest"), key, text)
    hits = contamination(docs, items, key, text, **settings).select("_key", "_digest")
    tagged = docs.withColumns({"_key": F.col(key), "_digest": text_key(key, text)[1]})
    return set_back(tagged.join(hits, same_row(tagged, hits), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]), old)
