"""Groups of near copies: links by SimHash and by five-word similarity together, one row of each group kept.

A document whose copy has several edits differs from it in more bits than anchors can cover, so the links of ``simhash`` (two bits) are
joined with those of ``jaccard_join`` (five words, 0.8), which finds every pair of that similarity. The nodes are the distinct shingle sets: a
fingerprint links the sets of the texts that have it. All links are put into components once, as joins; texts are neither grouped nor shuffled.

Results for odd input: texts without words are one node, as their fingerprint is zero; texts of fewer words than a shingle have the whole
sequence as their shingle; texts of any length are hashed whole; repeated rows are one group; an empty table stays empty; other columns of any type
are carried along. ``one_of_each`` keeps rows with a null key, and rows that share a key stay or go together; ``one_of_group`` keeps one row of each
group whatever its key: the smallest, null keys last.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import jaccard_join, simhash
from gleaner.llm.common import small_side, stored
from gleaner.llm.graph import components

#: The node of texts without words.
NONE = -1


def shingles(text: str | None, words: int = 5) -> Iterator[bytes]:
    """The runs of ``words`` words, A to Z in lower case."""
    own = text.encode().lower().split() if text else []
    if 0 < len(own) < words:
        return iter([b" ".join(own)])
    return map(b" ".join, zip(*(own[i:] for i in range(words))))


def similarity(a: str | None, b: str | None, words: int = 5) -> float:
    """Jaccard similarity of the sets of shingles; 0 if one has none."""
    left, right = set(shingles(a, words)), set(shingles(b, words))
    common = len(left & right)
    return common / (len(left) + len(right) - common) if common else 0.0


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that are linked by similarity, over any number of links, to one with a smaller key."""
    known = docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text))
    found = jaccard_join.join(known, key, text, words, percent).where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone"))
    gone = stored(found.distinct(), "gone")
    gone = small_side(gone, gone.count())
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def groups(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``key, own, root`` per row: the component over all links, and the digest of the text."""
    rows, sets, similar = jaccard_join.linked(docs, key, text, words, percent, fp=simhash.fingerprints(F.col(text)))
    named = rows.select("key", "own", "fp", "digest").join(sets.select("id", "digest"), "digest", "left")
    named = stored(named.select("key", "own", "fp", F.coalesce("id", F.lit(NONE).cast("long")).alias("id")), "named")
    of_print = stored(named.select("fp", "id").distinct(), "prints")
    first = stored(of_print.groupBy("fp").agg(F.min("id").alias("first")), "first")
    near = simhash.links(first.select("fp"))
    edges = of_print.join(first, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    for end in "ab":
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"set_{end}")), end)
    edges = edges.unionByName(near.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))
    edges = edges.unionByName(similar.select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = components(edges)
    return named.join(roots, named["id"] == roots["node"], "left").select("key", "own", F.coalesce("root", "id").alias("root"))


def one_of_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest key, then the smallest digest of its text."""
    rows = stored(groups(docs, key, text, words, percent).select(F.struct(F.col("key").isNull().alias("none"), "key", "own").alias("row"), "root"), "groups")
    kept = rows.groupBy("root").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1")
    of_group = stored(rows.join(kept, "root").select("root", "row", (F.col("row") == F.col("kept")).alias("stays")), "members")
    gone = stored(of_group.where("NOT stays").select("row.key", "row.own").distinct(), "gone")
    # Rows that equal the one that stays, its key and text repeated, are told apart by nothing: one of them is taken.
    repeated = stored(of_group.where("stays").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row.key", "row.own"), "repeated")
    n_repeated = repeated.count()

    def same(side: DataFrame):
        return (jaccard_join.own_digest(text) == side["own"]) & docs[key].eqNullSafe(side["key"])

    left = docs
    for side, n in ((gone, gone.count()), (repeated, n_repeated)):
        side = small_side(side, n)
        left = left.join(side, same(side), "left_anti") if n else left
    if not n_repeated:
        return left
    few = small_side(repeated, n_repeated)
    again = docs.join(few, same(few)).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), few["key"].alias("key"), few["own"].alias("own"))
    return left.unionByName(again.dropDuplicates(["key", "own"]).select("row.*"))
