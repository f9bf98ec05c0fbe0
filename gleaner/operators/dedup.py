"""Exact and fuzzy de-duplication.

Exact: one aggregation per key, so copies of a hot value are combined before the shuffle.

Fuzzy: values that differ only in case are collapsed first, so copies never meet each other. Distinct
values meet only if they share one of their rarest q-grams (prefix filtering, lossless for the threshold),
and pairs are verified with the exact similarity. The greedy keep rule runs in rounds over these blocks
instead of over all pairs: a round looks at the first ``width`` open values of each block, settles those
that no earlier open value resembles, and drops what resembles them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.arrays import once
from gleaner.functions.similarity import at_least, similarity
from gleaner.functions.text import _col
from gleaner.functions.validate import MISSING_WORDS
from gleaner.session import cut_lineage


def dedup_keep(df: DataFrame, columns: Sequence[str], order: str, keep: str = "first") -> DataFrame:
    """One row per distinct value of ``columns``: ``first`` or ``last`` by ``order``, or only unique rows (``none``)."""
    row = F.struct(*df.columns)
    chosen = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    grouped = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)]).agg(
        chosen.alias("row"), F.count("*").alias("n")
    )
    if keep == "none":
        grouped = grouped.filter(F.col("n") == 1)
    return grouped.select("row.*")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# -- blocks -----------------------------------------------------------------------------------------


def gram_size(threshold: float) -> int:
    """Longest q-gram for which the prefix filter is lossless.

    A pair at the threshold is at most ``D = (1 - t)(len(a) + len(b))`` single-character insertions and
    deletions apart; for a value of length n that is at most ``2n(1 - t) / t``. Each of them destroys at
    most q of its ``n + q - 1`` padded q-grams, so ``q * 2 * (1 - t) / t`` must stay below 1.
    """
    per_char = 2 * (1 - threshold) / threshold
    return max([q for q in (3, 2) if q * per_char < 0.95], default=1)


def _grams(values: DataFrame, q: int) -> DataFrame:
    """``id, n, gram``: padded q-grams; the k-th occurrence of a gram in a value is a gram of its own."""
    pad = "\x01" * (q - 1)
    padded = once(values, chars=F.split(F.concat(F.lit(pad), F.col("value"), F.lit(pad)), ""))
    starts = F.sequence(F.lit(1), F.greatest(F.size("chars") - (q - 1), F.lit(1)))
    raw = padded.select(
        "id", F.length("value").alias("n"),
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice("chars", i, q), ""))).alias("g"),
    )
    counted = raw.groupBy("id", "n", "g").agg(F.count("*").cast("int").alias("times"))
    return counted.select("id", "n", "g", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select(
        "id", "n", F.concat("g", F.lit("\x02"), F.col("k").cast("string")).alias("gram")
    )


def block_keys(values: DataFrame, threshold: float) -> DataFrame:
    """``id, block``: similar values share at least one block. ``values`` has ``id, value`` (lowercase).

    Grams are ranked by how many values contain them; each value is listed under its rarest ones, just as
    many as the filter needs. The counts are aggregated before the shuffle and the vocabulary is joined
    back by gram, not collected.

    Grams of short values tell little apart (of numbered names, only digits differ), so their blocks would grow with the
    table. Pairs that may be two edits apart at most meet by what is left after deleting characters instead.
    """
    limit, n = min(3 / (1 - threshold) if threshold < 1 else 64.0, 64.0), F.length("value")
    shortest, longest = threshold / (2 - threshold), (2 - threshold) / threshold
    short = values.filter(n * (1 + shortest) < limit + 1e-6)
    long = values.filter(n * (1 + longest) >= limit - 1e-6)
    return _deletion_keys(short).unionByName(_gram_keys(long, threshold))


def _deletion_keys(values: DataFrame) -> DataFrame:
    """``id, block``: values at most two insertions and deletions apart share a block.

    Either one character goes from both, or one or two go from the longer one, which leave the other. Two are
    taken only from values for which there is a value two shorter, and only what is a value then is listed.
    """
    def without(value: Column, at: Column) -> Column:
        return F.concat(F.substr(value, F.lit(1), at - 1), F.substr(value, at + 1))

    n = F.length("value")
    ones = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: without(F.col("value"), i))
    near = values.select("id", F.explode(F.array_distinct(F.concat(F.array("value"), ones))).alias("block"))
    sized = values.select("id", "value", n.alias("n"))
    longer = sized.join(sized.select((F.col("n") + 2).alias("n")).distinct(), "n", "left_semi")
    one = longer.select("id", "n", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: without(F.col("value"), i))).alias("at", "rest"))
    two = one.filter(F.col("at") + 1 < F.col("n")).select("id", F.explode(F.transform(
        F.sequence(F.col("at") + 1, F.col("n") - 1), lambda j: without(F.col("rest"), j))).alias("block"))
    known = values.select(F.col("value").alias("block"))
    return near.unionByName(two.join(known, "block", "left_semi").select("id", "block").distinct())


def _gram_keys(values: DataFrame, threshold: float) -> DataFrame:
    q = gram_size(threshold)
    shape = _grams(values, q)
    weights = shape.groupBy("gram").agg(F.count("*").alias("weight"))
    distance = F.floor(2 * F.col("n") * ((1 - threshold) / threshold) + 1e-9)
    if q == 1:
        # Without an insertion a character stays: at least t * (n + m) / 2 common characters remain, and
        # the partner is at least n * t / (2 - t) long.
        keep = F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9)
        prefix = F.greatest(F.col("n") - keep + 1, F.lit(1))
    else:
        prefix = distance * q + 1
    ranked = (
        shape.join(weights, "gram").groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("weight", "gram"))).alias("grams"))
    )
    return ranked.select("id", F.explode(F.slice("grams", 1, prefix.cast("int"))).alias("g")).select(
        "id", F.col("g.gram").alias("block")
    )


def _length_compatible(a: Column, b: Column, threshold: float) -> Column:
    return 2 * F.least(a, b) >= (threshold - 1e-12) * (a + b)


def _letter_bound(a: Column, b: Column, threshold: float) -> Column:
    """Lossless test before the exact one: character counts alone already cost this many edits."""
    def signature(c: Column) -> list[Column]:
        return [F.length(c) - F.length(F.translate(c, chars, "")) for chars in ("aeiou", "tnshrdl", "0123456789", " ")]

    cost = reduce(lambda x, y: x + y, [F.abs(x - y) for x, y in zip(signature(a), signature(b))])
    total = F.length(a) + F.length(b)
    return cost <= (1 - threshold + 1e-12) * total


def _verified(pairs: DataFrame, values: DataFrame, threshold: float, rounded: bool) -> DataFrame:
    """Candidate pairs ``a, b`` (ids) that reach the threshold, with ``similarity``.

    ``rounded`` compares whole per cents, as integer scores do.
    """
    left = values.select(F.col("id").alias("a"), F.col("value").alias("value_a"))
    right = values.select(F.col("id").alias("b"), F.col("value").alias("value_b"))
    near = (
        pairs.join(left, "a").join(right, "b")
        .filter(_length_compatible(F.length("value_a"), F.length("value_b"), _floor(threshold, rounded)))
        .filter(_letter_bound(F.col("value_a"), F.col("value_b"), _floor(threshold, rounded)))
        # The exact test is the expensive step: it is spread by pair, so that neither a leader with many
        # followers nor the merging of small partitions puts it into few tasks.
        .repartition(_tasks(pairs), "a", "b")
        .withColumn("similarity", similarity("value_a", "value_b"))
    )
    score = F.rint(F.col("similarity") * 100) / 100 if rounded else F.col("similarity")
    return near.filter(at_least(score, threshold)).select("a", "b", "value_a", "value_b", "similarity")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _floor(threshold: float, rounded: bool) -> float:
    """The smallest exact similarity that can pass."""
    return threshold - 0.005 if rounded else threshold


def _collapse(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct lowercase values: ``id`` (smallest key), ``last`` (largest), ``copies``, ``value``."""
    return df.groupBy(F.lower(value).alias("value")).agg(
        F.min(key).alias("id"), F.max(key).alias("last"), F.count("*").alias("copies")
    )


# -- all similar pairs ------------------------------------------------------------------------------


def similar_pairs(df: DataFrame, key: str, value: str, threshold: float = 0.9, rounded: bool = False) -> DataFrame:
    """Pairs of distinct lowercase values that reach the threshold: ``value_a, value_b, similarity, copies_a, copies_b``.

    Each unordered pair once (``value_a < value_b``). A value with copies is similar to itself; that is a
    row with both sides equal, not one row per pair of copies.
    """
    values = cut_lineage(_collapse(df, key, value))
    blocks = cut_lineage(block_keys(values, _floor(threshold, rounded)).join(
        values.select("id", F.length("value").alias("n")), "id"))
    left = blocks.select("block", F.col("id").alias("a"), F.col("n").alias("na"))
    right = blocks.select("block", F.col("id").alias("b"), F.col("n").alias("nb"))
    candidates = (
        left.join(right, "block").filter(F.col("a") < F.col("b"))
        .filter(_length_compatible(F.col("na"), F.col("nb"), _floor(threshold, rounded)))
        .select("a", "b").distinct()
    )
    found = _verified(candidates, values, threshold, rounded)
    counts = values.select("id", "copies")
    pairs = (
        found.join(counts.select(F.col("id").alias("a"), F.col("copies").alias("ca")), "a")
        .join(counts.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
        .select(
            F.least("value_a", "value_b").alias("value_a"),
            F.greatest("value_a", "value_b").alias("value_b"),
            "similarity",
            F.when(F.col("value_a") < F.col("value_b"), F.col("ca")).otherwise(F.col("cb")).alias("copies_a"),
            F.when(F.col("value_a") < F.col("value_b"), F.col("cb")).otherwise(F.col("ca")).alias("copies_b"),
        )
    )
    own = values.filter(F.col("copies") > 1).select(
        F.col("value").alias("value_a"), F.col("value").alias("value_b"), F.lit(1.0).alias("similarity"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
    )
    return pairs.unionByName(own)


# -- greedy leaders ---------------------------------------------------------------------------------


def leaders(
    values: DataFrame,
    order: str,
    threshold: float,
    rounded: bool = False,
    width: int = 32,
    block_table: DataFrame | None = None,
    assign: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """The values a greedy pass in ``order`` keeps (``id, ord``) and, with ``assign``, who resembles them.

    The second frame has ``id, leader`` for every value that is not kept: its first similar leader.

    ``values`` has distinct ``id, value`` and an order column without ties. Each round emits at most
    ``width`` partners per value and block, whatever the size of the block. ``block_table`` (``id, block``)
    replaces the lossless blocks.
    """
    keys = block_table if block_table is not None else block_keys(values.select("id", "value"), _floor(threshold, rounded))
    blocks = cut_lineage(
        keys.join(values.select("id", F.col(order).alias("ord"), F.length("value").alias("n")), "id")
    )
    texts = values.select("id", "value")
    if block_table is not None:
        # Long texts: those that share no block are in no pair, so they are not shuffled in every round.
        texts = cut_lineage(texts.join(_in_company(blocks), "id", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        if block_table is None:
            return _verified(pairs, texts, threshold, rounded)
        pairs = cut_lineage(pairs)
        return _verified(pairs, _texts_of(pairs, texts), threshold, rounded)

    open_blocks = blocks
    kept: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        place = F.row_number().over(Window.partitionBy("block").orderBy("ord"))
        front = cut_lineage(open_blocks.withColumn("place", place).filter(F.col("place") <= width))
        if front.isEmpty():
            break
        # A value is in view if it is among the first of every block it is listed under.
        listed = open_blocks.groupBy("id", "ord").agg(F.count("*").alias("blocks"))
        in_view = (
            front.groupBy("id").agg(F.count("*").alias("seen")).join(listed, "id")
            .filter(F.col("seen") == F.col("blocks")).select("id", "ord")
        )
        earlier = front.select("block", F.col("id").alias("a"), F.col("ord").alias("ord_a"), F.col("n").alias("na"))
        later = front.join(in_view.select("id"), "id", "left_semi").select(
            "block", F.col("id").alias("b"), F.col("ord").alias("ord_b"), F.col("n").alias("nb"))
        near = (
            earlier.join(later, "block").filter(F.col("ord_a") < F.col("ord_b"))
            .filter(_length_compatible(F.col("na"), F.col("nb"), _floor(threshold, rounded)))
            .select("a", "b").distinct()
        )
        waiting = verified(near).select(F.col("b").alias("id")).distinct()
        settled = cut_lineage(in_view.join(waiting, "id", "left_anti"))
        kept.append(settled)
        # Settled values leave with everything later that resembles them. To find first leaders, values that
        # have left already are compared as well: a leader before theirs may be settled only now.
        pairs = verified(_followers(blocks if assign else open_blocks, settled, _floor(threshold, rounded)))
        if assign:
            pairs = cut_lineage(pairs.join(settled.select(F.col("id").alias("a"), "ord"), "a").select("a", "b", "ord"))
            found.append(pairs)
        gone = pairs.select(F.col("b").alias("id")).distinct()
        left = open_blocks.join(settled.select("id").unionByName(gone), "id", "left_anti")
        open_blocks = cut_lineage(left)
    none = values.select("id", F.col(order).alias("ord")).limit(0)
    heads = reduce(DataFrame.unionByName, kept, none)
    if not assign:
        return heads, None
    nobody = none.select(F.col("id").alias("a"), F.col("id").alias("b"), "ord")
    members = reduce(DataFrame.unionByName, found, nobody)
    return heads, members.groupBy(F.col("b").alias("id")).agg(F.min_by("a", "ord").alias("leader"))


def _in_company(blocks: DataFrame) -> DataFrame:
    """``id`` of the values that are not alone in all their blocks."""
    shared = blocks.groupBy("block").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    return blocks.join(shared, "block", "left_semi").select("id").distinct()


#: Ids that are broadcast to pick their texts; more are left to the join.
_PICKED = 200_000


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of some pairs. Few ids are broadcast, so that no other text is shuffled."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return texts.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= _PICKED else texts


def _followers(blocks: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs ``a`` (one of ``heads``), ``b`` (a later value of ``blocks``)."""
    lead = blocks.join(heads.select("id"), "id", "left_semi").select(
        "block", F.col("id").alias("a"), F.col("ord").alias("ord_a"), F.col("n").alias("na"))
    rest = blocks.select("block", F.col("id").alias("b"), F.col("ord").alias("ord_b"), F.col("n").alias("nb"))
    return (
        rest.join(lead, "block").filter(F.col("ord_a") < F.col("ord_b"))
        .filter(_length_compatible(F.col("na"), F.col("nb"), threshold))
        .select("a", "b").distinct()
    )


def joined_value(columns: Sequence[str]) -> Column:
    """The compared text of a row: its columns joined by one space, a missing cell as ``None``."""
    return F.concat_ws(" ", *[F.coalesce(_col(c).cast("string"), F.lit("None")) for c in columns])


def fuzzy_dedup(df: DataFrame, key: str, columns: Sequence[str], threshold: float = 0.9, keep: str = "first") -> DataFrame:
    """Rows that survive fuzzy de-duplication in key order.

    ``first``: a row stays if it resembles no row kept before it. ``last``: a row goes if any later row
    resembles it. ``none``: kept rows that absorbed another one go as well.
    """
    text = df.withColumn("_value", F.lower(joined_value(columns)))
    values = cut_lineage(_collapse(text, key, "_value"))
    if keep == "last":
        survivors = _without_later(values, threshold).select("last")
        return df.join(survivors.select(F.col("last").alias(key)), key, "left_semi")
    heads, members = leaders(values, "id", threshold, assign=keep == "none")
    survivors = heads.select("id")
    if keep == "none":
        alone = values.filter(F.col("copies") == 1).select("id")
        survivors = survivors.join(alone, "id", "left_semi").join(
            members.select(F.col("leader").alias("id")).distinct(), "id", "left_anti"
        )
    return df.join(survivors.select(F.col("id").alias(key)), key, "left_semi")


def _without_later(values: DataFrame, threshold: float, width: int = 8) -> DataFrame:
    """Values that no value with a larger ``last`` resembles.

    Most of a large group of near copies already resembles one of the last few values of its blocks, so
    those are tried first; only what remains is compared with all later partners.
    """
    blocks = cut_lineage(
        block_keys(values.select("id", "value"), threshold).join(
            values.select("id", F.col("last").alias("ord"), F.length("value").alias("n")), "id"
        )
    )
    texts = values.select("id", "value")

    def resembled(early: DataFrame, late: DataFrame) -> DataFrame:
        a = early.select("block", F.col("id").alias("a"), F.col("ord").alias("ord_a"), F.col("n").alias("na"))
        b = late.select("block", F.col("id").alias("b"), F.col("ord").alias("ord_b"), F.col("n").alias("nb"))
        near = (
            a.join(b, "block").filter(F.col("ord_a") < F.col("ord_b"))
            .filter(_length_compatible(F.col("na"), F.col("nb"), threshold)).select("a", "b").distinct()
        )
        return _verified(near, texts, threshold, False).select(F.col("a").alias("id")).distinct()

    place = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("ord")))
    tail = blocks.withColumn("place", place).filter(F.col("place") <= width).drop("place")
    remaining = cut_lineage(blocks.join(resembled(blocks, tail), "id", "left_anti"))
    gone = resembled(remaining, blocks)
    open_ids = remaining.select("id").distinct().join(gone, "id", "left_anti")
    return values.join(open_ids, "id", "left_semi")


def similar_value_groups(df: DataFrame, value: str, threshold: int = 85) -> DataFrame:
    """Groups of similar values: ``canonical, member``. Leaders in ascending order take what resembles them.

    Scores are whole per cents. Missing-value words are left out; a value nothing resembles forms no group.
    """
    present = df.select(F.col(value).alias("original")).filter(
        F.col("original").isNotNull() & ~F.lower("original").isin(MISSING_WORDS)
    ).distinct()
    # Spellings that differ in case only are one value to the comparison; the smallest stands for them.
    values = cut_lineage(
        present.groupBy(F.lower("original").alias("value")).agg(F.min("original").alias("id"))
    )
    heads, assigned = leaders(values, "id", threshold / 100, rounded=True, assign=True)
    own = heads.select("id", F.col("id").alias("leader"))
    spellings = present.join(values.select("value", "id"), F.lower("original") == F.col("value"))
    return (
        spellings.join(assigned.unionByName(own), "id")
        .filter(F.col("original") != F.col("leader"))
        .select(F.col("leader").alias("canonical"), F.col("original").alias("member"))
    )


# -- long texts -------------------------------------------------------------------------------------


def minhash_blocks(values: DataFrame, hashes: int = 24, per_band: int = 3, shingle: int = 5) -> DataFrame:
    """``id, block`` of texts: MinHash values over word shingles, ``hashes / per_band`` bands of them."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"(?U)\W+", " ")), " ")
    cut = once(values, tokens=tokens)
    shingles = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("tokens") - shingle + 1, F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice("tokens", i, shingle), " ")),
    )
    hashed = once(cut, grams=F.array_distinct(shingles)).select("id", "grams")

    def seeded(seed: int) -> Callable[[Column], Column]:
        return lambda gram: F.xxhash64(gram, F.lit(seed))

    mins = [F.array_min(F.transform("grams", seeded(s))) for s in range(hashes)]
    bands = [
        F.xxhash64(F.lit(i), *mins[i * per_band : (i + 1) * per_band]) for i in range(math.ceil(hashes / per_band))
    ]
    return hashed.select("id", F.explode(F.array(*bands)).alias("block"))


def near_duplicate_texts(df: DataFrame, key: str, text: str, threshold: float = 0.9, **blocking: int) -> DataFrame:
    """Long texts that nearly repeat an earlier one: ``id, leader, copies``.

    Bands of MinHash values replace the lossless blocks, whose grams are too common in long texts to
    separate them; candidates are therefore approximate, while every reported pair reaches the exact
    similarity. Exact copies are one value: they are reported with the number of copies.
    """
    values = cut_lineage(_collapse(df, key, text))
    heads, members = leaders(
        values, "id", threshold, block_table=minhash_blocks(values.select("id", "value"), **blocking), assign=True
    )
    own = heads.select("id", F.col("id").alias("leader"))
    return members.unionByName(own).join(values.select("id", "copies"), "id").filter(
        (F.col("copies") > 1) | (F.col("id") != F.col("leader"))
    )
