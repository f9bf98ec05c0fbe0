"""Exact Jaccard join of texts over word shingles, small and large sets each in their own way, and the components of its links.

Equal sets are one node. The nodes are split by size; the boundary is where the cost of the whole join is least, given how many sets have each size.

* Small sets (light): two sets of s and t shingles are linked if they share o(s, t) of them, so both list all their subsets of that fixed
  size, under the two sizes. Sets that list the same subset are linked without looking further, and all of a list are one component:
  a star to its first set on the other side, never its pairs.
* Large sets (heavy) are looked up in inverted lists of their rarest shingles, as many as a partner must share one of. Sets of a list
  can be linked only if their sizes, the places of the shingle in both and the parities of their shingles in 256 slots allow it. A
  first round compares each set with the most central one of its list (and size class); what is linked then is one component. The second
  round compares the rest: pairs in different components, none left out. Components over all links are the result.

Shingles are ordered by the count of one of 2^20 slots their hash falls into, a table of fixed size; the order decides how long lists get, not what
is found. Texts never meet: pairs are compared by hashes of 64 bits of their shingles, made anew for the texts in question.

Results for odd input: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than a shingle have the
whole sequence as their only one; texts of any length are hashed whole, one at a time; repeated rows get a result each; rows with a null id take
part, and a component of such rows only has a null id; ties go to the smallest id; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import small_side, stored
from gleaner.llm.graph import components

#: Slots in which shingles are counted, as a power of two, and how many rows of a counter table go into one row.
SLOT_BITS, CHUNKS = 20, 16
#: Slots for parities of shingles.
PARITIES = 256
#: Sets up to this size may be listed by subsets; the boundary is chosen below it.
MOST_SMALL = 24
#: What comparing two sets costs, in keys of a list.
COMPARE = 24
#: Odd factors that mix hashes.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words, A to Z in lower case; of the whole sequence if it is shorter."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    size = min(words, len(own))
    mixed = hashes[: len(own) - size + 1] + MIX[2] * np.uint64(size)
    for i in range(1, size):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[0] + hashes[i : len(own) - size + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[1]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def overlap(s, t, percent: int):
    """The least common shingles of linked sets of ``s`` and ``t``; for numbers and, with ``div``, for columns."""
    total = (s + t) * percent + (99 + percent)
    return total // (100 + percent) if not isinstance(total, Column) else F.floor(total / F.lit(100 + percent))


def prefix(s: int, percent: int) -> int:
    """How many of its first shingles a set must be listed under, so that every partner of any size shares one of them."""
    return s - (percent * s + 99) // 100 + 1


def _count_slots(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            found = [slots(shingle_set(text.as_py(), words)) for text in batch.column(0)]
            total += np.bincount(np.concatenate([*found, np.empty(0, np.int64)]), minlength=total.size)
        parts = [zlib.compress(part.tobytes(), 1) for part in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    return count


def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a chunk follow each other; one sum is kept at a time."""
    chunk, total = None, None
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
            if at != chunk and chunk is not None:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
            chunk, total = at, part if at != chunk else total + part
    if chunk is not None:
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])


def slot_ranks(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How frequent each slot is, on a scale of logarithms from 0 to 255; one byte each."""
    counted = stored(docs.select(text).mapInArrow(_count_slots(words), "chunk int, counts binary"), "slots")
    summed = counted.repartition(CHUNKS, "chunk").sortWithinPartitions("chunk").mapInArrow(_sum_slots, "chunk int, counts binary")
    ranks = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS))
    for row in summed.collect():  # CHUNKS rows of fixed size
        ranks[row.chunk] = np.log2(1 + np.frombuffer(row.counts, np.int64))
    return np.minimum(ranks.ravel() * 6, 255).astype(np.uint8)


def signatures(docs: DataFrame, key: str, text: str, ranks: np.ndarray, words: int, percent: int, more: dict[str, Column]) -> DataFrame:
    """Per row: ``key, own`` (digest of the text), ``digest`` of the set, its ``size``, ``parity`` and first shingles; small sets whole; and ``more``."""
    names = list(more)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2):
                found = shingle_set(t.as_py(), words)
                n = len(found)
                if not n:
                    rows.append((None, 0, None, None))
                    continue
                order = np.argsort(ranks[slots(found)], kind="stable")
                first = found[order[: n if n <= MOST_SMALL else prefix(n, percent)]]
                parity = np.packbits(np.bincount((found & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1)
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).digest(), n, parity.view(np.int64).tolist(), first.view(np.int64).tolist()))
            digest, size, parity, first = zip(*rows) if rows else ((),) * 4
            made = [pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(parity, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *batch.columns[3:]], ["key", "own", "digest", "size", "parity", "first", *names])

    rows = docs.select(F.col(key).alias("key"), own_digest(text).alias("own"), F.col(text).alias("text"), *[c.alias(name) for name, c in more.items()])
    kinds = [f", {name} {rows.schema[name].dataType.simpleString()}" for name in more]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, own binary, digest binary, size long, parity array<long>, first array<long>{''.join(kinds)}"
    return stored(rows.mapInArrow(sign, schema), "signatures")


def own_digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size that is listed by subsets: the one with the least cost of all sets up to ``MOST_SMALL``."""

    def cost(x: int) -> int:
        light = sum(n * sum(subsets(s, t, percent) for t in range(1, x + 1)) for s, n in sizes.items() if s <= x)
        return light + sum(n * prefix(s, percent) * (1 + COMPARE) for s, n in sizes.items() if x < s <= MOST_SMALL)

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), x))


def subsets(s: int, t: int, percent: int) -> int:
    """How many subsets a set of ``s`` lists for partners of ``t``; none if such sets cannot be linked."""
    least = overlap(s, t, percent)
    return math.comb(s, least) if least <= min(s, t) else 0


def light_links(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """``a, b`` of linked sets of at most ``limit`` shingles: stars over the lists of subsets."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.sort(np.array(members.as_py(), np.int64))
                s = len(found)
                for t in range(1, limit + 1):
                    if subsets(s, t, percent):
                        low, high = min(s, t), max(s, t)
                        side = (s > t) - (s < t)
                        rows += [(at, side, xxhash.xxh64_intdigest(np.array([low, high, *c], np.int64).tobytes()), xxhash.xxh64_intdigest(np.array(c, np.int64).tobytes(), 7 * low + high))
                                 for c in itertools.combinations(found.tolist(), overlap(s, t, percent))]
            at, side, k1, k2 = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(side, pa.int32()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64))], ["id", "side", "k1", "k2"])

    small = sets.where(F.col("size") <= limit).select("id", "first", "size")
    keys = stored(small.select("id", "first").mapInArrow(listed, "id long, side int, k1 long, k2 long"), "subsets")
    # Side 0: lists of sets of one size. Sides -1 and 1: the smaller and the larger sets of a list, linked across.
    heads = keys.groupBy("k1", "k2").agg(*[F.min(F.when(F.col("side") == side, F.col("id"))).alias(name) for side, name in ((0, "same"), (-1, "low"), (1, "high"))], F.count("*").alias("n")).where("n > 1")
    across = F.when(F.col("side") == 0, F.col("same")).when(F.col("side") == 1, F.col("low")).otherwise(F.col("high"))
    return keys.join(heads, ["k1", "k2"]).select(across.alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def inverted_lists(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """``shingle, id, size, place, parity, class, head`` of lists with two sets or more; ``head`` is the most central set of a size class."""
    least = (percent * (limit + 1) + 99) // 100
    large = sets.where(F.col("size") >= max(least, 1))
    need = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1
    rows = large.select("id", "size", F.posexplode(F.slice("first", F.lit(1), need.cast("int"))).alias("place", "shingle"))
    rows = rows.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / percent))).cast("int"))
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).where("n > 1").drop("n")
    central = Window.partitionBy("shingle", "class").orderBy("place", "size", "id")
    return stored(shared.withColumn("head", F.first(F.struct("id", "size", "place")).over(central)), "lists")


def _possible(percent: int, limit: int) -> Column:
    """Whether ``a`` (not larger) and ``b`` can be linked, if the shingle is their first common one."""
    sa, sb, i, j = F.col("a.size"), F.col("b.size"), F.col("a.place"), F.col("b.place")
    need = overlap(sa, sb, percent)
    return (F.col("a.id") != F.col("b.id")) & (sa * 100 >= sb * percent) & (sb > limit) & (F.least(sa - i, sb - j) >= need)


def _few_differ(percent: int) -> Column:
    """Sets differ in at least as many shingles as they have parities that differ."""
    pairs = [F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(PARITIES // 64)]
    s = F.col("a.size") + F.col("b.size")
    return reduce(lambda x, y: x + y, pairs) <= s - 2 * overlap(F.col("a.size"), F.col("b.size"), percent)


def _of(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """What is asked of the sets that ``pairs`` name; few ids are broadcast, so that the sets stay where they are."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    asked = stored(sets.select("id", *columns).join(small_side(ids, n := ids.count()), "id"), "asked")
    return small_side(asked, n) if "first" not in columns else asked


def _sharing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose first shingles have enough in common.

    Of two prefixes, one ends first in the order of all shingles; what it shares with the other set, it shares with its prefix. So the overlap is
    at most the common first shingles and the rest of that set.
    """
    least = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1
    of = _of(pairs, sets, "size", "first").select("id", "size", F.slice("first", F.lit(1), least.cast("int")).alias("first"))
    both = pairs.join(of.select(F.col("id").alias("a"), F.struct("size", "first").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.struct("size", "first").alias("y")), "b")
    rest = F.greatest(*[F.col(f"{c}.size") - F.size(f"{c}.first") for c in "xy"])
    enough = F.size(F.array_intersect("x.first", "y.first")) + rest >= overlap(F.col("x.size"), F.col("y.size"), percent)
    return both.where(enough).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets that are linked."""
    pairs = stored(_sharing(stored(pairs, "pairs"), sets, percent), "pairs")
    asked = _of(pairs, sets, "key", "own")

    @F.arrow_udf("array<bigint>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_set(t.as_py(), words).view(np.int64) for t in batch], pa.list_(pa.int64()))

    @F.arrow_udf("bigint")
    def common(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(left, right)], pa.int64())

    rows = docs.select(F.col(key).alias("_key"), own_digest(text).alias("_own"), F.col(text).alias("_text"))
    met = rows.join(asked, (F.col("_own") == F.col("own")) & F.col("_key").eqNullSafe(F.col("key"))).select("id", hashes(F.col("_text")).alias("set"))
    # One exchange by id serves both sides of the pairs.
    found = met.dropDuplicates(["id"])
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    compared = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), common(F.col("x"), F.col("y")).alias("n_common"))
    return stored(compared.where(F.col("n_common") * 100 >= (F.col("n") - F.col("n_common")) * percent).select("a", "b"), "links")


def linked(docs: DataFrame, key: str, text: str, words: int, percent: int, **more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, with columns ``more``; distinct sets by ``id`` and ``digest``; and ``node, root`` of the sets that have links."""
    ranks = slot_ranks(docs, text, words)
    rows = signatures(docs, key, text, ranks, words, percent, more)
    grouped = rows.where("size > 0").groupBy("digest").agg(
        F.min("key").alias("component"), F.min(F.struct("key", "own")).alias("row"), F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("first").alias("first"))
    sets = stored(grouped.select(F.monotonically_increasing_id().alias("id"), "digest", "component", "row.key", "row.own", "size", "parity", "first"), "distinct")

    sizes = {r["size"]: r["n"] for r in sets.where(F.col("size") <= MOST_SMALL).groupBy("size").agg(F.count("*").alias("n")).collect()}  # MOST_SMALL rows
    limit = boundary(sizes, percent)
    links = [light_links(sets, limit, percent)] if limit else []
    own = inverted_lists(sets, limit, percent)

    # First round: each set with the head of its list.
    nodes = sets.select("id", "parity")
    heads = own.where("head.id <> id").select(
        F.when(F.struct("size", "id") < F.struct("head.size", "head.id"), F.struct("id", "size", "place")).otherwise(F.col("head")).alias("a"),
        F.when(F.struct("size", "id") < F.struct("head.size", "head.id"), F.col("head")).otherwise(F.struct("id", "size", "place")).alias("b"))
    near = heads.where(_possible(percent, limit)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb")).distinct()
    near = near.join(nodes.select(F.col("id").alias("a"), F.col("parity").alias("pa")), "a").join(nodes.select(F.col("id").alias("b"), F.col("parity").alias("pb")), "b")
    near = near.select(F.struct(F.col("a").alias("id"), F.col("sa").alias("size"), F.col("pa").alias("parity")).alias("a"), F.struct(F.col("b").alias("id"), F.col("sb").alias("size"), F.col("pb").alias("parity")).alias("b"))
    first = verified(near.where(_few_differ(percent)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")), sets, docs, key, text, words, percent)
    links.append(first)

    # Second round: what is in different components still.
    roots = stored(components(reduce(DataFrame.unionByName, links)), "roots")
    labelled = stored(own.drop("head", "class").join(nodes, "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "labelled")
    mixed = labelled.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    open_ = stored(labelled.join(mixed, "shingle", "left_semi"), "open")
    least = F.col("a.size") - overlap(F.col("a.size"), F.col("a.size"), percent) + 1
    smaller = F.struct("a.size", "a.id") < F.struct("b.size", "b.id")
    pairs = open_.alias("a").join(open_.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & smaller & (F.col("a.place") < least) & _possible(percent, limit) & _few_differ(percent))
    second = verified(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), sets, docs, key, text, words, percent)

    known = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return rows, sets, components(known.unionByName(second))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """Per row: ``key, n_shingles, component_id``, the smallest key reachable over links of a Jaccard similarity of ``percent`` or more."""
    rows, sets, final = linked(docs, key, text, words, percent)
    named = sets.join(final, sets["id"] == final["node"], "left").select("digest", "component", F.coalesce("root", "id").alias("root"))
    least_key = named.groupBy("root").agg(F.min("component").alias("component_id"))
    of_set = named.join(least_key, "root").select("digest", "component_id")
    grouped = rows.where("size > 0").select("key", "size", "digest").join(of_set, "digest").select("key", "size", "component_id")
    alone = rows.where("size = 0").select("key", "size", F.col("key").alias("component_id"))
    return grouped.unionByName(alone).select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
