"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits of a fingerprint are two halves. Fingerprints that differ in two bits or fewer agree in one half up to one bit.
The anchors of a half are the words of the (31, 26) Hamming code on 31 of its bits: a perfect code, so every value has one
anchor within its covering radius of 1, found by five parities. A fingerprint is replicated to every anchor within that
radius plus one differing bit (sixteen, or one for a code word); each half then compares the fingerprints at home at an
anchor with the replicas there. If x is at home at anchor c and y differs from x by one bit in that half, y is within two of c, so no
link is lost. Only distinct fingerprints are compared; components of the links are found by star steps, and the documents come to
their component by their fingerprint.

Results for odd input: null, empty and blank texts have fingerprint zero and are linked like any other; texts of one or two
words have that sequence as their shingle; repeated rows get a result each; rows with a null id take part, a component of such
rows only has a null id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import small_side, stored
from gleaner.llm.graph import components

#: Length of the code; radius of the ball that is replicated to.
CODE, SEED = 31, 42
#: Shingles that are counted at a time, so that very long texts take bounded memory.
STEP = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half the hashes of all shingles of ``words`` words."""
    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    runs = zip(*(own[i:] for i in range(words))) if len(own) >= words else iter([own])
    hashes = [xxhash.xxh64_digest(b" ".join(run), SEED) for run in runs]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(np.frombuffer(b"".join(hashes[i : i + STEP]), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column, as a signed long."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t, words) for t in batch.to_pylist()], pa.int64())

    return hashed(text)


def _halves(prints: DataFrame) -> DataFrame:
    """``fp, half, value, syndrome``: 31 bits of each half, and the position (1 to 31) to flip for the next code word, or 0."""
    masks = [sum(1 << (p - 1) for p in range(1, CODE + 1) if p >> k & 1) for k in range(5)]
    both = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit((1 << CODE) - 1).cast("long")).alias("value")) for h in (0, 1)])).alias("x"))
    rows = both.select("fp", "x.half", "x.value")
    parity = [F.shiftleft(F.bit_count(F.col("value").bitwiseAND(F.lit(m).cast("long"))).bitwiseAND(F.lit(1)), k) for k, m in enumerate(masks)]
    return rows.withColumn("syndrome", sum(parity[1:], parity[0]))


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints ``fp`` with a < b that differ in at most two bits."""
    if not 0 <= bits <= 2:
        raise ValueError("two halves and one flipped bit cover up to two differing bits")
    halves = _halves(prints)
    flip = "IF({p} = 0, 0L, shiftleft(1L, {p} - 1))"
    home = halves.select(F.col("fp").alias("a"), "half", F.expr(f"value ^ {flip.format(p='syndrome')}").alias("anchor"))
    # Code words at distance two: flips of two positions whose numbers have the syndrome as their exclusive or.
    near = F.expr(f"""concat(array(value ^ {flip.format(p='syndrome')}), IF(syndrome = 0, CAST(array() AS array<bigint>), transform(
        filter(sequence(1, {CODE}), i -> (i ^ syndrome) > i), i -> value ^ {flip.format(p='i')} ^ {flip.format(p='(i ^ syndrome)')})))""")
    replicas = halves.select(F.col("fp").alias("b"), "half", F.explode(near).alias("anchor"))
    pairs = home.join(replicas, ["half", "anchor"]).where(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """Per row: ``key, fp, component_id``, the smallest key reachable over links of at most ``bits`` differing bits."""
    rows = stored(docs.select(F.col(key), fingerprints(F.col(text), words).alias("fp")), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(links(prints.select("fp"), bits))
    grouped = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = grouped.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of_print, rows["fp"] == F.col("_fp")).select(key, "fp", "component_id")


def distinct_texts(docs: DataFrame, key: str, text: str, more: Callable[[Column], dict[str, Column]] = lambda body: {}) -> DataFrame:
    """A row per distinct text: ``_id``, the row with the smallest key as ``_row``, ``_first`` to order by, ``fp``, and ``more`` of the text."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("_digest")
    # Null keys come last.
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("_least")
    rows = docs.select(digest, row).groupBy("_digest").agg(F.min("_least").alias("_least"))
    body = F.col(f"_least.row.`{text}`")
    first = F.struct("_least.none", "_least.key", "_digest").alias("_first")
    out = rows.select(F.monotonically_increasing_id().alias("_id"), F.col("_least.row").alias("_row"), first, fingerprints(body).alias("fp"))
    return stored(out.withColumns(more(F.col(f"_row.`{text}`"))), "distinct")


def one_per_root(texts: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of each component, by key and digest of the text; ``roots`` of the fingerprints that have links."""
    own = texts.select("_id", "_first", "fp")
    of_root = own.join(roots, own["fp"] == roots["node"], "left").select("_id", "_first", F.coalesce("root", "fp").alias("root"))
    grouped = stored(of_root, "roots")
    kept = grouped.groupBy("root").agg(F.min(F.struct("_first", "_id")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = stored(grouped.join(kept, "root").where("_id <> kept._id").select("_id"), "gone")
    left = texts.join(small_side(gone, gone.count()), "_id", "left_anti")
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, whatever its key: the smallest key, then the smallest digest of the text."""
    texts = distinct_texts(docs, key, text)
    return one_per_root(texts, components(links(texts.select("fp").distinct())), docs.columns)
