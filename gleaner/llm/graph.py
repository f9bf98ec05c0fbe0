"""Connected components of a graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stored


def components(edges: DataFrame, low: str = "a", high: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node reachable from each node that has a link.

    Alternates large-star and small-star steps: links of a node are moved to the smallest node it knows. Minima are
    aggregated before the shuffle and joined back, so a node with very many links is no single task; the number
    of links never grows, and rounds grow with the logarithm of the longest path. Every round is written to the shared folder.
    """
    links = stored(_proper(edges.select(F.col(low).alias("u"), F.col(high).alias("v"))), "links")
    before = None
    for _ in range(rounds):
        links = stored(_star(_star(links, large=True), large=False), "links")
        # Stars are stable: the number and the sum of links no longer change.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _proper(links: DataFrame) -> DataFrame:
    """Each link once, smaller node first, no loops."""
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every node's larger neighbours are linked to its smallest neighbour (or itself). Small: the smaller ones and itself."""
    both = links if not large else links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return _proper(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("u"), "v"))
    least = links.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
    moved = links.join(least, F.col("v") == F.col("w"))
    return _proper(moved.select("m", F.col("u").alias("x")).unionByName(least.select("m", F.col("w").alias("x"))).select(F.col("m").alias("u"), F.col("x").alias("v")))
