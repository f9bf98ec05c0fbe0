"""A Merkle manifest of a dataset, checked by a recursive query that climbs from every leaf.

Each row is a leaf: the hash of its columns. The leaves of a source, in the order of their keys, are the bottom of a tree in which runs
of ``FANOUT`` nodes become their hash; what remains of each source is the bottom of one more tree, over the sources. One aggregation builds
``GENERATIONS`` levels at once: it gathers the at most ``FANOUT ** GENERATIONS`` nodes below one node of the last of them. What it
stores are rows that know their siblings in each of these levels and the ancestor they lead to.

``climb`` is a recursive common table expression over these rows: a round takes every leaf from its node to the linked ancestor, hashes what
it carries with the siblings left and right of it, level by level, and notes the siblings. What a leaf carries at the end is the root it proves.

Near the root all leaves pass the same nodes. A node with many leaves below it is therefore stored once for every ``SHARE`` of them, and
each leaf has the copy of its number, so a key has no more than some ``SHARE * FANOUT ** GENERATIONS`` rows, hot sources included. Places in a
source come from a range partition with offsets, and sources are told to their rows by stretches of ``SHARE`` rows; no window or join is
keyed by source.

Results for odd input: null cells are hashed as ``-`` and differ from empty ones; null keys come first in their source and are never
tampered with; rows with equal keys are leaves of their own, ordered by hash; repeated rows get a result each; a text of any length is one
value of one row; a source of one row has that leaf as its subroot, and a table of one source has that subroot as its root; an empty table has
no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import stored
from gleaner.operators.jobs import with_index

FANOUT, GENERATIONS = 3, 3
#: Nodes below a node of the last level that is built at once.
GROUP = FANOUT**GENERATIONS
#: Leaves that share a copy of a node.
SHARE = 729
#: Nodes to a file.
FILE = 10_000
#: The number of the tree over the subroots, and how its levels are counted.
TOP, TOP_LEVEL = -1, 64
#: Nodes are named by their first leaf, or the first leaf of their copy's share, and their level.
LEVELS = 128


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*fields), 256)


def leaves(docs: DataFrame, hashed: Sequence[str], key: str, source: str, altered: dict[str, Column]) -> DataFrame:
    """``number, stretch, tree, place, size, key, hash, altered``: the leaves in order.

    ``altered`` replaces columns before the second hash. ``place`` counts from 0 in the source, ``size`` is the number of its leaves.
    """
    rows = stored(docs.select(
        # Null before all others, which are compared bytewise.
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source"), F.col(key).alias("key"),
        leaf_hash([F.col(c) for c in hashed]).alias("hash"), leaf_hash([altered.get(c, F.col(c)) for c in hashed]).alias("altered"),
    ), "leaves")
    placed = with_index(rows, ["source", "key", "hash", "altered"], "number").withColumn("stretch", F.expr(f"number div {SHARE}"))
    placed = stored(placed, "placed")
    pieces = stored(placed.groupBy("source", "stretch").agg(F.min("number").alias("first"), F.count("*").alias("n")), "pieces")
    sources = pieces.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
    trees = stored(with_index(sources, ["source"], "tree"), "trees")
    known = pieces.select("source", "stretch").join(trees, "source")
    return placed.join(known, ["source", "stretch"]).select(
        "number", "stretch", F.col("tree").cast("long").alias("tree"), (F.col("number") - F.col("first")).alias("place"), "size", "key", "hash", "altered",
    )


def _at(first: Column, level: int) -> Column:
    return first * F.lit(LEVELS).cast("long") + level


def _copies(below: str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.expr(f"{below} div {SHARE}"))


def _groups(level: DataFrame, top: bool, depth: int, nodes: int) -> DataFrame:
    """``GENERATIONS`` levels up: ``tree, place, size, hash, first, below`` of the nodes there, and all below them as ``kids``.

    ``kids`` have their siblings ``left`` and ``right`` for each of the levels as ``hops``. Trees of one node are done and have no rows.
    ``nodes`` is about how many rows there are; few go to few files.
    """
    own = F.struct("place", "hash", "first", "below", *[c for c in ("number", "altered") if c in level.columns])
    rows = level.where("size > 1").groupBy("tree", F.expr(f"place div {GROUP}").alias("place")).agg(
        F.min("size").alias("size"), F.sum("below").alias("below"), F.min("first").alias("first"), F.array_sort(F.collect_list(own)).alias("members"))
    rows = rows.withColumn("level0", F.transform("members", lambda m: m["hash"]))
    size, hops = F.col("size"), []
    for g in range(GENERATIONS):
        below = F.col(f"level{g}")
        run = F.transform(F.sequence(F.lit(0), F.expr(f"(size(level{g}) - 1) div {FANOUT}")), lambda i: F.sha2(F.array_join(F.slice(below, i * FANOUT + 1, FANOUT), ""), 256))
        rows = rows.withColumns({f"level{g + 1}": F.when(size > 1, run).otherwise(below), f"open{g}": size > 1})
        size = F.expr(f"(size + {FANOUT ** (g + 1) - 1}) div {FANOUT ** (g + 1)}")
        hops.append(f"""IF(open{g}, array(named_struct(
            'left', unhex(array_join(slice(level{g}, (i div {FANOUT ** (g + 1)}) * {FANOUT} + 1, (i div {FANOUT ** g}) % {FANOUT}), '')),
            'right', unhex(array_join(slice(level{g}, (i div {FANOUT ** g}) + 2, {FANOUT - 1} - (i div {FANOUT ** g}) % {FANOUT}), '')))), array())""")
    more = ", m.number, m.altered" if "number" in level.columns else ""
    kids = F.expr(f"transform(members, (m, i) -> struct(m.first, m.below{more}, concat({', '.join(hops)}) AS hops))")
    out = rows.select("tree", "place", size.alias("size"), F.element_at(f"level{GENERATIONS}", 1).alias("hash"), "first", "below", kids.alias("kids"))
    return stored(out.coalesce(1 + nodes // FILE), f"levels-{'top-' if top else ''}{depth}")


def _linked(groups: DataFrame, top: bool, depth: int) -> DataFrame:
    """The nodes below these with the ancestor they lead to; a tree's last node leads to the tree over all sources."""
    base = TOP_LEVEL if top else 0
    last = F.col("size") == (1 if not top else 0)
    return groups.select("*", F.explode("kids").alias("kid")).select(
        "kid", _at(F.col("kid.first"), base + depth).alias("at"), F.col("kid.hops").alias("hops"),
        F.when(last, _at(F.col("first"), TOP_LEVEL)).otherwise(_at(F.col("first"), base + depth + 1)).alias("up"), _copies("below").alias("up_copies"))


def _forest(bottom: DataFrame, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees over ``bottom`` from below, and the last node of each tree: ``tree, hash, first, below``."""
    kept, last = ["tree", "place", "size", "hash", "first", "below"], ["tree", "hash", "first", "below"]
    levels, ends, level = [], [bottom.where("size = 1").select(*last)], bottom
    largest, n = bottom.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    while largest > 1:
        n = -(-n // GROUP)
        levels.append(_groups(level, top, len(levels), n))
        level = levels[-1].select(*kept)
        ends.append(level.where("size = 1").select(*last))
        largest = -(-largest // GROUP)
    return levels, stored(reduce(DataFrame.unionByName, ends), "subroots")


@contextmanager
def _without_row_limit(spark: SparkSession):
    """Recursive queries stop with an error at a number of rows; here that number is the size of the table times its levels."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What a leaf carries after it has passed the siblings of ``hops``, and these siblings.
FOLDED = "aggregate({hops}, {carried}, (h, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(h)), lower(hex(s.right))), 256)))"
PASSED = "aggregate({hops}, X'', (all, s) -> concat(all, s.left, s.right))"


def _next(up: str, number: str, copies: str) -> str:
    """The name of the ancestor's copy that a leaf goes to."""
    return f"{up} + {LEVELS * SHARE}L * pmod({number}, {copies})"


def climb(start: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Per leaf: ``number``, all its ``siblings`` from below, and ``folded``, the root that it proves.

    ``start`` has ``number``, the node a leaf is ``at``, what it carries as ``folded`` and the ``siblings`` so far; ``nodes`` has ``at, hops,
    up, up_copies``.
    """
    spark = start.sparkSession
    names = [f"merkle_{what}_{uuid.uuid4().hex}" for what in ("start", "nodes")]
    start.createOrReplaceTempView(names[0])
    nodes.createOrReplaceTempView(names[1])
    with _without_row_limit(spark):
        steps = spark.sql(f"""
            WITH RECURSIVE climb(number, step, at, folded, siblings) MAX RECURSION LEVEL {rounds + 2} AS (
                SELECT number, 0, at, folded, siblings FROM {names[0]}
                UNION ALL
                SELECT c.number, c.step + 1, {_next('n.up', 'c.number', 'n.up_copies')},
                       {FOLDED.format(hops='n.hops', carried='c.folded')}, {PASSED.format(hops='n.hops')}
                FROM climb c JOIN {names[1]} n ON c.at = n.at
            ) SELECT number, step, folded, siblings FROM climb""")
        out = stored(_way(steps), "climb")
    for name in names:
        spark.catalog.dropTempView(name)
    return out


def _way(steps: DataFrame) -> DataFrame:
    """The steps of each leaf put together."""
    ways = steps.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("way"), F.max_by("folded", "step").alias("folded"))
    return ways.select("number", "folded", F.aggregate("way", F.lit(b""), lambda all_, s: F.concat(all_, s["siblings"])).alias("siblings"))


def manifest(docs: DataFrame, hashed: Sequence[str], key: str = "doc_id", source: str = "source", altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``key, leaf, subroot, root``, its proof as ``siblings`` (hex text, from below), ``folded_root`` and ``verified``.

    ``folded_root`` is what the row proves with ``altered`` columns in place of its own; without any, every row is verified.
    """
    bottom = leaves(docs, hashed, key, source, altered or {})
    bottom = stored(bottom.withColumns({"first": F.col("number"), "below": F.lit(1).cast("long")}), "bottom")
    levels, subroots = _forest(bottom, top=False)
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(subroots.count()).cast("long").alias("size"), "hash", "first", "below")
    top_levels, roots = _forest(top, top=True)
    root = (roots.select("hash").first() or [None])[0]

    start = bottom.where("size = 1").select("number", _at(F.col("number"), TOP_LEVEL).alias("at"), F.unhex("altered").alias("folded"), F.lit(b"").alias("siblings"))
    linked = [_linked(rows, False, depth) for depth, rows in enumerate(levels)]
    if linked:
        start = start.unionByName(linked[0].select(
            F.col("kid.number").alias("number"), F.expr(_next("up", "kid.number", "up_copies")).alias("at"),
            F.expr(FOLDED.format(hops="hops", carried="unhex(kid.altered)")).alias("folded"), F.expr(PASSED.format(hops="hops")).alias("siblings")))
    above = linked[1:] + [_linked(rows, True, depth) for depth, rows in enumerate(top_levels)]
    if above:
        nodes = reduce(DataFrame.unionByName, [rows.withColumn("copies", _copies("kid.below")).drop("kid") for rows in above])
        shares = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        copies = nodes.select("*", shares.alias("share")).select((F.col("at") + F.col("share") * (LEVELS * SHARE)).alias("at"), "hops", "up", "up_copies")
        ways = climb(stored(start, "start"), stored(copies, "nodes"), len(above))
    else:
        ways = start
    proven = ways.select("number", _hex("siblings").alias("siblings"), _hex("folded").alias("folded_root"))
    # Subroots come to their rows by stretches, so that a large source is no single key.
    of_piece = bottom.select("tree", "stretch").distinct().join(subroots.select("tree", F.col("hash").alias("subroot")), "tree")
    own = bottom.select("number", "tree", "stretch", F.col("key").alias(key), F.col("hash").alias("leaf")).join(of_piece, ["tree", "stretch"])
    return own.join(proven, "number").select(
        key, "leaf", "subroot", F.lit(root).alias("root"), "siblings", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def _hex(binary: str) -> Column:
    return F.lower(F.hex(binary))
