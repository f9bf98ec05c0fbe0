"""Hard negatives by an R-tree over vectors, packed by sort-tile-recursive.

Packing: the coordinates with the largest variance cut the rows into slabs, these into strips and these into tiles of equal size; the cuts
are quantiles of a sample of about ``SAMPLE`` rows (the only thing fitted on a sample; every row is indexed), told apart by id where values
are equal, so that rows of one vector do not land in one tile. A tile is sorted by the next coordinate and cut into pages of ``PAGE`` rows.
A page is a row of a stored table: its minimum bounding box and its vectors.

Search: a box gives an interval for each coordinate and with it for the inner product with an anchor. Each task packs the boxes of its pages
into upper nodes and keeps a best-first queue for every anchor: nodes come in the order of the best score they may hold inside the wanted
window, and are left out if their interval misses the window or ends strictly below the k-th score found. What the tasks find is merged. If
there are many pages, one in ``RATIO`` to the power of r is searched first, so that later rounds start with a k-th score and return little.
Nothing is approximate: the search finds what comparing all rows would.

Anchors are searched for in blocks of bounded bytes, against all pages each. Scores are exact integers: vectors whose products pass 2^53 are
multiplied with Python's integers and not pruned.

Results for odd input: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; rows that are
repeated whole count once; different rows that share an id all take part, and no row is a partner of an anchor with its id; vectors meet
those of the same length only; scores beyond 64 bits are the largest or smallest long; ties go to the smaller id; an anchor without other rows
of its label, and a positive without rows in its window, have no rows; an empty table has none; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import shared_folder, stored

#: Rows of a page; pages that a task holds at a time; pages below an upper node.
PAGE, HELD, NODE = 1024, 64, 8
#: Rows that the cuts are fitted on, about; tiles at most.
SAMPLE, TILES = 20_000, 2048
#: Coordinates that tiles are cut by.
CUTS = 3
#: Bytes of anchors that are searched for at a time.
BLOCK_BYTES = 1 << 23
#: Each round of the search has so many times the pages of the one before; the first has about ``HELD``.
RATIO = 16
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``id, label, v`` of the rows that take part, each once."""
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(good).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")).distinct()


# -- packing ------------------------------------------------------------------------------------------


class Cuts:
    """Slabs, strips and tiles by quantiles of a sample."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tiles: int):
        self.axes = np.argsort(-vectors.var(axis=0), kind="stable")[:CUTS] if len(ids) else np.arange(min(CUTS, vectors.shape[1]))
        # Coordinates by which a tile is sorted on come after those it is cut by.
        self.per_axis = max(1, round(min(tiles, TILES) ** (1 / len(self.axes))))
        self.tree = self._cut(ids, vectors, 0)

    def _cut(self, ids, vectors, depth):
        if depth == len(self.axes):
            return None
        order = np.lexsort((ids, vectors[:, self.axes[depth]]))
        parts = np.array_split(order, self.per_axis)
        bounds = [(vectors[p[-1], self.axes[depth]], ids[p[-1]]) for p in parts[:-1] if len(p)]
        return bounds, [self._cut(ids[p], vectors[p], depth + 1) for p in parts[: len(bounds) + 1]]

    def tiles(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        self._place(self.tree, ids, vectors, np.arange(len(ids)), 0, out)
        return out

    def _place(self, node, ids, vectors, rows, depth, out):
        if node is None or not len(rows):
            return
        bounds, below = node
        at, own = vectors[rows, self.axes[depth]], ids[rows]
        part = np.zeros(len(rows), np.int64)
        for value, key in bounds:
            part += (at > value) | ((at == value) & (own > key))
        out[rows] = out[rows] * self.per_axis + part
        for i, child in enumerate(below):
            self._place(child, ids, vectors, rows[part == i], depth + 1, out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def pack(rows: DataFrame, width: int) -> DataFrame:
    """The pages of an R-tree over ``id, label, v`` of ``width`` components: ``page, low, high, ids, labels, vectors``."""
    n = rows.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1 << 30, int(SAMPLE / max(n, 1) * (1 << 30)) + 1)
    sample = rows.where(share).select("id", "v").toArrow()
    vectors = _matrix(sample.column("v").combine_chunks(), width) if sample.num_rows else np.empty((0, width))
    cuts = Cuts(sample.column("id").to_numpy(), vectors, -(-n // PAGE))
    by = int(cuts.axes[-1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tile = cuts.tiles(batch.column(0).to_numpy(), _matrix(batch.column(2), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], ["id", "label", "v", "tile"])

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def page():
            ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            v = np.concatenate([h[2] for h in held])
            cells = [[now], [v.min(axis=0).tolist()], [v.max(axis=0).tolist()], [ids.tobytes()], [labels.tobytes()], [np.ascontiguousarray(v).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, PAGE_TYPES)], PAGE_NAMES)

        for batch in batches:
            ids, labels, v, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width), batch.column(3).to_numpy()
            at = 0
            while at < len(ids):
                room = PAGE - sum(len(h[0]) for h in held)
                if held and (tiles[at] != now or room == 0):
                    yield page()
                    held, room = [], PAGE
                now = int(tiles[at])
                end = min(at + room, at + int(np.searchsorted(tiles[at:], now, side="right")))
                held.append((ids[at:end].copy(), labels[at:end].copy(), v[at:end].copy()))
                at = end
        if held:
            yield page()

    dealt = rows.select("id", "label", "v").mapInArrow(placed, "id long, label long, v array<double>, tile long")
    pages = dealt.repartition("tile").sortWithinPartitions("tile", F.col("v")[by], "id").mapInArrow(paged, "tile long, low array<double>, high array<double>, ids binary, labels binary, vectors binary")
    return stored(pages.withColumn("page", F.monotonically_increasing_id()), "pages")


PAGE_NAMES = ["tile", "low", "high", "ids", "labels", "vectors"]
PAGE_TYPES = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]


# -- search -------------------------------------------------------------------------------------------


class Best:
    """The first ``k`` of what was found for a window of an anchor, best first, ties by id."""

    __slots__ = ("low", "high", "k", "scores", "ids")

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """Below this score nothing can be among the first any more."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        # ~ turns the order of scores round without leaving 64 bits.
        order = np.lexsort((ids, ~scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Tree:
    """Upper nodes over some pages, and what their boxes say of all anchors."""

    def __init__(self, pages: list[dict], anchors: np.ndarray):
        self.pages, self.largest = pages, max(np.abs(anchors).max(initial=0), 1)
        low, high = np.array([p["low"] for p in pages]), np.array([p["high"] for p in pages])
        first = np.arange(0, len(pages), NODE)
        self.nodes = [range(i, min(i + NODE, len(pages))) for i in first]
        self.page_bounds = self._bounds(low, high, anchors)
        self.node_bounds = self._bounds(np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), anchors)
        self.cache: dict[int, np.ndarray] = {}

    def _bounds(self, low, high, anchors):
        """Least and largest inner products of each anchor with a box, from the interval of each coordinate."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        vague = np.maximum(np.abs(low).max(axis=1), np.abs(high).max(axis=1)) * self.largest * low.shape[1] >= EXACT
        least[:, vague], most[:, vague] = -np.inf, np.inf
        return least, most

    def scores(self, page: int, anchor: np.ndarray) -> np.ndarray:
        if page not in self.cache:
            v = self.pages[page]["v"]
            if max(abs(v.max()), abs(v.min())) * self.largest * v.shape[1] < EXACT:
                self.cache[page] = (v @ anchor).astype(np.int64)
            else:
                whole = [int(x) for x in anchor]
                self.cache[page] = np.array([min(max(sum(int(x) * y for x, y in zip(row, whole)), LEAST), MOST) for row in v.tolist()], np.int64)
        return self.cache[page]

    def search(self, a: int, anchor: np.ndarray, own: int, label: int, same: bool, best: Best) -> None:
        """Best-first: the queue is ordered by the best score a node may hold inside the window."""
        def push(bounds, level, numbers):
            least, most = bounds
            for i in numbers:
                if most[a, i] >= best.least() and least[a, i] <= best.high:
                    heapq.heappush(queue, (-min(most[a, i], best.high), level, i))

        queue: list = []
        push(self.node_bounds, 0, range(len(self.nodes)))
        while queue:
            reach, level, i = heapq.heappop(queue)
            if -reach < best.least():
                return
            if level == 0:
                push(self.page_bounds, 1, self.nodes[i])
                continue
            page, scores = self.pages[i], self.scores(i, anchor)
            fits = (scores >= best.least()) & (scores <= best.high) & ((page["labels"] == label) == same) & (page["ids"] != own)
            if fits.any():
                best.add(scores[fits], page["ids"][fits])


def _searcher(block, same: bool, k: int):
    """For pages: ``query, slot, id, score``, the first ``k`` of the task's pages for every window of every anchor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, windows = block.value
        found = [[Best(low, high, k) for low, high in own] for own in windows]

        def run(pages):
            tree = Tree(pages, vectors)
            for a, best in enumerate(found):
                tree.cache = {}
                for one in best:
                    if one.low <= one.high:
                        tree.search(a, vectors[a], ids[a], labels[a], same, one)

        held = []
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"]).reshape(-1, vectors.shape[1])
                held.append({"low": row["low"], "high": row["high"], "v": v, "ids": np.frombuffer(row["ids"], np.int64), "labels": np.frombuffer(row["labels"], np.int64)})
                if len(held) == HELD:
                    run(held)
                    held = []
        if held:
            run(held)
        rows = [(a, s, b.ids, b.scores) for a, own in enumerate(found) for s, b in enumerate(own) if len(b.ids)]
        if rows:
            n = [len(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([r[0] for r in rows], n)), pa.array(np.repeat([r[1] for r in rows], n)),
                pa.array(np.concatenate([r[2] for r in rows])), pa.array(np.concatenate([r[3] for r in rows]))], ["query", "slot", "id", "score"])

    return search


def first_of_all(pages: DataFrame, n_pages: int, block: tuple, same: bool, k: int) -> DataFrame:
    """``query, slot, rank, id, score``: the first ``k`` of all pages for every window. ``block``: ids, labels, vectors, windows of anchors."""
    context = pages.sparkSession.sparkContext
    ids, labels, vectors, windows = block
    rounds = max(0, math.ceil(math.log(max(n_pages, 1) / HELD, RATIO)))
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id")
    for r in range(rounds, -1, -1):
        some = pages.where(F.pmod(F.xxhash64("page"), F.lit(RATIO**r)) == 0) if r else pages
        spec = context.broadcast((ids, labels, vectors, windows))
        found = some.select("low", "high", "ids", "labels", "vectors").mapInArrow(_searcher(spec, same, k), "query long, slot long, id long, score long")
        first = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "first")
        if r:
            # A k-th score found so far is a bound for all pages.
            for row in first.where(F.col("rank") == k).select("query", "slot", "score").collect():  # windows of one block
                low, high = windows[row["query"]][row["slot"]]
                windows[row["query"]][row["slot"]] = (max(low, row["score"]), high)
    return first


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds of ``id``.

    An anchor's positives are the best other rows of its label; a negative of another label scores from ``percent`` per cent of the
    positive's score up to that score. ``vector`` holds whole numbers.
    """
    spark = rows.sparkSession
    own = stored(usable(rows, key, label, vector), "vectors")
    path = shared_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for width in sorted(r[0] for r in own.select(F.size("v")).distinct().collect()):
        alike = own.where(F.size("v") == width)
        pages = pack(alike, width)
        n_pages = pages.count()
        asked = alike.where(anchors)
        blocks = max(1, -(-asked.count() * width * 8 // BLOCK_BYTES))
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "anchors")
        for b in range(blocks):
            block = asked.where(F.col("block") == b).orderBy("id", "label", "v").toArrow()
            if not block.num_rows:
                continue
            ids, labels = block.column("id").to_numpy(), block.column("label").to_numpy()
            vectors = _matrix(block.column("v").combine_chunks(), width)
            first = first_of_all(pages, n_pages, (ids, labels, vectors, [[(LEAST, MOST)] for _ in ids]), True, positives)
            near = first.orderBy("query", "rank").collect()  # the positives of one block
            best: list[list] = [[] for _ in ids]
            for row in near:
                best[row["query"]].append((row["id"], row["score"]))
            windows = [[(-(-percent * score // 100), score) for _, score in own_] for own_ in best]
            found = first_of_all(pages, n_pages, (ids, labels, vectors, windows), False, negatives)
            names = spark.createDataFrame([(a, s, int(ids[a]), *p) for a, own_ in enumerate(best) for s, p in enumerate(own_)], "query long, slot long, anchor_id long, positive_id long, positive_score long")
            # As many rows as the block has positives.
            out = found.join(F.broadcast(names), ["query", "slot"])
            out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
