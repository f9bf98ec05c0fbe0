"""Class-based bigram scoring (Brown classes found by the exchange algorithm).

P(text) is the product over its words and one end of P(class | class before) * P(word | class). Counts of words are exact over all
training texts, whatever their number. Each word of the head of the vocabulary (a fixed number of the most frequent words) has a class of
its own; the words beyond it, which are rare by construction, share classes by their last bytes, so that what is broadcast is bounded.

Classes are found in two steps. The exchange algorithm first moves *units*, the top words and groups of words by their last bytes,
on a table of unit bigrams whose size does not grow. Then every word of the head is exchanged: Spark counts for each the classes of
its neighbours over the whole corpus, tasks move words to the class that raises the likelihood most, half of the words per round, as
all moves of a round start from the same table. The likelihood of each round is counted anew; classes that lower it are not kept.

Scoring splits the words in the same way: the head is looked up in a broadcast table while a text streams by; the others, so that no
key is hot, are joined with their counts and summed up per text.

Results for odd input: a null or empty text has the end as its only token; repeated rows are learned from and scored each; very long texts are
read whole; words as frequent as the last one of the head are in it or beyond it together; without training texts every token scores as
unseen; an empty table gives no rows; other columns are kept, columns named like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import set_apart, set_back, stored

#: Smoothing of counts; words looked up by broadcast and their length in bytes; words and groups of words that are units; classes.
ADD, HEAD, HEAD_BYTES, WORD_UNITS, SUFFIX_UNITS, CLASSES = 0.1, 200_000, 64, 1000, 256, 64
#: Rounds in which the words of the head are exchanged, half of them in each.
ROUNDS = 2
#: Distinct words that a counting task holds before it passes them on; bigrams that it adds up at a time; neighbours of words
#: that it holds; partial counts of a word that are merged at a time.
HELD_WORDS, HELD_PAIRS, HELD_NEIGHBOURS, MERGED = 200_000, 1 << 20, 1 << 21, 512
#: Neighbours of a word: classes before, classes after, the word itself.
NEIGHBOURS = 2 * CLASSES + 1


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


@dataclass
class Lexicon:
    """The head of the vocabulary with its counts, most frequent first. Places: 0 is the end, then the words, then groups by last bytes.

    ``start`` gives the unit that each place belongs to before words are exchanged: the top words are units of their own.
    """

    words: list[bytes]
    counts: np.ndarray

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        self.size = 1 + len(self.words) + SUFFIX_UNITS
        self.logs = np.log10(np.append(self.counts, 0) + ADD)
        groups = np.fromiter((self.group(w) for w in self.words[WORD_UNITS:]), np.int64)
        top = np.arange(1 + min(len(self.words), WORD_UNITS))
        self.start = 1 + WORD_UNITS + np.concatenate([top - 1 - WORD_UNITS, groups, np.arange(SUFFIX_UNITS)])

    def __reduce__(self):
        return Lexicon, (self.words, self.counts)

    @staticmethod
    def group(word: bytes) -> int:
        return zlib.crc32(word[-3:]) % SUFFIX_UNITS

    def place(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head (-1: not there) and place of each word."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        places = at + 1
        rare = np.flatnonzero(at < 0)
        places[rare] = [1 + len(self.words) + self.group(words[i]) for i in rare.tolist()]
        return at, places


UNITS = 1 + WORD_UNITS + SUFFIX_UNITS


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all texts, counted per task before anything is shuffled."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(tokens(t))
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=schema)

    return docs.select(text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame) -> Lexicon:
    """The most frequent words, as many as fit into the head.

    A histogram of counts gives the least count that is in; words as frequent stay together, so no words are ranked in one task.
    """
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n") * 16))
    total, least = 0, None
    for step, n in sorted(short.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > HEAD:
            break
        least = step
    if least is None:
        return Lexicon([], np.zeros(0, np.int64))
    top = short.where(F.col("step") >= least).select("word", "n").toArrow()
    rows = sorted(zip((bytes(w) for w in top["word"].to_pylist()), top["n"].to_pylist()), key=lambda r: (-r[1], r[0]))
    return Lexicon([w for w, _ in rows], np.array([n for _, n in rows], np.int64))


def _flat_places(lexicon: Lexicon, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; index and place of all words in a row; the positions of the ends in the row of places with an end per text."""
    own = [tokens(t) for t in texts]
    at, places = lexicon.place(list(chain.from_iterable(own)))
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    return own, at, np.insert(places, np.cumsum(lengths), 0), np.cumsum(lengths + 1) - 1


def _place_runs(lexicon: Lexicon, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The places of the tokens of many texts, ends included, at least ``size`` at a time but for the last."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_flat_places(lexicon, batch.column(0).to_pylist())[2])
            n += len(held[-1])
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def class_bigrams(docs: DataFrame, text: str, lexicon: Lexicon, of: np.ndarray, size: int) -> np.ndarray:
    """How often a class follows another, over all texts, for a map ``of`` places to ``size`` classes (or units)."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, of))
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of = shared.value
        total = np.zeros(size * size, np.int64)
        for places in _place_runs(lexicon, batches, HELD_PAIRS):
            own = of[places]
            total += np.bincount(np.append(of[0], own[:-1]) * size + own, minlength=size * size)
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 100_000):
            part = seen[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], schema=schema)

    pairs = docs.select(text).mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(size, size)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _binaries(bounds: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Neighbours as bytes and counts as 64-bit integers, cut into binary values at ``bounds``."""
    offsets, part = (bounds - bounds[0]).astype(np.int32), slice(bounds[0], bounds[-1])
    return [
        pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(keys[part].astype(np.uint8).tobytes())]),
        pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets * 8), pa.py_buffer(counts[part].astype("<i8").tobytes())]),
    ]


def _unpacked(keys: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and count of all that the rows hold."""
    keys, counts = keys.to_pylist(), counts.to_pylist()
    rows = np.repeat(np.arange(len(keys)), np.fromiter(map(len, keys), np.int64, len(keys)))
    return rows, np.frombuffer(b"".join(keys), np.uint8).astype(np.int64), np.frombuffer(b"".join(counts), "<i8")


def _packed(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per place with its neighbours."""
    places, first = np.unique(codes // NEIGHBOURS, return_index=True)
    bounds, keys = np.append(first, len(codes)), codes % NEIGHBOURS
    for i in range(0, len(places), 20_000):
        own = _binaries(bounds[i : i + 20_001], keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(places[i : i + 20_000], pa.int32()), *own], ["place", "keys", "counts"])


def _merged(rows: DataFrame, *by: Column | str) -> DataFrame:
    @F.arrow_udf("struct<keys:binary,counts:binary>")
    def merge(parts: pa.Array) -> pa.Array:
        lengths = np.fromiter((len(x) for x in parts), np.int64, len(parts))
        inner, keys, counts = _unpacked(*parts.flatten().flatten())
        codes = np.repeat(np.arange(len(parts)), lengths)[inner] * NEIGHBOURS + keys
        total = np.bincount(codes, counts, len(parts) * NEIGHBOURS).astype(np.int64)
        seen = np.flatnonzero(total)
        bounds = np.searchsorted(seen, np.arange(len(parts) + 1) * NEIGHBOURS)
        return pa.StructArray.from_arrays(_binaries(bounds, seen % NEIGHBOURS, total[seen]), ["keys", "counts"])

    grouped = rows.groupBy("place", *by).agg(F.collect_list(F.struct("keys", "counts")).alias("parts"))
    return grouped.select("place", merge("parts").alias("m")).select("place", "m.keys", "m.counts")


def class_table(rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """The bigrams of classes from the neighbours of all words, counted under the same classes."""
    shared = rows.sparkSession.sparkContext.broadcast(of)
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            row, keys, counts = _unpacked(batch.column(1), batch.column(2))
            after = (keys >= CLASSES) & (keys < 2 * CLASSES)
            own = shared.value[batch.column(0).to_numpy()][row[after]].astype(np.int64)
            total += np.bincount(own * CLASSES + keys[after] - CLASSES, counts[after], CLASSES * CLASSES)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen].astype(np.int64))], schema=schema)

    pairs = rows.mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def neighbours(docs: DataFrame, text: str, lexicon: Lexicon, of: np.ndarray) -> DataFrame:
    """``place, keys, counts``: how often each class stands before and after each word, and the word next to itself.

    A row holds at most 2 * CLASSES + 1 counts, and a task gives one row per word and some million neighbours. Where there are
    many tasks, the rows of a word are merged in parts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, of))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of = shared.value
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for right in _place_runs(lexicon, batches, HELD_PAIRS):
            left = np.append(0, right[:-1])
            codes = np.concatenate([
                right * NEIGHBOURS + of[left], left * NEIGHBOURS + CLASSES + of[right], right[left == right] * NEIGHBOURS + 2 * CLASSES])
            new, n = np.unique(codes, return_counts=True)
            held, counts = _summed(np.concatenate([held, new]), np.concatenate([counts, n]))
            if len(held) > HELD_NEIGHBOURS:
                yield from _packed(held, counts)
                held, counts = held[:0], counts[:0]
        yield from _packed(held, counts)

    rows = docs.select(text).mapInArrow(counted, "place int, keys binary, counts binary")
    if docs.rdd.getNumPartitions() > MERGED:
        rows = _merged(rows, (F.spark_partition_id() / MERGED).cast("int").alias("part"))
    return stored(_merged(rows), "neighbours")


def exchanged(rows: DataFrame, bigrams: np.ndarray, of: np.ndarray, part: int) -> np.ndarray:
    """One round: each word whose place falls into ``part`` of two moves to its best class, given the classes of all others."""
    shared = rows.sparkSession.sparkContext.broadcast((bigrams, of))
    schema = pa.schema([("place", pa.int32()), ("to", pa.int32())])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bigrams, of = shared.value
        lsum, rsum = bigrams.sum(axis=1), bigrams.sum(axis=0)
        for batch in batches:
            places, to = [], []
            for w, keys, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if w == 0 or zlib.crc32(b"%d" % w) % 2 != part:
                    continue
                n = np.zeros(NEIGHBOURS)
                n[np.frombuffer(keys, np.uint8)] = np.frombuffer(counts, "<i8")
                before, after, own = n[:CLASSES], n[CLASSES : 2 * CLASSES], n[2 * CLASSES]
                left, right = after.sum(), before.sum()
                before[of[w]] -= own
                after[of[w]] -= own
                table, ls, rs = bigrams.copy(), lsum.copy(), rsum.copy()
                take_out(table, ls, rs, of[w], before, after, own, left, right)
                b = best_class(table, ls, rs, of[w], before, after, own, left, right)
                if b != of[w]:
                    places.append(w)
                    to.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(to, pa.int32())], schema=schema)

    moves = rows.mapInArrow(moved, "place int, to int").toArrow()
    out = of.copy()
    out[moves["place"].to_numpy()] = moves["to"].to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood of the class model that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def take_out(table, lsum, rsum, a, before, after, own, left, right) -> None:
    """Takes a word out of its class ``a``; ``before`` and ``after`` count its neighbours by class, without itself."""
    table[:, a] -= before
    table[a] -= after
    table[a, a] -= own
    lsum[a] -= left
    rsum[a] -= right


def best_class(table, lsum, rsum, a, before, after, own, left, right) -> int:
    """The class to which a word that was taken out of ``a`` adds most; ``a`` unless another one is better. Never class 0, the end's."""
    now = _xlogx(table)
    into, out_of = _xlogx(table + before[:, None]) - now, _xlogx(table + after[None, :]) - now
    diagonal = table.diagonal()
    gain = into.sum(axis=0) - into.diagonal() + out_of.sum(axis=1) - out_of.diagonal()
    gain += _xlogx(diagonal + before + after + own) - _xlogx(diagonal)
    gain -= _xlogx(lsum + left) - _xlogx(lsum) + _xlogx(rsum + right) - _xlogx(rsum)
    gain[0] = -np.inf
    return int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else int(a)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """The class of each unit. The end keeps a class of its own, 0; every other unit moves to its best class in turn."""
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    order = np.argsort(-right, kind="stable")
    order = order[order != 0]
    of = np.zeros(len(bigrams), np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    hot = np.eye(classes)[of]
    table = hot.T @ bigrams @ hot
    lsum, rsum = hot.T @ left, hot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            if not left[w] and not right[w]:
                continue
            a, own = of[w], bigrams[w, w]
            before = np.bincount(of, bigrams[:, w], classes)
            after = np.bincount(of, bigrams[w], classes)
            before[a] -= own
            after[a] -= own
            take_out(table, lsum, rsum, a, before, after, own, left[w], right[w])
            b = best_class(table, lsum, rsum, a, before, after, own, left[w], right[w])
            table[:, b] += before
            table[b] += after
            table[b, b] += own
            lsum[b] += left[w]
            rsum[b] += right[w]
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


def find_classes(docs: DataFrame, text: str, lexicon: Lexicon, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each place, the bigrams of classes, and the likelihood of the start and of each round kept."""
    units = class_bigrams(docs, text, lexicon, lexicon.start, UNITS)
    unit_classes = exchange(units)
    hot = np.eye(CLASSES)[unit_classes]
    of, table = unit_classes[lexicon.start].astype(np.int32), hot.T @ units @ hot
    grown = [likelihood(table)]
    rows = neighbours(docs, text, lexicon, of) if rounds else None
    for n in range(rounds):
        moved = exchanged(rows, table, of, n % 2)
        # What the next round needs gives the bigrams of this one; the last round counts only those.
        more = neighbours(docs, text, lexicon, moved) if n < rounds - 1 else None
        new = class_bigrams(docs, text, lexicon, moved, CLASSES) if more is None else class_table(more, moved)
        if likelihood(new) > grown[-1]:
            of, table, rows = moved, new, more
            grown.append(likelihood(table))
    return of, table, grown


@dataclass
class Model:
    """``counts`` is the stored table of all words; the rest has a fixed size."""

    counts: DataFrame
    lexicon: Lexicon
    classes: np.ndarray  # of each place of the lexicon
    follow: np.ndarray  # log10 P(class | class before) - log10 of the normaliser of the class's words
    n_tokens: int
    n_types: int
    end_count: int
    likelihoods: list[float]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learns from all texts of ``docs``."""
    counts = stored(word_counts(docs, text), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.count()
    lexicon = head_of(counts)
    classes, bigrams, likelihoods = find_classes(docs, text, lexicon)
    # Tokens and types of each place: those of the groups are what the words of the head leave of all words with their last bytes.
    suffix = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")) % SUFFIX_UNITS
    sums = counts.groupBy(suffix.cast("int")).agg(F.sum("n"), F.count("*")).collect()
    group_tokens, group_types = np.zeros(SUFFIX_UNITS), np.zeros(SUFFIX_UNITS)
    for group, tokens_, types in sums:
        group_tokens[group], group_types[group] = tokens_, types
    own = np.fromiter(map(lexicon.group, lexicon.words), np.int64, len(lexicon.words))
    group_tokens -= np.bincount(own, lexicon.counts, SUFFIX_UNITS)
    group_types -= np.bincount(own, minlength=SUFFIX_UNITS)
    place_tokens = np.concatenate([[ends], lexicon.counts, group_tokens])
    place_types = np.concatenate([[int(ends > 0)], np.ones(len(lexicon.words)), group_types])
    table = bigrams + ADD
    words = np.log10(np.bincount(classes, place_tokens, CLASSES) + ADD * (np.bincount(classes, place_types, CLASSES) + 1))
    follow = np.log10(table / table.sum(axis=1, keepdims=True)) - words[None, :]
    return Model(counts, lexicon, classes, follow, int(n) + ends, int(v) + int(ends > 0), ends, likelihoods)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens, n_known, train_tokens, base_score, score, perplexity``; scores in log10."""
    docs, old, (text,) = set_apart(docs, ("_p", "_row", "more", "more_logs"), text)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]
    shared = spark.sparkContext.broadcast((model.lexicon, model.classes, model.follow, model.end_count))

    @F.arrow_udf("struct<n:bigint,known:bigint,logs:double,follow:double,rare:array<binary>,times:array<int>>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon, classes, follow, end_count = shared.value
        for batch in batches:
            own, at, places, ends = _flat_places(lexicon, batch.to_pylist())
            of = classes[places]
            upto = np.cumsum(follow[np.append(0, of[:-1]), of]) if len(of) else np.zeros(0)
            followed = np.diff(upto[ends], prepend=0)
            logs = np.concatenate([[0], np.cumsum(np.where(at < 0, 0, lexicon.logs[at]))])
            known = np.concatenate([[0], np.cumsum(at >= 0)])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            rare = [Counter([x[i] for i in np.flatnonzero(at[a:b] < 0).tolist()]) for x, a, b in zip(own, bounds, bounds[1:])]
            yield pa.StructArray.from_arrays([
                pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(np.diff(known[bounds]) + int(end_count > 0), pa.int64()),
                pa.array(np.diff(logs[bounds]) + np.log10(end_count + ADD), pa.float64()), pa.array(followed, pa.float64()),
                pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32())),
            ], ["n", "known", "logs", "follow", "rare", "times"])

    rows = stored(docs.select(*[F.col(f"`{c}`") for c in kept], placed(F.coalesce(F.col(text), F.lit(""))).alias("_p")).withColumn("_row", F.monotonically_increasing_id()), "placed")
    rare = rows.select("_row", F.explode(F.arrays_zip("_p.rare", "_p.times")).alias("x")).select("_row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(model.counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("more_logs"),
    )
    logs = F.col("_p.logs") + F.coalesce("more_logs", F.lit(0.0))
    whole = float(np.log10(model.n_tokens + ADD * (model.n_types + 1)))
    total: Column = logs + F.col("_p.follow")
    scored = rows.join(found, "_row", "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col("_p.n").alias("n_tokens"), (F.col("_p.known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), (logs - F.col("_p.n") * whole).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("_p.n")).alias("perplexity"),
    )
    return set_back(scored, old)
