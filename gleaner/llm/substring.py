"""Removal of passages that occur more than once, with suffix automata of reference shards.

A *window* is a run of ``window`` words. A word is removed if some window over it has the same words as a window elsewhere,
in another text or in its own. A corpus matched against automata of all its shards would be read once per shard; instead windows
are routed to the one shard that can hold their equals, by their *seed*: the run of ``gram`` words in them with the
smallest hash, which equal windows have in common.

1. The seeds of all texts are counted (in each task first). Only windows whose seed occurs twice can be repeated. Those seeds go
   into a bit filter of a capped size that is broadcast; bits set by chance cost work, not correctness.
2. Texts stream by the filter. Neighbouring windows with one seed form a segment; segments with a repeated seed are written with their words.
   Equal segments are collapsed in each task, so copies of a passage, however many, are one reference.
3. The segments of a seed are a reference shard. A suffix automaton over them, weighted by how often each occurs, gives the
   matching statistics of each segment: which of its windows occur twice or more. Seeds too frequent for one shard (a common short
   passage) are replaced by the hash of the whole window, so shards stay small.
4. The repeated windows go back to the places of their segments; the spans are merged per text and cut out.

Results for odd input: null, empty and short texts lose nothing; a repeated row is an occurrence elsewhere, so both lose all words
if they have ``window`` words or more; a repeated word or phrase within one text counts as occurring elsewhere; an empty table gives
no rows; other columns are kept by ``cut``, whatever their names but those of its outputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import same_row, set_apart, set_back, stored, text_key

#: Segments of a seed up to which it is a shard by itself; bits of a filter at least per seed and at most in all.
SHARD, BITS_PER_SEED, MOST_BITS = 2000, 32, 1 << 28
#: Distinct segments that a task holds before it passes them on.
HELD = 20_000
_MIX, _ROLL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` word hashes."""
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _ROLL + hashes[i : i + m]
    return _mixed(out)


def seeds_of(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the seed of every window; where segments begin (windows whose seed is at another place than before)."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < window:
        return hashes, np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = _rolled(hashes, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = views.argmin(axis=1) + np.arange(len(views))
    return hashes, grams[place], np.flatnonzero(np.append(True, place[1:] != place[:-1]))


class Bits:
    """A bit filter over 64-bit hashes with two bits per member."""

    def __init__(self, size: int, words: np.ndarray):
        self.size, self.words = size, words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.size):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        return [hashes % np.uint64(size), _mixed(hashes) % np.uint64(size)]


def bit_filter(seeds: DataFrame, count: int) -> Bits:
    """The filter of a column ``seed``; its size follows their number up to a cap, beyond which more seeds pass by chance."""
    size = 1 << max(10, min(MOST_BITS.bit_length() - 1, (count * BITS_PER_SEED).bit_length()))
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(Bits.places(batch.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], schema=schema)

    rows = seeds.select("seed").mapInArrow(placed, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return Bits(size, words.view(np.uint64))


def seed_counts(docs: DataFrame, text: str, window: int, gram: int) -> DataFrame:
    """``seed, n``: the seeds that occur in two segments or more."""
    schema = pa.schema([("seed", pa.int64()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[b] for _, s, b in (seeds_of(words_of(t), window, gram) for t in batch.column(0).to_pylist())]
            seeds, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return docs.select(text).mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")


def segments(docs: DataFrame, key: str, text: str, window: int, gram: int, repeated: Bits, frequent: Bits) -> DataFrame:
    """The segments with a repeated seed, as two kinds of rows.

    Places, a row per text and distinct segment: ``_key, _digest, segment, starts``. References, a row per distinct segment of a
    task: ``shard, segment, windows, n, words``, n being how often the task has met it. ``segment`` identifies shard and words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((repeated, frequent))
    rows = docs.select(F.col(key).cast("string").alias("_key"), text_key(key, text)[1], F.col(text).alias("text"))
    fields = "_key string, _digest string, segment binary, starts array<int>, shard long, windows int, n long, words string"
    schema = pa.schema([
        ("_key", pa.string()), ("_digest", pa.string()), ("segment", pa.binary()), ("starts", pa.list_(pa.int32())), ("shard", pa.int64()),
        ("windows", pa.int32()), ("n", pa.int64()), ("words", pa.string()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = shared.value
        references: dict[bytes, dict] = {}
        for batch in batches:
            places = []
            for key_, digest, text_ in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text_)
                hashes, seeds, begins = seeds_of(words, window, gram)
                if not len(seeds) or not (candidates := repeated.has(seeds)).any():
                    continue
                hot = frequent.has(seeds) & candidates
                shards = np.where(hot, _rolled(hashes, window), seeds) if hot.any() else seeds
                new = hot.copy()
                new[begins] = True
                at = np.flatnonzero(candidates & new)
                ends = np.append(np.flatnonzero(new), len(seeds))
                own: dict[bytes, list[int]] = {}
                for i, j in zip(at.tolist(), ends[np.searchsorted(ends, at, side="right")].tolist()):
                    part = b" ".join(words[i : j + window - 1])
                    shard = int(shards[i].view(np.int64))
                    name = hashlib.md5(part + shard.to_bytes(8, "big", signed=True)).digest()
                    own.setdefault(name, []).append(i)
                    if name in references:
                        references[name]["n"] += 1
                    else:
                        references[name] = {"segment": name, "shard": shard, "windows": j - i, "n": 1, "words": part.decode()}
                places += [{"_key": key_, "_digest": digest, "segment": name, "starts": starts} for name, starts in own.items()]
            if len(references) > HELD:
                places += references.values()
                references = {}
            yield pa.RecordBatch.from_pylist(places, schema)
        yield pa.RecordBatch.from_pylist(list(references.values()), schema)

    return rows.mapInArrow(cut, fields)


class SuffixAutomaton:
    """Of several sequences, each occurring a number of times."""

    def __init__(self):
        self.follow: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list, times: int) -> None:
        at = 0
        for w in words:
            at = self._extend(at, w)
            self.count[at] += times

    def _new(self, length: int, follow: dict, link: int) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _extend(self, last: int, w) -> int:
        follow, link, length = self.follow, self.link, self.length
        q = follow[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        now = self._new(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = now
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return now

    def _split(self, p: int, w, q: int) -> int:
        """A state for the shorter strings of q, which occur at more places."""
        copy = self._new(self.length[p] + 1, dict(self.follow[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.follow[p].get(w) == q:
            self.follow[p][w] = copy
            p = self.link[p]
        return copy

    def settle(self) -> None:
        """Adds the occurrences of longer strings to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """Begins of the windows of a sequence that occur twice or more among all."""
        at, out = 0, []
        for i, w in enumerate(words):
            at = self.follow[at][w]
            if i + 1 >= window:
                while self.length[self.link[at]] >= window:
                    at = self.link[at]
                if self.count[at] > 1:
                    out.append(i + 1 - window)
        return out


def _runs(begins: list[int]) -> list[dict]:
    out: list[dict] = []
    for b in begins:
        if out and out[-1]["begin"] + out[-1]["windows"] == b:
            out[-1]["windows"] += 1
        else:
            out.append({"begin": b, "windows": 1})
    return out


def _matched(shard: list[tuple[bytes, int, int, str]], window: int) -> Iterator[tuple[bytes, list[dict]]]:
    """Runs of repeated windows of each segment of a shard."""
    if not shard:
        return
    if len(shard) == 1:
        name, windows, n, _ = shard[0]
        if n > 1:
            yield name, [{"begin": 0, "windows": windows}]
        return
    split = [s[3].encode().split() for s in shard]
    codes = {w: i for i, w in enumerate({w for words in split for w in words})}
    coded = [[codes[w] for w in words] for words in split]
    # Without two equal window hashes no automaton is needed.
    mixed = _mixed(np.arange(1, len(codes) + 1, dtype=np.uint64))
    hashes = np.concatenate([np.unique(_rolled(mixed[c], window)) for c in coded])
    if all(n == 1 for _, _, n, _ in shard) and len(np.unique(hashes)) == len(hashes) == sum(s[1] for s in shard):
        return
    automaton = SuffixAutomaton()
    for words, (_, _, n, _) in zip(coded, shard):
        automaton.add(words, n)
    automaton.settle()
    for words, (name, _, _, _) in zip(coded, shard):
        if runs := _runs(automaton.repeated(words, window)):
            yield name, runs


def matching(found: DataFrame, window: int) -> DataFrame:
    """``segment, runs``: the repeated windows of the distinct segments, shard by shard."""
    fields = "segment binary, runs array<struct<begin:int,windows:int>>"
    schema = pa.schema([("segment", pa.binary()), ("runs", pa.list_(pa.struct([("begin", pa.int32()), ("windows", pa.int32())])))])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, out = None, {}, []
        for batch in batches:
            for name, own, windows, n, words in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    out += _matched(list(shard.values()), window)
                    now, shard = name, {}
                n += shard[own][2] if own in shard else 0
                shard[own] = (own, windows, n, words)
            if out:
                yield pa.RecordBatch.from_pylist([{"segment": s, "runs": r} for s, r in out], schema)
                out = []
        out += _matched(list(shard.values()), window)
        yield pa.RecordBatch.from_pylist([{"segment": s, "runs": r} for s, r in out], schema)

    references = found.where(F.col("words").isNotNull()).select("shard", "segment", "windows", "n", "words")
    return references.repartition("shard").sortWithinPartitions("shard").mapInArrow(streamed, fields)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 12) -> DataFrame:
    """``_key, _digest, spans`` per text with repeated windows; spans are arrays of (begin, size) in words."""
    if not 0 < gram < window:
        raise ValueError("a seed has to be shorter than a window")
    counts = stored(seed_counts(docs, text, window, gram), "seeds")
    frequent = counts.where(F.col("n") > SHARD)
    filters = [bit_filter(x, x.count()) for x in (counts, frequent)]
    found = stored(segments(docs, key, text, window, gram, *filters), "segments")
    runs = matching(found, window)
    places = found.where(F.col("words").isNull()).select("_key", "_digest", "segment", "starts").join(runs, "segment")
    spans = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r: F.struct((s + r["begin"]).alias("begin"), (r["windows"] + window - 1).alias("size")))))
    return places.select("_key", "_digest", spans.alias("spans")).distinct().groupBy("_key", "_digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(text: str | None, spans: list[dict] | None) -> tuple[int, int, str]:
    words = words_of(text)
    if not spans:
        return len(words), 0, b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    begins = np.array([s["begin"] for s in spans])
    np.add.at(change, begins, 1)
    np.add.at(change, begins + np.array([s["size"] for s in spans]), -1)
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay.tolist()]).decode()


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with ``n_words, n_removed, kept``: what is left of the text, words joined by a blank."""
    docs, old, (key, text) = set_apart(docs, ("_key", "_digest", "_left", "_spans"), key, text)
    spans = repeated_spans(docs, key, text, **settings)
    rows = docs.withColumns({"_key": F.col(key).cast("string"), "_digest": text_key(key, text)[1]})
    joined = rows.join(spans, same_row(rows, spans), "left").select(*[rows[f"`{c}`"] for c in docs.columns], spans["spans"].alias("_spans"))

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def left(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = [_kept(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n_words", "n_removed", "kept"])

    done = joined.withColumn("_left", left(F.col(text), F.col("_spans")))
    done = done.withColumns({c: F.col(f"_left.{c}") for c in ("n_words", "n_removed", "kept")}).drop("_left", "_spans")
    return set_back(done, old)
