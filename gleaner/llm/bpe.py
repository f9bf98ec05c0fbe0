"""Byte-pair encoding with forced boundaries.

Two bytes that are neighbours in no token of the vocabulary can never end up in one token, so a text may be cut between
them. Fragments between such certain cuts are encoded on their own and their ids concatenated; the result is that of the
undivided text. Words (between white space) are fragments in any case, as the pre-tokenizer drops white space.

Results for odd input: a null or empty text has no ids and decodes to the empty string; repeated rows are encoded each;
ids that the vocabulary lacks are skipped by ``decode``; texts of any length are encoded whole, and long words leave the table of words
when it has ``CACHED_CHARS`` characters; other columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import set_apart, set_back

#: White space of the pre-tokenizer's pattern. Python's own split also cuts at 0x1C to 0x1F, which count as symbols there.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{BLANK}]+")
#: Texts without such characters do with a small table of letters.
_FIRST_WIDE = 0x250
_WIDE = re.compile(f"[{chr(_FIRST_WIDE)}-{chr(sys.maxunicode)}]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed value: the pattern of pieces in the vocabulary file; others are refused.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words kept with their ids per Python worker, and characters of all of them; beyond either the table starts anew.
CACHED_WORDS, CACHED_CHARS = 150_000, 6_000_000
#: Fragments of more bytes are merged on their own.
LONG_WORD = 60
NONE = 1 << 40


@lru_cache(maxsize=2)
def _pieces(below: int) -> re.Pattern:
    """PIECES, with Python's Unicode tables for the letters and digits, or a line end; for characters before ``below``."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(below))
    ranges = {k: "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", kinds)) for k in "LN"}
    return re.compile(PIECES.replace(r"\s", BLANK).replace(r"\p{L}", ranges["L"]).replace(r"\p{N}", ranges["N"]) + r"|\n")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Codec:
    """Encoder of one vocabulary file (byte-level BPE with an end-of-word suffix, lower-cased)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        steps = [s.get("pattern", {}).get("Regex") for s in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or model.get("dropout") or PIECES not in steps or spec.get("decoder"):
            raise ValueError("only vocabularies of the word-end kind are supported")
        self.end = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        # Symbols: every byte inside a word and as a word's last; merges: (left id, right id) -> rank and id.
        byte = byte_symbols()
        self.inner = np.array([ids[b] for b in byte], np.int64)
        self.last = np.array([ids[b + self.end] for b in byte], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = np.array(list(self.merges.values()), np.int64)[order].T
        # Two symbols that are neighbours in some token; a text may be cut between all others.
        width = len(byte) + 1
        code = {c: i for i, c in enumerate(byte)}
        self.neighbours = np.zeros((width, width, 2), bool)
        for token in ids:
            inside = token.removesuffix(self.end) if token != self.end else token
            at = [code[c] for c in inside if c in code]
            for k, pair in enumerate(zip(at, at[1:]), 2):
                self.neighbours[*pair, int(k == len(at) and inside != token)] = True
        self._forget()

    def _forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._starts, self._sizes, self._pool, self._used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), 0
        self._chars = 0

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        own = [self._words(t) if t else [] for t in texts]
        n = np.fromiter(map(len, own), np.int64, len(own))
        words = list(chain.from_iterable(own))
        slots = np.fromiter(map(self._slots.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new) and (len(self._slots) + len(new) > CACHED_WORDS or self._chars > CACHED_CHARS):
            self._forget()
            new = np.arange(len(words))
        if len(new):
            self._learn(list(dict.fromkeys([words[i] for i in new.tolist()])))
            slots[new] = [self._slots[words[i]] for i in new.tolist()]
        sizes = self._sizes[slots]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._pool[np.arange(total) + np.repeat(self._starts[slots] - ends + sizes, sizes)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return ids, np.diff(upto)

    def _words(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not in the table yet, all at once."""
        plain = [w for w in words if w not in self.special]
        # Letter by letter, as the library does: a capital sigma at a word's end becomes the common small one.
        text = unicodedata.normalize("NFC", "\n".join(plain)).replace("\u03a3", "\u03c3").lower()
        pieces = _pieces(sys.maxunicode + 1 if _WIDE.search(text) else _FIRST_WIDE).findall(text) if plain else []
        of_word = np.cumsum([p == "\n" for p in pieces])  # the word of each piece
        kept = [i for i, p in enumerate(pieces) if p != "\n"]
        coded = [pieces[i].encode() for i in kept]
        sizes = np.array([len(c) for c in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        # Fragments begin where a piece begins and behind each certain cut.
        at_end = np.zeros(len(raw), np.int64)
        at_end[ends] = 1
        begins = np.ones(len(raw), bool)
        if len(raw):
            begins[1:] = (at_end[:-1] == 1) | ~self.neighbours[raw[:-1], raw[1:], at_end[1:]]
        piece = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(begins)
        tokens, fragment = self._merged(symbols, np.diff(np.append(starts, len(raw))))
        word = of_word[np.array(kept, np.int64)][piece[starts][fragment]] if len(raw) else np.empty(0, np.int64)
        counts = np.bincount(word, minlength=len(plain))
        named = [w for w in words if w in self.special]
        tokens = np.concatenate([tokens, [self.special[w] for w in named]]).astype(np.int32)
        counts = np.concatenate([counts, np.ones(len(named), np.int64)]).astype(np.int64)
        first = len(self._slots)
        self._slots.update(zip(plain + named, range(first, first + len(words))))
        if self._used + len(tokens) > len(self._pool):
            self._pool = np.concatenate([self._pool[: self._used], np.empty(self._used + 2 * len(tokens), np.int32)])
        self._pool[self._used : self._used + len(tokens)] = tokens
        self._starts = np.concatenate([self._starts, self._used + np.cumsum(counts) - counts])
        self._sizes = np.concatenate([self._sizes, counts])
        self._used += len(tokens)
        self._chars += sum(map(len, words))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of merging the pairs; NONE where nothing merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.made[at]

    def _merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all fragments and the fragment of each token. Every round makes the best merge of each fragment."""
        fragment = np.repeat(np.arange(len(sizes)), sizes)
        out = []
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            begin = np.cumsum(sizes) - sizes
            for f in long.tolist():
                own = self._merge_long(symbols[begin[f] : begin[f] + sizes[f]].tolist())
                out.append((np.array(own, np.int64), np.full(len(own), f)))
            rest = (sizes <= LONG_WORD)[fragment]
            symbols, fragment = symbols[rest], fragment[rest]
        if not len(symbols):
            out.append((symbols, fragment))
        else:
            rank, made = self._rank(symbols, np.append(symbols[1:], 0))
            rank[np.append(fragment[1:] != fragment[:-1], True)] = NONE
            while len(symbols):
                starts = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
                best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
                done = best == NONE
                out.append((symbols[done], fragment[done]))
                at = np.flatnonzero((rank == best) & ~done)
                if not len(at):
                    break
                at = at[np.append(True, fragment[at][1:] != fragment[at][:-1])]  # the leftmost
                symbols[at] = made[at]
                stay = ~done
                stay[at + 1] = False
                rank[at] = rank[at + 1]  # NONE if the fragment ends there
                moved = np.cumsum(stay) - 1
                at = moved[at]
                symbols, fragment, rank, made = symbols[stay], fragment[stay], rank[stay], made[stay]
                after = np.minimum(at + 1, len(symbols) - 1)
                ok = (after > at) & (fragment[after] == fragment[at])
                rank[at] = NONE
                rank[at[ok]], made[at[ok]] = self._rank(symbols[at[ok]], symbols[after[ok]])
                before = at - 1
                ok = (at > 0) & (fragment[before] == fragment[at])
                rank[before[ok]], made[before[ok]] = self._rank(symbols[before[ok]], symbols[at[ok]])
        tokens, fragment = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(fragment, kind="stable")
        return tokens[order], fragment[order]

    def _merge_long(self, parts: list[int]) -> list[int]:
        """One long fragment with a heap and links, as rounds over it would be quadratic."""
        n, merge = len(parts), self.merges.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merge((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, token, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = token, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (m := merge((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class Decoder:
    """The tokens of a vocabulary file by their ids."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec.get("decoder"):
            raise ValueError("only vocabularies of the word-end kind are supported")
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a blank, which is what a vocabulary without a decoder gives."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=1)
def _codec(text: str) -> Codec:
    return Codec(text)


@lru_cache(maxsize=1)
def _decoder(text: str) -> Decoder:
    return Decoder(text)


def _shared(spark: SparkSession, vocabulary: str):
    """The file's text for all executors, which need no such file of their own; its size is that of a vocabulary."""
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` in the column ``ids``."""
    shared = _shared(df.sparkSession, vocabulary)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        for batch in batches:
            found, counts = codec.encode_batch(batch.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(found, pa.int32()))

    return df.withColumn(ids, encoded(F.col(text)))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the column ``ids`` (null: no ids) in the column ``text``."""
    shared = _shared(df.sparkSession, vocabulary)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(shared.value)
        for batch in batches:
            ends, values = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False)
            yield pa.array([decoder.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    return df.withColumn(text, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the token ids of ``text`` and the text decoded from them, in one pass through Python instead of two."""
    shared = _shared(df.sparkSession, vocabulary)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, decoder = _codec(shared.value), _decoder(shared.value)
        for batch in batches:
            found, counts = codec.encode_batch(batch.to_pylist())
            ends = np.cumsum([0, *counts])
            back = pa.array([decoder.decode(found[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())), back], ["ids", "decoded"])

    df, old, (text,) = set_apart(df, ("_both",), text)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (ids, decoded)]
    rows = df.select(*rest, both(F.col(text)).alias("_both"))
    return set_back(rows.select(*rest, F.col("_both.ids").alias(ids), F.col("_both.decoded").alias(decoded)), old)
