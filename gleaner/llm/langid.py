"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords (runs of two to four bytes inside words, hashed to buckets).
Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows
(``max_rows``, spread over all languages, however many there are; a language that none of those rows has is not learned); counts of
languages are taken over all rows. Part of the sample calibrates: it sets the
temperature of the softmax and the two limits of rejection:

* the score, a third of the way from chance to what a share of ``reject_share`` of known texts stays below;
* the familiarity, the share of a text's subwords that occur in more than a share of ``USUAL`` of the examples of the language it is taken
  for. How an unknown language looks is seen from known ones: held-out texts under the tables of all languages but their own. The limit is
  half way between what nine in ten of those stay below and what a share of ``reject_share`` of texts stays below under their own table, and
  never above the latter. ``DOUBT`` subwords count as familiar in every text, so that a few rare names do not reject a short one.

Texts are read whole. As the average is linear, a trained model is one table of logits per bucket; scoring a text is one
histogram of buckets times that table.

Results for odd input: a null text, or one without letters, is ``und`` with score 0; rows without a label are not learned
from; repeated rows are scored each; ties go to the first language in alphabetical order; without any labelled row every text is
``und``; other columns are kept, columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import set_apart, set_back, small_side, stored

BUCKETS, SIZES = 1 << 15, (2, 3, 4)
DOUBT, USUAL = 50, 0.05
UNKNOWN = "und"
#: Bytes of a text that are hashed at a time, so that very long texts take bounded memory.
STEP = 1 << 20
#: ASCII letters in small, other ASCII characters as blanks, all other bytes as they are.
_FOLDED = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def histogram(text: str) -> np.ndarray:
    """How often each bucket occurs among the subwords of ``text``."""
    raw = _FOLDED[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP + max(SIZES) - 1].astype(np.uint32)
        blank = part == 32
        for n in SIZES:
            m = min(len(part) - n + 1, STEP)
            if m <= 0:
                continue
            value = part[:m].copy()
            inside = np.ones(m, bool)
            for i in range(1, n):
                value |= part[i : i + m] << np.uint32(8 * i)
                if i < n - 1:
                    inside &= ~blank[i : i + m]
            inside &= ~(blank[:m] & blank[n - 1 : n - 1 + m])
            mixed = (value[inside] + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(32 - 15), minlength=BUCKETS)
    return counts


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """``logits``: a row per bucket, a column per language, already divided by the temperature; ``seen``: which buckets a language usually has."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    reject_below: float
    seen: np.ndarray
    least_familiar: float

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """The likeliest language, its probability, and whether that is to be believed."""
        if not self.languages or not has_letters(text):
            return UNKNOWN, 0.0, False
        counts = histogram(text)
        used = np.flatnonzero(counts)
        p = _softmax(counts[used] @ self.logits[used] / max(1, counts[used].sum()) + self.bias)
        best = int(p.argmax())
        known = familiarity(counts[used][self.seen[used, best]].sum(), counts[used].sum())
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below and known >= self.least_familiar)


def familiarity(seen, n):
    """The share of subwords that were seen before, with some doubt in favour of the text."""
    return (seen + DOUBT) / (n + DOUBT)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame, key: str, text: str, lang: str, max_rows: int) -> pa.Table | None:
    """``lang, part, n, whole, buckets, shares``: about ``max_rows`` labelled rows, the same number of each language as far as there are.

    Rows are drawn by a hash of their key and text against a rate from exact counts. Texts become histograms on the
    executors; each gives two examples, itself and a short passage.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = stored(known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("rows")), "languages")
    n_languages = counts.count()
    if not n_languages:
        return None
    rates = counts.select("lang", F.least(F.lit(1.0), F.lit(max_rows / n_languages) / F.col("rows")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.length(text)), F.lit(1_000_003)) / 1_000_003.0
    drawn = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    drawn = drawn.join(small_side(rates, n_languages), "lang").where("draw < rate").select("lang", "text", "draw")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in schema.names}
            for row in batch.to_pylist():
                if not has_letters(row["text"]):
                    continue
                n = len(row["text"])
                begin = int(row["draw"] * 7919 * n) % max(1, n - 60)
                for whole, passage in ((True, row["text"]), (False, row["text"][begin : begin + 20 + int(row["draw"] * 104_729) % 60])):
                    counts = histogram(passage)
                    used = np.flatnonzero(counts)
                    if len(used):
                        out["lang"].append(row["lang"])
                        out["part"].append(int(row["draw"] * 1_000_003 + 0.5))
                        out["n"].append(int(counts[used].sum()))
                        out["whole"].append(whole)
                        out["buckets"].append(used.astype(np.int16))
                        out["shares"].append((counts[used] / counts[used].sum()).astype(np.float32))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_()), ("buckets", pa.list_(pa.int16())), ("shares", pa.list_(pa.float32()))])
    return drawn.mapInArrow(examples, "lang string, part int, n long, whole boolean, buckets array<smallint>, shares array<float>").toArrow()


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 2000,
          dim: int = 16, epochs: int = 6, rate: float = 20.0, reject_share: float = 0.001) -> Model:
    """A model from at most about ``max_rows`` labelled rows."""
    rows = sample(docs, key, text, lang, max_rows)
    if rows is None or not rows.num_rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0, np.zeros((BUCKETS, 0), bool), 0.0)
    rows = rows.append_column("size", pa.compute.list_value_length(rows["buckets"]))  # sorted, so that training repeats
    rows = rows.sort_by([("part", "ascending"), ("lang", "ascending"), ("size", "ascending")]).combine_chunks()
    languages = sorted(set(rows["lang"].to_pylist()))
    label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    buckets_, shares_ = (rows[c].combine_chunks() for c in ("buckets", "shares"))
    bounds = buckets_.offsets.to_numpy()
    all_buckets, all_shares = buckets_.values.to_numpy(), shares_.values.to_numpy()[:, None]
    xs = [(all_buckets[i:j], all_shares[i:j]) for i, j in zip(bounds, bounds[1:])]
    held = rows["part"].to_numpy() % 10 == 0
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learned = np.flatnonzero(~held) if (~held).any() else np.arange(len(xs))
    step, steps = 0, epochs * len(learned)
    for _ in range(epochs):
        for i in rng.permutation(learned):
            buckets, shares = xs[i]
            mean = (embedding[buckets] * shares).sum(axis=0)
            error = _softmax(mean @ weight + bias)
            error[label[i]] -= 1
            now = rate * (1 - step / steps)
            back = weight @ error
            weight -= now * 0.05 * np.outer(mean, error)
            bias -= now * 0.001 * error
            embedding[buckets] -= now * shares * back
            step += 1
    logits = embedding @ weight
    check = np.flatnonzero(held) if held.any() else learned
    raw = np.array([(logits[xs[i][0]] * xs[i][1]).sum(axis=0) + bias for i in check])
    heat = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(raw / t)[np.arange(len(check)), label[check]] + 1e-12).mean())
    top = _softmax(raw / heat).max(axis=1)
    chance = 1 / len(languages)
    held_by = np.zeros((BUCKETS, len(languages)), np.int32)  # examples with a bucket
    for i in learned:
        held_by[xs[i][0], label[i]] += 1
    seen = held_by > np.floor(USUAL * np.bincount(label[learned], minlength=len(languages)))
    whole, sizes = rows["whole"].to_numpy(), rows["n"].to_numpy()
    shares = {i: (seen[xs[i][0]] * xs[i][1]).sum(axis=0) for i in check if whole[i]}  # per language, of whole texts
    own = [familiarity(s[label[i]] * sizes[i], sizes[i]) for i, s in shares.items()]
    foreign = [familiarity(np.delete(s, label[i]).max(initial=0) * sizes[i], sizes[i]) for i, s in shares.items()]
    usual, unknown = (float(np.quantile(*x)) for x in ((own, reject_share), (foreign, 0.9))) if own else (0.0, 0.0)
    least = min(usual, (usual + unknown) / 2)
    reject_below = (2 * chance + float(np.quantile(top, reject_share))) / 3
    return Model(languages, (logits / heat).astype(np.float32), bias / heat, reject_below, seen, least)


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score",
            accepted: str = "accepted") -> DataFrame:
    """``docs`` with the likeliest language of ``text``, its calibrated probability, and whether neither score nor familiarity reject it."""
    docs, old, (text,) = set_apart(docs, ("_scored",), text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shared.value.score(t) for t in batch.to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(columns, ["lang", "score", "accepted"])

    rows = docs.withColumn("_scored", scored(F.col(text)))
    return set_back(rows.withColumns({lang: F.col("_scored.lang"), score: F.col("_scored.score"), accepted: F.col("_scored.accepted")}).drop("_scored"), old)


def only_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their columns."""
    docs, old, (text,) = set_apart(docs, ("_lang", "_score", "_accepted"), text)
    rows = predict(docs, model, text, "_lang", "_score", "_accepted")
    return set_back(rows.where("_accepted").drop("_lang", "_score", "_accepted"), old)
