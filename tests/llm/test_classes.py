"""Class model next to plain loops: counts, classes of neighbours, likelihood, scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import brown


def corpus(seed, n=120):
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("noun", "verb", "The-", "é")]
    return [" ".join(rng.choice(kinds[j % 4]) for j in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", "same same same"]


@pytest.fixture(scope="module")
def texts(spark):
    data = corpus(3)
    return data, spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)


def sequence(lexicon, data):
    """Places of all tokens, each text with its end, after one end."""
    out = [0]
    for t in data:
        for w in brown.tokens(t):
            out.append(1 + lexicon.index[w] if w in lexicon.index else 1 + len(lexicon.words) + lexicon.group(w))
        out.append(0)
    return out


def test_scores_equal_plain_loops(spark, texts, monkeypatch):
    """Also with a head of 50 words, so that most words are beyond it."""
    data, df = texts
    for head in (brown.HEAD, 50):
        monkeypatch.setattr(brown, "HEAD", head)
        model = brown.fit(df)
        assert 0 < len(model.lexicon.words) <= head
        counts = Counter(w for t in data for w in brown.tokens(t))
        ends, v = len(data), len(counts) + 1
        n = sum(counts.values()) + ends
        lexicon, of = model.lexicon, model.classes
        assert {w: c for w, c in zip(lexicon.words, lexicon.counts)} == {w: counts[w] for w in lexicon.words}
        place = {w: sequence(lexicon, [w.decode()])[1] for w in counts}
        run = sequence(lexicon, data)
        pairs = Counter((of[a], of[b]) for a, b in zip(run, run[1:]))
        mass = Counter({0: ends + brown.ADD * 2})
        for c in range(brown.CLASSES):
            own = [x for w, x in counts.items() if of[place[w]] == c]
            mass[c] = sum(own) + (ends if c == 0 else 0) + brown.ADD * (len(own) + (c == 0) + 1)
        other = data + ["unseen words same noun1"]
        rows = brown.score(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), model).collect()
        for r in rows:
            own = [*brown.tokens(other[r.doc_id]), None]
            c = [counts[w] if w is not None else ends for w in own]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(x > 0 for x in c), n)
            assert math.isclose(r.base_score, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), rel_tol=1e-9)
            want, before = 0.0, 0
            for w, x in zip(own, c):
                to = int(of[sequence(lexicon, [w.decode()])[1]]) if w is not None else 0
                total = sum(pairs[before, k] for k in range(brown.CLASSES)) + brown.ADD * brown.CLASSES
                want += math.log10((pairs[before, to] + brown.ADD) / total * (x + brown.ADD) / mass[to])
                before = to
            assert math.isclose(r.score, want, rel_tol=1e-9)


@pytest.mark.parametrize("merged, held", [(512, 1 << 21), (2, 100)])
def test_neighbours_equal_plain_loops(spark, texts, monkeypatch, merged, held):
    """Also when rows are merged in parts and tasks pass on what they hold early."""
    monkeypatch.setattr(brown, "MERGED", merged)
    monkeypatch.setattr(brown, "HELD_NEIGHBOURS", held)
    monkeypatch.setattr(brown, "HELD_PAIRS", 50)
    data, df = texts
    lexicon = brown.head_of(brown.word_counts(df, "text"))
    of = np.arange(lexicon.size, dtype=np.int32) % brown.CLASSES
    rows = brown.neighbours(df, "text", lexicon, of)
    assert (brown.class_table(rows, of) == brown.class_bigrams(df, "text", lexicon, of, brown.CLASSES)).all()
    got = {r.place: dict(zip(r["keys"], np.frombuffer(r["counts"], "<i8").tolist())) for r in rows.collect()}
    want = {}
    run = [sequence(lexicon, [t]) for t in data]
    for a, b in [p for own in run for p in zip(own, own[1:])]:
        want.setdefault(b, Counter())[int(of[a])] += 1
        want.setdefault(a, Counter())[brown.CLASSES + int(of[b])] += 1
        if a == b:
            want[a][2 * brown.CLASSES] += 1
    assert got == {w: dict(c) for w, c in want.items()}


def test_every_round_raises_the_likelihood(spark, texts, monkeypatch):
    """From a start where most words share four classes by their last bytes."""
    for name, value in (("WORD_UNITS", 10), ("SUFFIX_UNITS", 4), ("UNITS", 15)):
        monkeypatch.setattr(brown, name, value)
    data, df = texts
    lexicon = brown.head_of(brown.word_counts(df, "text"))
    of, table, grown = brown.find_classes(df, "text", lexicon, rounds=4)
    assert len(grown) > 1 and all(a < b for a, b in zip(grown, grown[1:]))
    run = sequence(lexicon, data)
    plain = np.zeros((brown.CLASSES, brown.CLASSES))
    np.add.at(plain, (of[run[:-1]], of[run[1:]]), 1)
    assert (plain == table).all() and math.isclose(grown[-1], brown.likelihood(plain))
    assert (of[1:] != 0).all() and of[0] == 0


def test_a_move_is_the_best_of_all(spark, texts):
    """The class chosen for a word gives the highest likelihood when all others stay."""
    data, df = texts
    lexicon = brown.head_of(brown.word_counts(df, "text"))
    rng = np.random.default_rng(1)
    of = np.append(0, rng.integers(1, 6, lexicon.size - 1)).astype(np.int32)
    table = brown.class_bigrams(df, "text", lexicon, of, brown.CLASSES)
    new = brown.exchanged(brown.neighbours(df, "text", lexicon, of), table, of, 0)
    run = np.array(sequence(lexicon, data))

    def at(classes):
        t = np.zeros((brown.CLASSES, brown.CLASSES))
        np.add.at(t, (classes[run[:-1]], classes[run[1:]]), 1)
        return brown.likelihood(t)

    moved = np.flatnonzero(new != of)
    assert len(moved) > 20
    for w in moved[:10]:
        tried = [at(np.where(np.arange(len(of)) == w, c, of)) for c in range(1, brown.CLASSES)]
        assert math.isclose(max(tried), tried[new[w] - 1], rel_tol=1e-12)
