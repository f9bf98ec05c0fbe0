"""R-tree search, Merkle manifest and Jaccard join next to plain loops, odd input included."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard_join, merkle, rtree

# -- hard negatives -----------------------------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<double>, v int, id string"


def negatives_by_loops(rows, k=5, percent=80):
    rows = {(i, label, tuple(v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        alike = [(sum(int(x) * int(y) for x, y in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        alike = [(min(max(s, rtree.LEAST), rtree.MOST), j, m) for s, j, m in alike]
        alike.sort(key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in alike if r[2] == label][:k]:
            fits = [r for r in alike if r[2] != label and percent * ps <= 100 * r[0] <= 100 * ps][:k]
            out += [(i, p, n, j, ps, s) for n, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], VECTORS)
    return sorted(tuple(r) for r in rtree.hard_negatives(df, F.col("id") % 100 == 0).collect())


def test_rtree_next_to_loops(spark, monkeypatch):
    monkeypatch.setattr(rtree, "PAGE", 16)
    monkeypatch.setattr(rtree, "HELD", 4)
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (4, 6))
    rows = [(int(i), int(i % 4), (centres[i % 4] + rng.integers(-12, 12, 6)).astype(float).tolist()) for i in range(700)]
    # Ties, copies of a vector under many ids, whole repetitions, two rows of one id, odd vectors.
    rows += [(1000 + i, i % 2, [5.0] * 6) for i in range(200)] + rows[:30] + [(100, 3, [1.0] * 6), (200, 1, [2.0] * 6)]
    rows += [(None, 1, [1.0] * 6), (300, None, [1.0] * 6), (400, 1, None), (500, 1, []), (600, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1700, 1, [math.nan] * 6), (1800, 2, [math.inf] * 6)]
    rows += [(2000, 1, [3.0, 4.0]), (2001, 1, [3.0, 3.0]), (2002, 2, [3.0, 2.5]), (2100, 9, [1.0] * 6)]
    rows = [(i, m, v if not v or None in v else [float(math.floor(x)) if math.isfinite(x) else x for x in v]) for i, m, v in rows]
    assert mined(spark, rows) == negatives_by_loops(rows)
    assert mined(spark, rows)


def test_rtree_beyond_doubles(spark):
    big = [(100, 1, [2.0**40, 3.0]), (101, 1, [2.0**40, 1.0]), (102, 2, [2.0**40, 0.0]), (103, 2, [2.0**40, -1.0]), (104, 1, [2.0**70, 1.0]), (105, 2, [2.0**70, 0.0]), (106, 2, [-(2.0**70), 0.0])]
    assert mined(spark, big) == negatives_by_loops(big)
    assert mined(spark, []) == []


def test_rtree_rounds(spark, monkeypatch):
    """Earlier rounds over few pages only raise the bound."""
    for name, value in (("PAGE", 4), ("HELD", 2), ("RATIO", 3)):
        monkeypatch.setattr(rtree, name, value)
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(3)), rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(301)]
    assert mined(spark, rows) == negatives_by_loops(rows)


# -- manifest -----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string"
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = {"doc_id": row[0], "source": row[3], "lang": row[2], "n_chars": row[4], "text": text}
    return sha("".join("-" if values[c] is None else f"{len(str(values[c]).encode())}:{values[c]}" for c in HASHED))


def tree_of(nodes):
    """The last node, and the siblings of each leaf from below as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % 3
            ways[i].append((nodes[first:place], nodes[place + 1 : first + 3]))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], ways


def manifest_by_loops(rows):
    def tampered(r):
        odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[1] is None
        return leaf_of(r, r[1] if odd else r[1].replace("\n", ""))

    leaves = sorted(((r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r, r[1]), tampered(r)) for r in rows))
    groups = [list(g) for _, g in itertools.groupby(leaves, key=lambda x: x[:2])]
    trees = [tree_of([x[4] for x in g]) for g in groups]
    root, top_ways = tree_of([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(groups, trees, top_ways):
        for x, way in zip(g, ways):
            h, siblings = x[5], ""
            for left, right in way + top:
                h, siblings = sha("".join([*left, h, *right])), siblings + "".join(left + right)
            out.append((x[3] if x[2] else None, x[4], subroot, root, siblings, h, h == root))
    return sorted(out, key=str)


def proven(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    return sorted((tuple(r) for r in merkle.manifest(df, HASHED, altered=altered).collect()), key=str)


@pytest.mark.parametrize("share", [729, 2])
def test_merkle_next_to_loops(spark, monkeypatch, share):
    monkeypatch.setattr(merkle, "SHARE", share)
    rows = [(i, f"text\n{i}" if i % 3 else f"text {i}", "en", f"s{i % 7}" if i % 2 else "hot", i) for i in range(170)]
    rows += [(1, None, None, None, None), (2, "", "", "", 0), (None, "a\nb", "en", "hot", 1), (None, "a\nb", "en", "hot", 1), (7, "x\n" * 30000, "en", "één", 1), (7, "other\n", "en", "hot", 1)]
    assert proven(spark, rows) == manifest_by_loops(rows)


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_merkle_sizes(spark, n):
    rows = [(i, f"a\n{i}", "en", "one", 1) for i in range(n)]
    assert proven(spark, rows) == (manifest_by_loops(rows) if n else [])
    # Sources of one row each.
    rows = [(i, f"a\n{i}", "en", f"s{i:02}", 1) for i in range(n)]
    assert proven(spark, rows) == (manifest_by_loops(rows) if n else [])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


# -- Jaccard join -------------------------------------------------------------------------------------


def components_by_loops(rows, words=4, percent=85):
    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(own[i : i + words]) for i in range(max(len(own) - words + 1, 1 if own else 0))}

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(keys, default=None)))
    return sorted(out, key=str)


def joined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, id int, size string")
    return sorted((tuple(r) for r in jaccard_join.join(df, **settings).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = int(rng.integers(len(words)))
        kind = rng.integers(3)
        words[at : at + 1] = [] if kind == 0 and len(words) > 1 else [f"new{rng.integers(10**6)}"] if kind == 1 else [words[at], f"more{rng.integers(10**6)}"]
    return words


@pytest.mark.parametrize("limit", [None, 20])
def test_jaccard_join_next_to_loops(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, percent: limit)
    rng = np.random.default_rng(8)
    rows, passage = [], [f"p{i}" for i in range(25)]
    for n in (3, 6, 9, 12, 15, 17, 20, 26, 40, 90, 400):
        base = [f"w{n}_{i}" for i in range(n)]
        # The original has neither the first nor the last id.
        rows += [(int(rng.integers(1, 10**6)), " ".join(edited(rng, base, int(e)))) for e in (1, 1, 2, 0, 0, 1, 2, 3, 1)]
        rows.append((int(rng.integers(1, 10**6)), " ".join(base + passage)))
    # A chain: each like the next, the ends unlike.
    words = [f"c{i}" for i in range(100)]
    rows += [(2000 + i, " ".join(words[: 100 - 2 * i] + [f"d{j}" for j in range(2 * i)])) for i in range(25)]
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "alone without an id at all"), (4, "One two"), (6, "É é"), (7, "é é"), (8, "a a a a a a a"), (9, "A A A A A")]
    assert joined(spark, rows) == components_by_loops(rows)


def test_jaccard_join_edges(spark):
    assert joined(spark, []) == []
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, None)]
    assert joined(spark, rows) == [(1, 59997, 1), (2, 59998, 1), (3, 0, 3)]
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]
    # Other thresholds and word counts.
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, i % 9))) for i in range(40)]
    for settings in ({"words": 2, "percent": 60}, {"words": 1, "percent": 95}, {"words": 5, "percent": 80}):
        assert joined(spark, rows, **settings) == components_by_loops(rows, **settings)
