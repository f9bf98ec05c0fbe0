"""Steps whose cost must not grow faster than their input."""

import bisect
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions.similarity import lcs_length
from gleaner.llm import decontaminate
from gleaner.operators import classify, dedup, quota
from gleaner.plans import catalog, queries_sources


def test_windows_of_requests_are_running_sums(spark):
    """Many requests within one window, several at a time: right, and no frame is read again for every row."""
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("p"), F.col("id") % 2)).alias("pool"),
        F.timestamp_seconds(F.col("id") * 37 % 500).alias("ts"), (F.col("id") % 3).alias("value"))
    out = quota.quotas(df, "pool", "ts", [("p1", 40, 30)], 50, 200)
    frames = re.findall(r"specifiedwindowframe\(([^)]*)\)?,", out._jdf.queryExecution().analyzed().toString())
    assert frames and all("unboundedpreceding" in f for f in frames)
    times: dict = {}
    rows = [(i, None if i % 7 == 0 else f"p{i % 2}", i * 37 % 500) for i in range(3000)]
    for _, pool, t in rows:
        times.setdefault(pool, []).append(t)
    want = {}
    for i, pool, t in rows:
        held, (limit, window) = sorted(times[pool]), (40, 30) if pool == "p1" else (50, 200)
        first = bisect.bisect_left(held, t - window)
        n = bisect.bisect_right(held, t) - first
        want[i] = (n, max(limit - n, 0), float(max(held[first] + window - t, 0)), i % 3)
    got = {r["id"]: (r["requests"], r["remaining"], r["reset_seconds"], r["value"]) for r in out.collect()}
    assert got == want


def test_blocks_of_numbered_names_stay_small(spark):
    names = spark.range(4000).select("id", F.format_string("supplier#%09d", "id").alias("value"))
    assert dedup.block_keys(names, 0.95).groupBy("block").count().agg({"count": "max"}).first()[0] <= 40


def test_greedy_pass_over_short_and_long_names(spark):
    """Equal to a plain loop, lengths on both sides of the limit and pairs one and two characters longer included."""
    rng = random.Random(5)
    names = set()
    for _ in range(60):
        name = "".join(rng.choice("ab7\U0001F600 ") for _ in range(rng.choice([0, 1, 5, 19, 21, 26, 30, 33]))).strip()
        names.add(name)
        for _ in range(4):
            cut = rng.randrange(len(name) + 1)
            name = name[:cut] + rng.choice(["", "x", "xy"]) + name[cut + rng.choice([0, 1, 2]):]
            names.add(name)
    rows = [(i, v) for i, v in enumerate(sorted(names, key=lambda v: (len(v) * 7 % 5, v)))]
    for threshold in (0.9, 0.95):
        kept, absorbed = [], set()
        for i, v in rows:
            like = [j for j, w in kept if 2 * lcs_length(v, w) >= (threshold - 1e-12) * (len(v) + len(w))]
            absorbed.update(like[:1])
            if not like:
                kept.append((i, v))
        df = spark.createDataFrame(rows, "id bigint, name string")
        got = {r["id"] for r in dedup.fuzzy_dedup(df, "id", ["name"], threshold, "none").collect()}
        assert got == {i for i, _ in kept} - absorbed


def test_terms_leave_python_a_few_texts_at_a_time():
    texts = [None if i % 50 == 0 else f"Été {i} x x" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": texts})
    out = list(classify._counted_terms(iter([batch]), ["id", "term", "tf"]))
    assert max(b.num_rows for b in out) <= 200
    got = {(r["id"], r["term"]): r["tf"] for b in out for r in b.to_pylist()}
    want = {}
    for i, text in enumerate(texts):
        if text is not None:
            want |= {(i, "ete"): 1, (i, str(i)): 1, (i, "x"): 2}
    assert got == want


def test_texts_are_read_once_for_windows_and_counts(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame(
        [(1, " ".join(words[3:20])), (1, " ".join(words[3:20])), (2, "A b-c"), (None, "x y"), (4, None), (5, ""), (6, "- -")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", " ".join(words[5:16])), ("j", "none of these words are in any of the texts here")], "item_id string, text string")
    out = decontaminate.decontaminate(docs, items)
    assert "regexp_count" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in out.collect())
    assert got == [(0, 2, 0, []), (1, 17, 11, ["i"]), (1, 17, 11, ["i"]), (2, 3, 0, []), (4, 0, 0, []), (5, 0, 0, []), (6, 0, 0, [])]


@pytest.mark.parametrize("name", ["html_table_rows", "html_table_wide"])
def test_pages_of_customers_are_parsed_on_all_cores(spark, tmp_path, name):
    rows = spark.range(200).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%d", "id").alias("c_name"), F.lit(3).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInPandas[\s\S]*Repartition 8", plan)
    assert out.count() == (800 if name == "html_table_rows" else 400)


def test_reports_of_customers_are_cut_on_all_cores(spark, tmp_path):
    customer = spark.range(200).select(
        F.col("id").alias("c_custkey"), F.format_string("Customer#%d", "id").alias("c_name"), F.lit(3).alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    customer.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["text_table_cells_aligned"](spark, str(tmp_path))
    assert re.search(r"Repartition 8[^\n]*\n[^\n]*c_custkey", out._jdf.queryExecution().optimizedPlan().toString())
    assert out.select("id").distinct().count() == 200


def test_texts_alone_in_their_blocks_are_not_compared(spark, monkeypatch):
    """Only texts that occur in pairs go into the exact test, and the result is that of a plain loop."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = list(enumerate([*texts, texts[3] + " tail", "head " + texts[3], texts[5], None, ""]))
    shipped, verified = [], dedup._verified

    def watched(pairs, values, threshold, rounded):
        shipped.append({r["id"] for r in values.select("id").collect()})
        return verified(pairs, values, threshold, rounded)

    monkeypatch.setattr(dedup, "_verified", watched)
    df = spark.createDataFrame(rows, "id bigint, text string")
    for picked in (200_000, 0):
        shipped.clear()
        monkeypatch.setattr(dedup, "_PICKED", picked, raising=False)
        got = {(r["id"], r["leader"], r["copies"]) for r in dedup.near_duplicate_texts(df, "id", "text").collect()}
        assert got == {(40, 3, 1), (41, 3, 1), (5, 5, 2)}
        assert shipped and all(ids <= {3, 40, 41} for ids in shipped)


def test_landed_pages_share_folders(spark, tmp_path, monkeypatch):
    """One file per page, yet not one folder to list for each of them."""
    rows = [(i, f"<p>{i % 50}</p>") for i in range(300)] + [(None, "<b>x</b>"), (301, None)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    seen, read = [], queries_sources.S.read_pages

    def watched(session, path, pattern):
        folder = path.removesuffix("/*").removeprefix("file:")
        seen.extend([len([d for d in os.listdir(folder) if "=" in d]), sum(f.endswith(".txt") for _, _, fs in os.walk(folder) for f in fs)])
        return read(session, path, pattern)

    monkeypatch.setattr(queries_sources.S, "read_pages", watched)
    got = {r["html"]: r["n"] for r in catalog.QUERIES["scan_pages"](spark, str(tmp_path)).collect()}
    assert got == {f"<p>{i}</p>": 6 for i in range(50)} | {"<b>x</b>": 1, "": 1}
    assert seen[0] <= 8 and seen[1] == 302


def test_forest_keeps_the_nodes_of_its_rows(spark, monkeypatch):
    """Rows remember their nodes instead of walking every tree again for each group of nodes; the trees are the same."""
    rows = [(i, f"{'red' if i % 3 else 'blue'} w{i % 11} w{i % 7}", i * 37 % 101, "ab"[i % 5 > 1]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, text string, n bigint, kind string").coalesce(2)
    trained = lambda: classify.train(df, "id", "kind", ["text", "n"], "k", trees=4, depth=12).model.stages[0]
    forest, plain = trained(), classify.RandomForestClassifier
    assert forest.getCacheNodeIds() and forest.totalNumNodes > 20
    monkeypatch.setattr(classify, "RandomForestClassifier", lambda **options: plain(**(options | {"cacheNodeIds": False})))
    assert forest.toDebugString.split("\n", 1)[1] == trained().toDebugString.split("\n", 1)[1]
