"""Forests that are grown outside the driver: the trees of Spark ML, however the rows are dealt, and whole when saved."""

import sys
import unicodedata

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gleaner.operators import classify, forest
from gleaner.session import cut_lineage

N = 1200


@pytest.fixture(scope="module")
def points():
    """Values, many of them zero, and noisy classes."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(N, 5)), 2)
    x[:, 2:] *= rng.random((N, 3)) < 0.3
    x[:, 1], x[:, 4] = rng.integers(0, 5, N), 1.0
    return x, ((x[:, 0] > 0).astype(int) + (x[:, 2] > 0.2) + (rng.random(N) < 0.2)) % 3


@pytest.fixture(scope="module")
def frame(spark, points):
    rows = [(float(y), [float(v) for v in x]) for x, y in zip(*points, strict=True)]
    return cut_lineage(spark.createDataFrame(rows, "_y double, a array<double>").select("_y", array_to_vector("a").alias("features")).coalesce(3))


def test_one_tree_is_that_of_spark(frame, points, monkeypatch):
    x, y = points
    model = DecisionTreeClassifier(labelCol="_y", featuresCol="features", maxDepth=30).fit(frame)
    want = {(r["_y"], tuple(r["f"])): r["p"] for r in model.transform(frame).select(
        "_y", vector_to_array("features").alias("f"), vector_to_array("probability").alias("p")).collect()}
    bins = forest.binned(x, [forest.cuts(x[:, f]) for f in range(5)])
    for keys in (2**18, 300):
        monkeypatch.setattr(forest, "_KEYS", keys)
        nodes = forest.merged(*forest.grow_part(bins, y, np.ones(N, np.int64), 3, 30, 5, np.random.default_rng(0)))
        assert len(nodes[0]) == model.numNodes > 300
        counts = nodes[3][forest.route(*nodes[:3], bins)]
        for point, label, got in zip(x, y, counts / counts.sum(1, keepdims=True), strict=True):
            assert got.tolist() == want[float(label), tuple(map(float, point))]


def test_trees_do_not_depend_on_the_rows_a_task_takes(frame, monkeypatch):
    """With all features at every node, nodes split over many tasks and parts grown in one task give the same tree."""
    monkeypatch.setattr(forest, "BLOCK", 5 * 100)
    trees = []
    for part in (2**24, 5 * 150):
        monkeypatch.setattr(forest, "PART", part)
        trees.append(forest.grow(frame, N, ["a", "b", "c"], 1, 30, 5).trees.first())
    assert trees[0] == trees[1] and len(trees[0]["feature"]) > 100 * 4
    monkeypatch.setattr(forest, "SHUFFLED", N * 5 // 4 * 3)  # three trees at a time
    grown = forest.grow(frame, N, ["a", "b", "c"], 7, 6, 5)
    assert sorted(r["tree"] for r in grown.trees.collect()) == list(range(7))


def _labeled(spark):
    rows = [(i, f"{'red' if i % 3 else 'blue'} w{i % 11} w{i % 7}", i * 37 % 101, "ab"[i % 5 > 1]) for i in range(400)]
    return spark.createDataFrame(rows, "id bigint, text string, n bigint, kind string").coalesce(2)


def test_many_rows_leave_no_nodes_in_the_driver(spark, monkeypatch, tmp_path):
    """Past DRIVER_ROWS, Spark ML and its driver-side trees are not used; scores are close to its own, also after a round trip."""
    df = _labeled(spark)
    usual = classify.train(df, "id", "kind", ["text", "n"], "k", trees=10, depth=30)
    monkeypatch.setattr(classify, "DRIVER_ROWS", 100)
    monkeypatch.setattr(classify, "RandomForestClassifier", None)
    model = classify.train(df, "id", "kind", ["text", "n"], "k", trees=10, depth=30)
    assert isinstance(model.model, forest.Forest) and model.sample_count == 400 and model.categories == ["a", "b"]
    score = lambda m: {r["id"]: r for r in m.classify(df.drop("kind")).collect()}
    got, plain = score(model), score(usual)
    kinds = {r["id"]: r["kind"] for r in df.collect()}
    right = lambda rows: sum(rows[i]["category"] == kinds[i] for i in kinds)
    assert len(got) == 400 and right(got) >= right(plain) - 20
    for r in got.values():
        assert abs(sum(r["probabilities"].values()) - 1) < 1e-9 and r["confidence"] == max(r["probabilities"].values())
        assert r["probabilities"][r["category"]] == r["confidence"]
    for _ in range(2):  # saving anew replaces what was there
        model.save(str(tmp_path))
    loaded = classify.Classifier.load(str(tmp_path), "k")
    assert score(loaded) == got
    loaded.save(str(tmp_path))
    assert score(classify.Classifier.load(str(tmp_path), "k")) == got
    assert [tuple(r) for r in classify.list_classifiers(spark, str(tmp_path)).collect()] == [("k", "random_forest", ["a", "b"], 400)]


def test_no_rows_are_scored_as_no_rows(spark, monkeypatch):
    monkeypatch.setattr(classify, "DRIVER_ROWS", 100)
    model = classify.train(_labeled(spark), "id", "kind", ["text", "n"], "k", trees=3, depth=4)
    ready = model.features(_labeled(spark))
    assert model.model.transform(ready.filter(F.col("id") < 0)).collect() == []
    assert [r["id"] for r in model.model.transform(ready.filter(F.col("id") == 399)).collect()] == [399]


def test_default_classifier_grows_outside_the_driver(spark, monkeypatch):
    monkeypatch.setattr(classify, "DRIVER_ROWS", 100)
    rows = [(i, f"{('article', 'name', 'title')[i % 3]} w{i % 11}", float(i % 40)) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, text string, length double")
    model = classify.default_classifier(df, "id", "text", "text", trees=8)
    assert isinstance(model.model, forest.Forest)
    assert {r["category"]: r["n"] for r in model.classify(df).groupBy("category").agg(F.count("*").alias("n")).collect()} == {
        "article": 80, "name": 80, "title": 80}


def test_all_combining_characters_go():
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    text = "".join(f"a{m}b " for m in marks) + "Caf\u00e9 \ufb01n \u00c5ngstr\u00f6m"
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    assert classify._terms(text) == classify._TERM.findall(plain)
    assert classify._terms(text)[-3:] == ["cafe", "fin", "angstrom"]
