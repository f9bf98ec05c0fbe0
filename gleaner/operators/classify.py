"""Classification with Spark ML: TF-IDF, numeric and mixed features, random forests and k-means."""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.features import FEATURE_FIELDS, feature_type, infer_category, mixed_features
from gleaner.functions.text import coerce_number
from gleaner.operators import forest
from gleaner.session import cut_lineage, ensure_checkpoint_dir

MAX_TERMS, MIN_DOCS, MAX_SHARE = 500, 2, 0.9

#: Rows times trees up to which Spark ML grows a forest; it holds all nodes in the driver, and there are about as many as that.
DRIVER_ROWS = 1_000_000


_TERM = re.compile(r"\w+")
#: Characters that combine with the one before; a character class is much faster than a test of each character.
_MARKS = re.compile("[" + "".join(map(chr, filter(lambda c: unicodedata.combining(chr(c)), range(sys.maxunicode + 1)))) + "]+")


def _terms(text: str | None) -> list[str]:
    """Runs of word characters, lowercase and without accents."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", plain))
    return _TERM.findall(plain)


#: Texts that are counted before their terms leave Python.
_TEXTS_AT_ONCE = 32

#: Vectors of texts that leave Python at once.
_VECTORS_AT_ONCE = 500


def _counted_terms(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of keys and texts to keys, terms and counts.

    A batch may hold ten thousand long texts; its terms are handed on a few texts at a time, so that memory does not follow it.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, _TEXTS_AT_ONCE):
            keys, texts = batch.slice(start, _TEXTS_AT_ONCE).columns
            owners, terms, tfs = [], [], []
            for i, value in enumerate(texts):
                counts = Counter(_terms(value.as_py()))
                owners.extend([i] * len(counts))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owners, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=names)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``, counted within each text, so that tokens are not shuffled."""
    both = df.select(F.col(key), F.col(text))
    schema = T.StructType([both.schema[0], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return both.mapInArrow(lambda batches: _counted_terms(batches, schema.names), schema)


def vocabulary(counts: DataFrame, documents: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """``term, idf`` of the most frequent terms that are in at least two and at most nine tenths of the texts."""
    usable = (F.col("df") >= MIN_DOCS) & (F.col("df") <= MAX_SHARE * documents)
    frequent = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter(usable)
    top = frequent.orderBy(F.desc("cf"), "term").limit(max_terms)
    return top.select("term", (F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """``key, term, weight``: sublinear term frequency times smooth idf, each text scaled to length 1."""
    counts = term_counts(df, key, text)
    return weights(counts, key, vocabulary(counts, df.count(), max_terms))


def weights(counts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """TF-IDF weights for a fitted vocabulary; it has at most ``max_terms`` rows and is broadcast."""
    raw = counts.join(F.broadcast(terms), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    per_text = raw.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return per_text.select(key, F.inline("t"), "norm").select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


@dataclass(frozen=True)
class TextFeatures:
    """A fitted vocabulary: the same terms and weights when training and when classifying."""

    terms: tuple[tuple[str, float], ...]

    @staticmethod
    def fit(df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS) -> TextFeatures:
        # At most max_terms rows come to the driver.
        rows = vocabulary(term_counts(df, key, text), df.count(), max_terms).collect()
        return TextFeatures(tuple(sorted((r["term"], r["idf"]) for r in rows)))

    def transform(self, df: DataFrame, text: str, output: str) -> DataFrame:
        """Adds the weight vector; stays within the row, so classifying needs no shuffle."""
        index = {term: i for i, (term, _) in enumerate(self.terms)}
        idf = np.array([w for _, w in self.terms])

        def one(value: str) -> np.ndarray:
            out = np.zeros(len(idf))
            for term, tf in Counter(_terms(value)).items():
                i = index.get(term)
                if i is not None:
                    out[i] = (1 + math.log(tf)) * idf[i]
            norm = math.sqrt(float(out @ out))
            return out / norm if norm else out

        @F.pandas_udf("array<double>")
        def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # A batch may hold ten thousand texts; their vectors leave Python a few at a time.
            for texts in batches:
                for start in range(0, len(texts), _VECTORS_AT_ONCE):
                    yield texts.iloc[start:start + _VECTORS_AT_ONCE].map(one)

        return df.withColumn(output, array_to_vector(vector(F.coalesce(F.col(text), F.lit("")))))


@dataclass
class Classifier:
    """A trained classifier: text vocabularies, the fitted pipeline and what it was trained on."""

    name: str
    algorithm: str
    fields: dict[str, str]
    texts: dict[str, TextFeatures]
    model: PipelineModel | forest.Forest
    categories: list[str]
    sample_count: int
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    cluster_labels: dict[int, str] = field(default_factory=dict)

    def metadata(self) -> dict:
        return {
            "name": self.name, "algorithm": self.algorithm, "feature_fields": self.fields, "categories": self.categories,
            "sample_count": self.sample_count, "created_at": self.created_at,
            "cluster_labels": {str(k): v for k, v in self.cluster_labels.items()},
            "texts": {f: list(t.terms) for f, t in self.texts.items()},
        } | ({"packed_trees": True} if isinstance(self.model, forest.Forest) else {})

    def features(self, df: DataFrame) -> DataFrame:
        return _features(df, self.fields, self.texts)

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds ``category`` and ``confidence``, and ``probabilities`` (or ``distances``) by category."""
        scored = self.model.transform(self.features(df))
        kept = [c for c in df.columns if c not in ("category", "confidence", "probabilities", "distances")]
        if self.algorithm == "kmeans":
            centers = [c.tolist() for c in self.model.stages[-1].clusterCenters()]
            distance = distances(vector_to_array("features"), centers)
            labels = F.create_map(*[F.lit(x) for k in range(len(centers)) for x in (k, self.cluster_labels.get(k, f"cluster_{k}"))])
            return scored.withColumn("distances", distance).select(
                *kept, labels[F.col("prediction")].alias("category"),
                (1 / (1 + F.get("distances", F.col("prediction")))).alias("confidence"), "distances")
        probability = vector_to_array("probability")
        names = F.array(*[F.lit(c) for c in self.categories])
        return scored.select(
            *kept, F.col("category_name").alias("category"), F.array_max(probability).alias("confidence"),
            F.map_from_arrays(names, probability).alias("probabilities"))

    def save(self, folder: str) -> None:
        spark = SparkSession.active()
        if isinstance(self.model, forest.Forest):
            self.model.save(f"{folder}/{self.name}/model")
        else:
            self.model.write().overwrite().save(f"{folder}/{self.name}/model")
        meta = spark.createDataFrame([(json.dumps(self.metadata()),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(f"{folder}/{self.name}/metadata")

    @staticmethod
    def load(folder: str, name: str) -> Classifier:
        meta = json.loads(SparkSession.active().read.text(f"{folder}/{name}/metadata").first()[0])
        at = f"{folder}/{name}/model"
        model = forest.Forest.load(at, meta["categories"]) if meta.get("packed_trees") else PipelineModel.load(at)
        return Classifier(
            name, meta["algorithm"], meta["feature_fields"],
            {f: TextFeatures(tuple((t, w) for t, w in terms)) for f, terms in meta["texts"].items()},
            model, meta["categories"], meta["sample_count"], meta["created_at"],
            {int(k): v for k, v in meta["cluster_labels"].items()},
        )


def list_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    """``name, algorithm, categories, sample_count`` of the saved classifiers."""
    meta = spark.read.text(f"{folder}/*/metadata")
    shape = "name string, algorithm string, categories array<string>, sample_count bigint"
    return meta.select(F.from_json("value", shape).alias("m")).select("m.*")


def _features(df: DataFrame, fields: dict[str, str], texts: dict[str, TextFeatures]) -> DataFrame:
    """One ``features`` vector from all fields; a field a frame lacks is empty."""
    parts = []
    for name, kind in fields.items():
        out = f"_f_{name}"
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0) if kind == "numeric" else F.lit(""))
        if kind == "text":
            df = texts[name].transform(df, name, out)
        elif kind == "numeric":
            v = F.coalesce(coerce_number(name), F.lit(0.0))
            df = df.withColumn(out, array_to_vector(F.array(v, F.log1p(F.abs(v)), (v == F.floor(v)).cast("double"))))
        else:
            m = mixed_features(F.coalesce(F.col(name).cast("string"), F.lit("")))
            df = df.withColumn("_m", m).withColumn(out, array_to_vector(F.array(*[
                F.col(f"_m.{f}") for f in ("length", "is_number", "is_string", "digit_ratio", "alpha_ratio", "upper_ratio",
                                           "punctuation_ratio", "dotted_number", "has_at", "has_separator")])))
        parts.append(out)
    return VectorAssembler(inputCols=parts, outputCol="features").transform(df)


def train(df: DataFrame, key: str, category: str, fields: Sequence[str], name: str, algorithm: str = "random_forest",
          trees: int = 100, depth: int = 30, seed: int = 42, max_terms: int = MAX_TERMS) -> Classifier:
    """Trains on the rows that have a category. Numeric fields stay unscaled: trees do not need it."""
    labeled = df.filter(F.col(category).isNotNull()).withColumn("_label", F.col(category).cast("string"))
    kinds = dict(df.dtypes)
    types = {f: feature_type(kinds[f]) for f in fields}
    texts = {f: TextFeatures.fit(labeled, key, f, max_terms) for f, kind in types.items() if kind == "text"}
    # Training passes over the features many times; they are computed once.
    featured = cut_lineage(_features(labeled, types, texts).select("_label", "features"))
    indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(featured)
    categories, rows = list(indexer.labels), featured.count()
    labels: dict[int, str] = {}
    if algorithm == "random_forest" and rows * trees > DRIVER_ROWS:
        model = forest.grow(indexer.transform(featured), rows, categories, trees, depth, seed)
    elif algorithm == "random_forest":
        learner = RandomForestClassifier(labelCol="_y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
        names = IndexToString(inputCol="prediction", outputCol="category_name", labels=categories)
        model = _plain_model(Pipeline(stages=[learner, names]).fit(indexer.transform(featured)))
    elif algorithm == "kmeans":
        model = _plain_model(Pipeline(stages=[KMeans(k=max(len(categories), 2), seed=seed, featuresCol="features")]).fit(featured))
        labels = majority_labels(model.transform(featured), "prediction", "_label")
    else:
        raise ValueError(f"unsupported algorithm: {algorithm}")
    return Classifier(name, algorithm, types, texts, model, categories, rows, cluster_labels=labels)


def _plain_model(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which would carry the session into every task."""
    folder = f"{ensure_checkpoint_dir(SparkSession.active()).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.save(folder)
    return PipelineModel.load(folder)


def majority_labels(assigned: DataFrame, cluster: str, label: str) -> dict[int, str]:
    """The most common label of each cluster (the smaller one on a tie); one row per cluster is collected."""
    counted = assigned.groupBy(cluster, label).agg(F.count("*").alias("n"))
    top = counted.groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"))
    return {r[cluster]: r["label"] for r in top.collect()}


def distances(vector: Column, centers: Sequence[Sequence[float]]) -> Column:
    """Euclidean distance of an array to each center."""
    def to(center: Sequence[float]) -> Column:
        c = F.lit([float(x) for x in center])
        squares = F.zip_with(vector, c, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))

    return F.array(*[to(c) for c in centers])


def assign_centers(df: DataFrame, vector: str, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``cluster``, ``distance`` and ``confidence`` (``1 / (1 + distance)``) for fixed centers."""
    d = distances(F.col(vector), centers)
    return df.withColumn("_d", d).withColumns({
        "distance": F.array_min("_d"),
        "cluster": (F.array_position("_d", F.array_min("_d")) - 1).cast("int"),
        "confidence": 1 / (1 + F.array_min("_d")),
    }).drop("_d")


def weak_labels(df: DataFrame, text: str, category: str, kind: str = "text") -> DataFrame:
    """Rows with their label, inferred where there is none."""
    label = infer_category(text, kind)
    known = F.col(category) if category in df.columns else F.lit(None).cast("string")
    return df.withColumn(category, F.coalesce(known, label))


def default_classifier(df: DataFrame, key: str, kind: str, text: str, category: str = "category", **options) -> Classifier:
    """A classifier with the default fields of a kind of data, on given and inferred labels."""
    fields = [f for f in FEATURE_FIELDS[kind] if f in df.columns]
    return train(weak_labels(df, text, category, kind), key, category, fields, f"{kind}_classifier", **options)
