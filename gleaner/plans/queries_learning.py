"""Features, classifiers and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.features import feature_type, value_feature_type
from gleaner.operators import classify as M
from gleaner.plans.registry import Tables, query
from gleaner.streaming.streams import stream_folder

_TERMS = """plain AS (SELECT doc_id, strip_accents(lower(text)) AS x FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(x, '[\\p{L}\\p{N}_]+')) AS term FROM plain) GROUP BY 1, 2),
    n AS (SELECT count(*) AS n FROM documents),
    vocab AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term
        HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n) ORDER BY sum(tf) DESC, term LIMIT 500)"""


@query("tfidf_vocabulary", f"WITH {_TERMS} SELECT term, round(idf, 9) AS idf FROM vocab")
def _(t: Tables):
    counts = M.term_counts(t.documents, "doc_id", "text")
    return M.vocabulary(counts, t.documents.count()).select("term", F.round("idf", 9).alias("idf"))


@query("tfidf_features", f"""WITH {_TERMS}, w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""")
def _(t: Tables):
    return M.tfidf(t.documents, "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query("feature_type_detect", """
    SELECT event_type, CASE event_type WHEN 'view' THEN 'numeric' WHEN 'click' THEN 'text' WHEN 'error' THEN 'mixed' WHEN 'signup' THEN 'numeric' ELSE 'text' END AS kind FROM events GROUP BY event_type""")
def _(t: Tables):
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    quoted = F.concat(F.lit('"'), n, F.lit('"'))
    cell = (
        F.when(kind == "view", F.when(F.col("value") > 10, n).otherwise(F.lit('""'))).when(kind == "click", quoted)
        .when(kind == "error", F.when(F.col("value") > 10, n).otherwise(quoted)).when(kind == "signup", F.lit("true"))
        .otherwise(F.when(F.col("value") > 10, quoted).otherwise(F.lit("0"))))
    return t.events.withColumn("cell", cell).groupBy("event_type").agg(value_feature_type("cell").alias("kind"))


@query("feature_types_of_columns", """
    SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'mixed' END AS kind
    FROM information_schema.columns WHERE table_name = 'orders'""")
def _(t: Tables):
    return t.spark.createDataFrame([(n, feature_type(k)) for n, k in t.orders.dtypes], "name string, kind string")


def _labeled(t: Tables):
    quality = F.when(F.col("quality") == 1, "good").otherwise("poor")
    joined = t.documents.join(t.labels, "doc_id", "left").withColumn("category", F.when(F.col("quality").isNotNull(), quality))
    return joined.select("doc_id", "text", "n_chars", "source", "lang", "category")


def _forest(t: Tables, **options):
    return M.train(_labeled(t), "doc_id", "category", ["text", "n_chars"], "quality", **options)


@query("train_random_forest")
def _(t: Tables):
    model = _forest(t)
    scored = model.classify(_labeled(t).filter(F.col("category").isNotNull()))
    return scored.select("doc_id", "category", F.round("confidence", 9).alias("confidence"))


@query("classify")
def _(t: Tables):
    # Trained on the labeled documents, applied to all of them.
    scored = _forest(t).classify(t.documents.select("doc_id", "text", "n_chars"))
    return scored.select("doc_id", "category", "confidence", F.col("probabilities")["good"].alias("p_good"))


@query("save_load_model")
def _(t: Tables):
    folder = stream_folder(t.spark)
    _forest(t).save(folder)
    loaded = M.Classifier.load(folder, "quality")
    scored = loaded.classify(t.documents.select("doc_id", "text", "n_chars")).groupBy("category").agg(F.count("*").alias("n"))
    listed = M.list_classifiers(t.spark, folder).select(F.concat(F.lit("model:"), "name").alias("category"), F.col("sample_count").alias("n"))
    return scored.unionAll(listed)


@query("default_classifier")
def _(t: Tables):
    texts = t.documents.select("doc_id", "text", F.length("text").cast("double").alias("length"))
    model = M.default_classifier(texts, "doc_id", "text", "text")
    return model.classify(texts).groupBy("category").agg(F.count("*").alias("n"))


@query("merge_labeled_samples", """
    WITH l AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS given, text FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT doc_id, coalesce(given, CASE WHEN contains(lower(text), 'article') THEN 'article' WHEN contains(lower(text), 'description') THEN 'description' WHEN contains(lower(text), 'title') THEN 'title'
        WHEN contains(lower(text), 'name') THEN 'name' WHEN contains(lower(text), 'comment') THEN 'comment' WHEN contains(lower(text), 'address') THEN 'address'
        WHEN length(text) < 50 THEN 'name' WHEN length(text) > 500 THEN 'article' ELSE 'description' END) AS category FROM l""")
def _(t: Tables):
    return M.weak_labels(_labeled(t), "text", "category").select("doc_id", "category")


@query("train_kmeans")
def _(t: Tables):
    docs = _labeled(t).select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.col("lang").alias("category"))
    model = M.train(docs, "doc_id", "category", ["n_chars"], "sizes", algorithm="kmeans")
    scored = model.classify(docs.drop("category"))
    return scored.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("kmeans_assign", """
    WITH e AS (SELECT vec_id, label, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
    d AS (SELECT vec_id, c.label, sqrt(sum((x - m) * (x - m))) AS distance FROM e JOIN c USING (i) GROUP BY vec_id, c.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance) AS r, (SELECT count(DISTINCT label) FROM embeddings o WHERE o.label < d.label) AS cluster FROM d)
    SELECT vec_id, cluster, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS confidence FROM r WHERE r = 1""")
def _(t: Tables):
    # The mean vector of each label is a center; one row per center comes to the driver.
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).orderBy("label").collect()
    centers = [[p["m"] for p in r["c"]] for r in rows]
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = M.assign_centers(vectors, "embedding", centers)
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))
