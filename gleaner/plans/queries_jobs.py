"""Job logs, activity, request quotas and response caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.features import infer_category
from gleaner.operators import jobs as J
from gleaner.operators import quota as Q
from gleaner.plans.queries_text import _CATEGORY_SQL
from gleaner.plans.registry import Tables, query

# -- classification results as a job log ------------------------------------------------------------

_RESULTS = f"""results AS (SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE {_CATEGORY_SQL} END AS category,
    CASE WHEN n_chars % 2 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN lang = 'de' THEN 'failed' END AS error FROM documents)"""


def _results(t: Tables):
    """Weak labels with a made-up confidence; Spanish texts come out blank, German ones failed."""
    return t.documents.select(
        "doc_id", F.when(F.col("lang") == "es", "").otherwise(infer_category("text")).alias("category"),
        F.when(F.col("n_chars") % 2 == 0, 0.5).otherwise(0.9).alias("confidence"), F.when(F.col("lang") == "de", "failed").alias("error"))


@query("classification_summary", f"""WITH {_RESULTS}
    SELECT category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percent, round(avg(confidence), 6) AS avg_confidence,
        count(*) FILTER (confidence < 0.7) AS low_confidence FROM results WHERE category <> '' AND error IS NULL GROUP BY category""")
def _(t: Tables):
    out = J.classification_summary(_results(t), "category", "confidence", "error")
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("percent", "avg_confidence")})


@query("classification_overall", f"""WITH {_RESULTS}
    SELECT count(*) AS total_classified, round(avg(confidence), 6) AS average_confidence, count(*) FILTER (confidence < 0.7) AS low_confidence_count FROM results WHERE category <> ''""")
def _(t: Tables):
    out = J.classification_overall(_results(t), "category", "confidence")
    return out.withColumn("average_confidence", F.round("average_confidence", 6))


@query("top_categories", f"""WITH {_RESULTS}
    SELECT category, count(*) AS n FROM results WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 3""")
def _(t: Tables):
    return J.top_categories(J.classification_summary(_results(t), "category", "confidence"))


@query("category_distribution", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label")
def _(t: Tables):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"))


# -- jobs -------------------------------------------------------------------------------------------


@query("batch_totals", """
    SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def _(t: Tables):
    return J.batch_totals(t.events.withColumn("error", F.when(F.col("event_type") == "error", F.col("props"))), "error", "user_id")


@query("batch_totals_overall", """
    SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed FROM events""")
def _(t: Tables):
    return J.batch_totals(t.events.withColumn("error", F.when(F.col("event_type") == "error", F.col("props"))), "error")


@query("job_statistics", """
    SELECT event_type, count(*) AS jobs, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6)::DOUBLE AS percent FROM events GROUP BY event_type""")
def _(t: Tables):
    return J.job_statistics(t.events, "event_type")


@query("job_progress", """
    SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 6)::DOUBLE AS progress
    FROM events GROUP BY user_id""")
def _(t: Tables):
    return J.progress(t.events, "user_id", F.col("event_type") == "purchase")


_AS_OF = "2024-02-01"


@query("daily_activity", f"""
    SELECT d::DATE AS day, count(event_id) AS events FROM generate_series(DATE '{_AS_OF}' - 6, DATE '{_AS_OF}', INTERVAL 1 DAY) s(d)
    LEFT JOIN events ON ts::DATE = d::DATE GROUP BY 1""")
def _(t: Tables):
    # The data ends before the last days: they are there with zero.
    return J.daily_activity(t.events, "ts", _AS_OF)


for _period in ("day", "week", "month"):
    @query(f"insights_by_{_period}", f"""
        SELECT date_trunc('{_period}', ts)::DATE AS period_start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1""")
    def _(t: Tables, period=_period):
        return J.by_period(t.events, "ts", period, "value").withColumn("total", F.round("total", 4))


@query("chunk_assign", """
    SELECT event_id, floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 1000)::BIGINT AS chunk FROM events""")
def _(t: Tables):
    return J.assign_chunks(t.events.select("event_id", "ts"), ["ts", "event_id"], 1000).select("event_id", "chunk")


@query("ordered_results", """
    SELECT chunk::BIGINT AS chunk, count(*) AS items, round(sum(value), 4) AS total FROM (SELECT value, floor((row_number() OVER (ORDER BY event_id) - 1) / 500) AS chunk FROM events)
    GROUP BY chunk ORDER BY chunk""")
def _(t: Tables):
    chunks = J.assign_chunks(t.events.select("event_id", "value"), ["event_id"], 500)
    return chunks.groupBy("chunk").agg(F.count("*").alias("items"), F.round(F.sum("value"), 4).alias("total")).orderBy("chunk")


for _name, _status, _n in (("recent_jobs_topk", "", 5), ("recent_jobs_by_status", "WHERE event_type = 'error'", 100)):
    @query(_name, f"SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events {_status} ORDER BY ts DESC, event_id LIMIT {_n}")
    def _(t: Tables, status=_status, n=_n):
        rows = t.events.filter("event_type = 'error'") if status else t.events
        return rows.orderBy(F.desc("ts"), "event_id").limit(n).select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# -- quotas and caches ------------------------------------------------------------------------------

_HOUR = 3600
_RANGE = "OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("rolling_request_count", f"""
    SELECT event_id, event_type, count(*) {_RANGE.format(_HOUR * 1_000_000)} AS requests FROM events""")
def _(t: Tables):
    return Q.rolling_count(t.events, "event_type", "ts", _HOUR).select("event_id", "event_type", "requests")


@query("rolling_request_count_exclusive", f"""
    SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS requests
    FROM (SELECT event_id, event_type, floor(epoch_us(ts) / 1e6)::BIGINT AS t FROM events)""")
def _(t: Tables):
    # Whole seconds, so that requests exactly one window apart occur.
    seconds = t.events.withColumn("ts", F.date_trunc("second", "ts"))
    return Q.rolling_count(seconds, "event_type", "ts", 600, inclusive=False).select("event_id", "requests")


_LIMITS = [("view", 20, 3600), ("error", 100, 86400), ("click", 5, 3600)]
_QUOTA_SQL = """
    WITH c AS (SELECT *, CASE event_type WHEN 'view' THEN 20 WHEN 'error' THEN 100 WHEN 'click' THEN 5 ELSE 60 END AS lim,
        CASE event_type WHEN 'view' THEN 3600 WHEN 'error' THEN 86400 WHEN 'click' THEN 3600 ELSE 60 END::BIGINT AS win FROM events),
    q AS (SELECT event_id, lim, win, epoch_us(ts) AS t, count(*) OVER w AS requests, min(epoch_us(ts)) OVER w AS oldest FROM c
        WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN win * 1000000 PRECEDING AND CURRENT ROW))
"""


@query("remaining_quota", f"{_QUOTA_SQL} SELECT event_id, requests, greatest(lim - requests, 0)::BIGINT AS remaining FROM q")
def _(t: Tables):
    return Q.quotas(t.events, "event_type", "ts", _LIMITS).select("event_id", "requests", "remaining")


@query("quota_reset_seconds", f"{_QUOTA_SQL} SELECT event_id, round(greatest((oldest + win * 1000000 - t) / 1e6, 0), 6)::DOUBLE AS reset_seconds FROM q")
def _(t: Tables):
    return Q.quotas(t.events, "event_type", "ts", _LIMITS).select("event_id", F.round("reset_seconds", 6).alias("reset_seconds"))


@query("ttl_cache", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
    f AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
        UNION ALL SELECT * FROM (SELECT f.user_id, min(e.t) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.t >= f.t + 86400000000 GROUP BY f.user_id, f.t))
    SELECT e.user_id, e.event_id, f.t IS NOT NULL AS fetched FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.t = e.t""")
def _(t: Tables):
    return Q.cached(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 86400).select("user_id", "event_id", "fetched")


@query("live_cache_entries", """
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
    f AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
        UNION ALL SELECT * FROM (SELECT f.user_id, min(e.t) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.t >= f.t + 86400000000 GROUP BY f.user_id, f.t)),
    s AS (SELECT user_id, max(t) + 86400000000 AS x FROM f WHERE t <= epoch_us(TIMESTAMP '2024-01-20') GROUP BY user_id)
    SELECT user_id, strftime(make_timestamp(x), '%Y-%m-%d %H:%M:%S') AS expires FROM s WHERE x > epoch_us(TIMESTAMP '2024-01-20')""")
def _(t: Tables):
    fetched = Q.cached(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 86400)
    live = Q.live_entries(fetched, "user_id", "ts", "2024-01-20", 86400)
    return live.select("user_id", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("quota_admission")
def _(t: Tables):
    return Q.admitted(t.events.select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 2, 86400).select("user_id", "event_id", "admitted")
