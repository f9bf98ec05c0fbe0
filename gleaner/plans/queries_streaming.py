"""Streams over the event and document files; each runs what is available and gives the written table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators.patterns import DEFAULT
from gleaner.plans.queries_extract import _union
from gleaner.plans.registry import Tables, query
from gleaner.streaming import streams as S


def _events(t: Tables):
    return S.read_stream(t.spark, t.folder, "events.parquet", t.events.schema)


@query("stream_chunks", """
    SELECT floor((event_id_no - 1) / 700)::BIGINT AS chunk, count(*) AS chunk_size, max(event_id_no)::BIGINT AS items_processed, 'success' AS status
    FROM (SELECT row_number() OVER (ORDER BY ts, event_id) AS event_id_no FROM events) GROUP BY 1""")
def _(t: Tables):
    folder = S.stream_folder(t.spark)
    progress = S.process_chunks(_events(t), ["ts", "event_id"], folder, lambda df: df.groupBy("chunk", "event_type").count(), chunk_size=700)
    return progress.select("chunk", "chunk_size", "items_processed", "status")


@query("stream_extract", f"SELECT doc_id, pattern, ord, match, confidence FROM ({_union(['email', 'phone', 'ip_address'])})")
def _(t: Tables):
    docs = S.read_stream(t.spark, t.folder, "documents.parquet", t.documents.schema)
    chosen = DEFAULT.select(["email", "phone", "ip_address"])
    return S.run_to_files(S.extract(docs, "doc_id", "text", chosen), S.stream_folder(t.spark))


@query("stream_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def _(t: Tables):
    counts = S.daily_counts(_events(t), "ts", "1 day", ["event_type"])
    return S.run_updates(counts, S.stream_folder(t.spark), ["day", "event_type"])


@query("stream_sliding_quota", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS requests
    FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2""")
def _(t: Tables):
    counts = S.sliding_counts(_events(t), "ts", "1 hour", "30 minutes", "1 day", "event_type")
    out = S.run_updates(counts, S.stream_folder(t.spark), ["window_start", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "requests")


@query("stream_rolling_quota")
def _(t: Tables):
    out = S.run_to_files(S.admitted(_events(t), "user_id", "ts", ["event_id"], 2, 86400), S.stream_folder(t.spark))
    return out.select("user_id", "event_id", "admitted")


@query("stream_ttl_dedup", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
    f AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
        UNION ALL SELECT * FROM (SELECT f.user_id, min(e.t) AS t FROM f JOIN e ON e.user_id = f.user_id AND e.t >= f.t + 86400000000 GROUP BY f.user_id, f.t))
    SELECT e.user_id, e.event_id, f.t IS NOT NULL AS fetched FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.t = e.t""")
def _(t: Tables):
    out = S.run_to_files(S.cached(_events(t), "user_id", "ts", ["event_id"], 86400), S.stream_folder(t.spark))
    return out.select("user_id", "event_id", "fetched")


@query("stream_expire_state")
def _(t: Tables):
    return S.run_to_files(S.expired(_events(t), "user_id", "ts", 86400), S.stream_folder(t.spark))
