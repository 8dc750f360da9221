"""Streaming queries; each equals its batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.streaming import stream

Q: dict[str, tuple] = {}


def q(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def _events(spark, d):
    return stream.read(spark, f"{d}/events.parquet")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@q("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts),'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return stream.finish(stream.tumbling(_events(spark, d)), "complete").withColumn("start", _stamp("start"))


@q("stream_sliding", "SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts)-INTERVAL 30 MINUTE]) AS s, event_type, value FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    return stream.finish(stream.tumbling(_events(spark, d), "1 hour", "30 minutes"), "complete").withColumn("start", _stamp("start"))


@q("stream_sessions", "WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w>INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    return stream.finish(stream.sessions(_events(spark, d)), "complete").select("user_id", _stamp("start").alias("start"), "n")


@q("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(spark, d):
    once = stream.finish(_events(spark, d).withWatermark("ts", "1 day").dropDuplicates(["event_id", "ts"]).select("event_id", "event_type"), "append")
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


@q("stream_state_last5", "SELECT user_id, n, list_aggregate(list_reverse_sort(ids)[1:5],'min') AS fifth, list_aggregate(ids,'max') AS newest FROM (SELECT user_id, count(*) AS n, list(event_id) AS ids FROM events GROUP BY 1)")
def stream_state_last5(spark, d):
    s = stream.finish(stream.last_values(_events(spark, d)), "update")
    s = s.groupBy("user_id").agg(F.max_by("last_ids", "n").alias("ids"), F.max("n").alias("n"))
    a = F.transform(F.split("ids", ","), lambda x: x.cast("bigint"))
    return s.select("user_id", "n", F.array_min(a).alias("fifth"), F.array_max(a).alias("newest"))


@q("stream_ingest_pages", "SELECT collection_name, count(DISTINCT page_id) AS pages FROM extracted_pages GROUP BY 1")
def stream_ingest_pages(spark, d):
    """Pages that arrive twice are taken once; hash and identity are computed on the way in."""
    p = stream.read(spark, f"{d}/extracted_pages.parquet").withWatermark("extracted_at", "400 days").dropDuplicatesWithinWatermark(["page_id"])
    done = stream.finish(p.select("page_id", "collection_name", F.sha2("text", 256).alias("hash")), "append")
    return done.groupBy("collection_name").agg(F.count("*").alias("pages"))


# ---- append mode: a window is written once, when the watermark has passed its end, and its state is dropped
_CLOSED = "(SELECT max(ts)-INTERVAL 1 DAY FROM events)"


@q("stream_tumbling_closed", f"SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, value FROM events) WHERE s+INTERVAL 1 HOUR<={_CLOSED} GROUP BY ALL")
def stream_tumbling_closed(spark, d):
    return stream.finish(stream.tumbling(_events(spark, d)), "append").withColumn("start", _stamp("start"))


@q("stream_sliding_closed", f"SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value),2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts)-INTERVAL 30 MINUTE]) AS s, event_type, value FROM events) WHERE s+INTERVAL 1 HOUR<={_CLOSED} GROUP BY ALL")
def stream_sliding_closed(spark, d):
    return stream.finish(stream.tumbling(_events(spark, d), "1 hour", "30 minutes"), "append").withColumn("start", _stamp("start"))


@q("stream_sessions_closed", f"WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w>INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts)+INTERVAL 30 MINUTE<={_CLOSED}")
def stream_sessions_closed(spark, d):
    return stream.finish(stream.sessions(_events(spark, d)), "append").select("user_id", _stamp("start").alias("start"), "n")


@q("stream_reindex", "SELECT collection_name AS collection, count(DISTINCT file_name||'/'||page_num) AS added FROM extracted_pages WHERE text IS NOT NULL GROUP BY 1")
def stream_reindex(spark, d):
    """Each batch of arriving pages is compared with the index of the batches before; only new and changed pages are taken in."""
    p = stream.read(spark, f"{d}/extracted_pages.parquet").where("text is not null")
    p = p.select(F.col("collection_name").alias("collection"), F.col("file_name").alias("doc_id"), "page_num", "text", F.col("extracted_at").alias("seq"))
    return stream.reindex(p).where("status = 'ADDED'").groupBy("collection").agg(F.count("*").alias("added"))
