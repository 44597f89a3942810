"""Queries over the batch forms of the stream jobs; tests hold the streams against them."""

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from ..streaming import streams as S
from ..streaming.ingest import ingest
from ..streaming.sinks import SyncedTable, days_sink
from .registry import query
from .sync_queries import _OLD_NEW, old_and_new
from .views import QUERY_LOG, query_log, table


def _requests(spark, d):
    return query_log(spark, d).select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "timestamp")


@query()
def n1_rate_limited(spark, d):
    return S.rate_limited(_requests(spark, d), 3, 86_400)


@query(f"WITH {QUERY_LOG} SELECT event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM v_query_log")
def n2_trailing_count(spark, d):
    return S.trailing_count(_requests(spark, d), 3600).select("request_id", "in_window")


@query()
def n3_active_users(spark, d):
    return S.active_users(query_log(spark, d))


@query(f"WITH {QUERY_LOG} SELECT CAST(timestamp AS DATE) AS day, count(*) AS queries, count(*) FILTER (success) AS ok, round(sum(response_time_ms), 4) AS time_ms FROM v_query_log GROUP BY 1")
def n4_daily_rollup(spark, d):
    return S.daily_rollup(query_log(spark, d)).withColumn("time_ms", F.round("time_ms", 4))


_ROLLUP = f"WITH {QUERY_LOG} SELECT CAST(timestamp AS DATE) AS day, count(*) AS queries, count(*) FILTER (success) AS ok, round(sum(response_time_ms), 4) AS time_ms FROM v_query_log GROUP BY 1"


def _stream_of(spark, d, name):
    """A table's files as a stream."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _new_folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(_ROLLUP)
def n4_daily_rollup_upserts(spark, d):
    """The roll-up as a stream whose batches replace their days."""
    folder = _new_folder(spark)
    log = _stream_of(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time_ms"))
    S.run_batches(S.daily_rollup(log), days_sink(f"{folder}/table"), f"{folder}/checkpoint", "update")
    return spark.read.parquet(f"{folder}/table").select("day", "queries", "ok", F.round("time_ms", 4).alias("time_ms"))


@query(f"WITH {_OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def n6_incremental_sync(spark, d):
    """The stored table after a stream of the source's records."""
    folder, (old, _) = _new_folder(spark), old_and_new(spark, d)
    synced = SyncedTable(spark, folder, "c_custkey long, c_name string, bal decimal(18,2)", "c_custkey", ["c_name", "bal"], buckets=8)
    synced.fill(old)
    S.run_batches(old_and_new(spark, d, _stream_of(spark, d, "customer"))[1], synced.apply, f"{folder}/checkpoint")
    return synced.read()


@query(f"""WITH {QUERY_LOG}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts FROM v_query_log WINDOW w AS (PARTITION BY user_id ORDER BY timestamp)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY timestamp) AS n FROM g)
    SELECT user_id, min(timestamp) AS started, max(timestamp) AS last_seen, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS micros, count(*) AS events FROM s GROUP BY user_id, n""")
def n5_user_sessions(spark, d):
    return S.user_sessions(query_log(spark, d))


@query()
def n7_clean_and_chunk(spark, d):
    return S.clean_and_chunk(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "hash")


@query()
def n7_ingest(spark, d):
    docs = table(spark, d, "documents").withColumn("published", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, doc_id)"))
    out = ingest(docs, "doc_id", "text", "published")
    return out.select("doc_id", "chunk_index", "hash", "word_count", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squares"))


@query(f"""WITH {QUERY_LOG}, r AS (SELECT *, sum(success::INT) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS run FROM v_query_log), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY timestamp, event_id) AS failures FROM r WHERE NOT success)
    SELECT user_id, timestamp, failures FROM n WHERE failures = 2""")
def n8_failure_alerts(spark, d):
    return S.failure_alerts(query_log(spark, d), 2)
