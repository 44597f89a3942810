"""Queries over logs."""

from pyspark.sql import functions as F

from ..operators import logs
from .registry import query
from .views import AS_OF, DOCUMENT_EVENTS, QUERY_LOG, document_events, query_log, table

_MEASURES = """count(*) AS total_queries, count(*) FILTER (success) AS successful_queries, count(*) FILTER (NOT success) AS failed_queries,
    round(avg(response_time_ms), 2) AS avg_time_ms, count(DISTINCT user_id) AS unique_users, round(100.0 * count(*) FILTER (success) / count(*), 2)::DOUBLE AS success_rate"""


@query(f"WITH {QUERY_LOG} SELECT {_MEASURES} FROM v_query_log WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS")
def l1_query_stats(spark, d):
    return logs.query_stats(query_log(spark, d), AS_OF, 7)


@query(f"WITH {QUERY_LOG} SELECT CAST(timestamp AS DATE) AS day, {_MEASURES} FROM v_query_log WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS GROUP BY 1")
def l2_daily_trend(spark, d):
    return logs.daily_trend(query_log(spark, d), AS_OF, 30)


@query(f"""WITH {QUERY_LOG}, {DOCUMENT_EVENTS}, q AS (SELECT CAST(timestamp AS DATE) AS day, {_MEASURES} FROM v_query_log GROUP BY 1),
    e AS (SELECT CAST(timestamp AS DATE) AS day, count(*) FILTER (event_type = 'upload') AS documents_added, count(*) FILTER (event_type = 'delete') AS documents_deleted FROM v_doc_event GROUP BY 1)
    SELECT coalesce(q.day, e.day) AS day, coalesce(total_queries, 0) AS total_queries, coalesce(successful_queries, 0) AS successful_queries, coalesce(failed_queries, 0) AS failed_queries, coalesce(avg_time_ms, 0) AS avg_time_ms,
    coalesce(unique_users, 0) AS unique_users, coalesce(success_rate, 0) AS success_rate, coalesce(documents_added, 0) AS documents_added, coalesce(documents_deleted, 0) AS documents_deleted,
    CAST(greatest(0, sum(coalesce(documents_added, 0) - coalesce(documents_deleted, 0)) OVER (ORDER BY coalesce(q.day, e.day))) AS BIGINT) AS total_documents FROM q FULL JOIN e ON q.day = e.day""")
def l3_daily_rollup(spark, d):
    return logs.daily_rollup(query_log(spark, d), document_events(spark, d))


@query(f"WITH {DOCUMENT_EVENTS} SELECT CAST(greatest(0, coalesce(sum(CASE event_type WHEN 'upload' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END), 0)) AS BIGINT) AS documents FROM v_doc_event")
def l4_document_count(spark, d):
    return logs.document_count(document_events(spark, d))


@query(f"WITH {QUERY_LOG} SELECT count(DISTINCT user_id) AS active_users FROM v_query_log WHERE timestamp BETWEEN TIMESTAMP '2024-01-30 23:59:00' - INTERVAL 600 MINUTES AND TIMESTAMP '2024-01-30 23:59:00'")
def l5_active_users(spark, d):
    return logs.active_users(query_log(spark, d), "2024-01-30 23:59:00", 600)


@query(f"WITH {QUERY_LOG} SELECT event_id, user_id, response_time_ms, success FROM v_query_log ORDER BY timestamp DESC, event_id DESC LIMIT 50")
def l6_recent_queries(spark, d):
    return logs.recent(query_log(spark, d), "timestamp", "event_id", 50).select("event_id", "user_id", "response_time_ms", "success")


@query(f"WITH {QUERY_LOG} SELECT event_id, timestamp, response_time_ms FROM v_query_log WHERE user_id = 8 ORDER BY timestamp DESC, event_id DESC LIMIT 20 OFFSET 10")
def l8_user_history(spark, d):
    return query_log(spark, d).where("user_id = 8").orderBy(F.desc("timestamp"), F.desc("event_id")).offset(10).limit(20).select("event_id", "timestamp", "response_time_ms")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, round(sum(value), 6) AS sum_value, round(avg(value), 6) AS avg_value,
    CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) AS sum_tokens, round(avg(CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS avg_tokens, quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.95) AS p95_value,
    quantile_disc(CAST(json_extract(props, '$.k') AS DOUBLE), 0.5) AS p50_tokens, quantile_disc(CAST(json_extract(props, '$.k') AS DOUBLE), 0.95) AS p95_tokens FROM events GROUP BY 1, 2""")
def l9_latency_breakdown(spark, d):
    log = table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long").cast("double"))
    return logs.latency_breakdown(log, ["value", "tokens"], [F.to_date("ts").alias("day"), "event_type"])


@query(f"WITH {QUERY_LOG} SELECT count(*) AS searches, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 4)::DOUBLE AS filtered_percent, round(avg(response_time_ms), 4) AS avg_time_ms, round(avg(event_id % 20), 4) AS avg_results FROM v_query_log")
def l10_search_stats(spark, d):
    return logs.search_stats(query_log(spark, d), F.col("event_type") == "view", F.col("event_id") % 20)


@query(f"WITH {QUERY_LOG} SELECT event_type, count(*) AS accesses, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) FILTER (event_id % 3 <> 0) AS misses, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS hit_rate FROM v_query_log GROUP BY 1")
def l11_cache_stats(spark, d):
    return logs.cache_stats(query_log(spark, d), "event_type", F.col("event_id") % 3 == 0)


@query(f"WITH {QUERY_LOG} SELECT CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(timestamp))) / 60) AS BIGINT) AS age_minutes, count(*) AS accesses FROM v_query_log GROUP BY 1")
def l11_access_ages(spark, d):
    return logs.access_ages(query_log(spark, d), AS_OF)


@query(f"""WITH {QUERY_LOG}, p(model, price) AS (VALUES ('view', 0.5), ('click', 0.25), ('purchase', 2.0))
    SELECT event_type AS model_name, count(*) AS requests, round(avg(success::INT), 6) AS success_rate, round(avg(response_time_ms), 4) AS avg_time_ms, CAST(sum(event_id % 100) AS BIGINT) AS tokens,
    round(sum((event_id % 100) * coalesce(CAST(price AS DOUBLE), 0.0) / 1000.0), 6)::DOUBLE AS cost FROM v_query_log LEFT JOIN p ON event_type = p.model GROUP BY 1""")
def l12_provider_stats(spark, d):
    prices = spark.createDataFrame([("view", 0.5), ("click", 0.25), ("purchase", 2.0)], "model string, price double")
    return logs.provider_stats(query_log(spark, d).withColumn("tokens", F.col("event_id") % 100), prices, "event_type", "tokens")


@query(f"""WITH {QUERY_LOG}, r AS (SELECT *, sum(success::INT) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS run FROM v_query_log)
    SELECT user_id, min(timestamp) AS started, max(timestamp) AS ended, count(*) AS failures FROM r WHERE NOT success GROUP BY user_id, run HAVING count(*) >= 3""")
def l13_failure_streaks(spark, d):
    return logs.failure_streaks(query_log(spark, d), "user_id", 3)


@query("SELECT o_custkey, o_orderkey, o_totalprice, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS o_totalprice_change FROM orders")
def l14_version_deltas(spark, d):
    out = logs.version_deltas(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_totalprice"])
    return out.withColumn("o_totalprice_change", F.round("o_totalprice_change", 4))


@query(f"WITH {QUERY_LOG} SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) AS started, round(avg(response_time_ms), 6) AS mean, max(response_time_ms) AS most FROM v_query_log GROUP BY 1")
def l15_performance_samples(spark, d):
    return logs.performance_samples(query_log(spark, d).withColumnRenamed("response_time_ms", "value"))


@query(f"""WITH {QUERY_LOG}, {DOCUMENT_EVENTS} SELECT 'query_failed' AS kind, user_id, '{{"event_id":' || event_id || '}}' AS details, timestamp FROM v_query_log WHERE NOT success
    UNION ALL SELECT 'document_' || event_type, user_id, '{{"document_id":' || document_id || '}}', timestamp FROM v_doc_event""")
def l16_system_events(spark, d):
    return logs.system_events(query_log(spark, d), document_events(spark, d))


@query(f"WITH {QUERY_LOG} SELECT round(avg(response_time_ms), 4) AS avg_ms, min(response_time_ms) AS min_ms, max(response_time_ms) AS max_ms, round(1000.0 / avg(response_time_ms), 4)::DOUBLE AS per_second FROM v_query_log")
def l17_latency_summary(spark, d):
    return logs.latency_summary(query_log(spark, d))


@query("""WITH a AS (SELECT event_id AS request_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'u' || user_id END AS user_id, CASE event_type WHEN 'view' THEN '/api/query' WHEN 'click' THEN '/chat/1' ELSE '/health' END AS path,
    CAST(200 + (event_id % 4) * 100 AS INTEGER) AS status, CASE WHEN event_id % 2 = 0 THEN ' 10.0.0.' || (event_id % 9) || ', 10.1.1.1' END AS forwarded_for, '192.168.0.1' AS client FROM events)
    SELECT request_id, coalesce(user_id, 'anonymous') AS user_id, status BETWEEN 200 AND 399 AS success, CASE WHEN NOT status BETWEEN 200 AND 399 THEN 'HTTP ' || status END AS error,
    coalesce(trim(split_part(forwarded_for, ',', 1)), client) AS address FROM a WHERE regexp_matches(path, '/(query|chat)')""")
def l18_access_log(spark, d):
    e = table(spark, d, "events")
    log = e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), "user_id")).alias("user_id"),
        F.when(F.col("event_type") == "view", "/api/query").when(F.col("event_type") == "click", "/chat/1").otherwise("/health").alias("path"),
        (200 + (F.col("event_id") % 4) * 100).cast("int").alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("event_id") % 9, F.lit(", 10.1.1.1"))).alias("forwarded_for"),
        F.lit("192.168.0.1").alias("client"),
    )
    return logs.queries_from_access_log(log)
