"""Analytics over query, document and session logs.  Every "now" is an explicit ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _after(column: str, as_of: str, interval: str) -> Column:
    return F.col(column) >= F.expr(f"timestamp'{as_of}' - interval {interval}")


def _query_measures() -> list[Column]:
    ok = F.count_if(F.col("success"))
    return [
        F.count("*").alias("total_queries"),
        ok.alias("successful_queries"),
        F.count_if(~F.col("success")).alias("failed_queries"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_time_ms"),
        F.countDistinct("user_id").alias("unique_users"),
        F.round(F.when(F.count("*") > 0, 100.0 * ok / F.count("*")).otherwise(0.0), 2).alias("success_rate"),
    ]


def query_stats(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row over the last ``days`` days: totals, failures, mean time, distinct users, success rate in percent."""
    return log.where(_after("timestamp", as_of, f"{days} days")).agg(*_query_measures())


def daily_trend(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """``query_stats`` for each day."""
    return log.where(_after("timestamp", as_of, f"{days} days")).groupBy(F.to_date("timestamp").alias("day")).agg(*_query_measures())


def document_changes(events: DataFrame) -> DataFrame:
    """Documents added and deleted for each day."""
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(F.count_if(F.col("event_type") == "upload").alias("documents_added"), F.count_if(F.col("event_type") == "delete").alias("documents_deleted"))


def daily_rollup(log: DataFrame, events: DataFrame) -> DataFrame:
    """Query measures, document changes and the number of documents up to each day.

    The running total works on one row a day, not on the logs, so its single window partition stays small.
    """
    by_day = log.groupBy(F.to_date("timestamp").alias("day")).agg(*_query_measures())
    days = by_day.join(document_changes(events), "day", "full").na.fill(0)
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("total_documents", F.greatest(F.lit(0), F.sum(F.col("documents_added") - F.col("documents_deleted")).over(upto)))


def document_count(events: DataFrame) -> DataFrame:
    """Uploads less deletions, at least 0."""
    change = F.when(F.col("event_type") == "upload", 1).when(F.col("event_type") == "delete", -1).otherwise(0)
    return events.agg(F.greatest(F.lit(0), F.coalesce(F.sum(change), F.lit(0))).cast("long").alias("documents"))


def active_users(log: DataFrame, as_of: str, minutes: int) -> DataFrame:
    return log.where(_after("timestamp", as_of, f"{minutes} minutes") & (F.col("timestamp") <= F.expr(f"timestamp'{as_of}'"))).agg(F.countDistinct("user_id").alias("active_users"))


def recent(rows: DataFrame, order: str, key: str, n: int) -> DataFrame:
    """The last ``n`` rows by time; ties by key."""
    return rows.orderBy(F.desc(order), F.desc(key)).limit(n)


def hit_metrics(hits: DataFrame) -> DataFrame:
    """Count and similarity statistics of each query's hits."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.avg("score"), 6).alias("avg_score"))


def latency_breakdown(log: DataFrame, parts: list[str], by: list[str | Column]) -> DataFrame:
    """Sum, mean, median and 95th percentile of each timing or token column for each group; percentiles are exact, from a group's distinct values and their counts."""
    percentile = lambda c, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{c}`)")
    forms = {"sum": lambda c: F.round(F.sum(c), 6), "avg": lambda c: F.round(F.avg(c), 6), "p50": lambda c: percentile(c, 0.5), "p95": lambda c: percentile(c, 0.95)}
    return log.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in parts for n, f in forms.items()])


def search_stats(log: DataFrame, filtered: Column, results: Column) -> DataFrame:
    """Totals, the share of filtered searches in percent, mean time, mean number of results."""
    return log.agg(F.count("*").alias("searches"), F.round(100.0 * F.count_if(filtered) / F.count("*"), 4).alias("filtered_percent"), F.round(F.avg("response_time_ms"), 4).alias("avg_time_ms"), F.round(F.avg(results), 4).alias("avg_results"))


def cache_stats(log: DataFrame, key: str, hit: Column) -> DataFrame:
    """Accesses, hits, misses and hit rate of each cache or collection."""
    return log.groupBy(key).agg(F.count("*").alias("accesses"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.count_if(hit) / F.count("*"), 6).alias("hit_rate"))


def access_ages(log: DataFrame, as_of: str) -> DataFrame:
    """How many accesses are so many whole minutes old."""
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("timestamp")) / 60)
    return log.groupBy(age.cast("long").alias("age_minutes")).agg(F.count("*").alias("accesses"))


def provider_stats(log: DataFrame, prices: DataFrame, model: str, tokens: str) -> DataFrame:
    """Requests, success rate, mean time, tokens and cost of each model; ``prices(model, price)`` is a small table, per 1000 tokens."""
    priced = log.join(F.broadcast(prices), log[model] == prices["model"], "left").drop(prices["model"])
    return priced.groupBy(F.col(model).alias("model_name")).agg(
        F.count("*").alias("requests"),
        F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"),
        F.round(F.avg("response_time_ms"), 4).alias("avg_time_ms"),
        F.sum(tokens).alias("tokens"),
        F.round(F.sum(F.col(tokens) * F.coalesce("price", F.lit(0.0)) / 1000.0), 6).alias("cost"),
    )


def failure_streaks(log: DataFrame, key: str, at_least: int = 5) -> DataFrame:
    """Runs of ``at_least`` failures in a row of each key: first and last time, length."""
    order = Window.partitionBy(key).orderBy("timestamp", "event_id")
    runs = log.withColumn("run", F.sum(F.col("success").cast("int")).over(order)).where("not success")
    return runs.groupBy(key, "run").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.count("*").alias("failures")).where(F.col("failures") >= at_least).drop("run")


def version_deltas(versions: DataFrame, key: str, order: str, measures: list[str]) -> DataFrame:
    """Each version's measures less those of the version before it (null for the first)."""
    line = Window.partitionBy(key).orderBy(order)
    return versions.select(key, order, *measures, *[(F.col(m) - F.lag(m).over(line)).alias(f"{m}_change") for m in measures])


def performance_samples(samples: DataFrame, interval: str = "5 minutes") -> DataFrame:
    """Mean and maximum of a value in each interval."""
    return samples.groupBy(F.window("timestamp", interval).alias("w")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("started"), "mean", "most")


def system_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """Query failures and document events as one event table with JSON details."""
    failed = log.where("not success").select(F.lit("query_failed").alias("kind"), "user_id", F.to_json(F.struct("event_id")).alias("details"), "timestamp")
    changed = events.select(F.concat(F.lit("document_"), "event_type").alias("kind"), "user_id", F.to_json(F.struct("document_id")).alias("details"), "timestamp")
    return failed.unionByName(changed)


def latency_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.round(F.avg("response_time_ms"), 4).alias("avg_ms"), F.min("response_time_ms").alias("min_ms"), F.max("response_time_ms").alias("max_ms"), F.round(1000.0 / F.avg("response_time_ms"), 4).alias("per_second"))


def queries_from_access_log(log: DataFrame) -> DataFrame:
    """Requests to query or chat paths as query log rows: status 200 to 399 succeeds, the first forwarded address counts."""
    ok = F.col("status").between(200, 399)
    return log.where(F.col("path").rlike("/(query|chat)")).select(
        "request_id",
        F.coalesce("user_id", F.lit("anonymous")).alias("user_id"),
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("HTTP "), F.col("status"))).alias("error"),
        F.coalesce(F.trim(F.get(F.split("forwarded_for", ","), 0)), F.col("client")).alias("address"),
    )
