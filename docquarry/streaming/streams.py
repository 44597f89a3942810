"""Structured Streaming forms of the log, sync and ingest jobs, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .state import trailing_counts

#: How late an event may be.
LATENESS = "10 minutes"


def _seconds(times: pd.Series) -> list[float]:
    return (times.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def _accept(accepted: list[float], t: float, most: int, seconds: int) -> bool:
    """Whether a request at ``t`` is accepted; ``accepted`` is brought up to date."""
    accepted[:] = [a for a in accepted if a > t - seconds]
    if len(accepted) < most:
        accepted.append(t)
        return True
    return False


def rate_limited(requests: DataFrame, most: int = 100, seconds: int = 60) -> DataFrame:
    """``request_id, accepted``: at most ``most`` accepted requests of a client in the trailing time; rejected ones do not count.

    A client's requests are decided in the order of time and id.  Rows come sorted, batch by batch, and only the ``most`` accepted times of
    one client are held, so a client with a third of all requests takes one task long but not its memory.  On a stream the accepted times
    are the client's state and the order is that within each part of the stream.
    """
    schema = "request_id long, accepted boolean"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepted: list[float] = []
        client: object = decide
        for rows in batches:
            out = []
            for c, t in zip(rows["client"], _seconds(rows["timestamp"]), strict=True):
                c = None if pd.isna(c) else c
                if c != client:
                    client, accepted = c, []
                out.append(_accept(accepted, t, most, seconds))
            yield pd.DataFrame({"request_id": rows["request_id"], "accepted": out})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["timestamp", "request_id"])
        out = [_accept(accepted, t, most, seconds) for t in _seconds(rows["timestamp"])]
        state.update((accepted,))
        yield pd.DataFrame({"request_id": rows["request_id"], "accepted": out})

    rows = requests.select("request_id", "client", "timestamp")
    if requests.isStreaming:
        return rows.groupBy("client").applyInPandasWithState(step, schema, "times array<double>", "append", "NoTimeout")
    return rows.repartition("client").sortWithinPartitions("client", "timestamp", "request_id").mapInPandas(decide, schema)


#: Spans of a client's line, as multiples of the trailing time: a batch counts them on their own.
SPAN = 16


def trailing_count(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """How many requests of the client there were in the trailing time, this one and those of the same moment included.

    On a batch the requests keep their columns.  A client's line is cut into spans of ``SPAN`` times the trailing time, and a request near
    a span's end also counts in the next one, so that a client with very many requests is split.  On a stream there are ``request_id`` and
    ``in_window``, told once the watermark has passed the request.
    """
    if requests.isStreaming:
        return trailing_counts(requests, seconds, LATENESS)
    length = seconds * 1_000_000
    at, span = F.unix_micros("timestamp"), F.floor(F.unix_micros("timestamp") / (SPAN * length))
    reaches = F.floor((at + length) / (SPAN * length)) > span
    spread = requests.withColumn("_span", F.explode(F.when(reaches, F.array(span, span + 1)).otherwise(F.array(span))))
    line = Window.partitionBy("client", "_span").orderBy(F.unix_micros("timestamp")).rangeBetween(-length, 0)
    counted = spread.withColumn("in_window", F.count("*").over(line))
    return counted.where(F.col("_span").eqNullSafe(span)).drop("_span")


def active_users(log: DataFrame, length: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Users in each sliding window; the same on a batch and on a stream."""
    rows = log.withWatermark("timestamp", LATENESS) if log.isStreaming else log
    return rows.groupBy(F.window("timestamp", length, slide).alias("w")).agg(F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("started"), "users")


def daily_rollup(log: DataFrame) -> DataFrame:
    rows = log.withWatermark("timestamp", "1 day") if log.isStreaming else log
    by = rows.groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count("*").alias("queries"), F.count_if("success").alias("ok"), F.sum("response_time_ms").alias("time_ms"))
    return by.select(F.to_date("w.start").alias("day"), "queries", "ok", "time_ms")


def user_sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by gaps between events: start, last event, duration, events."""
    rows = log.withWatermark("timestamp", LATENESS) if log.isStreaming else log
    by = rows.groupBy("user_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("events"), F.min("timestamp").alias("started"), F.max("timestamp").alias("last_seen"))
    return by.select("user_id", "started", "last_seen", (F.unix_micros("last_seen") - F.unix_micros("started")).alias("micros"), "events")


def clean_and_chunk(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Stateless ingest: cleaned text in fixed chunks with their hashes; works on streams and batches."""
    from ..operators.chunk import chunk_fixed
    from ..operators.clean import clean_episode

    cleaned = docs.select(key, clean_episode(F.col(text)).alias("_text"))
    return chunk_fixed(cleaned, key, "_text", size, overlap).withColumn("hash", F.sha2("content", 256))


def drop_seen(rows: DataFrame, time: str, key: str) -> DataFrame:
    """Each key once; on a stream within the watermark."""
    return rows.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def failure_alerts(log: DataFrame, streak: int = 5) -> DataFrame:
    """``user_id, timestamp, failures``: a row when a user's failures in a row reach ``streak``; on a stream the count is kept as state."""
    if not log.isStreaming:
        line = Window.partitionBy("user_id").orderBy("timestamp", "event_id")
        runs = log.withColumn("run", F.sum(F.col("success").cast("int")).over(line)).where("not success")
        nth = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("timestamp", "event_id"))
        return runs.withColumn("failures", nth.cast("long")).where(F.col("failures") == streak).select("user_id", "timestamp", "failures")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, out = state.get[0] if state.exists else 0, []
        rows = pd.concat(list(batches)).sort_values(["timestamp", "event_id"])
        for t, ok in zip(rows["timestamp"], rows["success"], strict=True):
            count = 0 if ok else count + 1
            if count == streak:
                out.append((key[0], t, count))
        state.update((count,))
        yield pd.DataFrame(out, columns=["user_id", "timestamp", "failures"])

    return log.groupBy("user_id").applyInPandasWithState(step, "user_id long, timestamp timestamp, failures long", "n long", "append", "NoTimeout")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is available as parquet and stops; the checkpoint remembers what has been read."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hands each new part of a stream to ``apply(batch, id)``, for example ``SyncedTable.apply`` or ``days_sink``; the checkpoint replaces a last-sync time.

    A batch may come again after a failure, with the same id and rows: ``apply`` must end the same.
    """
    query = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sync_available(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return run_batches(stream, apply, checkpoint)
