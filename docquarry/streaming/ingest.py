"""Continuous ingest: cleaned, chunked, annotated and embedded documents, and a log of what each batch dropped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import chunk, clean, meta, vector
from .streams import drop_seen

#: Name of the observation of the documents that were read.
READ = "ingest_read"


def ingest(docs: DataFrame, key: str, text: str, time: str, size: int = 1000, overlap: int = 200, batch: Callable[[list[str]], np.ndarray] = vector.hashed_terms, fields: tuple[str, ...] = ()) -> DataFrame:
    """``key, chunk_index, content, hash, word_count, ..., embedding`` and ``fields`` of each document's chunks, the same on a batch and on a stream.

    Texts are cleaned; of documents whose cleaned texts are equal one counts (on a stream the first within the watermark, on a batch the
    least by time and key).  Each chunk gets its statistics and hash, and a vector by ``batch``.  The time is an ingest or publication time:
    on a stream documents that come later than the watermark allows are dropped, and counted by Spark.
    """
    cleaned = docs.select(key, time, *fields, clean.clean_episode(F.col(text)).alias("_text"))
    cleaned = cleaned.withColumn("_hash", meta.content_hash("_text"))
    if docs.isStreaming:
        cleaned = drop_seen(cleaned.observe(READ, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_text").isNull() | (F.col("_text") == "")).alias("empty")), time, "_hash")
    else:
        first = cleaned.groupBy("_hash").agg(F.min(F.struct(time, key)).alias("_first"))
        cleaned = cleaned.join(first, "_hash").where(F.struct(time, key) == F.col("_first")).dropDuplicates(["_hash"])
    kept = cleaned.withColumn("_of", F.struct(key, *fields))
    pieces = chunk.chunk_fixed(kept, "_of", "_text", size, overlap).select("_of.*", "chunk_index", "content")
    stats = meta.content_stats("content")
    annotated = pieces.withColumns({**stats, "hash": meta.content_hash("content")})
    return vector.embed(annotated, key, "content", batch, keep=tuple(c for c in annotated.columns if c != key))


class IngestLog(StreamingQueryListener):
    """Keeps one row for each batch of a query: documents read, empty ones, repeated ones and late ones that were dropped."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int, int, int]] = []

    def onQueryProgress(self, event: StreamingQueryListener.QueryProgressEvent) -> None:
        progress = event.progress
        read = progress.observedMetrics.get(READ)
        states = progress.stateOperators
        late = sum(s.numRowsDroppedByWatermark for s in states)
        repeated = sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in states)
        self.rows.append((str(progress.id), progress.batchId, read["documents"] if read else 0, read["empty"] if read else 0, repeated, late))

    def onQueryStarted(self, event: StreamingQueryListener.QueryStartedEvent) -> None: ...

    def onQueryIdle(self, event: StreamingQueryListener.QueryIdleEvent) -> None: ...

    def onQueryTerminated(self, event: StreamingQueryListener.QueryTerminatedEvent) -> None: ...

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query_id string, batch long, documents long, empty long, repeated long, late long")


def run_ingest(chunks: DataFrame, path: str, checkpoint: str, log: IngestLog | None = None, wait: bool = True) -> StreamingQuery:
    """Appends what is available to ``path`` as parquet; ``log`` listens meanwhile."""
    spark = chunks.sparkSession
    if log:
        spark.streams.addListener(log)
    try:
        query = chunks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        if wait:
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        if log and wait:
            spark.streams.removeListener(log)
    return query
