"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds, bucket_of, cut

#: Rows of one sorted part, and the most parts; the driver holds two sums for each part.
PART_ROWS, MOST_PARTS = 10_000, 10_000


def balanced_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts documents, ascending by id, into ``shards`` runs with nearly equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  Size is the text's UTF-8 bytes plus 8.  A row
    goes where the middle of its bytes lies on the line of all bytes, so a shard misses its target by at most one row.

    Rows are dealt into parts by quantiles of the id; parts are sorted and summed on their own, the driver adds up
    the parts' totals (two numbers each), and each row's global position is its part's offset plus its own sum.

    A null or empty text has size 8 and checksum 0.  Null ids come first.  Repeated ids are ordered by checksum and
    size; equal rows are interchangeable.  Other columns are not read.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    rows = sized.count()
    parts = sized.withColumn("part", bucket_of("doc_id", bounds(sized, "doc_id", min(MOST_PARTS, 1 + rows // PART_ROWS))))
    totals = sorted(parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    offsets, total, before = [], 0, 0
    for t in totals:
        offsets.append((t["part"], total, before))
        total, before = total + t["bytes"], before + t["rows"]
    offset = sized.sparkSession.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    order = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumns({"inner": F.sum("size").over(running), "at": F.row_number().over(order)}).join(F.broadcast(offset), "part")
    doubled = 2 * (F.col("bytes_before") + F.col("inner")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(doubled.cast("decimal(30,0)") * shards / F.lit(max(1, 2 * total)).cast("decimal(25,0)"))).cast("int")
    placed = cut(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("at") - 1).alias("rank")))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
