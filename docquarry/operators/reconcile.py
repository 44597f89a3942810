"""Reconciliation of sources, registries and stored rows by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(stored: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Stored rows whose document is gone; blank keys are ignored."""
    return stored.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).join(documents.select(key), key, "left_anti")


def failed_documents(documents: DataFrame, stored: DataFrame, key: str, text: str, most: int = 10_000) -> DataFrame:
    """Documents without stored rows, with the likely cause."""
    cause = F.when(F.length(text) > most, "too long").when(F.length(F.trim(text)) == 0, "empty").otherwise("unknown")
    return documents.join(stored.select(key), key, "left_anti").select(key, F.length(text).alias("length"), cause.alias("cause"))


def failed_page(failed: DataFrame, order: list[str], limit: int, offset: int, within: tuple[str, str] | None = None) -> DataFrame:
    """One page of the failed documents, ordered, with ``total`` of them all, optionally of one group (its column and value)."""
    rows = failed.where(F.col(within[0]) == within[1]) if within else failed
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def common_causes(failed: DataFrame) -> DataFrame:
    """Each cause's count and share in percent; the total is over the few groups."""
    counts = failed.groupBy("cause").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("cause", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def group_status(documents: DataFrame, stored: DataFrame, key: str, group: list[str], text: str, chunked_from: int = 8000) -> DataFrame:
    """Totals, processed, failed and long documents of each group (none: one row), with a status label.  Documents count once."""
    have = stored.select(key).distinct().withColumn("has", F.lit(1))
    rows = documents.join(have, key, "left")
    total, done = F.count("*"), F.count("has")
    out = rows.groupBy(*group).agg(
        total.alias("total"), done.alias("processed"), F.greatest(F.lit(0), total - done).alias("failed"), F.count_if(F.length(text) > chunked_from).alias("chunked"),
        F.round(F.when(total > 0, 100.0 * done / total).otherwise(0.0), 4).alias("success_percent"),
    )
    return out.withColumn("status", F.when(F.col("processed") == 0, "pending").when(F.col("processed") < F.col("total"), "partial").otherwise("completed"))


def requested(ids: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Whether each requested id exists."""
    return ids.select(key).distinct().join(documents.select(key, F.lit(True).alias("found")).distinct(), key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def touched_groups(documents: DataFrame, ids: DataFrame, key: str, group: str) -> DataFrame:
    return documents.join(ids.select(key), key, "left_semi").select(group).distinct()


def stuck(documents: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    """Rows in processing for longer than ``hours`` become failed."""
    late = (F.col("status") == "processing") & (F.col("updated_at") < F.expr(f"timestamp'{as_of}' - interval {hours} hours"))
    return documents.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each named table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def record_hash(*columns: str) -> Column:
    """md5 of the columns' text joined by ``:``; nulls are empty."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def sync_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Which records are new, changed, unchanged or deleted, by the hash of their columns; a null differs from an empty text."""
    whole = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    a, b = (x.select(key, whole.alias(h)) for x, h in ((old, "old_hash"), (new, "new_hash")))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def sync_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("records"))


def sync_log(runs: DataFrame) -> DataFrame:
    """Each run of ``runs(source_id, run_id, started, ended, processed, added, updated, deleted, error)`` with its status and duration in seconds."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("ended").isNull(), "running").otherwise("completed")
    return runs.select("*", status.alias("status"), (F.col("ended").cast("double") - F.col("started").cast("double")).alias("duration"))


def sync_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """The state table, one row for each source, with the latest of the new runs in place of the old row; a failed run keeps the last good time."""
    logged = sync_log(runs)
    last = logged.groupBy("source_id").agg(F.max_by(F.struct("status", "processed", "added", "updated", "deleted", "duration", "error"), F.struct("started", "run_id")).alias("r"), F.max(F.when(F.col("status") == "completed", F.col("ended"))).alias("_good"))
    before = state.select("source_id", F.col("last_sync").alias("_before"))
    new = last.join(before, "source_id", "left").select("source_id", F.coalesce("_good", "_before").alias("last_sync"), "r.*")
    return state.join(new.select("source_id"), "source_id", "left_anti").select(*new.columns).unionByName(new)


def life_cycle(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """``key, status, processed_date, chunk_count, vector_count, metadata`` of each document, from its ``chunks(key, done_at, has_vector, metadata)``.

    A document with chunks is processed, at the time of its last chunk; the chunks' metadata replace the document's map ``metadata`` key by key,
    the value of the latest chunk first.  Documents without the column start with an empty map.
    """
    own = F.col("metadata") if "metadata" in documents.columns else F.create_map().cast("map<string,string>")
    counts = chunks.groupBy(key).agg(F.count("*").alias("_chunks"), F.count_if("has_vector").alias("_vectors"), F.max("done_at").alias("processed_date"))
    pairs = chunks.select(key, "done_at", F.explode("metadata").alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", F.struct("done_at", "v")).alias("v"))
    merged = pairs.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("_new"))
    rows = documents.select(key, own.alias("_own")).join(counts, key, "left").join(merged, key, "left")
    kept = F.map_filter("_own", lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(key, F.when(F.col("_chunks") > 0, "processed").otherwise("uploading").alias("status"), "processed_date", zero("_chunks").alias("chunk_count"), zero("_vectors").alias("vector_count"), F.map_concat(kept, F.coalesce("_new", F.create_map().cast("map<string,string>"))).alias("metadata"))


def run_statistics(runs: DataFrame, ok: Column, value: str) -> DataFrame:
    """Runs, success rate in percent (100 without runs) and mean of a value."""
    return runs.agg(F.count("*").alias("runs"), F.round(F.when(F.count("*") == 0, 100.0).otherwise(100.0 * F.count_if(ok) / F.count("*")), 4).alias("success_rate"), F.round(F.avg(value), 4).alias("average"))


def marked_in_json(rows: DataFrame, column: str, word: str) -> DataFrame:
    return rows.where(F.col(column).contains(word))
