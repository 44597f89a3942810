"""Streams whose files come in any order, whose batches are repeated, and whose rows come late, against plain batches."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquarry.operators import reconcile
from docquarry.sources.tables import upsert
from docquarry.streaming import ingest as I
from docquarry.streaming import sinks, streams

START = 1_704_067_200


def write_parts(rows, path, parts):
    """One file a part, so that a stream reads them one after the other."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(str(path))


def files(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_trailing_counts_of_shuffled_files(spark, tmp_path, rocksdb):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 2, 2]), START + i * 7 + rng.randrange(-200, 200)) for i in range(600)] + [(1000 + i, 2, START + 900) for i in range(5)]
    df = spark.createDataFrame([*rows, (-1, 99, START + 1_000_000), (-2, 99, START + 2_000_000)], "request_id long, client long, s long").select("request_id", "client", F.timestamp_seconds("s").alias("timestamp"))
    parts = [F.expr(f"request_id between 0 and 999 and request_id div 150 = {k} or {k} = 0 and request_id >= 1000") for k in range(4)]
    write_parts(df, tmp_path / "in", [*parts, F.col("request_id") == -1, F.col("request_id") == -2])
    query = streams.run_available(streams.trailing_count(files(spark, tmp_path / "in", df.schema), 600), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["request_id"]: r["in_window"] for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["request_id"] >= 0}
    brute = {i: sum(c2 == c and s - 600 <= s2 <= s for _, c2, s2 in rows) for i, c, s in rows}
    assert got == brute
    assert {r["request_id"]: r["in_window"] for r in streams.trailing_count(df, 600).collect() if r["request_id"] >= 0} == brute
    # Clients that stay away leave no state: only the last request's client is still known.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_trailing_count_splits_a_hot_client(spark):
    rng = random.Random(2)
    rows = [(i, 1, START + rng.randrange(100_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "request_id long, client long, s long").select("request_id", "client", F.timestamp_seconds("s").alias("timestamp"), F.lit("x").alias("more"))
    counted = streams.trailing_count(df, 100)
    assert counted.columns == ["request_id", "client", "timestamp", "more", "in_window"] and counted.count() == 3000
    times = sorted(s for _, _, s in rows)
    assert {r["request_id"]: r["in_window"] for r in counted.collect()} == {i: sum(s - 100 <= t <= s for t in times) for i, _, s in rows}


def test_daily_rollup_changes_only_its_days(spark, tmp_path):
    log = spark.range(400).select("id", F.timestamp_seconds(START + F.col("id") * 1800).alias("timestamp"), (F.col("id") % 3 > 0).alias("success"), F.col("id").cast("double").alias("response_time_ms"))
    late = log.where("id < 40").withColumn("timestamp", F.timestamp_seconds(START + 7 * 86_400 + F.col("id")))  # of a day that is already written
    table, cp = str(tmp_path / "table"), str(tmp_path / "cp")
    write_parts(log, tmp_path / "in", [F.expr(f"id div 100 = {k}") for k in range(4)])
    stream = lambda: streams.daily_rollup(files(spark, tmp_path / "in", log.schema))
    streams.run_batches(stream(), sinks.days_sink(table), cp, "update")
    rows = lambda df: {r["day"]: (r["queries"], r["ok"], r["time_ms"]) for r in df.collect()}
    assert rows(spark.read.parquet(table)) == rows(streams.daily_rollup(log))
    stamps = lambda: {p: p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}
    before = stamps()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.run_batches(stream(), sinks.days_sink(table), cp, "update")
    assert rows(spark.read.parquet(table)) == rows(streams.daily_rollup(log.unionByName(late)))
    kept = set(before) & set(stamps())
    assert {p.parent.name for p in set(before) - kept} == {"day=2024-01-08"}
    assert all(before[p] == stamps()[p] for p in kept)


class Killed(Exception):
    pass


@pytest.mark.parametrize("at", ["before", "staging", "replacing", "after"])
def test_sync_that_is_killed_and_started_again(spark, tmp_path, monkeypatch, at):
    """The table and its log end as if nothing had happened, wherever the second batch breaks off."""
    schema = "id long, name string, bal long"
    old = spark.createDataFrame([(i, f"n{i}", i) for i in range(40)], schema)
    new = spark.createDataFrame([(i, f"n{i}" if i % 3 else f"m{i}", i) for i in range(10, 70)] + [(10, "zz", 1), (11, None, 2)], schema)
    write_parts(new, tmp_path / "in", [F.expr(f"id % 3 = {k}") for k in range(3)])
    table = sinks.SyncedTable(spark, str(tmp_path / "t"), schema, "id", ["name", "bal"], buckets=4)
    table.fill(old)

    def broken(batch, batch_id):
        if batch_id != 1:
            return table.apply(batch, batch_id)
        if at == "before":
            raise Killed
        if at == "staging":  # a folder without its mark of success
            table.apply(batch.limit(0), 99)
            (tmp_path / "t/staged/batch=99/_SUCCESS").unlink()
            (tmp_path / "t/staged/batch=99").rename(tmp_path / "t/staged/batch=1")
            raise Killed
        if at == "replacing":
            monkeypatch.setattr(table, "_replace", lambda rows: (sinks._only_these_partitions(rows.where("bucket < 2"), f"{table.path}/table", "bucket"), (_ for _ in ()).throw(Killed())))
        table.apply(batch, batch_id)
        raise Killed

    stream = lambda: files(spark, tmp_path / "in", new.schema)
    with pytest.raises(Exception, match="Killed"):
        streams.run_batches(stream(), broken, str(tmp_path / "cp"))
    monkeypatch.undo()
    streams.run_batches(stream(), table.apply, str(tmp_path / "cp"))
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(map(tuple, upsert(old, new, ["id"]).collect()), key=str)
    once = upsert(new, new, ["id"])
    want = {r["change"]: r["records"] for r in reconcile.sync_counts(reconcile.sync_diff(old, once, "id", ["name", "bal"])).collect() if r["change"] != "deleted"}
    got = {}
    for r in table.log().where("batch < 99").collect():
        got[r["change"]] = got.get(r["change"], 0) + r["records"]
    assert got == want
    again = sorted(Path(tmp_path / "t/table").rglob("*.parquet"))
    streams.run_batches(stream(), table.apply, str(tmp_path / "cp"))
    assert sorted(Path(tmp_path / "t/table").rglob("*.parquet")) == again


def test_ingest_stream_equals_batch_and_tells_what_it_dropped(spark, tmp_path):
    rng = random.Random(3)
    text = lambda i: " ".join(rng.choice(["river", "stone", "cloud", "green", "Paper"]) + str(i) for _ in range(60))
    texts = {i: text(i) for i in range(40)}
    docs = [(i, texts[i % 30] if i >= 35 else texts[i], "s", START + 60 * i) for i in range(40)] + [(50, None, "s", START + 2000), (51, "  ", "s", START + 2000)]
    late = [(100 + i, text(100 + i), "s", START - 90_000) for i in range(7)]
    schema = "doc_id long, text string, source string, s long"
    shape = lambda rows: spark.createDataFrame(rows, schema).select("doc_id", "text", "source", F.timestamp_seconds("s").alias("at"))
    all_docs = shape(docs)
    write_parts(all_docs, tmp_path / "in", [F.col("doc_id") < 20, F.col("doc_id") >= 20])
    shape(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = I.IngestLog()
    stream = I.ingest(files(spark, tmp_path / "in", all_docs.schema), "doc_id", "text", "at", 200, 50, fields=("source",))
    I.run_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), log)
    batch = I.ingest(all_docs, "doc_id", "text", "at", 200, 50, fields=("source",))
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    rows = lambda df: sorted((r["doc_id"], r["chunk_index"], r["content"], r["hash"], r["word_count"], r["source"], tuple(r["embedding"])) for r in df.collect())
    assert rows(got) == rows(batch) != []
    assert {r["doc_id"] for r in got.collect()} == set(range(35))
    table = log.table(spark).agg(F.sum("documents"), F.sum("empty"), F.sum("repeated"), F.sum("late")).head()
    assert (table[0], table[1], table[3]) == (49, 2, 7) and table[2] >= 5


def test_without_a_shared_folder_nothing_is_written(tmp_path):
    """With an empty configuration folder there is no folder for written tables: an error, not a machine-local folder."""
    code = """
from pyspark.sql import SparkSession
from docquarry.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
try:
    scratch.written(spark.range(3))
    print("written")
except ValueError as e:
    print("refused", e)
"""
    import os

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert "refused" in out.stdout
    code = code.replace('.config("spark.ui.enabled", "false")', f'.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared")')
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert "written" in out.stdout and (tmp_path / "shared").exists()
