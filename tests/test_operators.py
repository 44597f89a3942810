"""Edges and properties of operators that SQL does not cover."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import chunk, clean, rank, reconcile
from docquarry.operators import vector as V
from docquarry.sources import tables
from docquarry.streaming import streams

TEXTS = ["", " ", "a", "no separators" * 30, "One. Two! Three?\n\nFour. " * 40, "\n\n\n", "x" * 2500]


@pytest.mark.parametrize("name", ["recursive", "boundary", "sentence", "character", "fixed", "token"])
def test_chunkers_take_edges(spark, name):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "k long, t string")
    out = chunk.chunker(name)(rows, "k", "t").collect()
    assert all(r["content"].strip() for r in out)
    assert not {r["k"] for r in out} & {0, 1, 7}


def test_recursive_chunks_fit():
    for t in TEXTS:
        parts = chunk.split_recursive(t, 100, 20)
        assert all(len(p) <= 100 for p in parts)
        assert set("".join(t.split())) == set("".join("".join(parts).split()))


def test_boundary_chunks_fit_and_cover():
    text = "Some words here. " * 500
    parts = chunk.split_at_boundaries(text, 300, 50)
    assert all(len(p) <= 300 for p in parts)
    assert len(parts) == len(set(parts))


def test_clean_text_names_what_changed(spark):
    rows = spark.createDataFrame([(1, "<p>a&amp;b</p>\t“x”  y"), (2, None), (3, "  "), (4, "plain")], "k int, t string")
    out = {r["k"]: r for r in clean.clean_text(rows, "t").collect()}
    assert out[1]["cleaned"] == 'a&b "x" y'
    assert "html_tags" in out[1]["rules_applied"] and "quotes" in out[1]["rules_applied"]
    assert out[2]["cleaned"] is None and out[3]["warning"] == "blank text"
    assert out[4]["rules_applied"] == []


def test_wrap_and_tabs(spark):
    row = spark.createDataFrame([("aa bb cc dd\nlonglonglong x\ta",)], "t string").select(clean.wrap_lines(F.col("t"), 5).alias("w"), clean.expand_tabs(F.lit("a\tb")).alias("e")).head()
    assert row["w"].split("\n")[:2] == ["aa bb", "cc dd"]
    assert row["e"] == "a   b"


def test_zero_vector_and_short_corpus(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query_vec array<double>")
    c = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 0.0])], "vec_id long, embedding array<float>")
    hits = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in V.vector_topk(q, c, 5).orderBy("query_id", "rank").collect()]
    assert hits[:3] == [(1, 1, 10, 1.0), (1, 2, 11, 1.0), (1, 3, 12, 0.0)]
    assert len(hits) == 6
    assert V.vector_topk_batched(q, c, 2).count() == 4


def test_many_queries_are_searched_in_blocks(spark, monkeypatch):
    from docquarry.operators import blocks

    c = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = c.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in df.collect())
    whole = hits(V.vector_topk(q, c, 3))
    # No query table is small enough to be broadcast, and blocks hold a few rows.
    monkeypatch.setattr(V, "MOST_QUERY_BYTES", 0)
    monkeypatch.setattr(V, "BLOCK_ROWS", 3)
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 64 * 40)
    assert hits(V.vector_topk(q, c, 3)) == hits(V.vector_topk_batched(q, c, 3)) == whole
    assert len(whole) == 21


def test_mmr_with_full_weight_is_top_k(spark):
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, query_vec array<double>")
    c = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "vec_id long, embedding array<float>")
    top = V.vector_topk(q, c, 8, fields=("embedding",))
    assert [r["vec_id"] for r in V.mmr(top, 3, 1.0).orderBy("rank").collect()] == [r["vec_id"] for r in top.orderBy("rank").limit(3).collect()]


def test_visiting_all_cells_is_exact(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = c.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    celled, centres = V.ivf_cells(c, "embedding", 4)
    assert V.recall(V.approximate_topk(q, celled, centres, 5, 4), V.vector_topk(q, c, 5)).agg(F.min("recall")).head()[0] == 1.0


@pytest.mark.parametrize("name", ["f9_diverse_by_score", "f10_mmr", "f19_approximate_topk", "f20_recall"])
def test_every_fiftieth_vector_is_searched(spark, name):
    from docquarry.plans import catalog

    out = catalog.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    assert set(out["query_id"]) == set(range(0, 500, 50))
    if name == "f20_recall":
        assert out["recall"].mean() >= 0.9


def test_near_copies_go(spark):
    hits = spark.createDataFrame([(1, 1, "a b c d", 0.9), (1, 2, "a b c d", 0.8), (1, 3, "x y", 0.7)], "query_id long, doc_id long, t string, s double")
    assert sorted(r["doc_id"] for r in rank.drop_near_copies(hits, "t", "s").collect()) == [1, 3]


def test_write_counts_rows_and_json_round_trip(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    assert tables.write_rows(rows, str(tmp_path / "t"), ["p"]) == 10
    tables.export_json(rows, str(tmp_path / "j"))
    assert tables.import_json(spark, str(tmp_path / "j"), "id long, p long").count() == 10


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("grüß".encode())
    (tmp_path / "b.md").write_bytes(b"bad \xff byte")
    (tmp_path / "c.bin").write_bytes(b"no")
    got = {r["id"]: r["text"] for r in tables.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"file_a": "grüß", "file_b": "bad � byte"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "event_id long, success boolean, response_time_ms double, user_id long")
    assert reconcile.run_statistics(empty, F.col("success"), "response_time_ms").head()["success_rate"] == 100.0


@pytest.fixture()
def event_files(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", F.col("value").alias("response_time_ms"), (F.col("event_type") != "error").alias("success"))
    for part in range(3):  # one after the other, so that the stream reads them in the order of time
        log.where(F.expr(f"event_id div 334 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return log, lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), tmp_path


@pytest.mark.parametrize("job", [streams.daily_rollup, streams.user_sessions, streams.active_users])
def test_streams_agree_with_batches(spark, event_files, job):
    log, stream, path = event_files
    streams.run_available(job(stream()), str(path / "out"), str(path / "cp"))
    batch = job(log)
    got = spark.read.schema(batch.schema).parquet(str(path / "out"))
    if "time_ms" in batch.columns:  # sums of doubles differ in their last bits
        got, batch = got.withColumn("time_ms", F.round("time_ms", 4)), batch.withColumn("time_ms", F.round("time_ms", 4))
    # What ends last stays open until the watermark passes it; all else is equal.
    assert got.exceptAll(batch).count() == 0
    assert 0 < got.count() <= batch.count()


def test_stream_of_alerts(spark, event_files):
    log, stream, path = event_files
    streams.run_available(streams.failure_alerts(stream(), 2), str(path / "out"), str(path / "cp"))
    want = streams.failure_alerts(log, 2)
    rows = lambda df: sorted(map(tuple, df.select("user_id", "timestamp", "failures").collect()))
    assert rows(spark.read.parquet(str(path / "out"))) == rows(want) != []


def test_stream_of_rate_limits(spark, event_files):
    _, stream, path = event_files
    requests = lambda rows: rows.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "timestamp")
    log = requests(event_files[0])
    accepted, want = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["timestamp"], r["request_id"])):
        known = accepted.setdefault(r["client"], [])
        want[r["request_id"]] = sum((r["timestamp"] - t).total_seconds() < 86_400 for t in known) < 3
        known += [r["timestamp"]] * want[r["request_id"]]
    assert {r["request_id"]: r["accepted"] for r in streams.rate_limited(log, 3, 86_400).collect()} == want
    assert not all(want.values())
    streams.run_available(streams.rate_limited(requests(stream()), 3, 86_400), str(path / "out"), str(path / "cp"))
    assert {r["request_id"]: r["accepted"] for r in spark.read.parquet(str(path / "out")).collect()} == want


def test_numbers_within_a_hot_group(spark):
    from docquarry.plans.views import numbered

    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 == 0, "cold")).alias("g"))
    got = {r["id"]: r["n"] for r in numbered(rows, "g", "id", "n", 7).collect()}
    seen, want = {}, {}
    for r in rows.orderBy("id").collect():
        want[r["id"]] = seen[r["g"]] = seen.get(r["g"], 0) + 1
    assert got == want
    assert numbered(rows.limit(0), "g", "id", "n").count() == 0


def test_incremental_sync(spark, event_files):
    _, stream, path = event_files
    seen = []
    streams.sync_available(stream().select("event_id"), str(path / "cp"), lambda batch, _: seen.append(batch.count()))
    assert sum(seen) == 1000
    streams.sync_available(stream().select("event_id"), str(path / "cp"), lambda batch, _: seen.append(-batch.count()))
    assert sum(seen) == 1000


def test_recall_of_the_registered_index(spark):
    from docquarry.plans import catalog

    found = catalog.queries()["f20_recall"](spark, "/root/testdata/sf0.1").agg(F.avg("recall"), F.min("recall")).head()
    assert found[0] >= 0.9


def test_efforts():
    from docquarry.operators import vector

    assert [vector.probes_for(e, 500, 0) for e in ("precision", "balanced", "speed")] == [256, 64, 16]
    assert [vector.probes_for("adaptive", 500, n) for n in (100, 10_000, 5_000_000)] == [16, 64, 256]
    assert vector.probes_for("precision", 8, 0) == 8
