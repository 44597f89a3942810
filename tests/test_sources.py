"""Sources with pushed filters: a database by JDBC, and an adapter as a data source."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from docquarry.sources import tables
from docquarry.sources.adapter import SqliteAdapter, read_source


@pytest.fixture(scope="module")
def derby(spark):
    """A table in the embedded database that Spark ships."""
    url = "jdbc:derby:memory:docquarry;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("text "), "id").alias("BODY"), (F.col("id") % 7).alias("KIND"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 3600).alias("MODIFIED"))
    rows.write.format("jdbc").options(url=url, dbtable="DOCS", driver="org.apache.derby.jdbc.EmbeddedDriver").mode("overwrite").save()
    return url


def test_jdbc_reads_only_what_changed_since(spark, derby):
    read = tables.read_jdbc_incremental(spark, derby, "DOCS", "MODIFIED", "2024-01-03 00:00:00", "ID", "BODY", partitionColumn="ID", lowerBound="0", upperBound="100", numPartitions="4", driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = read.collect()
    assert sorted(r["id"] for r in got) == list(range(49, 100))
    assert {r["metadata"] for r in got if r["id"] == 50} == {'{"KIND":1}'} and got[0]["content"].startswith("text ")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(MODIFIED,2024-01-03" in plan.split("PushedFilters: ")[1]
    assert read.rdd.getNumPartitions() == 4


@pytest.fixture()
def store(tmp_path):
    path = tmp_path / "source.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE docs (id INTEGER, title TEXT, score REAL, modified TEXT, raw BLOB)")
        db.executemany("INSERT INTO docs VALUES (?, ?, ?, ?, ?)", [(i, f"t{i % 5}", i / 2, f"2024-01-{1 + i % 28:02d}", bytes([i])) for i in range(200)])
        db.execute("INSERT INTO docs VALUES (NULL, NULL, NULL, NULL, NULL)")
    return str(path)


def test_adapter_rows_and_parts(spark, store):
    df = read_source(spark, SqliteAdapter, path=store, table="docs", key="id", parts="6")
    assert df.dtypes == [("id", "bigint"), ("title", "string"), ("score", "double"), ("modified", "string"), ("raw", "binary")]
    assert df.rdd.getNumPartitions() == 6
    rows = df.collect()
    assert len(rows) == 201 and sum(r["id"] is None for r in rows) == 1 and {r["id"]: r["raw"] for r in rows if r["id"] == 7} == {7: bytearray([7])}


@pytest.mark.parametrize(("condition", "want"), [
    ("modified > '2024-01-27'", lambda i: 1 + i % 28 > 27), ("id >= 20 and id < 25", lambda i: 20 <= i < 25), ("title in ('t1', 't2') and score <= 10", lambda i: i % 5 in (1, 2) and i / 2 <= 10),
    ("id = 3 or title = 't4'", lambda i: i == 3 or i % 5 == 4), ("id is null", lambda i: False), ("length(title) = 2 and id > 190", lambda i: i > 190), ("title = \"it's\"", lambda i: False),
])
def test_adapter_filters(spark, store, condition, want):
    df = read_source(spark, SqliteAdapter, path=store, table="docs", key="id", parts="3").where(condition)
    assert sorted(r["id"] for r in df.collect() if r["id"] is not None) == [i for i in range(200) if want(i)]
    assert df.where("id is null").count() == int(condition == "id is null")


def test_filters_reach_the_source(spark, store):
    """A part is read by the filter: Spark has nothing left to drop."""
    df = read_source(spark, SqliteAdapter, path=store, table="docs", key="id", parts="3").where("modified > '2024-01-20' and title = 't1' and score > rand(1) - 2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter" in line]
    assert not any("2024-01-20" in line.split("BatchScan")[0] for line in left) and any("rand" in line for line in left)
    adapter = SqliteAdapter({"path": store, "table": "docs", "key": "id", "parts": "3"})
    assert adapter.where([("modified", ">", "2024-01-20"), ("title", "in", ("a", "b"))]) == ('1 = 1 AND "modified" > ? AND "title" in (?, ?)', ["2024-01-20", "a", "b"])
    assert adapter.partitions([("id", ">", 1000)]) == []
    assert read_source(spark, SqliteAdapter, path=store, table="docs", key="id").where("id > 1000").count() == 0
