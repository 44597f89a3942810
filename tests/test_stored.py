"""The stored inverted index in many segments: postings are added up where they lie."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import indexed, lexical, rank
from docquarry.plans.views import questions, table

SF = "/root/testdata/sf0.001"


def scored(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("key", ["doc_id", "name"])
def test_segments_give_the_best_without_a_row_for_each_posting(spark, tmp_path, monkeypatch, small_batches, key):
    monkeypatch.setattr(indexed, "BLOCK_POSTINGS", 7)
    monkeypatch.setattr(indexed, "HELD_SCORES", 100)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).select(F.concat(F.lit("é"), "doc_id").alias("name") if key == "name" else "doc_id", "text")
    terms = lexical.query_terms(questions(spark, SF), "query")
    store = indexed.IndexStore(spark, str(tmp_path / "index"), key, buckets=4).write(docs, "text")
    got = store.best(terms, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInPandas" in plan
    want = rank.rank_by(lexical.bm25(docs, key, "text", terms).withColumn("bm25", F.round("bm25", 6)), F.col("bm25"), key).where("rank <= 4")
    columns = "query_id", "rank", key, "bm25"
    assert scored(got, *columns) == scored(want, *columns)
    # More terms than a task takes: some queries at a time.
    monkeypatch.setattr(indexed, "MOST_TERMS", terms.count() // 2)
    assert scored(store.best(terms, 4), *columns) == scored(want, *columns)
    assert store.scores(terms).count() == lexical.bm25(docs, key, "text", terms).count()


def test_softmax_reads_the_hits_twice_and_holds_for_any_score(spark):
    import math

    values = [(1, -1500.0), (1, 2000.0), (1, 1999.0), (1, 1899.5), (2, 3.0), (2, 103.0), (2, 102.5), (3, 0.0), (4, None), (4, 7.0)]
    hits = spark.createDataFrame([(q, i, x) for i, (q, x) in enumerate(values)], "query_id long, doc_id long, bm25 double")
    out = rank.normalize_list(hits, "bm25", "softmax")
    got = {r["doc_id"]: r["normalized"] for r in out.collect()}
    for i, (q, x) in enumerate(values):
        mine = [v for p, v in values if p == q and v is not None]
        want = None if x is None else math.exp(x - max(mine)) / sum(math.exp(v - max(mine)) for v in mine)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 2
