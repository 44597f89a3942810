"""All pairs: what is shuffled grows as the rows, not as the pairs, and odd rows have theirs too."""

import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import blocks
from docquarry.operators import vector as V


def sides(spark, n, dims=8):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dims)]) for i in range(n)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return c.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), c


def shuffled(spark, df) -> int:
    """Bytes that the stages of ``df`` write for others."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    scala, tracker = context._jsc.sc(), context.statusTracker()
    scala.listenerBus().waitUntilEmpty()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    done = [scala.statusStore().lastStageAttempt(s) for s in stages]
    return sum(s.shuffleWriteBytes() for s in done)


def test_pairs_shuffle_no_row_for_each_block_of_the_other_side(spark, monkeypatch):
    q, c = sides(spark, 2800)
    c = c.localCheckpoint()
    few, many = [], []
    for rows, out in ((1 << 10, few), (20, many)):
        monkeypatch.setattr(blocks, "PAIR_ROWS", rows)
        out.append(shuffled(spark, blocks.pairwise(q, c)))
    assert many[0] < 4 * few[0]


def test_ranks_shuffle_no_pairs(spark):
    q, c = sides(spark, 2800)
    assert shuffled(spark, blocks.ranked_pairs(q, c)) < 400 * 2800 // 2


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_ranks_by_any_metric_with_several_blocks_in_a_task(spark, metric, monkeypatch):
    monkeypatch.setattr(blocks, "PAIR_ROWS", 4)
    monkeypatch.setattr(blocks, "SENT_ROWS", 11)
    q, c = sides(spark, 100)
    score = F.round(V.METRICS[metric]("query_vec", "embedding"), 6)
    order = Window.partitionBy("query_id").orderBy(score.desc() if metric in V.SIMILARITIES else score.asc(), "vec_id")
    want = q.crossJoin(c).select("query_id", "vec_id", F.row_number().over(order).alias("rank"))
    assert sorted(map(tuple, blocks.ranked_pairs(q, c, metric).collect())) == sorted(map(tuple, want.collect()))


def test_few_queries_a_task_when_lists_are_long(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_BYTES", 4 * 100 * 2)
    q, c = sides(spark, 100)
    got = blocks.ranked_pairs(q, c)
    assert got.rdd.getNumPartitions() == 8
    assert got.count() == 1500


def test_an_id_of_two_rows_has_one_list(spark):
    q, c = sides(spark, 60)
    twice = q.unionByName(q.where("query_id < 20").withColumn("query_vec", F.reverse("query_vec")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(V.METRICS["cosine"]("query_vec", "embedding"), 6)), "vec_id")
    want = twice.crossJoin(c).select("query_id", "vec_id", F.row_number().over(order).alias("rank"))
    assert sorted(map(tuple, blocks.ranked_pairs(twice, c).collect())) == sorted(map(tuple, want.collect()))


def test_missing_vectors_and_other_kinds_of_keys(spark):
    c = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [0.0, 0.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [3.0, 1.0]), ("y", None), (None, [1.0, 1.0])], "query_id string, query_vec array<float>")
    names = ("cosine", "ip", "euclidean", "manhattan")
    whole = "query_vec is not null and embedding is not null"
    scores = [F.when(F.expr(whole), F.round(V.METRICS[m]("query_vec", "embedding"), 6)).alias(m) for m in names]
    want = q.crossJoin(c).select("query_id", "vec_id", *scores)
    assert sorted(map(str, blocks.pairwise(q, c, names).collect())) == sorted(map(str, want.collect()))


def test_no_rows(spark):
    q, c = sides(spark, 20)
    none = F.lit(False)
    for a, b in ((q.where(none), c), (q, c.where(none))):
        assert blocks.pairwise(a, b).count() == blocks.ranked_pairs(a, b).count() == 0
