"""Searches by matrix products in pairs of blocks, against every pair's metric."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import blocks
from docquarry.operators import vector as V


def sides(spark, n=90):
    """Equal, zero and missing vectors among others; every seventh row is a query."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)] if i % 5 else [1.0, 2.0, 0.5, 0.0, 0.0, float(i % 2)], i % 4) for i in range(n)] + [(n, [0.0] * 6, 1), (n + 1, None, 2)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp int")
    return c.where("vec_id % 7 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), (F.col("vec_id") % 3).cast("int").alias("wanted")), c


def by_pairs(q, c, metric, k, where):
    """The best of all pairs, each judged alone."""
    pairs = q.crossJoin(c.where("embedding is not null")).where(where).withColumn("distance", V.METRICS[metric]("query_vec", "embedding"))
    order = Window.partitionBy("query_id").orderBy(F.desc("distance") if metric in V.SIMILARITIES else F.asc("distance"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_nearest_equals_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 6 * 25)
    monkeypatch.setattr(blocks, "HELD_SCORES", 40)
    q, c = sides(spark)
    got = V.vector_topk(q, c, 6, metric)
    assert found(got) == found(by_pairs(q, c, metric, 6, F.lit(True)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_filter_of_each_query_and_its_own_number(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_NUMBERS", 6 * 25)
    q, c = sides(spark)
    q = q.withColumn("k", (F.col("query_id") % 3 + 1).cast("int"))
    other = F.col("grp") != F.col("wanted")
    got = V.vector_topk(q, c, "k", match=other, match_on=("wanted", "grp"), fields=("grp",))
    assert found(got) == found(by_pairs(q, c, "cosine", F.col("k"), other)) == found(V.vector_topk(q, c.where("embedding is not null"), "k", match=other))
    assert {(r["vec_id"], r["grp"]) for r in got.collect()} <= {(r["vec_id"], r["grp"]) for r in c.collect()}


def test_a_vector_that_is_missing_comes_last(spark):
    q, c = sides(spark)
    last = V.vector_topk(q, c, 92).where("rank = 92").select("vec_id", "distance").distinct().collect()
    assert [tuple(r) for r in last] == [(91, None)]


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PAIR_ROWS", 17)
    q, c = sides(spark)
    known = c.where("embedding is not null")
    names = ["cosine", "ip", "euclidean", "manhattan"]
    got = blocks.pairwise(q, known, tuple(names))
    want = q.crossJoin(known).select("query_id", "vec_id", *[F.round(V.METRICS[m]("query_vec", "embedding"), 6).alias(m) for m in names])
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    places = want.select("query_id", "vec_id", F.row_number().over(order).alias("rank"))
    assert sorted(tuple(r) for r in blocks.ranked_pairs(q, known).collect()) == sorted(tuple(r) for r in places.collect())


def test_rounding_is_half_up_as_in_sql(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 10, (rng.integers(-10**6, 10**6, 500) * 2 + 1) / 2e6, [0.0, -0.0, 1.0000005, 2.5e-7, -5e-7, 5e-7]])
    want = [r[0] + 0.0 for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert blocks.rounded(x).tolist() == want
