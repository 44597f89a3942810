"""Percentiles of large groups and overlaps of chunks, against plain Python."""

import random

from pyspark.sql import functions as F

from docquarry.operators import logs, meta


def test_percentiles_of_a_large_group_are_exact(spark):
    """More different values than an approximate percentile tells apart."""
    n = 60_001
    log = spark.range(n).select(F.lit("a").alias("kind"), ((F.col("id") * 7919) % n).cast("double").alias("value"))
    r = logs.latency_breakdown(log, ["value"], ["kind"]).head()
    values = sorted(float(i) for i in range(n))
    assert (r["p50_value"], r["p95_value"]) == (values[-(-n // 2) - 1], values[-(-n * 95 // 100) - 1])


def test_overlaps_take_only_the_ends_through_the_window(spark):
    rng = random.Random(2)
    rows = [(k, i, "".join(rng.choice("aé") for _ in range(rng.randrange(12)))) for k in range(20) for i in range(5)]
    got = meta.overlaps(spark.createDataFrame(rows, "k int, chunk_index int, content string"), "k", 4).select("k", "chunk_index", "overlap_previous", "overlap_next")
    text = {(k, i): c for k, i, c in rows}

    def longest(k, i):
        a, b = text.get((k, i - 1), ""), text.get((k, i), "")
        return max((m for m in range(1, min(len(a), len(b), 4) + 1) if a[-m:] == b[:m]), default=0)

    assert sorted(tuple(r) for r in got.collect()) == sorted((k, i, longest(k, i), longest(k, i + 1)) for k, i, _ in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lag(_tail" in plan and "lag(content" not in plan
