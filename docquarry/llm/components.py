"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  Minima are pre-aggregated, so a node with very many neighbours does not gather them in one task."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = sides.join(low, sides.a == low.n)
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: the least node that each node reaches, for nodes with an edge.

    Nulls and loops are dropped, repeated edges count once, an empty table gives an empty result.  The
    edge table keeps at most its size in every round, and each round replaces the one before; only two numbers a round come to the
    driver.  The path of the last table, on which the result depends, is added to ``within``.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    spent: list[str] = []
    now, before = cut(tidy(edges.where("a is not null and b is not null")), spent), None
    while True:
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).head()
        state = (row["n"], row["x"])
        if state == before or row["n"] == 0:
            break
        before, old = state, list(spent)
        spent.clear()
        now = cut(tidy(_stars(tidy(_stars(now, True)), False)), spent)
        discard(edges.sparkSession, old)
    if within is not None:
        within += spent
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
