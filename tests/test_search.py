"""Stored cells, blocks of vectors and the stored inverted index, against exact searches of their inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import lexical, rank
from docquarry.operators import vector as V
from docquarry.operators.blocks import CellStore, best_products, topk_in_blocks
from docquarry.operators.indexed import IndexStore
from docquarry.plans.views import questions, table

SF = "/root/testdata/sf0.001"


def hits(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize(("k", "n"), [(1, 7), (3, 7), (7, 7), (9, 7), (3, 1), (2, 0)])
def test_best_products_against_a_sort(k, n, monkeypatch):
    monkeypatch.setattr("docquarry.operators.blocks.HELD_SCORES", 9)
    rng = np.random.default_rng(k * 10 + n)
    q, v = rng.integers(-2, 3, (5, 4)).astype(float), rng.integers(-2, 3, (n, 4)).astype(float)
    ids, keys = np.arange(5) * 10, rng.permutation(n)
    want = [(i, int(keys[j]), float(s[j])) for i, s in zip(ids.tolist(), q @ v.T if n else [[]] * 5, strict=True) for j in sorted(range(n), key=lambda j: (-s[j], keys[j]))[:k]]
    assert [(int(a), int(b), float(c)) for a, b, c in zip(*best_products(ids, q, keys, v, k), strict=True)] == want


def test_two_sided_blocks(spark, monkeypatch):
    c = table(spark, SF, "embeddings").unionByName(spark.createDataFrame([(9000, None)], "vec_id long, embedding array<float>"), allowMissingColumns=True)
    q = c.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    whole = hits(topk_in_blocks(q, c, 5))
    monkeypatch.setattr("docquarry.operators.blocks.BLOCK_NUMBERS", 64 * 30)
    parts = topk_in_blocks(q, c, 5)
    assert hits(parts) == whole == hits(V.vector_topk(q.where("query_vec is not null"), c.where("embedding is not null"), 5))
    assert "Broadcast" not in parts._jdf.queryExecution().executedPlan().toString()
    assert topk_in_blocks(q.limit(0), c, 5).count() == 0 == topk_in_blocks(q, c.limit(0), 5).count()


def clustered(spark, n=600, dims=8, groups=12):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(groups, dims)) * 10
    group = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % groups)  # one group has over a third
    return spark.createDataFrame([(i, [float(x) for x in centres[g] + rng.normal(size=dims)]) for i, g in enumerate(group.tolist())], "vec_id long, embedding array<float>")


def test_stored_cells_read_only_what_is_visited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docquarry.operators.blocks.BLOCK_NUMBERS", 8 * 50)
    c = clustered(spark)
    store = CellStore(spark, str(tmp_path / "cells")).write(c, 12)
    sizes = {r["cell"]: (r["vectors"], r["blocks"]) for r in store.centres().collect()}
    assert sum(n for n, _ in sizes.values()) == 600 and all(b == -(-n // 50) for n, b in sizes.values()) and max(b for _, b in sizes.values()) > 1
    q = c.where("vec_id in (1, 2)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    visits = store.visits(q, 2)
    stored = store.visited(visits)
    cells = {r[0] for r in visits.select("cell").distinct().collect()}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert {int(f.split("cell=")[1].split("/")[0]) for f in [r[0] for r in stored.select(F.input_file_name()).distinct().collect()]} == cells != set(sizes)
    assert hits(store.search(q, 5, 12)) == hits(V.vector_topk(q, c, 5))
    near = V.recall(store.search(q, 5, 2), V.vector_topk(q, c, 5)).agg(F.avg("recall")).head()[0]
    assert near >= 0.9


@pytest.mark.parametrize("effort", ["precision", "balanced", "speed", "adaptive"])
def test_recall_of_each_preset(spark, effort):
    """The registered searches, over vectors that hardly cluster."""
    from docquarry.plans import catalog

    d = "/root/testdata/sf0.01"
    q, c = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), table(spark, d, "embeddings")
    found = catalog.queries()[f"f19_{effort}"](spark, d)
    assert V.recall(found, V.vector_topk(q, c, 10)).agg(F.avg("recall")).head()[0] >= 0.9


def scored(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stored_index_gives_the_scores_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docquarry.operators.indexed.BLOCK_POSTINGS", 16)
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "!")], "doc_id long, text string"))
    terms = lexical.query_terms(questions(spark, SF), "query")
    store = IndexStore(spark, str(tmp_path / "index"), "doc_id", buckets=8).write(docs, "text")
    rounded = lambda df: df.withColumn("bm25", F.round("bm25", 6))
    want = rounded(lexical.bm25(docs, "doc_id", "text", terms))
    assert scored(rounded(store.scores(terms)), "query_id", "doc_id", "bm25") == scored(want, "query_id", "doc_id", "bm25")
    fixed = lexical.bm25(docs, "doc_id", "text", terms, least_idf=None, mean_length=100.0)
    assert scored(rounded(store.scores(terms, None, 100.0)), "query_id", "doc_id", "bm25") == scored(rounded(fixed), "query_id", "doc_id", "bm25")
    top = rank.rank_by(want, F.col("bm25")).where("rank <= 3")
    assert scored(store.best(terms, 3), "query_id", "rank", "doc_id", "bm25") == scored(top, "query_id", "rank", "doc_id", "bm25")
    # Only the folders of the terms are read, and the index isn't shuffled to meet them.
    one = terms.where("query_id = 0").limit(2)
    plan = store.blocks_of(one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert store.scores(terms.limit(0)).count() == 0 == store.best(terms.limit(0), 3).count()


def test_blocks_that_cannot_matter_are_passed_over(spark, tmp_path, monkeypatch):
    """A common and a rare word: the common word's blocks of long texts stay below the best scores."""
    monkeypatch.setattr("docquarry.operators.indexed.BLOCK_POSTINGS", 16)
    docs = spark.createDataFrame([(i, "common " * (1 + i % 5) + "filler " * (i % 300) + ("rare " * 3 if i % 60 == 0 else "")) for i in range(1200)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "rare", 1), (1, "common", 1), (2, "common", 1), (3, "absent", 1)], "query_id long, term string, times long")
    store = IndexStore(spark, str(tmp_path / "index"), "doc_id", buckets=4).write(docs, "text")
    want = rank.rank_by(lexical.bm25(docs, "doc_id", "text", terms).withColumn("bm25", F.round("bm25", 6)), F.col("bm25")).where("rank <= 5")
    assert scored(store.best(terms, 5), "query_id", "rank", "doc_id", "bm25") == scored(want, "query_id", "rank", "doc_id", "bm25")
    kept = store.kept_blocks(terms, 5)
    # A word alone: only the blocks of its best texts.  Beside a rare word it can't bring in a document of its own.
    assert kept.where("query_id = 2").count() < store.blocks_of(terms).where("query_id = 2").count() / 4
    assert kept.where("query_id = 1 and term = 'common' and needed").count() == 0 < kept.where("query_id = 1 and term = 'rare' and needed").count()
