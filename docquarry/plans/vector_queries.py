"""Queries over vectors."""

import uuid

from pyspark.sql import functions as F

from ..operators import vector as V
from ..operators.blocks import CellStore, pairwise, ranked_pairs, topk_in_blocks
from ..sources.scratch import shared_dir
from .registry import query
from .views import VECTORS, table, vectors

_COS = "list_dot_product(query_vec, embedding) / (sqrt(list_dot_product(query_vec, query_vec)) * sqrt(list_dot_product(embedding, embedding)))"
_L2 = "list_sum(list_transform(list_zip(query_vec, embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_L1 = "list_sum(list_transform(list_zip(query_vec, embedding), lambda z: abs(z[1] - z[2])))"


def _top(k, where="true", score=_COS, name="h"):
    return f"""{name} AS (SELECT * FROM (SELECT query_id, vec_id, grp, {score} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, vec_id) AS INTEGER) AS rank FROM v_query_vec, v_corpus_vec WHERE {where}) WHERE rank <= {k})"""


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {VECTORS} SELECT query_id, vec_id, round({_COS}, 6) AS cosine, round(list_dot_product(query_vec, embedding), 6) AS ip, round(sqrt({_L2}), 6) AS euclidean, round({_L1}, 6) AS manhattan FROM v_query_vec, v_corpus_vec")
def f1_pairwise(spark, d):
    return pairwise(*vectors(spark, d), ("cosine", "ip", "euclidean", "manhattan"))


@query(f"WITH {VECTORS}, {_top(10, 'user_id <> 2')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h")
def f2_vector_topk(spark, d):
    q, c = vectors(spark, d)
    return _r(V.vector_topk(q, c, 10, where=F.col("user_id") != 2), "score").select("query_id", "rank", "vec_id", "score")


@query(f"WITH {VECTORS}, {_top(10)} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h")
def f2_vector_topk_batched(spark, d):
    return _r(V.vector_topk_batched(*vectors(spark, d), 10), "score")


@query(f"WITH {VECTORS}, h AS (SELECT query_id, vec_id, {_L2} AS d FROM v_query_vec, v_corpus_vec), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM h) SELECT query_id, rank, vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM r WHERE rank <= 5")
def f3_l2_scores(spark, d):
    return _r(V.vector_topk(*vectors(spark, d), 5, "l2"), "distance", "score")


@query(f"WITH {VECTORS}, {_top(20, 'user_id <> query_id // 50 % 5')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h WHERE rank <= 1 + query_id // 50 % 4")
def f4_batch_limits(spark, d):
    q, c = vectors(spark, d)
    q = q.withColumns({"k": F.expr("cast(1 + query_id div 50 % 4 as int)"), "without": F.expr("query_id div 50 % 5")})
    return _r(V.vector_topk(q, c, "k", match=F.col("user_id") != F.col("without"), match_on=("without", "user_id")), "score").select("query_id", "rank", "vec_id", "score")


_LISTS = f"{VECTORS}, {_top(10, name='h0')}, {_top(10, 'grp = 3', name='h1')}, {_top(10, 'user_id = 1', name='h2')}, l AS (SELECT *, 0 AS list_id FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2)"


def _lists(spark, d):
    return V.hybrid_lists(*vectors(spark, d), 10, [F.col("grp") == 3, F.col("user_id") == 1])


@query(f"WITH {_LISTS} SELECT query_id, rank, vec_id, list_id, round(score, 6) AS score FROM l")
def f5_hybrid_lists(spark, d):
    return _r(_lists(spark, d), "score").select("query_id", "rank", "vec_id", "list_id", "score")


@query(f"WITH {_LISTS} SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM l GROUP BY 1, 2")
def f6_rank_fusion(spark, d):
    return V.reciprocal_rank_fusion(_lists(spark, d)).withColumn("fused", F.round("fused", 9))


@query(f"WITH {_LISTS} SELECT query_id, vec_id, round(sum(CASE list_id WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 ELSE 1.0 END::DOUBLE / (1 + score)), 6) AS fused FROM l GROUP BY 1, 2")
def f7_weighted_fusion(spark, d):
    weights = spark.createDataFrame([(1, 2.0), (2, 0.5)], "list_id int, weight double")
    return _r(V.weighted_fusion(_lists(spark, d), weights), "fused")


@query(f"WITH {_LISTS}, f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM l GROUP BY 1, 2) SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, vec_id) AS INTEGER) AS rank FROM f")
def f8_rerank(spark, d):
    return V.rerank(V.reciprocal_rank_fusion(_lists(spark, d)).withColumn("fused", F.round("fused", 9)), "fused").select("query_id", "vec_id", "rank")


@query()
def f9_diverse_by_score(spark, d):
    return V.diverse_by_score(V.vector_topk(*vectors(spark, d), 30), 0.97)


@query()
def f10_mmr(spark, d):
    q, c = vectors(spark, d)
    return V.mmr(V.vector_topk(q, c, 20, fields=("embedding",)), 4).select("query_id", "rank", "vec_id", "score")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) ** 2)), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def f11_normalized(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.normalized("embedding").alias("n"))
    return e.select("vec_id", F.round(V.dot("n", "n"), 6).alias("length"), F.round(F.col("n")[0], 6).alias("first"))


@query("""SELECT vec_id, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS cut_sum, round(list_sum(list_transform(range(0, 8), lambda i: list_sum(embedding[i * 8 + 1 : i * 8 + 8]::DOUBLE[]) / 8)), 6) AS avg_sum,
    round(list_sum(list_transform(range(0, 8), lambda i: list_max(embedding[i * 8 + 1 : i * 8 + 8]::DOUBLE[]))), 6) AS max_sum FROM embeddings""")
def f13_reduced(spark, d):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return table(spark, d, "embeddings").select("vec_id", total(V.truncated("embedding", 16)).alias("cut_sum"), total(V.pooled("embedding", 64, 8)).alias("avg_sum"), total(V.pooled("embedding", 64, 8, "max")).alias("max_sum"))


@query()
def f14_principal_components(spark, d):
    """Each row's coordinates on four components (signs by the greatest loading are free, so their squares), and the components' shares of variance."""
    rows, shares = V.principal_components(table(spark, d, "embeddings"), "embedding", 4)
    squares = F.transform("reduced", lambda x: F.round(x * x, 6))
    return rows.select("vec_id", F.size("reduced").alias("dims"), squares.alias("squares"), F.array(*[F.lit(round(x, 6)) for x in shares]).alias("shares"))


@query("""WITH e AS (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS least, max(x) AS most, var_pop(x) AS var FROM e GROUP BY 1),
    h AS (SELECT *, var / sum(var) OVER () AS share FROM s), r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, round(sum(share) OVER w, 9) AS running FROM h WINDOW w AS (ORDER BY share DESC, dim))
    SELECT place, place <= 10 AS in_top_10, count(*) FILTER (running <= 0.95) OVER () AS dims_for_95, count(*) FILTER (share < 0.001) OVER () AS low_dims, count(*) FILTER (share > 0.01) OVER () AS high_dims, dim, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS least, round(most, 6) AS most, round(var, 6) AS var, round(share, 6) AS share FROM r""")
def f15_dimension_stats(spark, d):
    return _r(V.dimension_stats(table(spark, d, "embeddings"), "embedding"), "mean", "std", "least", "most", "var", "share")


@query("SELECT doc_id FROM documents WHERE md5(text || '|m|64') NOT IN (SELECT md5(text || '|m|64') FROM documents WHERE doc_id % 3 = 0)")
def f16_missing_embeddings(spark, d):
    docs = table(spark, d, "documents")
    stored = docs.where("doc_id % 3 = 0").select(V.reuse_key("text", "m", 64).alias("embedding_key"))
    return V.missing_embeddings(docs, stored, "text", "m", 64).select("doc_id")


@query()
def f17_embed(spark, d):
    return V.embed(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("embedding").alias("dims"), F.round(V.norm("embedding"), 4).alias("length"))


@query(f"""WITH {VECTORS}, c AS (SELECT query_id, vec_id, unnest([16, 32]) AS n, query_vec, embedding FROM v_query_vec, v_corpus_vec), s AS (SELECT query_id, vec_id, n, list_dot_product(query_vec[1:n], embedding[1:n]) / (sqrt(list_dot_product(query_vec[1:n], query_vec[1:n])) * sqrt(list_dot_product(embedding[1:n], embedding[1:n]))) AS score FROM c),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score, 'cut' || n AS model FROM r WHERE rank <= 5""")
def f18_search_models(spark, d):
    q, c = vectors(spark, d)
    queries = {f"cut{n}": q.select("query_id", V.truncated("query_vec", n).alias("query_vec")) for n in (16, 32)}
    corpora = {f"cut{n}": c.select("vec_id", V.truncated("embedding", n).alias("embedding")) for n in (16, 32)}
    return _r(V.search_models(queries, corpora, 5), "score").select("query_id", "rank", "vec_id", "score", "model")


#: Stored cells by application, folder and number: built once, read by all queries here.
_STORES = {}
#: Of 8 cells: these vectors hardly cluster, so a mean recall of 0.9 takes six; the presets' least, 16 cells, does it of 20.
PROBES, CELLS = 6, 20
_COS_TOP = f"WITH {VECTORS}, {_top(10)} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM h"


def _cells(spark, d, cells):
    at = spark.sparkContext.applicationId, d, cells
    if at not in _STORES:
        _STORES[at] = CellStore(spark, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}").write(vectors(spark, d)[1], cells)
    return _STORES[at]


@query()
def f19_approximate_topk(spark, d):
    return _r(_cells(spark, d, 8).search(vectors(spark, d)[0], 10, PROBES), "score")


@query(_COS_TOP)
def f19_precision(spark, d):
    """Visits up to 256 cells: here all, so the result is exact."""
    return _r(_cells(spark, d, CELLS).search(vectors(spark, d)[0], 10, "precision"), "score")


@query(_COS_TOP)
def f19_balanced(spark, d):
    return _r(_cells(spark, d, CELLS).search(vectors(spark, d)[0], 10, "balanced"), "score")


@query()
def f19_speed(spark, d):
    return _r(_cells(spark, d, CELLS).search(vectors(spark, d)[0], 10, "speed"), "score")


@query()
def f19_adaptive(spark, d):
    return _r(_cells(spark, d, CELLS).search(vectors(spark, d)[0], 10, "adaptive"), "score")


@query()
def f20_recall(spark, d):
    q, c = vectors(spark, d)
    return V.recall(_cells(spark, d, 8).search(q, 10, PROBES), V.vector_topk_batched(q, c, 10))


@query(_COS_TOP)
def f2_vector_topk_in_blocks(spark, d):
    """The search for query tables of any size: no side is broadcast."""
    return _r(topk_in_blocks(*vectors(spark, d), 10), "score")


@query("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS hamming, round(CASE WHEN bit_count(event_id | user_id) > 0 THEN bit_count(event_id & user_id)::DOUBLE / bit_count(event_id | user_id) ELSE 1.0 END, 6) AS jaccard FROM events")
def f21_bit_distances(spark, d):
    return table(spark, d, "events").select("event_id", V.hamming("event_id", "user_id").alias("hamming"), F.round(V.bit_jaccard("event_id", "user_id"), 6).alias("jaccard"))


@query(f"WITH {VECTORS}, {_top(50)} SELECT query_id, vec_id FROM h WHERE round(score, 6) >= 0.2")
def f22_contextual_compression(spark, d):
    return _r(V.vector_topk(*vectors(spark, d), 50), "score").where("score >= 0.2").select("query_id", "vec_id")


@query(f"WITH {VECTORS}, {_top(10)} SELECT query_id // 4 AS question_id, vec_id, round(max(score), 6) AS score FROM h GROUP BY 1, 2")
def f23_best_of_phrasings(spark, d):
    q, c = vectors(spark, d)
    phrasings = q.select("query_id", F.expr("query_id div 4").alias("question_id"))
    return _r(V.best_of_phrasings(V.vector_topk(q, c, 10), phrasings), "score")


@query(f"WITH {_LISTS} SELECT query_id, vec_id, round(sum(CASE list_id WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.5 END::DOUBLE / (60 + rank)), 9) AS fused FROM l GROUP BY 1, 2")
def f24_ensemble(spark, d):
    return V.reciprocal_rank_fusion(_lists(spark, d), weights={0: 0.5, 1: 0.3, 2: 0.2}).withColumn("fused", F.round("fused", 9))


@query("SELECT count(*) AS \"rows\", CAST(max(len(embedding)) AS INTEGER) AS dims, count(*) * max(len(embedding)) * 4 AS bytes, CAST(floor(104857600 / (max(len(embedding)) * 4)) AS BIGINT) AS rows_in_100_mb FROM embeddings")
def f25_storage_size(spark, d):
    return V.storage_size(table(spark, d, "embeddings"), "embedding")


@query(f"WITH {VECTORS}, {_top(20)} SELECT query_id, grp, round(max(score), 6) AS score FROM h GROUP BY 1, 2")
def f26_parents_of_hits(spark, d):
    q, c = vectors(spark, d)
    return _r(V.parents_of_hits(V.vector_topk(q, c, 20), c, "grp"), "score")


@query(f"WITH {VECTORS}, {_top(10)} SELECT query_id, count(*) AS hits, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score, round(avg(score), 6) AS avg_score FROM h GROUP BY 1")
def l7_hit_metrics(spark, d):
    from ..operators.logs import hit_metrics

    return hit_metrics(V.vector_topk(*vectors(spark, d), 10))


@query(f"WITH {VECTORS}, {_top(50)}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'v' || vec_id) AS p FROM h WHERE score >= 0.2) SELECT query_id, 'v' || vec_id AS term, round(score * 0.7, 6) AS weight FROM n WHERE p <= 3")
def i3_neighbour_terms(spark, d):
    from ..operators.question import neighbour_terms

    pairs = V.vector_topk(*vectors(spark, d), 50).select("query_id", F.concat(F.lit("v"), "vec_id").alias("term"), "score")
    return _r(neighbour_terms(pairs, 6, 0.2), "weight").drop("kind")


@query(f"WITH {VECTORS} SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({_COS}, 6) DESC, vec_id) AS INTEGER) AS rank FROM v_query_vec, v_corpus_vec")
def g10_rank_by_similarity(spark, d):
    return ranked_pairs(*vectors(spark, d))
