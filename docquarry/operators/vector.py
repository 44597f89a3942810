"""Vector operators: distances, top-k, fusion, diversity, reduction, approximate search.  Query tables keep ``query_id``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A query table is broadcast up to so many bytes of vectors and other columns; a larger one meets the corpus in blocks of so many rows.
MOST_QUERY_BYTES, BLOCK_ROWS = 16 << 20, 1 << 14
def _double(c: Column | str) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: str, b: str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: str) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity; 0 if one vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2_sq(a: str, b: str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(l2_sq(a, b))


def manhattan(a: str, b: str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


METRICS: dict[str, Callable[[str, str], Column]] = {"cosine": cosine, "ip": dot, "l2": l2_sq, "euclidean": euclidean, "manhattan": manhattan}
SIMILARITIES = ("cosine", "ip")


def to_score(distance: Column, metric: str) -> Column:
    """Similarities are scores themselves; distances become 1 / (1 + d)."""
    return distance if metric in SIMILARITIES else 1.0 / (1.0 + distance)


def small_enough(queries: DataFrame) -> bool:
    """Whether a query table may be broadcast: its vectors' numbers and 100 bytes for each row."""
    row = queries.agg(F.count("*").alias("n"), F.sum(F.size("query_vec")).alias("numbers")).head()
    return 100 * row["n"] + 8 * max(0, row["numbers"] or 0) <= MOST_QUERY_BYTES


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int | str, metric: str = "cosine", where: Column | None = None, key: str = "vec_id", vector: str = "embedding", fields: tuple[str, ...] = (), match: Column | None = None, match_on: tuple[str, str] | None = None) -> DataFrame:
    """``query_id, rank, key, distance, score`` of the nearest rows of each query; ties by key, which is unique.

    The filter runs before the distances.  Both sides are dealt into blocks of bounded size by the hash of their keys; each pair of blocks is
    one task's matrix product, whose best rows get their distances number by number (``blocks.nearest``).  ``k`` may be a column of the queries.
    ``match`` is a filter of each query's own: a condition on columns of both sides, for example ``col("wanted_group") == col("grp")``.  If it
    depends on one column of few values on each side, ``match_on`` names them (query's, corpus'), and it is judged once for each pair of
    values; without ``match_on`` every pair of rows is made and judged.
    """
    from .blocks import nearest

    rows = corpus.where(where) if where is not None else corpus
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("distance") if metric in SIMILARITIES else F.asc_nulls_last("distance"), key)
    if match is None or match_on is not None:
        asked = queries.select("query_id", "query_vec", *([match_on[0]] if match_on else []), F.col(k).alias("_k") if isinstance(k, str) else F.lit(k).alias("_k"))
        pairs = nearest(asked, rows, metric, key, vector, match, match_on)
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("_k"))
        # The hits' other fields are fetched once the best are known.
        ranked = ranked.join(rows.select(key, *fields), key) if fields else ranked
    else:
        extra = [k] if isinstance(k, str) else []
        both = rows.crossJoin(F.broadcast(queries)) if small_enough(queries) else _met_in_blocks(queries, rows, key)
        pairs = both.where(match).select("query_id", key, *fields, *extra, METRICS[metric]("query_vec", vector).alias("distance"))
        ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (F.col(k) if isinstance(k, str) else k))
    return ranked.select("query_id", "rank", key, *fields, "distance", to_score(F.col("distance"), metric).alias("score"))


def _met_in_blocks(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every query beside every row, by an equal join of blocks."""
    blocks = lambda df: -(-df.count() // BLOCK_ROWS) or 1
    many_q, many_c = blocks(queries), blocks(rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("_i", block("query_id", many_q)).withColumn("_j", each(many_c))
    right = rows.withColumn("_j", block(key, many_c)).withColumn("_i", each(many_q))
    return left.hint("shuffle_hash").join(right, ["_i", "_j"]).drop("_i", "_j")


def vector_topk_batched(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine top-k by matrix products: for many queries of many dimensions.  Same result as ``vector_topk`` up to rounding.

    A query table whose size is checked goes to every task, and the corpus isn't shuffled; a larger one meets it in blocks.
    """
    from .blocks import best_products, topk_in_blocks

    if not small_enough(queries):
        return topk_in_blocks(queries, corpus, k, key, vector)
    known = queries.where("query_vec is not null").orderBy("query_id").select("query_id", normalized("query_vec").alias("q")).toPandas()
    ids, matrix = known["query_id"].to_numpy(), np.array(known["q"].tolist(), float).reshape(len(known), -1 if len(known) else 0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(ids) and len(pdf):
                v = np.array(pdf[vector].tolist(), float)
                i, j, s = best_products(ids, matrix, pdf[key].to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), k)
                yield pd.DataFrame({"query_id": i, key: j, "score": s})

    found = corpus.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(best, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def hybrid_lists(queries: DataFrame, corpus: DataFrame, k: int, filters: list[Column], metric: str = "cosine", key: str = "vec_id") -> DataFrame:
    """One unfiltered list and one for each filter, told apart by ``list_id``."""
    lists = [vector_topk(queries, corpus, k, metric, f, key).withColumn("list_id", F.lit(i)) for i, f in enumerate([None, *filters])]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def reciprocal_rank_fusion(hits: DataFrame, key: str = "vec_id", k: int = 60, weights: dict[int, float] | None = None) -> DataFrame:
    """Sum of weight / (k + rank) over the lists; ranks count from 1."""
    weight = F.lit(1.0)
    for i, w in (weights or {}).items():
        weight = F.when(F.col("list_id") == i, w).otherwise(weight)
    return hits.groupBy("query_id", key).agg(F.sum(weight / (k + F.col("rank"))).alias("fused"))


def weighted_fusion(hits: DataFrame, weights: DataFrame, key: str = "vec_id") -> DataFrame:
    """Sum of weight / (1 + distance); ``weights(list_id, weight)`` is a small table, a missing weight is 1."""
    return hits.join(F.broadcast(weights), "list_id", "left").groupBy("query_id", key).agg(F.sum(F.coalesce("weight", F.lit(1.0)) / (1.0 + F.col("distance"))).alias("fused"))


def rerank(hits: DataFrame, score: str, key: str = "vec_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), key)))


def _greedy(rows: DataFrame, keep: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """Order-dependent choice among one query's few hits, which a top-k has bounded."""
    schema = rows.schema
    return rows.groupBy("query_id").applyInPandas(lambda pdf: pdf.iloc[keep(pdf)], schema)


def diverse_by_score(hits: DataFrame, most: float = 0.8) -> DataFrame:
    """Keeps a hit only if 1 - |score gap| / max(scores, 1) is at most ``most`` against every kept hit."""

    def keep(pdf: pd.DataFrame) -> list[int]:
        order, kept = np.argsort(pdf["rank"].to_numpy(), kind="stable"), []
        scores = pdf["score"].to_numpy()
        for i in order:
            if all(1 - abs(scores[i] - scores[j]) / max(scores[i], scores[j], 1.0) <= most for j in kept):
                kept.append(i)
        return kept

    return _greedy(hits, keep)


def mmr(hits: DataFrame, k: int = 4, weight: float = 0.5, vector: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over ``query_id, rank, score, vector`` rows: adds ``rank`` of the choice.  A weight of 1 gives the top-k."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = np.array(pdf[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        alike, score, chosen = v @ v.T, pdf["score"].to_numpy(), []
        while len(chosen) < min(k, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in chosen]
            gain = [weight * score[i] - (1 - weight) * max((alike[i, j] for j in chosen), default=0.0) for i in rest]
            chosen.append(rest[int(np.argmax(np.round(gain, 12)))])  # of equal gains the better ranked
        out = pdf.iloc[chosen].copy()
        out["rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    return hits.groupBy("query_id").applyInPandas(choose, hits.schema)


def normalized(c: str) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(c)
    return F.transform(_double(c), lambda x: F.when(size > 0, x / size).otherwise(x))


def truncated(c: str, dims: int) -> Column:
    return F.slice(_double(c), 1, dims)


def pooled(c: str, dims: int, target: int, how: str = "avg") -> Column:
    """Mean or maximum of windows of ``dims // target`` dimensions; a remainder is left out."""
    width = dims // target
    part = lambda i: F.slice(_double(c), i * width + 1, width)
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), (lambda i: F.array_max(part(i))) if how == "max" else (lambda i: _sum(part(i)) / width))


def principal_components(rows: DataFrame, vector: str, target: int) -> tuple[DataFrame, list[float]]:
    """Centred rows projected on ``target`` principal components (column ``reduced``), and the shares of variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("_v", array_to_vector(vector))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(data).transform(data)
    model = PCA(k=target, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p"), [float(x) for x in model.explainedVariance]


def dimension_stats(rows: DataFrame, vector: str) -> DataFrame:
    """Mean, population deviation, extremes and variance share of each dimension, with its place by share, and of all dimensions how many
    hold 95 % of the variance (those whose running share does not exceed it), and how many have a share below 0.001 or over 0.01."""
    each = rows.select(F.posexplode(_double(vector)).alias("dim", "x"))
    stats = each.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"), F.var_pop("x").alias("var"))
    total = F.sum("var").over(Window.partitionBy())
    line = Window.partitionBy().orderBy(F.desc("share"), "dim")
    shares = stats.withColumn("share", F.col("var") / total).withColumns({"place": F.row_number().over(line), "running": F.round(F.sum("share").over(line), 9)})
    counts = {"dims_for_95": F.col("running") <= 0.95, "low_dims": F.col("share") < 0.001, "high_dims": F.col("share") > 0.01}
    return shares.withColumns({n: F.count_if(c).over(Window.partitionBy()) for n, c in counts.items()}).withColumn("in_top_10", F.col("place") <= 10).drop("running")


def reuse_key(text: str, model: str, dims: int) -> Column:
    return F.md5(F.concat_ws("|", text, F.lit(model), F.lit(dims)))


def missing_embeddings(rows: DataFrame, stored: DataFrame, text: str, model: str, dims: int) -> DataFrame:
    """Texts whose key is not stored yet."""
    return rows.withColumn("embedding_key", reuse_key(text, model, dims)).join(stored.select("embedding_key"), "embedding_key", "left_anti")


def hashed_terms(texts: list[str], dims: int = 64) -> np.ndarray:
    """Default offline embedder: signed hashed term counts at length 1."""
    import zlib

    out = np.zeros((len(texts), dims))
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % dims] += 1.0 if h & 0x10000 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embed(rows: DataFrame, key: str, text: str, batch: Callable[[list[str]], np.ndarray] = hashed_terms, size: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``keep`` and ``embedding``: a callable turns batches of texts into vectors, ``size`` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield part[[key, *keep]].assign(embedding=list(np.asarray(batch(part[text].tolist()), np.float32)))

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, *keep))
    return rows.select(*dict.fromkeys((key, *keep, text))).mapInPandas(run, f"{schema}, embedding array<float>")


def search_models(queries: dict[str, DataFrame], corpora: dict[str, DataFrame], k: int) -> DataFrame:
    """Top-k of each model's own collection, told apart by ``model``."""
    lists = [vector_topk(queries[m], corpora[m], k).withColumn("model", F.lit(m)) for m in sorted(corpora)]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def ivf_cells(corpus: DataFrame, vector: str, cells: int, seed: int = 42):
    """Corpus rows with their cell, and the cells' centres as a small table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = corpus.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(data)
    centres = corpus.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(data).drop("_v"), centres


#: Cells that a search visits, by how much effort it makes.
EFFORTS = {"precision": 256, "balanced": 64, "speed": 16}


def probes_for(effort: str, cells: int, rows: int) -> int:
    """Cells to visit of ``cells``: a preset's number, or for ``adaptive`` more for a larger table: 16, from 10,000 rows 64, from a million 256."""
    wanted = EFFORTS[effort] if effort != "adaptive" else 16 if rows < 10_000 else 64 if rows < 1_000_000 else 256
    return max(1, min(cells, wanted))


def approximate_topk(queries: DataFrame, celled: DataFrame, centres: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top-k by cosine within the ``probes`` nearest cells of each query; visiting all cells gives the exact result."""
    line = Window.partitionBy("query_id").orderBy("_d", "cell")
    visits = queries.crossJoin(F.broadcast(centres)).withColumn("_d", l2_sq("query_vec", "centre")).withColumn("_n", F.row_number().over(line)).where(F.col("_n") <= probes).select("query_id", "query_vec", "cell")
    pairs = celled.join(visits, "cell").select("query_id", key, cosine("query_vec", vector).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """Share of the exact hits that were found, for each query."""
    marks = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return marks.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def bit_jaccard(a: str, b: str) -> Column:
    both, any_ = F.bit_count(F.col(a).bitwiseAND(F.col(b))), F.bit_count(F.col(a).bitwiseOR(F.col(b)))
    return F.when(any_ > 0, both / any_).otherwise(1.0)


def best_of_phrasings(hits: DataFrame, phrasings: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits of several phrasings of a question, each once with its best score; ``phrasings(query_id, question_id)``."""
    return hits.join(F.broadcast(phrasings), "query_id").groupBy("question_id", key).agg(F.max("score").alias("score"))


def parents_of_hits(hits: DataFrame, chunks: DataFrame, parent: str, key: str = "vec_id") -> DataFrame:
    """Best chunk score of each parent document."""
    return hits.join(chunks.select(key, parent), key).groupBy("query_id", parent).agg(F.max("score").alias("score"))


def storage_size(rows: DataFrame, vector: str, bytes_each: int = 4) -> DataFrame:
    per = F.max(F.size(vector)) * bytes_each
    return rows.agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("dims"), (F.count("*") * per).alias("bytes"), F.floor(F.lit(100 << 20) / per).alias("rows_in_100_mb"))
