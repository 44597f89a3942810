"""Ranking, score combination and post-processing of hits."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import question


def _by_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def recency(column: str | Column, as_of: str, days: float = 30.0) -> Column:
    """exp(-age / days) with the age in days."""
    return F.exp(-(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(column)) / 86_400.0 / days)


def popularity(views: Column, likes: Column, comments: Column) -> Column:
    return F.least(F.ln(1 + views + 2 * likes + 3 * comments) / 10, F.lit(1.0))


def temporal_score(similarity: Column, fresh: Column, popular: Column) -> Column:
    return 0.6 * similarity + 0.2 * fresh + 0.1 * popular


def metadata_relevance(keywords: Column, words: Column, entities: Column, found: Column, same_type: Column) -> Column:
    share = lambda want, have: F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 * share(keywords, words) + 0.3 * share(entities, found) + F.when(same_type, 0.2).otherwise(0.0))


def bm25_hybrid_rank(hits: DataFrame, bm25: str, terms: Column, similarity: str, key: str = "doc_id") -> DataFrame:
    """Hits ranked by 0.6 similarity + 0.4 BM25 for each query term (``ranking``, ``rank``); a query without terms ranks by similarity alone."""
    per_term = F.when(terms > 0, F.col(bm25) / terms).otherwise(0.0)
    return rank_by(hits.withColumn("ranking", 0.6 * F.col(similarity) + 0.4 * per_term), F.round("ranking", 9), key)


def temporal_rank(hits: DataFrame, similarity: str, date: str, retrieved: str, as_of: str, counts: tuple[str, str, str], key: str = "doc_id") -> DataFrame:
    """Hits ranked by ``temporal_score``; without a date of its own a hit is as old as its retrieval, and missing ``counts`` (views, likes, comments) are 0."""
    fresh = recency(F.coalesce(F.col(date), F.col(retrieved)), as_of)
    popular = popularity(*[F.coalesce(F.col(c), F.lit(0)) for c in counts])
    return rank_by(hits.withColumn("ranking", temporal_score(F.col(similarity), fresh, popular)), F.round("ranking", 9), key)


def metadata_rank(hits: DataFrame, similarity: str, relevance: Column, key: str = "doc_id") -> DataFrame:
    """Hits ranked by 0.6 similarity + 0.1 metadata relevance."""
    return rank_by(hits.withColumn("ranking", 0.6 * F.col(similarity) + 0.1 * relevance), F.round("ranking", 9), key)


def hybrid_score(vector: str, bm25: str, tfidf: str, semantic: str, words: Column, entities: Column) -> Column:
    """Weighted sum of four scores; weights by the query's words and entities: few words, many entities, many words, else."""
    mixed = lambda a, b, c, d: a * F.col(vector) + b * F.col(bm25) + c * F.col(tfidf) + d * F.col(semantic)
    # Weights of the four scores.
    return F.when(words < 3, mixed(0.2, 0.2, 0.1, 0.5)).when(entities > 2, mixed(0.5, 0.2, 0.2, 0.1)).when(words > 10, mixed(0.1, 0.4, 0.4, 0.1)).otherwise(mixed(0.3, 0.3, 0.2, 0.2))


#: Width of the levels of scores whose exponentials are added up apart: e to its power is far from overflow.
LEVEL = 100.0


def normalize_list(hits: DataFrame, score: str, how: str, key: str = "doc_id") -> DataFrame:
    """``normalized`` over each query's list: none, minmax, zscore (population), softmax, rank.  A constant list stays as it is.

    A list's numbers (one row for each query, broadcast) are aggregated first in one pass, so only ``rank`` shuffles the lists; hits are read twice.
    The sum of ``softmax`` is added up by levels of ``LEVEL``, as the greatest score isn't known yet: no exponent grows beyond a level's width.
    """
    x = F.col(score)
    if how == "none":
        return hits.withColumn("normalized", x)
    if how == "softmax":
        level = F.floor(x / LEVEL).cast("double")
        levels = hits.groupBy("query_id", level.alias("_level")).agg(F.max(score).alias("_most"), F.sum(F.exp(x - LEVEL * level)).alias("_part"))
        lists = levels.groupBy("query_id").agg(F.max("_most").alias("_high"), F.collect_list(F.struct("_level", "_part")).alias("_levels"))
        total = F.aggregate("_levels", F.lit(0.0), lambda acc, v: acc + F.coalesce(v["_part"] * F.exp(LEVEL * v["_level"] - F.col("_high")), F.lit(0.0)))
        beside = hits.join(F.broadcast(lists.select("query_id", "_high", total.alias("_total"))), "query_id")
        return beside.select(*hits.columns, (F.exp(x - F.col("_high")) / F.col("_total")).alias("normalized"))
    numbers = hits.groupBy("query_id").agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_std"), F.count("*").alias("_n"))
    beside = hits.join(F.broadcast(numbers), "query_id")
    forms = {
        "minmax": lambda: F.when(F.col("_low") == F.col("_high"), x).otherwise((x - F.col("_low")) / (F.col("_high") - F.col("_low"))),
        "zscore": lambda: F.when(F.col("_low") == F.col("_high"), x).otherwise((x - F.col("_mean")) / F.col("_std")),
        "rank": lambda: 1 - (F.row_number().over(_by_query().orderBy(F.desc(score), key)) - 1) / F.col("_n"),
    }
    return beside.withColumn("normalized", forms[how]()).select(*hits.columns, "normalized")


def normalize_row(scores: list[str], how: str) -> Column:
    """The scores of one row, normalised across each other, as an array: none, minmax, zscore (population), softmax, rank.

    Equal scores stay as they are under minmax and zscore; of equal ones the later ranks higher.
    """
    xs = F.array(*[F.col(c).cast("double") for c in scores])
    n, low, high = len(scores), F.array_min(xs), F.array_max(xs)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    if how == "minmax":
        return F.when(high > low, F.transform(xs, lambda x: (x - low) / (high - low))).otherwise(xs)
    if how == "zscore":
        mean = total(xs) / n
        spread = F.sqrt(total(F.transform(xs, lambda x: (x - mean) * (x - mean))) / n)
        return F.when(spread > 0, F.transform(xs, lambda x: (x - mean) / spread)).otherwise(xs)
    if how == "softmax":
        parts = F.transform(xs, lambda x: F.exp(x - high))
        return F.transform(parts, lambda x: x / total(parts))
    if how == "rank":
        better = lambda x, i: F.aggregate(F.transform(xs, lambda y, j: ((y > x) | ((y == x) & (j > i))).cast("int")), F.lit(0), lambda acc, v: acc + v)
        return F.transform(xs, lambda x, i: 1 - better(x, i) / n)
    return xs


def final_score(learned: str, hybrid: str, *others: str) -> Column:
    """0.7 learned + 0.3 hybrid where learned, else hybrid, else the best of the others."""
    best = F.greatest(*[F.col(c) for c in others]) if len(others) > 1 else F.col(others[0])
    return F.when(F.col(learned) > 0, 0.7 * F.col(learned) + 0.3 * F.col(hybrid)).when(F.col(hybrid) > 0, F.col(hybrid)).otherwise(best)


def rank_by(hits: DataFrame, score: Column, key: str = "doc_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_by_query().orderBy(score.desc(), key)))


def content_relevance(query: str, content: str) -> Column:
    """Half for the whole phrase, 0.3 for the share of query words, less for long contents; at most 1."""
    q, c = F.lower(query), F.lower(content)
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    share = F.when(F.size(words(q)) > 0, F.size(F.array_intersect(words(q), words(c))) / F.size(words(q))).otherwise(0.0)
    raw = F.when(F.contains(c, q), 0.5).otherwise(0.0) + 0.3 * share
    return F.least(F.lit(1.0), F.when(F.length(content) > 2000, raw * 0.8).otherwise(raw))


def rerank_by_content(hits: DataFrame, query: str, content: str, score: str, key: str = "doc_id") -> DataFrame:
    out = hits.withColumn("reranked", 0.8 * F.col(score) + 0.2 * content_relevance(query, content))
    return rank_by(out, F.round("reranked", 9), key)


def _tokens(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", text.lower()))


def _jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def drop_near_copies(hits: DataFrame, content: str, score: str, most: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Within each query's few hits, keeps the better of two whose token sets are more alike than ``most``."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        sets, chosen = [_tokens(t or "") for t in pdf[content]], []
        for i in range(len(sets)):
            if all(_jaccard(sets[i], sets[j]) <= most for j in chosen):
                chosen.append(i)
        return pdf.iloc[chosen]

    return hits.groupBy("query_id").applyInPandas(keep, hits.schema)


def diverse_by_tokens(hits: DataFrame, content: str, score: str, k: int, weight: float = 0.6, key: str = "doc_id") -> DataFrame:
    """Maximal marginal relevance on token-set similarity; the first row is the top hit."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True])
        sets, scores, chosen = [_tokens(t or "") for t in pdf[content]], pdf[score].tolist(), []
        while len(chosen) < min(k, len(sets)):
            rest = [i for i in range(len(sets)) if i not in chosen]
            chosen.append(max(rest, key=lambda i: (weight * scores[i] - (1 - weight) * max((_jaccard(sets[i], sets[j]) for j in chosen), default=0.0), -i)) if chosen else 0)
        return pdf.iloc[chosen]

    return hits.groupBy("query_id").applyInPandas(choose, hits.schema)


def post_process(hits: DataFrame, query: str, content: str, score: str, most: int = 5, least: int = 1, key: str = "doc_id") -> DataFrame:
    """Near copies out, re-ranked by content, the best ``most``; ``too_few`` warns below ``least``."""
    out = rerank_by_content(drop_near_copies(hits, content, score, key=key), query, content, score, key).where(F.col("rank") <= most)
    return out.withColumn("too_few", F.count("*").over(_by_query()) < least)


def with_ranker(hits: DataFrame, ranker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's own ranking or scoring function."""
    return ranker(hits)


def context_text(hits: DataFrame, header: Column, content: str, most: int, least_part: int = 100) -> DataFrame:
    """Header and content of each query's hits by rank, joined, within ``most`` characters; the first part that does not fit is cut if more than ``least_part`` are left.

    ``query_id, context, truncated``; truncated tells that a part was cut or dropped.
    """
    line = _by_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.withColumn("_part", F.concat(header, F.lit("\n"), F.col(content))).withColumn("_size", F.length("_part"))
    rows = rows.withColumn("_used", F.coalesce(F.sum("_size").over(line), F.lit(0))).withColumn("_left", F.lit(most) - F.col("_used"))
    shown = F.when(F.col("_size") <= F.col("_left"), F.col("_part")).when(F.col("_left") > least_part, F.left("_part", F.col("_left").cast("int")))
    rows = rows.withColumn("_shown", shown)
    parts = F.sort_array(F.collect_list(F.when(F.col("_shown").isNotNull(), F.struct("rank", "_shown"))))
    out = rows.groupBy("query_id").agg(parts.alias("p"), F.max((F.col("_size") > F.col("_left")).cast("int")).alias("cut"))
    return out.select("query_id", F.array_join("p._shown", "\n\n---\n\n").alias("context"), (F.col("cut") == 1).alias("truncated"))


def simple_context(hits: DataFrame, content: str, most: int) -> DataFrame:
    parts = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", content))).alias("p"))
    return parts.select("query_id", F.left(F.array_join(f"p.{content}", "\n\n"), F.lit(most)).alias("context"))


def answer_relevance(hits: DataFrame, score: str, key: str, group: str) -> DataFrame:
    """Mean score, a confidence a little above it, and what was referred to."""
    return hits.groupBy("query_id").agg(F.round(F.avg(score), 6).alias("relevance"), F.round(F.least(F.avg(score) + 0.1, F.lit(1.0)), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ",").alias("documents"), F.array_join(F.array_sort(F.collect_set(group)), ",").alias("groups"))


#: The features of a hit, in order.
RANKING_FEATURES = (
    "vector", "bm25", "tfidf", "semantic", "query_words", "query_keywords", "query_entities", "query_complexity", "expanded_terms", "phrases", "expansion_seconds",
    "content_words", "content_chars", "similarity", "relevance", "content_keywords", "content_entities", "age_seconds",
)


def ranking_features(hits: DataFrame, query: str, content: str, as_of: str, retrieved: str, given: dict[str, Column] | None = None) -> DataFrame:
    """``query_id, doc_id`` and the 18 features of each hit for learning to rank: four scores, query, expansion, document, age.

    Scores, expansion counts, similarity and relevance are ``given`` as columns; what is not given is 0.
    """
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    shapes = {
        "query_words": words(query), "query_keywords": F.size(question.keywords(query)), "query_entities": F.size(question.entities(query)), "query_complexity": question.complexity(query),
        "content_words": words(content), "content_chars": F.length(content), "content_keywords": F.size(question.keywords(content)), "content_entities": F.size(question.entities(content)),
        "age_seconds": F.unix_timestamp(F.lit(as_of)) - F.col(retrieved).cast("timestamp").cast("long"),
    }
    every = {**shapes, **(given or {})}
    return hits.select("query_id", "doc_id", *[F.coalesce(every.get(name, F.lit(0.0)).cast("double"), F.lit(0.0)).alias(name) for name in RANKING_FEATURES])


def train_ranker(rows: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42, least_rows: int = 50):
    """Standardised features into a random forest; None below ``least_rows`` rows.  ``model.stages[-1].featureImportances`` has the importances."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    if rows.limit(least_rows).count() < least_rows:
        return None
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features"), RandomForestRegressor(featuresCol="_features", labelCol=label, predictionCol="learned", numTrees=trees, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def retrieve_contexts(queries: DataFrame, hits: DataFrame, content: str, query: str, score: str, most: int = 5, threshold: float = 0.1, strategy: Callable[[DataFrame], DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """Over-fetched hits (``2 * most`` of each query) above the threshold, ranked by a strategy (default: the score itself), then ``post_process``."""
    kept = rank_by(hits.where(F.col(score) >= threshold), F.col(score), key).where(F.col("rank") <= 2 * most)
    ranked = with_ranker(kept, strategy) if strategy else kept
    return post_process(ranked.join(F.broadcast(queries.select("query_id", query)), "query_id"), query, content, score, most, key=key)
