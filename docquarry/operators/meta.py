"""Chunk metadata: statistics, hashes, links, inheritance."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXTRACTORS: dict[str, Callable[[Column], Column]] = {}


def register_extractor(name: str, extractor: Callable[[Column], Column]) -> None:
    """Adds a metadata field that is computed from the content."""
    _EXTRACTORS[name] = extractor


def with_extractors(chunks: DataFrame, content: str = "content") -> DataFrame:
    return chunks.withColumns({name: f(F.col(content)) for name, f in _EXTRACTORS.items()}) if _EXTRACTORS else chunks


def content_stats(content: Column | str) -> dict[str, Column]:
    parts = lambda sep: F.size(F.filter(F.split(content, sep), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""))
    return {"word_count": F.size(F.regexp_extract_all(content, F.lit(r"\S+"), F.lit(0))), "sentence_count": parts(r"\."), "paragraph_count": parts("\n\n"), "char_count": F.length(content)}


def content_hash(c: str) -> Column:
    return F.sha2(c, 256)


def query_hash(c: str) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def inherit(chunks: DataFrame, parents: DataFrame, key: str, fields: list[str], tags: str | None = None, custom: str | None = None) -> DataFrame:
    """The parents' fields on their chunks; tags of both, each once; with ``custom``, a map column, its keys that begin with ``custom_`` too.

    A chunk's own entry of the map stays as it is.
    """
    cols = [key, *fields] + ([F.col(tags).alias("_tags")] if tags else []) + ([custom_fields(custom).alias("_custom")] if custom else [])
    out = chunks.join(parents.select(*cols), key, "left")
    if tags:
        none = F.array().cast("array<string>")
        out = out.withColumn(tags, F.array_sort(F.array_union(F.coalesce(tags, none), F.coalesce("_tags", none)))).drop("_tags")
    if custom:
        empty = F.create_map().cast("map<string,string>")
        own = F.coalesce(custom, empty) if custom in chunks.columns else empty
        out = out.withColumn(custom, F.map_concat(F.map_filter(F.coalesce("_custom", empty), lambda k, _: ~F.map_contains_key(own, k)), own)).drop("_custom")
    return out


def custom_fields(c: str) -> Column:
    return F.map_filter(c, lambda k, _: k.startswith("custom_"))


def link_chunks(chunks: DataFrame, key: str) -> DataFrame:
    line = Window.partitionBy(key).orderBy("chunk_index")
    return chunks.withColumns({"previous_chunk": F.lag("chunk_index").over(line), "next_chunk": F.lead("chunk_index").over(line)})


def overlaps(chunks: DataFrame, key: str, most: int) -> DataFrame:
    """Lengths of the longest end of the previous chunk that is this one's beginning, and of this one's that is the next's, up to ``most`` characters."""
    line = Window.partitionBy(key).orderBy("chunk_index")
    # Only the ends that can overlap go through the window, beside the caller's columns.
    ends = chunks.withColumns({"_head": F.left("content", F.lit(most)), "_tail": F.right("content", F.lit(most))})
    own = ends.withColumn("_before", F.lag("_tail").over(line)).withColumn("overlap_previous", F.pandas_udf(_longest_overlap, "int")("_before", "_head")).drop("_before", "_head", "_tail")
    return own.withColumn("overlap_next", F.coalesce(F.lead("overlap_previous").over(line), F.lit(0)))


def _longest_overlap(before: pd.Series, after: pd.Series) -> pd.Series:
    """Characters of the longest end of the one that is the other's beginning; 0 without one."""
    longest = lambda a, b: next((i for i in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:i])), 0)
    return pd.Series([longest(a or "", b or "") for a, b in zip(before, after, strict=True)], dtype="int32")


def related(chunks: DataFrame, key: str, depth: int) -> DataFrame:
    """``key, chunk_index, related_index``: chunks of the same document within ``depth`` links."""
    steps = F.explode(F.array(*[F.lit(i) for i in range(-depth, depth + 1) if i]))
    near = chunks.select(key, "chunk_index", steps.alias("step")).select(key, "chunk_index", (F.col("chunk_index") + F.col("step")).alias("related_index"))
    return near.join(chunks.select(key, F.col("chunk_index").alias("related_index")), [key, "related_index"], "left_semi").select(key, "chunk_index", "related_index")


def enrich(chunks: DataFrame, updates: DataFrame, keys: list[str], known: list[str]) -> DataFrame:
    """Known fields are overwritten where the update has a value; all others go into the map ``custom``."""
    others = [c for c in updates.columns if c not in keys and c not in known]
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in known], F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()).alias("custom"))
    return chunks.join(new, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in known}).drop(*[f"_{c}" for c in known])


def missing_fields(rows: DataFrame, required: list[str]) -> DataFrame:
    """``field, missing``: rows without a value for each required field."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in required])))


def collection_stats(chunks: DataFrame, key: str) -> DataFrame:
    per = chunks.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("links"), F.round(F.avg("n"), 6).alias("chunks_per_document"))


def provenance(rows: DataFrame, strategy: str, parameters: dict[str, str], steps: list[str], version: str, at: str) -> DataFrame:
    pairs = [x for k, v in parameters.items() for x in (F.lit(k), F.lit(v))]
    return rows.withColumns({"strategy": F.lit(strategy), "parameters": F.create_map(*pairs), "steps": F.array(*[F.lit(s) for s in steps]), "version": F.lit(version), "processed_at": F.lit(at).cast("timestamp")})
