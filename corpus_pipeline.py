"""Corpus pipeline: language ID, near-duplicates, repeated substrings, benchmark leaks, pieces."""

from __future__ import annotations

import uuid

import public_tokenizers
from docquarry.llm.common import cut, discard, may_match, semi_or_anti, table
from docquarry.llm.decontam import leaks
from docquarry.llm.langid import keep_identified, train
from docquarry.llm.neardup import near_duplicates
from docquarry.llm.pieces import piece_round_trip
from docquarry.llm.substrings import remove_repeats
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages known with less than this score are rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the byte network knows; it learns from a bounded sample of rows with a language."""
    return keep_identified(docs, train(docs, F.lit(True)), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each near-duplicate group, and one of the rows that share it.  A row without id is kept."""
    groups = near_duplicates(docs)
    ids = cut(groups.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"))
    once = semi_or_anti(docs, ids, "doc_id", "left_anti")
    return once.unionByName(semi_or_anti(docs, ids.where("kept"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated 35-word windows; a changed text has its kept words joined by one space.

    A document stays even if no word is left: its text is then empty.  Only rows whose id has a change are shuffled.
    """
    new = f"_kept{uuid.uuid4().hex}"
    less = remove_repeats(docs).where("n_removed > 0").select("doc_id", F.col("kept_text").alias(new)).dropDuplicates(["doc_id"])
    less = cut(less)
    same = semi_or_anti(docs, less, "doc_id", "left_anti")
    changed = may_match(docs, less, "doc_id").join(less.hint("merge"), "doc_id")
    changed = changed.withColumns({"text": F.col(new), "n_chars": F.length(new).cast("long")}).select(*docs.columns)
    return same.unionByName(changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return semi_or_anti(docs, leaks(docs, table(spark, sf_dir, "benchmark")), "doc_id", "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's pieces, with digests and whether they decode to the text."""
    return piece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]
#: The stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        written: list[str] = []
        docs = cut(stage(spark, docs, sf_dir), written)
        discard(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
