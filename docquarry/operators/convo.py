"""Conversation histories: ``conv_id, turn, role, text, timestamp, user_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _newest() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy(F.desc("turn"))


def _oldest() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation, numbered from the oldest of them."""
    kept = messages.withColumn("back", F.row_number().over(_newest())).where(F.col("back") <= n)
    return kept.withColumn("position", F.row_number().over(_oldest())).drop("back")


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its message count and last time, newest first, and its ``place`` in its user's list."""
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("timestamp").alias("updated_at"))
    return conversations.join(counts, "conv_id", "left").select("conv_id", "user_id", F.coalesce("messages", F.lit(0)).alias("messages"), "updated_at", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("conv_id"))).alias("place")).orderBy("user_id", "place")


def create_if_absent(conversations: DataFrame, wanted: DataFrame) -> DataFrame:
    """The table with those wanted conversations that it lacks."""
    return conversations.unionByName(wanted.join(conversations.select("conv_id"), "conv_id", "left_anti").select(*conversations.columns))


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The messages with the new ones ``(conv_id, role, text, timestamp, ...)`` after them, numbered on from each conversation's last turn."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("timestamp", "role", "text")
    numbered = new.withColumn("_n", F.row_number().over(order)).join(last, "conv_id", "left")
    numbered = numbered.withColumn("turn", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast(dict(messages.dtypes)["turn"]))
    return messages.unionByName(numbered.select(*messages.columns))


def add_messages(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations whose ``updated_at`` is moved to their newest added message."""
    latest = new.groupBy("conv_id").agg(F.max("timestamp").alias("newest"))
    return conversations.join(latest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "newest")).drop("newest")


def delete_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (conversations or messages) without those of the given conversations."""
    return rows.join(ids.select("conv_id"), "conv_id", "left_anti")


def with_title(messages: DataFrame, most: int = 30) -> DataFrame:
    """Metadata JSON with a title: the first user message, cut."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.to_json(F.create_map(F.lit("title"), F.left("text", F.lit(most)))).alias("metadata"))


def merge_metadata(conversations: DataFrame, updates: DataFrame) -> DataFrame:
    """Conversations with the keys of ``updates(conv_id, metadata)`` put over those of their own ``metadata`` (JSON objects); others stay."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = conversations.join(updates.select("conv_id", F.col("metadata").alias("_new")), "conv_id", "left").withColumns({"_a": parsed(F.col("metadata")), "_b": parsed(F.col("_new"))})
    merged = F.map_concat(F.map_filter("_a", lambda k, v: ~F.map_contains_key("_b", k)), F.col("_b"))
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    return rows.withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(F.to_json(sorted_))).select(*conversations.columns)


def recent_turns(messages: DataFrame, window: int = 5) -> DataFrame:
    """The last ``window`` turns of each conversation, newest first."""
    return messages.withColumn("back", F.row_number().over(_newest())).where(F.col("back") <= window)


def paired_turns(messages: DataFrame) -> DataFrame:
    """Each user message with the next assistant message of the conversation, numbered from 1."""
    ahead = _oldest().rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("role") == "assistant", F.struct("turn", "text")), ignorenulls=True).over(ahead)
    asked = messages.withColumn("answer", answer).where("role = 'user'")
    return asked.select("conv_id", F.row_number().over(_oldest()).alias("pair"), F.col("text").alias("question"), F.col("answer.text").alias("reply"), F.col("answer.turn").alias("reply_turn"))


def session_state(messages: DataFrame, as_of: str, idle_hours: int = 24, max_turns: int = 50) -> DataFrame:
    """Turns, last activity, and whether a session has expired or is full."""
    by = messages.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("timestamp").alias("last_activity"))
    return by.select("conv_id", "turns", (F.col("last_activity") < F.expr(f"timestamp'{as_of}' - interval {idle_hours} hours")).alias("expired"), (F.col("turns") >= max_turns).alias("is_full")).withColumn("is_active", ~F.col("expired"))


def digest(messages: DataFrame, first: int = 6, most: int = 200) -> DataFrame:
    """The first messages, cut and labelled, as one text for a title."""
    label = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: ")
    kept = messages.withColumn("n", F.row_number().over(_oldest())).where(F.col("n") <= first)
    lines = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(label, F.left("text", F.lit(most))).alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join("lines.line", "\n").alias("digest"))


def conversational_query(messages: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries(conv_id, query)`` with the user's part of the last two messages before them."""
    recent = last_messages(messages, 2).where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return queries.join(recent, "conv_id", "left").select("conv_id", F.trim(F.concat_ws(" ", F.array_join("m.text", " "), F.col("query"))).alias("query"))


def token_estimate(pairs: DataFrame) -> DataFrame:
    """White-space words of question and reply."""
    words = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return pairs.select("conv_id", "pair", words("question").alias("prompt_tokens"), words("reply").alias("completion_tokens"), (words("question") + words("reply")).alias("total_tokens"))


def owned(messages: DataFrame, claims: DataFrame) -> DataFrame:
    """Messages of conversations that the claiming user owns."""
    return messages.join(claims.select("conv_id", "user_id"), ["conv_id", "user_id"], "left_semi")


def prompt_context(messages: DataFrame, sources: DataFrame, last: int = 6, most: int = 5) -> DataFrame:
    """``conv_id, prompt``: the last messages, then the best sources with their relevance; ``sources(conv_id, title, score)``."""
    recent = last_messages(messages, last).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("m"))
    line = Window.partitionBy("conv_id").orderBy(F.desc("score"), "title")
    best = sources.withColumn("n", F.row_number().over(line)).where(F.col("n") <= most)
    shown = best.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("["), "title", F.lit("] "), F.format_string("%.2f", "score")).alias("line")))).alias("s"))
    return recent.join(shown, "conv_id", "left").select("conv_id", F.concat_ws("\n", F.array_join("m.line", "\n"), F.array_join("s.line", "\n")).alias("prompt"))
