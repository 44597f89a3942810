"""Views of the driver's tables on which the operators are queried, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Later than the last event: time-relative operators take it as "now".
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, group: str, order: str, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with the number of each within its group by ``order`` (long), in a new column ``name``.

    Ranges of ``order`` split a group over ``parts`` tasks; a row's number is its place in its range after the rows of the ranges before,
    which are counted from two columns.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 20 * parts)).head()[0] or []
    part = lambda: F.coalesce(F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)
    counts = rows.groupBy(F.col(group).alias("_group"), part().alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = rows.withColumn("_part", part())
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_part").orderBy(order)))
    return own.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))).select(*rows.columns, (F.col("_at") + F.col("_before")).cast("int").alias(name))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return numbered(docs, "source", "doc_id", "_number").select(
        F.col("doc_id").alias("episode_id"),
        F.col("source").alias("novel_id"),
        F.col("_number").alias("episode_number"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("episode_title"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 365 as int))").alias("publication_date"),
        F.col("text").alias("content"),
    )


EPISODES = """v_episode AS (SELECT doc_id AS episode_id, source AS novel_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS episode_number,
    'doc ' || doc_id AS episode_title, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS publication_date, text AS content FROM documents)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", F.col("value").alias("response_time_ms"), (F.col("event_type") != "error").alias("success"), "event_type")


QUERY_LOG = "v_query_log AS (SELECT event_id, ts AS timestamp, user_id, value AS response_time_ms, event_type <> 'error' AS success, event_type FROM events)"


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") == "error", "delete")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("event_type"), "user_id").where("event_type is not null")


DOCUMENT_EVENTS = "v_doc_event AS (SELECT event_id AS document_id, ts AS timestamp, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'error' THEN 'delete' END AS event_type, user_id FROM events WHERE event_type IN ('signup', 'error'))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"), (F.col("conv_id") % 7).alias("user_id"))


MESSAGES = "v_message AS (SELECT conv_id, turn, role, text, to_timestamp(1704067200 + conv_id * 1000 + turn)::TIMESTAMP AS timestamp, conv_id % 7 AS user_id FROM conversations)"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query vectors (every id divisible by 50) and the whole table as corpus."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("grp"), (F.col("vec_id") % 5).alias("user_id"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), e


VECTORS = """v_query_vec AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS query_vec FROM embeddings WHERE vec_id % 50 = 0),
v_corpus_vec AS (SELECT vec_id, embedding::DOUBLE[] AS embedding, label AS grp, vec_id % 5 AS user_id FROM embeddings)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's whole text as a query, its words joined by one space."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.expr(r"regexp_extract_all(text, '\\S+', 0)"), " ").alias("query"))


QUESTIONS = r"v_query AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[^\s]+'), ' ') AS query FROM benchmark)"
