"""Sources, sinks and whole-table edits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: File name endings that are read as text by default.
EXTENSIONS = ("txt", "md")


def extract_documents(docs: DataFrame, groups: list | None = None, ids: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Six columns of the documents, filtered by optional lists, ordered by group, number and id."""
    rows = docs.select("episode_id", "content", "episode_number", "episode_title", "publication_date", "novel_id")
    if groups:
        rows = rows.where(F.col("novel_id").isin(*groups))
    if ids:
        rows = rows.where(F.col("episode_id").isin(*ids))
    rows = rows.orderBy("novel_id", "episode_number", "episode_id")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def incremental(rows: DataFrame, modified: str, since: str, key: str, content: str) -> DataFrame:
    """Rows modified after ``since``: key, content, and all other columns in one JSON object."""
    rest = [c for c in rows.columns if c not in (key, content, modified)]
    return rows.where(F.col(modified) > F.lit(since).cast("timestamp")).select(F.col(key).alias("id"), F.col(content).alias("content"), F.to_json(F.struct(*rest)).alias("metadata"), F.col(modified).alias("modified_date"))


def read_jdbc_incremental(spark: SparkSession, url: str, table: str, modified: str, since: str, key: str, content: str, **partitioned) -> DataFrame:
    """``incremental`` over a JDBC table; the filter is pushed down.  ``partitioned``: partitionColumn, lowerBound, upperBound, numPartitions."""
    return incremental(spark.read.format("jdbc").options(url=url, dbtable=table, **partitioned).load(), modified, since, key, content)


def read_text_files(spark: SparkSession, path: str, since: str | None = None, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True, errors: str = "replace") -> DataFrame:
    """Whole files as rows: ``id, path, size, modified, text``, optionally only those modified after ``since`` (ISO time)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", recursive)
    files = (reader.option("modifiedAfter", since) if since else reader).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select(F.concat(F.lit("file_"), stem).alias("id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), decode_bytes("content", errors).alias("text"))


def decode_bytes(column: str, errors: str = "replace") -> Column:
    """Bytes as UTF-8: bad sequences are replaced, ignored, make the value null (``null``) or fail (``strict``)."""
    text = F.col(column).cast("string")
    if errors == "ignore":
        return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))
    return {"replace": F.make_valid_utf8, "null": F.try_validate_utf8, "strict": F.validate_utf8}[errors](text)


def write_rows(rows: DataFrame, path: str, partition: list[str] | None = None, mode: str = "append") -> int:
    """Writes parquet, partitioned by the given columns, and returns how many rows were written."""
    seen = Observation()
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return seen.get["rows"]


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the updates in place of rows that share their keys; null keys are equal.

    Of updates that share their keys one counts: the one that is greatest in all its columns, in order.
    """
    columns = target.columns
    once = updates.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(*columns)).alias("_row"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return target.join(once, same, "left_anti").select(*columns).unionByName(once.select("_row.*").select(*columns))


def replace_by_parent(target: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the new rows' parents go, the new rows come."""
    return target.join(new.select(parent).distinct(), parent, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; an unknown condition keeps the row."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def validate_collection(rows: DataFrame, key: str, vector: str, dim: int, required: list[str]) -> DataFrame:
    """Counts of rows, repeated keys, vectors of another dimension, and rows that lack a required field.  The schema is checked first."""
    if len(set(rows.columns)) != len(rows.columns):
        raise ValueError("column names are not unique")
    if dict(rows.dtypes)[key] not in ("bigint", "string"):
        raise ValueError(f"the key {key} must be a long or a string")
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull()
    return rows.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct(key)).alias("repeated_keys"), F.count_if(F.size(vector) != dim).alias("wrong_dimension"), F.count_if(lacks).alias("incomplete"))


def fill_entry_defaults(rows: DataFrame, now: int) -> DataFrame:
    """Missing times become ``now``, missing permissions and metadata empty objects, missing groups an empty list."""
    defaults = {"created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long"), "metadata": F.lit("{}"), "permissions": F.lit("{}"), "group_ids": F.lit("[]")}
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})


def in_partitions(rows: DataFrame, column: str, names: list) -> DataFrame:
    """Rows of the named partitions; on a partitioned table only their folders are read."""
    return rows.where(F.col(column).isin(*names))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def profile_table(rows: DataFrame) -> DataFrame:
    """``column_name, type, nullable, rows, nulls, distinct_values`` of each column, from one pass."""
    nullable = {f.name: f.nullable for f in rows.schema.fields}
    total = F.count(F.lit(1)).alias("rows")
    facts = rows.agg(total, *[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.countDistinct(c).alias("d")).alias(f"_{i}") for i, c in enumerate(rows.columns)])
    per = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.lit(nullable[c]).alias("nullable"), F.col("rows"), F.col(f"_{i}.nulls").alias("nulls"), F.col(f"_{i}.d").alias("distinct_values")) for i, (c, t) in enumerate(rows.dtypes)])
    return facts.select(F.inline(per))


def sample_rows(rows: DataFrame, key: str, n: int = 5) -> DataFrame:
    """``n`` rows as examples: those with the least keys, the same ones every time."""
    return rows.orderBy(key).limit(n)


def tables_with_column(tables: dict[str, DataFrame], column: str) -> list[str]:
    return sorted(name for name, t in tables.items() if column in t.columns)


def relationships(keys: DataFrame) -> DataFrame:
    """``keys(table_name, refers_to)`` -> for each table, those that it refers to and those that refer to it."""
    sides = keys.select(F.col("table_name").alias("t"), F.col("refers_to").alias("to_"), F.lit(None).cast("string").alias("from_")).unionByName(keys.select(F.col("refers_to").alias("t"), F.lit(None).cast("string").alias("to_"), F.col("table_name").alias("from_")))
    return sides.groupBy("t").agg(F.array_join(F.sort_array(F.collect_set("to_")), ",").alias("refers_to"), F.array_join(F.sort_array(F.collect_set("from_")), ",").alias("referred_by")).withColumnRenamed("t", "table_name")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows`` of each table."""
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)


def links_of(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How far a reference holds: rows with a key, distinct keys, and keys that the parent lacks."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("_k"), F.lit(1).alias("_known")).distinct()
    return keys.join(known, "_k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linked_rows"), F.count("*").alias("keys"), F.count_if(F.col("_known").isNull()).alias("unknown_keys"))


def missing_tables(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected names without an existing table, whatever the case."""
    low = lambda t: t.select(F.lower("name").alias("low"))
    return expected.withColumn("low", F.lower("name")).join(low(existing), "low", "left_anti").select("name")
