"""Sinks for ``foreachBatch`` that end in the same table when a batch is repeated, after a failure at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile
from ..sources.tables import upsert


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _only_these_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrites the partitions that ``rows`` have; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def days_sink(path: str, day: str = "day") -> Callable[[DataFrame, int], None]:
    """Writes whole days of an aggregation in update mode: a batch's days replace those in the table, and no other day is touched."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        _only_these_partitions(batch.repartition(day), path, day)

    return apply


class SyncedTable:
    """A table kept equal to a stream of records by their hashes: new and changed records are written, unchanged ones are not.

    ``path/table`` is partitioned by a bucket of the key, so a batch rewrites the buckets with a new or changed record only.  A batch first
    writes those buckets as they will be to ``path/staged/batch=N``, from the table before it; when that is complete, it replaces them in the
    table.  A batch that is repeated after a failure finds either no complete staged folder, and the table as it was, or a complete one, and
    replaces the same buckets again: the table ends the same.  ``path/log`` has one row of counts for each batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, content: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.content, self.buckets = spark, path, key, content, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, bucket int"

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def log(self) -> DataFrame:
        return self.spark.read.schema("change string, records long, batch int").parquet(f"{self.path}/log")

    def _stored(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/table"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/table")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def fill(self, rows: DataFrame) -> None:
        """The table's first content."""
        _only_these_partitions(self._bucketed(rows).repartition("bucket"), f"{self.path}/table", "bucket")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``.  Of a batch's records of one key the one that is greatest in all its columns counts."""
        staged, log = f"{self.path}/staged/batch={batch_id}", f"{self.path}/log/batch={batch_id}"
        if not _exists(self.spark, f"{staged}/_SUCCESS"):
            _delete(self.spark, staged)
            batch.persist()
            self._stage(batch, staged, log)
            batch.unpersist()
        new = self.spark.read.schema(self.schema).parquet(staged)
        self._replace(new)
        if batch_id > 0:  # the batch before is committed, or this one would not run
            _delete(self.spark, f"{self.path}/staged/batch={batch_id - 1}")

    def _replace(self, new: DataFrame) -> None:
        _only_these_partitions(new.repartition("bucket"), f"{self.path}/table", "bucket")

    def _stage(self, batch: DataFrame, staged: str, log: str) -> None:
        records = self._bucketed(batch)
        stored = self._stored()
        seen = [r[0] for r in records.select("bucket").distinct().collect()]  # at most as many as there are buckets
        near = stored.where(F.col("bucket").isin(seen))
        once = records.groupBy(F.col(self.key).alias("_k")).agg(F.max(F.struct(*self.columns, "bucket")).alias("_r")).select("_r.*")
        change = reconcile.sync_diff(near.select(*self.columns), once.select(*self.columns), self.key, self.content).where("change <> 'deleted'")
        change.groupBy("change").agg(F.count("*").alias("records")).coalesce(1).write.mode("overwrite").parquet(log)
        wanted = once.join(change.where("change <> 'unchanged'").select(self.key), self.key, "left_semi").select(*self.columns, "bucket")
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
        upsert(near.where(F.col("bucket").isin(touched)), wanted, [self.key]).repartition("bucket").write.parquet(staged)
