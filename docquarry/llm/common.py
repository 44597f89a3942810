"""Shared helpers of the training-data operators: tables, lineage cuts, word hashes, Arrow rows."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words in the contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it when the session is built; without one there is nowhere to write."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("build the session with spark.checkpoint.dir: a folder that the driver and all executors share")
    return configured


def cut(df: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it, so that later steps survive lost executors.

    The table's path is added to ``within``, for ``discard``.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if within is not None:
        within.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``cut`` wrote and that nothing needs any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    paths.clear()


#: 64-bit words of the filter that stands for a table of ids: a fixed size (about 32 MB when broadcast), whatever their number.
FILTER_WORDS = 1 << 20


def _place(column: F.Column) -> tuple[F.Column, F.Column]:
    """The id's word in the filter, and its three bits in that word."""
    h = F.xxhash64(column.cast("long"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(FILTER_WORDS - 1).cast("long")), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def _filter_of(ids: DataFrame, column: str, name: str) -> DataFrame:
    """The filter of ``ids(column)``: its words that are not 0, each the OR of its ids' bits (``name`` and ``name`` + b)."""
    word, bits = _place(F.col(column))
    return F.broadcast(ids.select(word.alias(name), bits.alias("_bits")).groupBy(name).agg(F.bit_or("_bits").alias(name + "b")))


def _probed(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, F.Column]:
    """The rows with their place in the filter of ``ids(column)``, and whether they hit it."""
    word, bits = _place(F.col(column))
    own = "_at" + uuid.uuid4().hex
    return rows.join(_filter_of(ids, column, own), word == F.col(own), "left"), F.coalesce(F.col(own + "b").bitwiseAND(bits) == bits, F.lit(False))


def may_match(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is in ``ids(column)``, and a few others: what an exact join has to shuffle.

    The ids become a filter of fixed size, each word the OR of its ids' bits, which is broadcast.  Up to about ten million ids few rows
    pass in vain; when there are so many that the filter is full, all rows do.
    """
    word, bits = _place(F.col(column))
    own = "_at" + uuid.uuid4().hex
    return rows.join(_filter_of(ids, column, own), (word == F.col(own)) & (F.col(own + "b").bitwiseAND(bits) == bits)).select(*rows.columns)


def semi_or_anti(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) one of ``ids(column)``, exactly, with their columns as they are.

    Rows that miss the ids' filter are decided in place; only the others are shuffled for the exact join.  There is one plan whatever
    the number of ids.  Null ids are never among ``ids``.
    """
    marked, hit = _probed(rows, ids, column)
    found = marked.where(hit).select(*rows.columns).join(ids.select(column).distinct().hint("merge"), column, how).select(*rows.columns)
    return found if how == "left_semi" else marked.where(~hit).select(*rows.columns).unionByName(found)


def least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """The rows whose hash over all columns is among the ``n`` least: about ``n`` rows and their repetitions, the same in every run.

    Only the greatest such hash comes to the driver, and no key is joined, so that no repeated id can bring more rows.
    """
    h = F.xxhash64(*rows.columns)
    top = rows.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).head()[0]
    return rows.limit(0) if top is None else rows.where(h <= top)


def numbered(rows: DataFrame, order: list[F.Column], within: list[str], size: str | None = None) -> DataFrame:
    """The rows with ``_n``, their place (from 0) in the order over all rows, and with ``_before``, the sum of ``size`` over the rows before.

    Rows are dealt by ranges of the order, which splits a hot first key by the later ones, and are numbered within their range; a range's
    offset comes from the ranges' totals, of which there are as many as partitions.  ``order`` must tell all rows apart, or those that it
    doesn't must be interchangeable.  The table's path is added to ``within``.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = cut(dealt.withColumns({"_part": F.shiftrightunsigned("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), within)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum(size or F.lit(0)).cast("long").alias("_sum"))
    offsets = totals.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_s0"))
    out = kept.join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_n0") + F.col("_at"))
    if size:
        inner = F.sum(size).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("_before", F.col("_s0") + inner - F.col(size))
    return out.drop("_part", "_at", "_n0", "_s0")


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h = h * _MIX2
    h ^= h >> np.uint64(31)
    return h


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; ``len(words) - n + 1`` values (none if there are fewer words)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for j in range(n):
        h = mix(h * _ODD + words[j : j + count])
    return h


def give_back() -> None:
    """Returns to the system what Python, Arrow and the C library hold for reuse: a worker goes on to other tasks and stages, or idles beside them."""
    import ctypes  # loaded where it is used: functions travel to the workers by value

    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[list[dict]]:
    """The rows of Arrow batches, few at a time, so that Python objects of a whole batch never coexist.

    What the worker's last task left is given back first, and what Arrow holds for reuse at the end.
    """
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).to_pylist()
    give_back()


def bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """Ascending distinct cut points that split ``column`` (long) into about ``buckets`` equal parts.

    The driver gets at most ``buckets - 1`` numbers, whatever the table's size.
    """
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, 20 * buckets).alias("p")).head()
    return sorted({int(x) for x in (found["p"] or []) if x is not None})


def bucket_of(column: str, cuts: list[int]) -> F.Column:
    """Number of cut points <= the value, found by halving; null goes to bucket 0."""
    if not cuts:
        return F.lit(0)
    size = 1 << (len(cuts)).bit_length()
    padded = F.array(*[F.lit(x).cast("long") for x in cuts])
    value = F.col(column)
    steps = [size >> i for i in range(1, size.bit_length())]
    below = F.lit(0)
    n = len(cuts)
    for step in steps if n <= 2 else []:
        probe = below + F.lit(step)
        below = F.when((probe <= n) & (F.get(padded, probe - 1) <= value), probe).otherwise(below)
    if n > 2:
        below = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda acc, s: F.when((acc + s <= n) & (F.get(padded, acc + s - 1) <= value), acc + s).otherwise(acc),
        )
    return F.when(value.isNull(), F.lit(0)).otherwise(below)


def let(value: F.Column, use) -> F.Column:
    """``use(value)`` with the value computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]
