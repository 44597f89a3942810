"""Vector search in blocks: one matrix product for each pair of a block of queries and a block of vectors, and stored cells for the approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import METRICS, SIMILARITIES, l2_sq, normalized, probes_for

#: Numbers (8 bytes each) of a block of vectors, and scores that are held at once.
BLOCK_NUMBERS, HELD_SCORES = 1 << 20, 1 << 22
#: Rows that the centres of a stored table are fitted on, for each centre.
SAMPLE_A_CELL = 256


def best_products(ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query id, key, score`` of the ``k`` greatest products of each query, ties by key; some queries at a time, so that scores stay few."""
    out = [(ids[:0], keys[:0], np.zeros(0))]
    step = max(1, HELD_SCORES // max(1, len(keys)))
    for at in range(0, len(ids) if len(keys) else 0, step):
        scores = np.round(queries[at : at + step] @ vectors.T, 12)
        if k < len(keys):
            least = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
            row, column = np.nonzero(scores >= least[:, None])
        else:
            row, column = np.indices(scores.shape).reshape(2, -1)
        found = scores[row, column]
        order = np.lexsort((keys[column], -found, row))
        row, column, found = row[order], column[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        out.append((ids[at + row[kept]], keys[column[kept]], found[kept]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float) if len(vectors) else np.zeros((0, 0))


def _products(queries: DataFrame, corpus: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    """The best ``k`` of each query in each pair of blocks that share ``by``, and of those its best."""

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        i, j, s = best_products(left["query_id"].to_numpy(), _matrix(left["_q"]), right[key].to_numpy(), _matrix(right["_v"]), k)
        return pd.DataFrame({"query_id": i, key: j, "score": s})

    found = queries.groupBy(*by).cogroup(corpus.groupBy(*by)).applyInPandas(product, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _blocks_of(rows: DataFrame, vector: str) -> int:
    """How many blocks the rows' vectors fill; two numbers come to the driver."""
    row = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dims")).head()
    return max(1, -(-row["n"] * max(1, row["dims"] or 1) // BLOCK_NUMBERS))


def topk_in_blocks(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, key, score``: exact cosine top-k of any number of queries, without a broadcast, in one plan.

    Both sides are normalised once and dealt into blocks of bounded size by the hash of their key; each pair of blocks is one task's matrix
    product, of which each query keeps its best ``k``.  A row goes to as many tasks as the other side has blocks.
    """
    many_q, many_c = _blocks_of(queries, "query_vec"), _blocks_of(corpus, vector)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    queries, corpus = queries.where("query_vec is not null"), corpus.where(F.col(vector).isNotNull())
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), normalized("query_vec").alias("_q"), block("query_id", many_q).alias("_i")).withColumn("_j", each(many_c))
    right = corpus.select(F.col(key).cast("long").alias(key), normalized(vector).alias("_v"), block(key, many_c).alias("_j")).withColumn("_i", each(many_q))
    return _products(left, right, ["_i", "_j"], k, key)


#: Share of the greatest possible product that rounding can't reach: rows so near the last of the best are compared number by number.
SLACK = 1e-11
#: Rows of each side of a block whose pairs are all results, parts of a side, and rows that leave a task at once.
PAIR_ROWS, MOST_PARTS, SENT_ROWS = 1 << 10, 1 << 6, 1 << 16
#: Queries whose whole lists a task ranks, and bytes of those lists.
RANKED_QUERIES, HELD_BYTES = 1 << 5, 1 << 27


def _stacked(*sides: pd.Series) -> list[np.ndarray]:
    """Each side's vectors as rows; what a vector lacks (null, null numbers, fewer dimensions) is NaN."""
    lists = [[() if v is None else np.asarray(v, float) for v in side] for side in sides]
    dims = max((len(v) for vectors in lists for v in vectors), default=0)
    out = []
    for vectors in lists:
        if vectors and all(len(v) == dims for v in vectors):
            out.append(np.stack(vectors))
        else:
            out.append(np.full((len(vectors), dims), np.nan))
            for row, v in zip(out[-1], vectors, strict=True):
                row[: len(v)] = v
    return out


def _line_sums(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Sums over the dimensions of two equally long lists of vectors, one dimension after the other, as ``vector.METRICS`` adds them."""
    out = np.zeros(len(left))
    for x, y in zip(left.T, right.T, strict=True):
        out += x * y if metric in SIMILARITIES else np.abs(x - y) if metric == "manhattan" else (x - y) * (x - y)
    return out


def _sizes(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(_line_sums(vectors, vectors, "ip"))


def distances(left: np.ndarray, right: np.ndarray, metric: str, left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """The metric of two equally long lists of vectors, row by row, equal to ``vector.METRICS``; NaN where a vector lacks numbers."""
    sums = _line_sums(left, right, metric)
    if metric == "cosine":
        size = left_sizes * right_sizes
        return np.divide(sums, size, out=np.where(size == 0, 0.0, np.nan), where=size > 0)
    return np.sqrt(sums) if metric == "euclidean" else sums


def _manhattan(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out, part = np.zeros((len(queries), len(vectors))), np.empty((len(queries), len(vectors)))
    for x, y in zip(queries.T, np.ascontiguousarray(vectors.T), strict=True):
        np.subtract(x[:, None], y, out=part)
        np.abs(part, out=part)
        out += part
    return out


def _closeness(queries: np.ndarray, vectors: np.ndarray, metric: str, query_sizes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How close each vector is to each query, up to rounding (the greater the closer; -inf if unknown), and for each query what rounding can change."""
    most = np.nanmax(sizes, initial=0.0)
    if metric == "cosine":
        unit = lambda v, size: v / np.where(size > 0, size, 1.0)[:, None]
        found, slack = unit(queries, query_sizes) @ unit(vectors, sizes).T, np.full(len(queries), SLACK)
    elif metric == "ip":
        found, slack = queries @ vectors.T, SLACK * query_sizes * most
    elif metric == "manhattan":
        found = -_manhattan(queries, vectors)
        slack = SLACK * np.nan_to_num(np.abs(queries).sum(axis=1) + np.nanmax(np.abs(vectors).sum(axis=1), initial=0.0))
    else:
        found = 2 * (queries @ vectors.T) - (sizes * sizes) - (query_sizes * query_sizes)[:, None]
        slack = SLACK * (query_sizes * query_sizes + most * most)
    found[np.isnan(found)] = -np.inf
    return found, np.nan_to_num(slack)


def best_rows(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query's row, vector's row, distance``: the ``k`` (one number for each query) nearest of each query, ties by key.

    Matrix products choose the rows that may be among them; their distances are then added up as ``vector.METRICS`` does.
    """
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    query_sizes, sizes = _sizes(queries), _sizes(vectors)
    sign = -1 if metric in SIMILARITIES else 1
    places = np.unique(keys, return_inverse=True)[1]
    step = max(1, HELD_SCORES // max(1, len(keys)))
    for at in range(0, len(queries) if len(keys) else 0, step):
        part = slice(at, at + step)
        close, slack = _closeness(queries[part], vectors, metric, query_sizes[part], sizes)
        most = int(k[part].max())
        if most < len(keys):
            least = np.partition(close, len(keys) - max(most, 1), axis=1)[:, len(keys) - max(most, 1)]
            row, column = np.nonzero(close >= (least - slack)[:, None])
        else:
            row, column = np.indices(close.shape).reshape(2, -1)
        for begin in range(0, len(row), 1 << 16):
            some = slice(begin, begin + (1 << 16))
            found = distances(queries[at + row[some]], vectors[column[some]], metric, query_sizes[at + row[some]], sizes[column[some]])
            out.append((at + row[some], column[some], found))
    row, column, found = (np.concatenate(part) for part in zip(*out, strict=True))
    order = np.lexsort((places[column], np.where(np.isnan(found), np.inf, sign * found), row))
    row, column, found = row[order], column[order], found[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k[row]
    return row[kept], column[kept], found[kept]


def _dealt(queries: DataFrame, corpus: DataFrame, key: str, many_q: int, many_c: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by the pairs of their blocks, ``_i`` and ``_j``."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    return queries.withColumn("_i", block("query_id", many_q)).withColumn("_j", each(many_c)), corpus.withColumn("_j", block(key, many_c)).withColumn("_i", each(many_q))


def nearest(queries: DataFrame, corpus: DataFrame, metric: str, key: str = "vec_id", vector: str = "embedding", match: Column | None = None, match_on: tuple[str, str] | None = None) -> DataFrame:
    """``query_id, key, distance, _k``: of each pair of blocks the ``_k`` (a column of the queries) nearest of each query.

    With ``match`` a query has the values of ``match_on``'s second column that go with its value of the first.
    """
    left, right = queries.select("query_id", "query_vec", "_k"), corpus.select(key, F.col(vector).alias("_v"))
    if match is not None:
        mine, theirs = match_on
        value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
        fitting = queries.select(mine).distinct().crossJoin(F.broadcast(corpus.select(theirs).distinct())).where(match)
        wanted = fitting.groupBy(value(mine).alias("_of")).agg(F.sort_array(F.collect_set(value(theirs))).alias("_wanted"))
        left = queries.withColumn("_of", value(mine)).join(F.broadcast(wanted), "_of").select("query_id", "query_vec", "_k", "_wanted")
        right = corpus.select(key, F.col(vector).alias("_v"), value(theirs).alias("_has"))
    left, right = _dealt(left, right, key, _blocks_of(queries, "query_vec"), _blocks_of(corpus, vector))

    judged = match is not None

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, v = _stacked(left["query_vec"], right["_v"])
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for mine, theirs in _fitting(left, right) if judged else [(np.arange(len(left)), np.arange(len(right)))]:
            i, j, d = best_rows(q[mine], v[theirs], right[key].to_numpy()[theirs], left["_k"].to_numpy()[mine], metric)
            found.append((mine[i], theirs[j], d))
        i, j, d = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[i], key: right[key].to_numpy()[j], "distance": d, "_k": left["_k"].to_numpy()[i]})

    types = dict(queries.dtypes) | {key: dict(corpus.dtypes)[key]}
    schema = f"query_id {types['query_id']}, `{key}` {types[key]}, distance double, _k {types['_k']}"
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(product, schema)


def _fitting(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of queries that want the same values, beside the rows that have them."""
    wanted, has = left["_wanted"].map(tuple), right["_has"]
    for values in wanted.unique():
        yield np.flatnonzero(wanted.map(lambda w: w == values)), np.flatnonzero(has.isin(values))  # noqa: B023


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Half up, as ``round`` in SQL: by the shortest decimal form of the number."""
    scaled = np.abs(x) * 10**digits
    whole = np.floor(scaled)
    near = np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-6 + scaled * 1e-15)
    out = np.copysign(np.floor(scaled + 0.5) / 10**digits, x)
    unit = Decimal(1).scaleb(-digits)
    out[near] = [float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in x[near]]
    return out + 0.0


def all_pairs(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """The metric of every query (row) with every vector (column); NaN where a vector lacks numbers."""
    if metric == "manhattan":
        return _manhattan(queries, vectors)
    products, query_sizes, sizes = queries @ vectors.T, _sizes(queries), _sizes(vectors)
    if metric == "ip":
        return products
    if metric == "cosine":
        size = query_sizes[:, None] * sizes
        return np.divide(products, size, out=np.where(size == 0, 0.0, np.nan), where=size > 0)
    total = (query_sizes * query_sizes)[:, None] + sizes * sizes
    squares = total - 2 * products
    i, j = np.nonzero(squares < total * 1e-3)  # what cancels out is added up number by number
    squares[i, j] = _line_sums(queries[i], vectors[j], metric)
    return np.sqrt(squares) if metric == "euclidean" else squares


def _number(rows: DataFrame, vector: str) -> type:
    return np.float32 if dict(rows.dtypes)[vector] == "array<float>" else np.float64


def _packed(rows: DataFrame, key: str, vector: str, side: str) -> DataFrame:
    """Blocks of at most ``PAIR_ROWS`` rows, packed where they are read: keys, the vectors' numbers as bytes, how many a vector has, the task and the block's place in it."""
    names, number = [f"_{side}_{c}" for c in ("keys", "numbers", "dims", "part", "place")], _number(rows, vector)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                keys, vectors = batch.slice(at, PAIR_ROWS).columns
                (block,) = _stacked(vectors.to_pandas())
                if vectors.null_count == len(keys):
                    block = np.full((len(keys), 1), np.nan)
                ints = [pa.array([n], pa.int32()) for n in (block.shape[1], part, place)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([block.astype(number).tobytes()]), *ints], names)
                place += 1

    return rows.select(key, vector).mapInArrow(pack, f"{names[0]} array<{dict(rows.dtypes)[key]}>, {names[1]} binary, " + ", ".join(f"{n} int" for n in names[2:]))


def _met(queries: DataFrame, corpus: DataFrame, key: str, vector: str, parts_q: int, parts_c: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple]]]:
    """Each packed block of the corpus beside each of the queries, and a function that reads a batch of them.

    A task has one part of each side: the corpus's blocks come to it one after another, each beside every block of its queries.  A row is
    shuffled as its side is packed, not again for the blocks of the other side.
    """
    left = _packed(corpus, key, vector, "c").repartition(parts_c)
    right = _packed(queries.repartition(parts_q, "query_id"), "query_id", "query_vec", "q").repartitionById(parts_q, "_q_part")
    number = {"q": _number(queries, "query_vec"), "c": _number(corpus, vector)}

    def side(row: dict, name: str) -> tuple[pa.Array, np.ndarray]:
        keys = row[f"_{name}_keys"].values
        return keys, np.frombuffer(row[f"_{name}_numbers"].as_py(), number[name]).reshape(len(keys), row[f"_{name}_dims"].as_py()).astype(float)

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Of each pair: which block of queries it is, its ids and vectors, and the keys and vectors of the corpus's block."""
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at] for name in batch.schema.names}
            (ids, q), (keys, v) = side(row, "q"), side(row, "c")
            dims = max(q.shape[1], v.shape[1])
            q, v = (np.pad(x, ((0, 0), (0, dims - x.shape[1])), constant_values=np.nan) if x.shape[1] < dims else x for x in (q, v))
            yield (row["_q_part"].as_py(), row["_q_place"].as_py()), ids, q, keys, v

    return left.crossJoin(right.hint("shuffle_replicate_nl")), read


def pairwise(queries: DataFrame, corpus: DataFrame, metrics: tuple[str, ...] = tuple(METRICS), digits: int = 6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, key`` and each metric, rounded, of every query with every row: two packed blocks at a time.

    The number of pairs grows with the product of both sides; what is shuffled grows with their sum.
    """
    names, types = ["query_id", key, *metrics], dict(queries.dtypes) | {key: dict(corpus.dtypes)[key]}
    parts = lambda df: max(1, min(MOST_PARTS, -(-df.count() // PAIR_ROWS)))
    pairs, read = _met(queries, corpus, key, vector, parts(queries), parts(corpus))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, q, keys, v in read(batch):
                step = max(1, SENT_ROWS // len(keys))
                for at in range(0, len(ids), step):
                    some = ids[at : at + step]
                    left, right = np.divmod(np.arange(len(some) * len(keys)), len(keys))
                    found = (pa.array(rounded(all_pairs(q[at : at + step], v, m).ravel(), digits), from_pandas=True) for m in metrics)
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(left)), keys.take(pa.array(right)), *found], names)

    return pairs.mapInArrow(product, f"query_id {types['query_id']}, `{key}` {types[key]}, " + ", ".join(f"{m} double" for m in metrics))


def _small(metric: str, digits: int) -> bool:
    """Whether 4 bytes hold the rounded metric."""
    return metric == "cosine" and digits < 9


def _ascending(found: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Numbers that ascend from the nearest by the rounded metric, unknown ones last."""
    worse = rounded(-found if metric in SIMILARITIES else found, digits)
    if _small(metric, digits):
        return np.where(np.isnan(worse), np.iinfo(np.int32).max, np.rint(worse * 10**digits)).astype(np.int32)
    return np.where(np.isnan(worse), np.inf, worse)


def _order(numbers: np.ndarray) -> np.ndarray:
    """Places of the numbers as they ascend, equal ones as they stand."""
    if numbers.dtype != np.int32:
        return np.argsort(numbers, kind="stable")
    both = numbers.astype(np.int64) << 32 | np.arange(len(numbers))
    both.sort()
    return both & 0xFFFFFFFF


def ranked_pairs(queries: DataFrame, corpus: DataFrame, metric: str = "cosine", digits: int = 6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, key, rank`` of every row for every query, by the rounded metric, ties by key.

    A task has few queries, fewer the longer their lists are, and the packed corpus comes to it block by block: it holds the queries' rounded
    metrics and the keys, then puts one list's ranks after another in their place.  The corpus is one part so that every task reads all of it; no
    pair is shuffled.  A key's rows for a task's queries leave it side by side, which written files compress best.
    """
    corpus = corpus.withColumn(key, F.col(key).cast("long"))
    at_once = max(1, min(RANKED_QUERIES, HELD_BYTES // ((4 if _small(metric, digits) else 8) * max(1, corpus.count()))))
    pairs, read = _met(queries, corpus, key, vector, max(1, -(-queries.count() // at_once)), 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found, known = {}, {}, []
        for batch in batches:
            for block, ids, q, keys, v in read(batch):
                found.setdefault(block, []).append(_ascending(all_pairs(q, v, metric).ravel(), metric, digits).reshape(len(ids), -1))
                asked[block] = ids
                if block == next(iter(asked)):
                    known.append(keys)
        if not asked:
            return
        by_key = pc.sort_indices(pa.concat_arrays(known)).to_numpy()
        ends = np.cumsum([len(keys) for keys in known])[:-1]
        same = pa.concat_arrays(asked.values()).dictionary_encode(null_encoding="encode").indices.to_numpy()
        rows = [(found[block], row) for block, ids in asked.items() for row in range(len(ids))]
        for mine in (np.flatnonzero(same == i) for i in np.unique(same)):  # an id of several rows has one list
            order = _order(np.stack([np.concatenate([part[row] for part in parts])[by_key] for parts, row in map(rows.__getitem__, mine)], axis=1).ravel())
            ranks = np.empty((len(mine), len(by_key)), np.int32)
            ranks[order % len(mine), by_key[order // len(mine)]] = np.arange(1, len(order) + 1)
            for i, own in zip(mine, ranks, strict=True):
                parts, row = rows[i]
                for part, some in zip(parts, np.split(own, ends), strict=True):
                    part[row] = some
        for block, ids in asked.items():
            for keys, part in zip(known, found[block], strict=True):
                right, left = np.divmod(np.arange(part.size), len(ids))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), keys.take(pa.array(right)), pa.array(part.T.ravel().astype(np.int32))], ["query_id", key, "rank"])

    return pairs.mapInArrow(place, f"query_id {dict(queries.dtypes)['query_id']}, `{key}` long, rank int")


class CellStore:
    """Vectors stored in cells around centres (an inverted file): ``path/rows`` is partitioned by cell, ``path/centres`` has the centres.

    A search reads the cells that its queries visit, as Spark prunes the other folders.  A cell with more vectors than a block has them in
    several blocks, so that one cell with a third of all vectors takes many tasks.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path, key

    def write(self, corpus: DataFrame, cells: int, vector: str = "embedding", fields: tuple[str, ...] = (), seed: int = 42) -> CellStore:
        """Stores every vector.  The centres are fitted on at most about ``SAMPLE_A_CELL * cells`` of them, those with the least hashes."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = corpus.where(F.col(vector).isNotNull()).select(F.col(self.key).cast("long").alias(self.key), *fields, normalized(vector).alias("_v"))
        total = rows.count()
        share = min(1.0, SAMPLE_A_CELL * cells / max(1, total))
        sample = rows.where(F.pmod(F.xxhash64(self.key), F.lit(1 << 30)) <= int(share * (1 << 30))).select(array_to_vector("_v").alias("_v"))
        model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(sample)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        placed = model.transform(rows.withColumn("_a", F.col("_v")).withColumn("_v", array_to_vector("_v"))).drop("_v").withColumnRenamed("_a", "_v")
        dims = len(centres[0][1]) if centres else 1
        most = max(1, BLOCK_NUMBERS // dims)
        sizes = placed.groupBy(F.col("cell").alias("_cell")).agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / most).cast("int"))
        # One row for each cell: at most as many as there are centres.
        known = placed.join(F.broadcast(sizes), F.col("cell") == F.col("_cell"))
        known = known.withColumn("block", F.pmod(F.xxhash64(self.key), F.col("_blocks")).cast("int")).drop("_cell", "_n", "_blocks")
        known.repartition("cell", "block").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        table = self.spark.createDataFrame(centres, "cell int, centre array<double>").join(F.broadcast(sizes.select(F.col("_cell").alias("cell"), F.col("_n").alias("vectors"), F.col("_blocks").alias("blocks"))), "cell")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        return self

    def centres(self) -> DataFrame:
        """``cell, centre, vectors, blocks`` of each cell that has vectors."""
        return self.spark.read.parquet(f"{self.path}/centres")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def probes(self, effort: str) -> int:
        """Cells that a search of this effort visits: a preset's number, or for ``adaptive`` by the number of vectors."""
        row = self.centres().agg(F.count("*").alias("cells"), F.sum("vectors").alias("n")).head()
        return probes_for(effort, row["cells"], row["n"])

    def visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, _q, cell, block``: the ``probes`` nearest cells of each query, block by block."""
        near = Window.partitionBy("query_id").orderBy("_d", "cell")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), normalized("query_vec").alias("_q"))
        # The centres are one small file by construction.
        ranked = asked.crossJoin(F.broadcast(self.centres())).withColumn("_d", l2_sq("_q", "centre")).withColumn("_n", F.row_number().over(near))
        return ranked.where(F.col("_n") <= probes).select("query_id", "_q", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def visited(self, visits: DataFrame) -> DataFrame:
        """The stored rows of the cells that ``visits`` has: only their folders are read.  At most as many numbers as there are cells come to the driver."""
        return self.rows().where(F.col("cell").isin([r[0] for r in visits.select("cell").distinct().collect()]))

    def search(self, queries: DataFrame, k: int, effort: str | int = "balanced") -> DataFrame:
        """``query_id, rank, key, score`` by cosine among the cells that the effort (a preset, ``adaptive`` or a number of cells) visits."""
        visits = self.visits(queries, effort if isinstance(effort, int) else self.probes(effort))
        stored = self.visited(visits).select(F.col(self.key), "_v", "cell", "block")
        return _products(visits, stored, ["cell", "block"], k, self.key)
