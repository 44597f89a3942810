"""Mixing of sources to target weights: fixed-length blocks, multinomial shard counts, index permutations.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, discard, let, numbered

#: Words of a block, blocks of an output shard on average, and how often a source may be repeated at most.
BLOCK_WORDS, SHARD_BLOCKS, MOST_EPOCHS = 64, 4096, 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Rounds of the permutation, draws that one row becomes, and draws of a task at least, up to so many tasks.
ROUNDS, DRAWS_A_ROW, TASK_DRAWS, MOST_TASKS = 24, 1 << 12, 1 << 16, 20_000


def words_in(text: F.Column) -> F.Column:
    """Number of words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, within: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources(source, source_size, ...)`` with ``sid``, its place by code point (null last), and ``target``, the words it gives to the mix.

    The targets share the sum of all sizes by weight; a target stops at ``most`` times its source's size, and the excess is shared by weight
    until none is above.  So a target is ``min(most * size, level * weight)``; the level rises until no further source stops.  Each round
    brings two sums to the driver, however many sources there are.
    """
    ranked = numbered(sources, [F.asc_nulls_last("source")], within).withColumnRenamed("_n", "sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    known = cut(ranked.withColumns({"weight": weight, "cap": most * F.col("source_size")}), within)
    total, level, stopped = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0], 0.0, -1
    while True:
        free = F.col("cap") > F.col("weight") * level
        row = known.agg(F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0)).alias("given"), F.count_if(~free).alias("stopped")).head()
        if row["weight"] == 0 or row["stopped"] == stopped:
            break
        stopped, level = row["stopped"], (total - row["given"]) / row["weight"]
    return known.withColumn("target", F.when(F.col("cap") > F.col("weight") * level, F.col("weight") * level).otherwise(F.col("cap")).cast("double")).drop("weight", "cap")


def permuted(x: F.Column, n: F.Column, *key: F.Column | int, rounds: int = ROUNDS) -> F.Column:
    """A pseudorandom permutation of 0 to ``n - 1`` chosen by ``key``, applied to ``x``.

    Each round pairs ``x`` with ``k - x`` modulo ``n`` and swaps the pair or not by a hash of its greater member, so it is a permutation for
    every ``n``, without a search for a number in range.
    """
    keys = [F.lit(k) if isinstance(k, int) else k for k in key]

    def swapped(value: F.Column, r: F.Column) -> F.Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - value, n)
        return let(other, lambda y: F.when(F.xxhash64(*keys, r, F.greatest(value, y)).bitwiseAND(1) == 1, y).otherwise(value))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swapped)


def draws(plan: DataFrame, seed: int = 0, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``plan(sid, blocks, drawn)`` -> a row ``sid, draw, shard, block`` for each of a source's ``drawn`` blocks.

    Each draw falls on an output shard by a uniform hash, so the sources' counts of the shards are multinomial and each source's total is
    exact.  A source's draws go through permutations of its blocks, one for each time through, so that no block comes once more than another
    does twice.  The draws of a large source start from many rows, dealt over a stated number of tasks, as the rows that start them are few.
    """
    total = plan.agg(F.coalesce(F.sum("drawn"), F.lit(0))).head()[0]
    shards, tasks = F.lit(max(1, -(-total // shard_blocks))).cast("long"), min(MOST_TASKS, 1 + total // TASK_DRAWS)
    starts = plan.where("drawn > 0").select("sid", "blocks", "drawn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("drawn") - 1) / DRAWS_A_ROW).cast("long"))).alias("part"))
    last = F.least(F.col("drawn"), (F.col("part") + 1) * DRAWS_A_ROW) - 1
    each = starts.repartition(tasks, "sid", "part").select("sid", "blocks", F.explode(F.sequence(F.col("part") * DRAWS_A_ROW, last)).alias("draw"))
    time = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    block = permuted(F.pmod("draw", "blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), time)
    return each.select("sid", "draw", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "sid", "draw"), shards).alias("shard"), block.alias("block"))


def _packed(docs: DataFrame, within: list[str], block_words: int, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """The documents in their sources' lines of words (``start``), and the sources with ``blocks`` and ``drawn``."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), F.xxhash64(text).alias("tie"), *([text.alias("text")] if texts else []))
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), within)
    line = numbered(rows, [F.asc_nulls_last("source"), F.asc("doc_id"), F.asc("size"), F.asc("tie"), F.asc("at")], within, "size")
    sources = line.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_before").alias("first"))
    plan = targets(cut(sources, within), within, weights, most)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = F.round(F.try_divide(blocks * F.col("target"), F.col("source_size"))).cast("long")
    plan = cut(plan.withColumns({"blocks": blocks, "drawn": F.coalesce(F.least(wanted, most * blocks), F.lit(0))}), within)
    placed = line.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source"))).withColumn("start", F.col("_before") - F.col("first"))
    return placed, plan


def _pieces(placed: DataFrame, block_words: int, texts: bool) -> DataFrame:
    """A row for each block that a document reaches into: ``block``, ``words`` it has there and, with ``texts``, the words themselves."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    begin = lambda b: F.greatest(F.col("start"), b * block_words)
    n = lambda b: F.least(F.col("start") + F.col("size"), (b + 1) * block_words) - begin(b)
    numbers = F.when(F.col("size") > 0, F.sequence(first.cast("long"), last.cast("long")))
    if not texts:
        return placed.withColumn("block", F.explode_outer(numbers)).withColumn("words", n(F.col("block")))
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cuts = let(found, lambda w: F.transform(numbers, lambda b: F.struct(b.alias("block"), F.array_join(F.slice(w, (begin(b) - F.col("start") + 1).cast("int"), n(b).cast("int")), " ").alias("piece"))))
    return placed.withColumn("p", F.explode(cuts)).select("sid", "start", "p.block", "p.piece")


def mixed_blocks(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: ``shard, slot, source, block, text``, one row for each drawn block, with its words joined by one space.

    Written with ``partitionBy("shard")`` it is a training set.  A shard has about ``shard_blocks`` slots from 0, in pseudorandom order.
    Edges are those of ``mix_report``.
    """
    within: list[str] = []
    placed, plan = _packed(docs, within, block_words, id_col, text_col, source_col, weights, most, texts=True)
    # At most block_words pieces meet in a block.
    content = _pieces(placed, block_words, texts=True).groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"))
    content = content.select("sid", "block", F.array_join("p.piece", " ").alias("text"))
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("slot"), "sid", "draw"), "sid", "draw")) - 1
    # Draws look small to the optimizer, as the rows that start them are: they must not be broadcast.
    drawn = draws(plan, seed, shard_blocks).withColumn("slot", slot)
    out = cut(drawn.hint("merge").join(content, ["sid", "block"]).join(plan.select("sid", "source"), "sid").select("shard", "slot", "source", "block", "text"))
    discard(docs.sparkSession, within)
    return out


def mix_report(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: how many of a document's words the mix takes, repeats counted.

    Sources give words by weight: 1, 2, 3, repeating in the order of their names; the mix has as many words as all documents, and none more
    than ``most`` times a source's size.  A source's words, documents ascending by id, are packed into blocks of ``block_words``; so many
    blocks are drawn that its share is met to half a block, each block as often as any other or once more, never over ``most`` times.

    A null text has no words; a document without words takes none.  The null source is one source, the last.  Null ids come first in their
    source; repeated ids are ordered by size and text, so that reruns agree; equal rows are interchangeable.  Other columns are not read.
    An empty table gives an empty result.
    """
    within: list[str] = []
    placed, plan = _packed(docs, within, block_words, id_col, text_col, source_col, weights, most, texts=False)
    times = draws(plan, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    pieces = _pieces(placed, block_words, texts=False).select("_n", "doc_id", "size", "source_size", "target", "sid", "block", "words")
    # Draws look small to the optimizer, as the rows that start them are: they must not be broadcast.
    met = pieces.join(times.hint("merge"), ["sid", "block"], "left")
    kept = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    out = met.groupBy("_n").agg(*kept, F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).alias("taken")).drop("_n")
    out = cut(out)
    discard(docs.sparkSession, within)
    return out
