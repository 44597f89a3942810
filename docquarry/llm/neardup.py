"""Near-duplicate groups of documents: SetSketch registers, bands, joint likelihood, exact confirmation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, discard, mix, ngram_hashes, rows_of, semi_or_anti
from .components import components

#: SetSketch parameters: base, rate of the exponential values, and the largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_534
BANDS, WIDTH = 32, 4
REGISTERS = BANDS * WIDTH
#: Parts that each bucket is joined in.
PARTS = 8
#: A pair goes on to the exact check when its estimated similarity is at least the threshold less this; the
#: standard error of the estimate is 0.04 or less, so that a pair at the threshold is lost once in ten million.
SLACK = 0.2

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, cache: WordHashes, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased; one for a short text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(cache.of(words), min(words_per_shingle, len(words))))


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each non-empty set: floor(1 - log_base(least exponential value)), truncated.

    The least value of register i is found on the hash's order and mapped to the exponential scale once.
    """
    out = np.empty((len(sets), REGISTERS), np.uint64)
    for k, s in enumerate(sets):
        low = None
        for at in range(0, len(s), 2048):
            part = ((s[at : at + 2048, None] ^ _SEEDS) * _FACTORS).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        out[k] = low
    uniform = ((out >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    level = np.floor(1.0 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16)


def joint_estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, from how many registers are greater, less and equal.

    The likelihood in J is concave; the maximum is found by ternary search over [0, least/greatest size].
    """
    more = (left > right).sum(axis=1)
    less = (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1.0 - u
    share = (BASE - 1.0) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0.0, 1.0) * share) / np.log(BASE), 1e-12, 1.0)

    def fit(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1.0 - up - down, 1e-12, 1.0))

    lo, hi = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    for _ in range(40):
        third = (hi - lo) / 3.0
        a, b = lo + third, hi - third
        left_better = fit(a) > fit(b)
        hi, lo = np.where(left_better, b, hi), np.where(left_better, lo, a)
    return (lo + hi) / 2.0


def _sketch(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in rows_of(batches):
            sets = [shingle_set(r["text"], cache, words_per_shingle) for r in rows]
            full = [s for s in sets if len(s)]
            regs = iter([r.tobytes() for r in registers_of(full)] if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc_id"] for r in rows], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(regs) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "regs"],
            )

    return run


def _sets(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in rows_of(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([shingle_set(r["text"], cache, words_per_shingle).tobytes() for r in rows], pa.binary())],
                ["id", "set"],
            )

    return run


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
                n_left, n_right = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                est = joint_estimate(left, right, n_left, n_right)
                keep = est >= threshold - SLACK
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep)), pa.array(est[keep])], ["a", "b", "est"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            linked = []
            for r in rows:
                x, y = np.frombuffer(r["set_a"], np.uint64), np.frombuffer(r["set_b"], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r["a"] for r in rows], pa.int64()), pa.array([r["b"] for r in rows], pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _merge(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 8):
            edges = [e for r in rows for e in merging_links(r["members"], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def merging_links(members: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that join the components (``root``) of a block's members: enough of them to span what can be joined.

    Every pair of different components is compared on its full sets, by counting a set's shingles in an index of all.
    """
    sets = [np.frombuffer(m["set"], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    label = np.unique([m["root"] for m in members], return_inverse=True)[1]
    most = np.bincount(label).argmax()
    found = []
    for q in np.flatnonzero(label != most):
        lo, hi = np.searchsorted(values, sets[q], "left"), np.searchsorted(values, sets[q], "right")
        width = hi - lo
        hits = np.arange(width.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        both = np.bincount(owners[hits], minlength=len(sets))
        for t in np.flatnonzero((100 * both >= percent * (sizes[q] + sizes - both)) & (label != label[q])):
            if label[t] != label[q]:
                found.append((members[q]["id"], members[t]["id"]))
                label[label == label[t]] = label[q]
    return found


#: Documents whose sets differ in size by less than this factor are one size class.
CLASS_STEP = 1.05


def size_class(n: int) -> int:
    return math.floor(math.log(n) / math.log(CLASS_STEP) + 1e-9)


def prefix_lengths(n: int, percent: int) -> list[tuple[int, int]]:
    """``(class, prefix)``: how many of its rarest shingles a set of ``n`` must show to partners of each size class.

    A partner of size b that is linked has at least percent (n + b) / (100 + percent) shingles in common, so both cannot hide
    all of them behind their first n - common + 1 shingles in one order.  Classes without a possible partner are left out.
    """
    least, most = -(-percent * n // 100), 100 * n // percent
    found = []
    for c in range(size_class(max(1, least)) - 1, size_class(most) + 2):
        low = max(least, math.floor(CLASS_STEP**c) - 1, 1)
        if low <= most and size_class(low) <= c + 1:
            common = -(-percent * (n + low) // (100 + percent))
            found.append((c, max(0, n - common + 1)))
    return found


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        sets = [np.frombuffer(r["set"], np.int64) for r in rows]
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([r["id"] for r in rows], np.int64), sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["id", "n", "shingle"])


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 16):
            for r in rows:
                common, own = np.array(r["common"], np.int64), size_class(r["n"])
                taken = [(c, max(0, min(len(common), length - r["n"] + len(common)))) for c, length in prefix_lengths(r["n"], percent)]
                counts = [n for _, n in taken]
                sides = [np.repeat(np.array([f(own, c) for c, _ in taken], np.int32), counts) for f in (min, max)]
                shown = np.concatenate([common[:n] for n in counts]) if counts else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shown), *map(pa.array, sides), *[pa.array(np.full(len(shown), r[x], np.int64)) for x in ("id", "root")]], ["shingle", "low", "high", "id", "root"])

    return run


def suspects(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members(id, root)`` that can be linked with a member of another root, by their rarest shingles and sizes: ``id``.

    Exact in that no linked member is left out, and linear: shingles are counted, and keys of shingle and two size classes keep
    only their least and greatest root, so that no pairs are formed.  Members of a large group that share most, but not enough,
    show each other only shingles that nobody else has.
    """
    each = sets.mapInArrow(_each_shingle, "id long, n long, shingle long")
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(often, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    shown = ranked.join(members, "id").select("id", "root", "n", F.col("common.shingle").alias("common")).mapInArrow(_prefixes(percent), "shingle long, low int, high int, id long, root long")
    open_keys = shown.groupBy("shingle", "low", "high").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("shingle", "low", "high")
    return shown.join(open_keys, ["shingle", "low", "high"], "left_semi").select("id").distinct()


#: Bytes of shingle sets that one side of a block holds at most, but for a single larger set.
BLOCK_BYTES = 4 << 20


def _across_components(named: DataFrame, sets_for, percent: int, within: list[str] | None = None) -> DataFrame:
    """``named(key, id, root)`` -> links ``(a, b)`` between members of one bucket that lie in different components.

    Only buckets with several components count, and in them the ``suspects``.  Per bucket the members outside its largest component meet that
    component and each other, in blocks of bounded bytes, so that neither a large bucket nor all pairs of a
    component come together; the blocks' tasks give links only, at most one for each join of components.
    """
    sized = lambda named: named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    named = cut(named.join(sized(named).select("key"), "key", "left_semi"), within)
    members = cut(named.select("id", "root").distinct(), within)
    sets = sets_for(members.select(F.col("id").alias("doc_id")))
    named = cut(named.join(suspects(members, sets, percent), "id", "left_semi"), within)
    spread = cut(named.join(sized(named).select("key", "top"), "key").select("key", "id", "root", (F.col("root") != F.col("top")).alias("asks")), within)
    size = F.octet_length("set")
    weighed = spread.join(sets.select("id", size.alias("bytes")), "id")
    blocks = weighed.groupBy("key").agg(*[F.ceil(F.greatest(F.lit(1), F.sum(F.when(F.col("asks") == yes, F.col("bytes")).otherwise(0))) / BLOCK_BYTES).alias(c) for c, yes in (("nq", True), ("nt", False))])
    placed = spread.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("nq")).otherwise(F.col("nt"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_top = F.transform(upto(F.col("nt")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(False).alias("asking")))
    with_asking = F.transform(upto(F.col("nq")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(True).alias("asking")))
    of_top = F.transform(upto(F.col("nq")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asking")))
    tasks = F.when(F.col("asks"), F.concat(with_top, F.when(F.col("nq") > 1, with_asking).otherwise(F.slice(with_asking, 1, 0)))).otherwise(of_top)
    dealt = placed.select("key", "id", "root", F.explode(tasks).alias("task")).join(sets, "id")
    groups = dealt.groupBy("key", "task").agg(F.collect_list(F.struct("id", "root", "set")).alias("members")).where("size(members) > 1").select("members")
    return groups.mapInArrow(_merge(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, percent: int = 75) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row; ``component_id`` is the least id
    that a document reaches over confirmed links, ``kept`` holds for that document.

    1. Documents with one shingle set form a class; its least id stands for it, so copies are never expanded.
    2. Each class has 128 SetSketch registers; 32 bands of 4 registers are bucket keys (a pair at 0.75 shares
       no bucket once in 190,000).  Bucket minima are pre-aggregated, and each member is paired with its
       bucket's least id: as many pairs as members.
    3. Pairs whose joint likelihood estimate is near the threshold are confirmed on the full sets: first each
       class's likeliest pair, then the pairs that still join two components, last, in buckets whose members
       lie in several components, the pairs across those components that sizes and rarest shingles allow.

    Null ids are dropped.  Null or empty texts and texts without words have an empty set and are linked with nothing.
    Repeated rows each get a row; rows that share an id count as one document.  Other columns are not read, so
    their names can't clash.  An empty table gives an empty result.
    """
    threshold, spent = percent / 100, []
    kept = lambda df: cut(df, spent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sketches = kept(docs.mapInArrow(_sketch(words_per_shingle), "doc_id long, n_shingles long, digest binary, regs binary"))
    classes = kept(sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))

    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("regs", k * (2 * WIDTH) + 1, F.lit(2 * WIDTH))))
    banded = classes.select("id", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("members")).where("members > 1")
    # Each bucket's row meets its members in several parts, so that a large bucket is no single task.
    parts = shared.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    buckets = kept(banded.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS).cast("long"))).join(parts, ["key", "part"]).select("key", "id", "low", "members"))

    def estimated(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
        return both.mapInArrow(_likely(threshold), "a long, b long, est double")

    pairs = kept(estimated(buckets.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()))

    def sets_for(ids: DataFrame) -> DataFrame:
        return kept(semi_or_anti(docs, ids, "doc_id", "left_semi").mapInArrow(_sets(words_per_shingle), "id long, set binary"))

    sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long, linked boolean")

    def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b")
    first = kept(confirmed(best, sets))
    roots = components(first.where("linked").select("a", "b"), spent)
    second = kept(confirmed(across(pairs.select("a", "b"), roots).join(first, ["a", "b"], "left_anti"), sets))
    links = first.unionByName(second).where("linked").select("a", "b")
    roots = kept(components(links, spent))

    named = buckets.where("members > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    third = _across_components(named, sets_for, percent, spent)
    roots = components(links.unionByName(third), spent)

    rooted = classes.select("digest", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    joined = sketches.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    out = joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = cut(out.withColumn("kept", F.col("doc_id") == F.col("component_id")))
    discard(docs.sparkSession, spent)
    return out
