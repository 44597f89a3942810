"""Removal of repeated word windows over prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, discard, may_match, ngram_hashes, rows_of

#: Words of the shortest prefix.  It stands at the least prefix hash of its window, so that all copies of a window choose the same.
PREFIX = 8
#: Bytes of text that one subtree is built from; the prefixes of a larger group are lengthened by so many words at a time.
GROUP_BYTES, LENGTHEN = 4 << 20, 9


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a prefix position: ``(position, first window, last window, prefix hash)``."""
    grams = ngram_hashes(hashes, PREFIX)
    if len(hashes) < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    span = window - PREFIX + 1
    starts = len(hashes) - window + 1
    at = np.empty(starts, np.int64)
    for lo in range(0, starts, 65_536):
        part = np.lib.stride_tricks.sliding_window_view(grams[lo : lo + 65_536 + span - 1], span)[: starts - lo]
        at[lo : lo + len(part)] = part.argmin(axis=1) + np.arange(lo, lo + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    return at[first], first, last, grams[at[first]]


def _scan(window: int):
    """Word count and digest of each text, and its runs of windows as two arrays (first window, prefix hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in rows_of(batches, 64):
            out = []
            for r in rows:
                words = _words(r["text"])
                _, first, _, grams = anchored(cache.of(words), window)
                out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), first.astype(np.int32), grams.view(np.int64)))
            offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in out])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in out]))) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "row")] + [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])] + lists,
                ["doc_id", "row", "n_words", "digest", "firsts", "grams"],
            )

    return run


_RUN = ["doc_id", "row", "first", "gram", "key", "words"]


def _suffixes(window: int):
    """The words of each run that shares its prefix with another run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, held = WordHashes(), [], 0
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], _RUN)
        for rows in rows_of(batches, 64):
            for r in rows:
                words = _words(r["text"])
                position, first, last, grams = anchored(cache.of(words), window)
                for k in np.flatnonzero(np.isin(first, np.array(r["firsts"]))):
                    lo = int(first[k])
                    content = b" ".join(words[lo : int(last[k]) + window])
                    key = hashlib.blake2b(content, digest_size=16, salt=int(position[k] - lo).to_bytes(4, "little")).digest()
                    out.append((r["doc_id"], r["row"], lo, int(grams[k].view(np.int64)), key, content))
                    held += len(content)
                    if held > 1 << 20:
                        yield pack()
                        out, held = [], 0
        yield pack()

    return run


class Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def suffix_tree(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of runs of words, cut at depth ``window``, as a tree: ``(owner, order, common)``.

    ``owner`` is each suffix's run, ``order`` the suffixes' numbers in sorted order, ``common`` the words that each sorted suffix shares with
    the one before: the depth of the internal node where the two leaves part.  Words are compared as such.
    """
    numbers = Numbers()
    runs = [np.lib.stride_tricks.sliding_window_view(np.fromiter(map(numbers.__getitem__, c.split(b" ")), np.int32), window) for c in contents]
    leaves = np.ascontiguousarray(np.concatenate(runs))
    order = np.argsort(leaves.view(np.dtype((np.void, 4 * window))).ravel(), kind="stable")
    leaves = leaves[order]
    parts = leaves[1:] != leaves[:-1]
    common = np.where(parts.any(axis=1), parts.argmax(axis=1), window)
    return np.repeat(np.arange(len(runs)), [len(r) for r in runs]), order, common


def repeated_windows(contents: list[bytes], copies: list[int], window: int) -> list[np.ndarray]:
    """For each run of words, which of its windows occur anywhere else among the runs: the leaves below an internal node of depth ``window``.

    A run that has copies repeats whole.  Windows that follow each other are one maximal repeat.
    """
    owner, order, common = suffix_tree(contents, window)
    flags = np.array(copies)[owner] > 1
    deep = common >= window
    flags[order[1:][deep]] = True
    flags[order[:-1][deep]] = True
    return np.split(flags, np.cumsum(np.bincount(owner, minlength=len(contents)))[:-1])


def _subtrees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, held = [], 0
            for at in range(batch.num_rows):
                group = batch.column(0)[at].as_py()
                groups += group
                held += sum(len(x["words"]) for x in group)
                if held > 1 << 19 or at == batch.num_rows - 1:
                    flags = repeated_windows([x["words"] for x in groups], [x["copies"] for x in groups], window)
                    found = [(x["key"], np.flatnonzero(f).astype(np.int32).tolist()) for x, f in zip(groups, flags, strict=True) if f.any()]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([f for _, f in found], pa.list_(pa.int32()))], ["key", "windows"])
                    groups, held = [], 0

    return run


def _windows(window: int):
    """Each window of a run with its digest and the length of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for rows in rows_of(batches, 64):
            for r in rows:
                words = r["words"].split(b" ")
                position, first, last, _ = anchored(cache.of(words), window)
                found = [(r["key"], s, b" ".join(words[s : s + window]), int(p) - s + PREFIX, r["copies"]) for p, lo, hi in zip(position, first, last, strict=True) for s in range(int(lo), int(hi) + 1)]
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64()))]
                digests = pa.array([hashlib.blake2b(x[2], digest_size=16).digest() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, digests], ["run", "at", "words", "prefix", "copies", "key"])

    return run


def _by_size(units: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """``units(group, key, words, copies)`` of groups that fit one subtree, as lists, and the groups that don't."""
    sizes = units.groupBy("group").agg(F.sum(F.octet_length("words")).alias("bytes"), F.sum("copies").alias("uses")).where("uses > 1")
    fits = F.col("bytes") <= GROUP_BYTES
    fitting = units.join(sizes.where(F.lit(True) if last else fits).select("group"), "group", "left_semi")
    return fitting.groupBy("group").agg(F.collect_list(F.struct("key", "words", "copies")).alias("units")).select("units"), None if last else sizes.where(~fits).select("group")


def _trees(contents: DataFrame, window: int, within: list[str]) -> DataFrame:
    """``contents(key, gram, words, copies)``: which windows of each run repeat, ``key, windows``.

    Groups of one prefix that fit become subtrees.  Of larger groups, the windows stand alone: distinct ones with counts, grouped by their own
    prefix, which is lengthened until the groups fit; at full length a group is one window.
    """
    result = "key binary, windows array<int>"
    fitting, large = _by_size(contents.withColumnRenamed("gram", "group"), False)
    marks = cut(fitting.mapInArrow(_subtrees(window), result), within)
    large = cut(large, within)
    rest = contents.join(large.withColumnRenamed("group", "gram"), "gram", "left_semi").select("key", "words", "copies")
    places = cut(rest.mapInArrow(_windows(window), "run binary, at int, words binary, prefix int, copies long, key binary"), within)
    left = places.groupBy("key").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"), F.first("prefix").alias("prefix"))
    for extra in range(0, window - PREFIX + LENGTHEN, LENGTHEN):
        left = cut(left, within)
        if left.isEmpty():
            break
        length = F.least(F.lit(window), F.col("prefix") + extra)
        units = left.withColumn("length", length).withColumn("group", F.xxhash64(F.expr("substring_index(cast(words as string), ' ', length)"), "prefix"))
        fitting, large = _by_size(units, extra >= window - PREFIX)
        deep = fitting.mapInArrow(_subtrees(window), result).select("key")
        marks = marks.unionByName(cut(places.join(deep, "key", "left_semi").groupBy("run").agg(F.collect_list("at").alias("windows")).select(F.col("run").alias("key"), "windows"), within))
        if large is None:
            break
        left = units.join(cut(large, within), "group", "left_semi").select("key", "copies", "words", "prefix")
    return marks


def _without(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 64):
            out = []
            for r in rows:
                words = _words(r["text"])
                steps = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(r["starts"], np.int64))
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + window, -1)
                covered = np.cumsum(steps[:-1]) > 0
                kept = b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)
                out.append((int(covered.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "row")] + [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out])],
                ["doc_id", "row", "n_removed", "kept_text", "kept_digest"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, texts: bool = True) -> DataFrame:
    """Removes each word that is covered by a ``window`` of words whose sequence starts anywhere else too.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept_text``: null for a row that keeps
    all its words, else the kept words joined by one space.  One row per input row.

    Suffixes are grouped by a prefix that ends at the least 8-word hash of their window, so its length varies from
    8 words to the window.  A window with a repeat has its prefix twice, so prefixes that occur once are left out
    first, by pre-aggregated counts of hashes alone.  The remaining runs of suffixes are reduced to distinct ones with
    counts (a passage that a third of all rows share is one run) and meet by prefix in groups of bounded bytes.  Each group becomes
    a subtree, whose internal nodes of the window's depth give the repeats; a group beyond the bound has its prefixes
    lengthened until its parts fit.

    Null ids are dropped.  A null or empty text has no words and nothing is removed; a text shorter than the window
    stays.  Repeated rows repeat each other's windows.  Other columns are not read.  An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").withColumn("row", F.xxhash64("text"))
    kept_tables: list[str] = []
    spent: list[str] = []
    scanned = cut(docs.mapInArrow(_scan(window), "doc_id long, row long, n_words long, digest string, firsts array<int>, grams array<long>"), kept_tables)
    runs = scanned.select("doc_id", "row", F.inline(F.arrays_zip("firsts", "grams")).alias("first", "gram"))
    # Written, so that the join has an exchange on both sides and a hot prefix can be split.
    twice = cut(scanned.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), spent)
    shared = cut(runs.join(twice, "gram", "left_semi").groupBy("doc_id", "row").agg(F.collect_list("first").alias("firsts")), spent)
    touched = cut(may_match(docs, shared, "doc_id").join(shared, ["doc_id", "row"]), spent)

    suffixes = cut(touched.mapInArrow(_suffixes(window), "doc_id long, row long, first int, gram long, key binary, words binary"), spent)
    contents = cut(suffixes.groupBy("key").agg(F.count("*").alias("copies"), F.first("gram").alias("gram"), F.first("words").alias("words")), spent)
    marks = suffixes.select("doc_id", "row", "first", "key").join(_trees(contents, window, spent), "key")
    starts = marks.select("doc_id", "row", F.transform("windows", lambda w: w + F.col("first")).alias("s")).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("s")).alias("starts"))
    less = touched.select("doc_id", "row", "text").join(starts, ["doc_id", "row"])
    less = less.mapInArrow(_without(window), "doc_id long, row long, n_removed long, kept_text string, kept_digest string")
    less = cut(less.groupBy("doc_id", "row").agg(*[F.first(c).alias(c) for c in ("n_removed", *(["kept_text"] if texts else []), "kept_digest")]), kept_tables)
    discard(docs.sparkSession, spent)
    out = scanned.select("doc_id", "row", "n_words", "digest").join(less, ["doc_id", "row"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_digest", "digest").alias("kept_sha256"), *(["kept_text"] if texts else []))
