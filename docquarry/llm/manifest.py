"""Merkle manifest of documents: parents keep the hash state before each child, and a changed leaf is folded from there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, numbered, rows_of
from .sha import START, bytes_of, closed, compressed, hex_blocks, hex_of, words_of

#: Children of a node, and levels that one step of a task joins: a block of 512 nodes becomes one.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS

#: How a node goes up to the root, level by level: its place among its parent's children, the parent's state before it, and all those children.
PATH = "array<struct<slot:int,state:binary,nodes:binary>>"


def leaf_hash(fields: list[F.Column]) -> F.Column:
    """SHA-256 (hex) of the fields: ``-`` for null, else the bytes of its text, a colon and the text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class Levels:
    """The levels above sorted nodes of blocks: parents, slots, states before each child, digests.

    ``group`` numbers each node's block, ``place`` is its place in the tree's line, and ``levels`` how many levels its block still has, at
    most ``LEVELS``; a block without levels is a single node.  All blocks climb together.
    """

    def __init__(self, words: np.ndarray, group: np.ndarray, place: np.ndarray, levels: np.ndarray):
        self.nodes, self.steps = [words], []
        for level in range(LEVELS):
            n = len(words)
            climbs = levels > level
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ~climbs[1:] | (place[1:] // FAN != place[:-1] // FAN)]) if n else np.zeros(0, int)
            counts = np.diff(np.r_[starts, n])
            parent = np.repeat(np.arange(len(starts)), counts)
            slot = np.arange(n) - starts[parent]
            states, before, blocks = np.tile(START, (len(starts), 1)), np.zeros((n, 8), np.uint32), hex_blocks(words)
            for j in range(int(counts.max(initial=0))):
                live = np.flatnonzero(counts > j)
                at = starts[live] + j
                before[at] = states[live]
                states[live] = compressed(states[live], blocks[at])
            up = climbs[starts]
            self.steps.append((parent, slot, counts, before, blocks, climbs))
            words = np.where(up[:, None], closed(states, counts), words[starts])
            group, place, levels = group[starts], place[starts] // FAN, levels[starts]
            self.nodes.append(words)

    def folded(self, words: np.ndarray) -> np.ndarray:
        """The blocks' digests with one leaf replaced, for each leaf by its row of ``words``."""
        node = np.arange(len(words))
        for parent, slot, counts, before, blocks, climbs in self.steps:
            words = np.where(climbs[node][:, None], _resumed(before[node], words, counts[parent[node]], slot[node], lambda t, who, b=blocks, n=node: b[n[who] + t]), words)
            node = parent[node]
        return words

    def paths(self) -> list[list[dict]]:
        """Each leaf's way to its block's digest."""
        texts = [bytes_of(w) for w in self.nodes]
        raw = [(*step, bytes_of(step[3]), np.cumsum(np.r_[0, step[2]])) for step in self.steps]
        out = []
        for node in range(len(texts[0])):
            way = []
            for (parent, slot, _, _, _, climbs, states, ends), nodes in zip(raw, texts, strict=False):
                p = parent[node]
                if climbs[node]:
                    way.append({"slot": int(slot[node]), "state": states[node], "nodes": b"".join(nodes[ends[p] : ends[p + 1]])})
                node = p
            out.append(way)
        return out

    def siblings(self, above: list[bytes]) -> list[bytes]:
        """The hex digits of each leaf's siblings, level by level, followed by its block's ``above``."""
        for (parent, slot, counts, _, _, climbs), words in zip(self.steps[::-1], self.nodes[-2::-1], strict=True):
            text, ends = hex_of(words).tobytes(), 64 * np.cumsum(np.r_[0, counts])
            own = []
            for p, s, c in zip(parent.tolist(), (64 * slot).tolist(), climbs.tolist(), strict=True):
                run = text[ends[p] : ends[p + 1]]
                own.append(run[:s] + run[s + 64 :] + above[p] if c else above[p])
            above = own
        return above


def _resumed(states: np.ndarray, words: np.ndarray, counts: np.ndarray, slot: np.ndarray, right) -> np.ndarray:
    """The parents' digests from the states before a child, its replacement, and ``right(t, who)``: the blocks of the siblings ``t`` further on."""
    states = compressed(states, hex_blocks(words))
    for t in range(1, FAN):
        who = np.flatnonzero(slot + t < counts)
        if len(who):
            states[who] = compressed(states[who], right(t, who))
    return closed(states, counts)


def folded_along(words: np.ndarray, group: np.ndarray, ways: list[list[dict]]) -> np.ndarray:
    """Digests led on by the ways of their groups to the root."""
    for level in range(max(map(len, ways), default=0)):
        has = np.array([len(w) > level for w in ways])
        steps = [w[level] if len(w) > level else {"slot": 0, "state": bytes(32), "nodes": b""} for w in ways]
        slot, states = np.array([s["slot"] for s in steps]), words_of([s["state"] for s in steps])
        counts = np.array([len(s["nodes"]) // 32 for s in steps])
        blocks = hex_blocks(words_of([s["nodes"] for s in steps]))
        first = np.cumsum(np.r_[0, counts])[:-1]
        who = np.flatnonzero(has[group])
        g = group[who]
        words[who] = _resumed(states[g], words[who], counts[g], slot[g], lambda t, x, g=g: blocks[first[g[x]] + slot[g[x]] + t])
    return words


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[list[dict]]]:
    """Whole blocks of sorted rows, some thousand rows at a time: only the block at hand waits for the next rows."""
    held: list[dict] = []
    for rows in rows_of(batches, 4096):
        rows = held + rows
        starts = [0, *(i for i in range(1, len(rows)) if any(rows[i][k] != rows[i - 1][k] for k in keys)), len(rows)]
        if len(starts) > 2:
            yield [rows[a:b] for a, b in pairwise(starts[:-1])]
        held = rows[starts[-2] :]
    if held:
        yield [held]


def _levels(blocks: list[list[dict]]) -> Levels:
    sizes = [len(b) for b in blocks]
    group = np.repeat(np.arange(len(blocks)), sizes)
    column = lambda name: [r[name] for b in blocks for r in b]
    return Levels(words_of(column("digest")), group, np.array(column("place"), np.int64), np.minimum(np.array(column("levels")), LEVELS))


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _joined(nodes: DataFrame) -> DataFrame:
    """The digests of the blocks of ``nodes(tree, place, levels, digest)``: the nodes of the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _blocks(batches, ("tree", "block")):
            tops = bytes_of(_levels(blocks).nodes[-1])
            rows = [{"tree": b[0]["tree"], "place": b[0]["block"], "levels": max(0, b[0]["levels"] - LEVELS), "digest": t} for b, t in zip(blocks, tops, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("levels", pa.int32()), ("digest", pa.binary())]))

    return _dealt(nodes.select("tree", "place", "levels", "digest")).mapInArrow(run, "tree long, place long, levels int, digest binary")


def _led(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, place, path`` of the nodes, from the paths of their blocks (``above(tree, place, path)``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way = pa.list_(pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("nodes", pa.binary())]))
        for blocks in _blocks(batches, ("tree", "block")):
            heads, blocks = [b[0]["path"] for b in blocks], [b[1:] for b in blocks]
            paths, rows = iter(_levels(blocks).paths()), []
            for head, block in zip(heads, blocks, strict=True):
                rows += [{"tree": r["tree"], "place": r["place"], "path": next(paths) + head} for r in block]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("path", way)]))

    return _headed(nodes.select("tree", "place", "levels", "digest"), above).mapInArrow(run, f"tree long, place long, path {PATH}")


def _headed(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks of nodes, each headed by the row that has its path."""
    heads = above.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path")
    rows = nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).unionByName(heads, allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _levels_of(count: F.Column) -> F.Column:
    """Levels until ``count`` nodes are one."""
    return sum(((count > FAN**k).cast("int") for k in range(21)), F.lit(0))


def _tree(nodes: DataFrame, within: list[str]) -> list[DataFrame]:
    """The nodes of each step up to the roots, one for each ``tree``."""
    steps = [nodes]
    for _ in range(-(-(nodes.agg(F.max("levels")).head()[0] or 0) // LEVELS)):
        steps.append(cut(_joined(steps[-1]), within))
    return steps


def _down(steps: list[DataFrame], roots: DataFrame, within: list[str]) -> DataFrame:
    """The paths of the nodes of the second step (``roots`` if there is none), from ``roots(tree, place, path)``."""
    for nodes in steps[:0:-1][1:]:
        roots = cut(_led(nodes, roots), within)
    return roots


def manifest(docs: DataFrame, tampered: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each document, in a tree of 8 children for each group.

    A leaf is the hash of the document's ``fields``; each group's leaves ascend by id, and runs of eight become one node, level by level;
    the groups' roots, in order, likewise become the root.  ``proof_sha256`` is the hash of the siblings on a leaf's way to the root.
    ``folded_root`` is the root that follows from the leaf as it is now (with its ASCII letters lower-cased where ``tampered``) and the
    siblings: folding goes on from the state that the parent kept before the leaf's slot, with the new digest and the siblings to its right.

    A step joins three levels: blocks of 512 nodes, which are dealt evenly whatever the size of a group, become one node each, until one is
    left.  Then the ways from the blocks to the root go down again, and each leaf gets its way from its block's.

    A null id comes first in its group; the null group is the first.  Repeated ids are ordered by their leaves; equal rows are interchangeable.
    Null and empty texts differ.  Other columns are not read.  A lone leaf is its group's root, a lone group's root the root, and their proof
    is the hash of nothing.  An empty table gives an empty result.
    """
    within: list[str] = []
    changed = F.lit(False) if tampered is None else tampered
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = F.unhex(leaf_hash([F.col(f) for f in fields]))
    other = F.when(changed, F.unhex(leaf_hash([lower if f == text_col else F.col(f) for f in fields])))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), group.alias("group"), leaf.alias("digest"), other.alias("other"))
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()), within)
    line = numbered(rows, [F.asc("group"), F.asc("doc_id"), F.asc("digest"), F.asc("at")], within)

    groups = cut(line.groupBy("group").agg(F.min("_n").alias("first"), F.count("*").alias("rows")), within)
    trees = cut(numbered(groups, [F.asc("group")], within).withColumnRenamed("_n", "tree").withColumnRenamed("group", "_group"), within)
    leaves = line.join(trees, F.col("group") == F.col("_group")).select("tree", (F.col("_n") - F.col("first")).alias("place"), _levels_of(F.col("rows")).alias("levels"), "doc_id", "digest", "other")
    leaves = cut(leaves, within)

    steps = _tree(leaves, within)
    # The groups' roots are the nodes of one more tree.
    count = F.lit(trees.count())
    tops = cut(steps[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), _levels_of(count).alias("levels"), "digest"), within)
    top_steps = _tree(tops, within)
    none = F.array().cast(PATH)
    way = _down(top_steps, top_steps[-1].select("tree", "place", none.alias("path")), within)
    way = cut(_led(tops, way), within) if len(top_steps) > 1 else way
    root = top_steps[-1].select(F.col("digest").alias("root"))
    roots = way.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    above = _down(steps, roots, within) if len(steps) > 1 else roots
    subroots = steps[-1].select("tree", F.col("digest").alias("subroot"))
    heads = above.join(subroots, "tree").crossJoin(F.broadcast(root))  # the root is one row
    out = cut(_proved(leaves, heads))
    discard(docs.sparkSession, within)
    return out


def _proved(leaves: DataFrame, heads: DataFrame) -> DataFrame:
    """The result for each leaf, from its block's path."""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _blocks(batches, ("tree", "block")):
            heads, blocks = [b[0] for b in blocks], [b[1:] for b in blocks]
            levels, group = _levels(blocks), np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
            rows = [r for b in blocks for r in b]
            ways = [h["path"] for h in heads]
            now = levels.folded(words_of([r["digest"] if r["other"] is None else r["other"] for r in rows]))
            ends = bytes_of(folded_along(now, group, ways))
            around = lambda s: (s["nodes"][: 32 * s["slot"]] + s["nodes"][32 * s["slot"] + 32 :]).hex().encode()
            proofs = levels.siblings([b"".join(map(around, way)) for way in ways])
            roots, subroots = [h["root"] for h in heads], [h["subroot"].hex() for h in heads]
            columns = (
                [r["doc_id"] for r in rows], [r["digest"].hex() for r in rows], [subroots[g] for g in group], [roots[g].hex() for g in group],
                [hashlib.sha256(p).hexdigest() for p in proofs], [e.hex() for e in ends], [e == roots[g] for e, g in zip(ends, group, strict=True)],
            )
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = leaves.select("tree", "place", "levels", "doc_id", "digest", "other")
    extra = heads.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), "path", "subroot", "root")
    both = rows.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")).unionByName(extra, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def third_by_checksum(id_col: str = "doc_id") -> F.Column:
    """Whether 3 divides the unsigned CRC-32 of the decimal id; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
