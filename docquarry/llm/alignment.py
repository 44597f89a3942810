"""Alignment of two tokenizers' tokens: overlapping tokens are linked, and inverted bitmaps count the documents that hold a pair linked."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, rows_of

#: Documents of one 64-bit word, words of a container at most, and entries from which a container is closed before.
WORD_DOCS, WORDS, MOST_ENTRIES = 64, 64, 2_000_000
#: Chunks and their characters that are remembered.
MOST_CHUNKS, MOST_CHARS = 400_000, 12_000_000
#: Both tokenizers can be run on the parts between spaces that follow a visible character: neither has a token across.
_SPLIT = re.compile(r"(?<=[^\s᠎]) ")

_FIELDS = [("container", pa.int64()), ("kind", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("groups_sha256", pa.string()), ("code", pa.int64()), ("documents", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary()))]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "container long, kind int, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, code long, documents long, links long, planes array<binary>"


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: visible Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, and what their tokens of each chunk of text make: groups, links, and whether they give back its bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        piece = lambda i: self.b.id_to_piece(i)
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_b = len(self.bytes_b)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in parts], np.int64) for parts in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars, self.groups, self.counts, self.fits = 0, [], array("q"), array("b")
        self.codes, self.ends, self.start = array("q"), array("q", [0]), 0

    def numbers_of(self, texts: list[list[str]]) -> list[list[int]]:
        """The places of the texts' chunks in the tables of what is remembered; those that are new are aligned together."""
        known = self.numbers
        new = list(dict.fromkeys(c for chunks in texts for c in chunks if c not in known))
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])
        return [list(map(known.__getitem__, chunks)) for chunks in texts]

    def learn(self, chunks: list[str]) -> None:
        """Aligns chunks, each with a space before it, on one line of bytes."""
        spaced = [f" {c}" for c in chunks]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = [ids if c else [self.space] for c, ids in zip(chunks, self.b.encode(chunks, num_threads=1), strict=True)]
        fits = [self._gives(a, self.bytes_a, t) and self._gives(b, self.bytes_b, t) for a, b, t in zip(ids_a, ids_b, map(str.encode, spaced), strict=True)]
        tokens_a, ends_a, first_a = self._line([a for a, ok in zip(ids_a, fits, strict=True) if ok], self.lengths_a)
        tokens_b, ends_b, first_b = self._line([b for b, ok in zip(ids_b, fits, strict=True) if ok], self.lengths_b)
        # Between two neighbouring ends there is one token of each side: each such stretch is a link, and each overlap is one stretch.
        ends = np.union1d(ends_a, ends_b)
        codes = tokens_a[np.searchsorted(ends_a, ends)] * self.size_b + tokens_b[np.searchsorted(ends_b, ends)] if len(ends) else ends
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        stop_a, stop_b = (np.searchsorted(ends_a, shared) + 1).tolist(), (np.searchsorted(ends_b, shared) + 1).tolist()
        text_a, text_b = list(map(str, tokens_a.tolist())), list(map(str, tokens_b.tolist()))
        groups = [",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in zip([0, *stop_a], stop_a, [0, *stop_b], stop_b, strict=False)]
        closing = ends_a[first_a[1:] - 1]  # where each chunk ends
        stop_link, stop_group = np.searchsorted(ends, closing, "right").tolist(), np.searchsorted(shared, closing, "right").tolist()
        place = link = group = 0
        for chunk, a, b, ok in zip(chunks, ids_a, ids_b, fits, strict=True):
            self.numbers[chunk] = len(self.groups)
            self.chars += len(chunk)
            self.fits.append(ok)
            if ok:
                self.groups.append(";".join(groups[group : stop_group[place]]))
                self.counts.extend((len(a), len(b), stop_group[place] - group, stop_link[place] - link))
                link, group, place = stop_link[place], stop_group[place], place + 1
            else:
                self.groups.append("")
                self.counts.extend((0, 0, 0, 0))
            self.ends.append(self.start + link)
        self.codes.frombytes(codes.tobytes())
        self.start += len(codes)

    @staticmethod
    def _gives(ids: list[int], parts, whole: bytes) -> bool:
        """Whether the tokens' bytes are the chunk's."""
        return b"".join([parts[i] for i in ids]) == whole

    @staticmethod
    def _line(ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of all chunks, where each ends on the line of bytes, and where each chunk's tokens begin."""
        tokens = np.fromiter((i for x in ids for i in x), np.int64)
        return tokens, np.cumsum(lengths[tokens]), np.cumsum([0, *map(len, ids)])


class Container:
    """Bitmaps of the pairs of up to 4,096 documents.  ``planes[p]`` of a pair has the documents that link it so often that bit ``p`` is set."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, int, np.ndarray]] = []
        self.entries = self.words = 0

    def add(self, slots: np.ndarray, codes: np.ndarray, times: np.ndarray) -> None:
        """One more word of documents: rows ``(slot below 64, pair, times)``, each pair once in a document."""
        order = np.argsort(codes, kind="stable")
        codes, bits, times = codes[order], np.uint64(1) << slots[order].astype(np.uint64), times[order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        if len(starts):
            planes = [np.bitwise_or.reduceat(np.where((times >> p) & 1, bits, np.uint64(0)), starts) for p in range(int(times.max()).bit_length())]
            self.parts.append((codes[starts], self.words, np.stack(planes)))
        self.entries += len(starts)
        self.words += 1

    def full(self) -> bool:
        return self.words >= WORDS or self.entries >= MOST_ENTRIES

    def rows(self) -> dict[str, list]:
        """``code, documents, links, planes``: a plane is a word that marks its words that are not 0, and those."""
        if not self.parts:
            return {"code": [], "documents": [], "links": [], "planes": []}
        most = max(len(p) for _, _, p in self.parts)
        codes = np.concatenate([c for c, _, _ in self.parts])
        at = np.concatenate([np.full(len(c), w, np.uint64) for c, w, _ in self.parts])
        planes = np.concatenate([np.pad(p, ((0, most - len(p)), (0, 0))) for _, _, p in self.parts], axis=1)
        order = np.lexsort((at, codes))
        codes, at, planes = codes[order], at[order], planes[:, order]
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        # A pair's documents are the union of its planes.
        documents = np.add.reduceat(np.bitwise_count(np.bitwise_or.reduce(planes, axis=0)).astype(np.int64), starts)
        links = np.add.reduceat(sum(np.bitwise_count(p).astype(np.int64) << i for i, p in enumerate(planes)), starts)
        out: list[list[bytes]] = [[] for _ in starts]
        for words in planes:
            held = words != 0
            heads = np.bitwise_or.reduceat(np.where(held, np.uint64(1) << at, np.uint64(0)), starts)
            kept, ends = words[held].tobytes(), 8 * np.cumsum(np.add.reduceat(held.astype(np.int64), starts))
            raw, begin = heads.tobytes(), 0
            for i, end in enumerate(ends.tolist()):
                out[i].append(raw[8 * i : 8 * i + 8] + kept[begin:end])
                begin = end
        for row in out:
            while row and len(row[-1]) == 8:
                row.pop()
        return {"code": codes[starts].tolist(), "documents": documents.tolist(), "links": links.tolist(), "planes": out}


def _expanded(aligner: Aligner, numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of up to 64 documents given by the numbers of their chunks: slots, pairs and times, each pair once in a document."""
    ends = np.frombuffer(aligner.ends, np.int64)
    own = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers]).astype(np.int64)
    chunks, seen = np.unique(own << 40 | np.fromiter((x for n in numbers for x in n), np.int64, len(own)), return_counts=True)
    slots, chunks = chunks >> 40, chunks & ((1 << 40) - 1)
    sizes = ends[chunks + 1] - ends[chunks]
    at = np.repeat(ends[chunks] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    codes, times = np.frombuffer(aligner.codes, np.int64)[at] if len(at) else at, np.repeat(seen, sizes)
    keys, place = np.unique(np.repeat(slots, sizes) << 48 | codes, return_inverse=True)
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, place, times)
    return keys >> 48, keys & ((1 << 48) - 1), totals


def encoded(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: a row of each document (``kind`` 1) and of each pair of a container (``kind`` 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, container, number = Aligner(path_a, path_b), Container(), TaskContext.get().partitionId() << 32

        def closed() -> Iterator[pa.RecordBatch]:
            rows = container.rows()
            n = len(rows["code"])
            for at in range(0, n, 8192):
                part = {k: v[at : at + 8192] for k, v in rows.items()} | {"container": [number] * min(8192, n - at), "kind": [0] * min(8192, n - at)}
                yield _batch(part)

        for rows in rows_of(batches, WORD_DOCS):
            if len(aligner.groups) > MOST_CHUNKS or aligner.chars > MOST_CHARS:
                aligner.forget()
            out = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256")}
            all_numbers = aligner.numbers_of([_SPLIT.split(r["text"]) if r["text"] else [] for r in rows])
            all_numbers = [x if all(map(aligner.fits.__getitem__, x)) else [] for x in all_numbers]
            for numbers in all_numbers:
                line = ";".join(map(aligner.groups.__getitem__, numbers))
                out["groups"].append(line if groups else None)
                out["groups_sha256"].append(hashlib.sha256(line.encode()).hexdigest() if line else "")
            counts = np.frombuffer(aligner.counts, np.int64).reshape(-1, 4)
            for numbers in all_numbers:
                for k, n in zip(("n_a", "n_b", "n_groups", "n_links"), counts[numbers].sum(axis=0).tolist() if numbers else (0, 0, 0, 0), strict=True):
                    out[k].append(n)
            del counts
            container.add(*_expanded(aligner, all_numbers))
            first = (container.words - 1) * WORD_DOCS
            yield _batch(out | {"container": [number] * len(rows), "kind": [1] * len(rows), "slot": list(range(first, first + len(rows))), "doc_id": [r["doc_id"] for r in rows]})
            if container.full():
                yield from closed()
                container, number = Container(), number + 1
        yield from closed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _DDL)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["container"])
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _FIELDS], schema=_SCHEMA)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``code, a, b, documents, links, best`` of each pair of ``encoded`` rows: containers' counts are added up; ``best`` tells that no pair of ``a`` is in more documents."""
    sums = rows.where("kind = 0").groupBy("code").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    parts = sums.withColumns({"a": F.floor(F.col("code") / size_b).cast("int"), "b": F.pmod("code", F.lit(size_b)).cast("int")})
    # One id of the first vocabulary meets at most the second vocabulary.
    return parts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def _scores(rows: pa.RecordBatch, best: np.ndarray, total: np.ndarray) -> None:
    """Adds what the pairs' documents get to the container's arrays."""
    lists = rows.column("planes")
    per_row = np.diff(lists.offsets.to_numpy())
    blobs = lists.flatten()
    if not len(blobs):
        return
    data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64)
    sizes = np.array([len(x) // 8 for x in blobs.to_pylist()])
    heads = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(per_row)), per_row)
    plane = np.arange(len(blobs)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    bits = lambda words: np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    blob, at = bits(data[heads])
    words = np.delete(data, heads)
    entry, bit = bits(words)
    slots, source = at[entry] * WORD_DOCS + bit, blob[entry]
    times = np.left_shift(1, plane[source])
    np.add.at(total, slots, times * rows.column("documents").to_numpy()[row[source]])
    np.add.at(best, slots, times * rows.column("best").to_numpy(zero_copy_only=False)[row[source]])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document, and with ``groups`` those themselves.

    A space and the text are encoded by a byte-level vocabulary (``path_a``), the text by a piece model that puts the space there itself
    (``path_b``), both without special tokens.  Tokens whose bytes overlap are linked; where tokens of both end, a group ends.  A pair of ids
    counts the documents that hold it linked: ``n_best`` are a document's links whose count is their first id's highest, ``count_sum`` is the
    sum of its links' counts.

    Texts are read once.  Chunks between spaces are aligned once and remembered, as far as the bound goes.  A task turns its documents into
    containers of up to 4,096 (fewer where they have very many pairs) with a compressed bitmap of each pair and bit of its number of links;
    their unions are counted, the counts added up by pair, joined to the containers' pairs, and given back to the documents by their bits.
    All that belongs to one container meets in one task; a frequent pair has a row in each container, which a join may split.

    Null and empty texts, and those whose tokens don't give back the space and the text, have no tokens: zeros and ''.  Rows count one by
    one, repeated ones and null ids too.  Other columns are not read.  An empty table gives an empty result.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    within: list[str] = []
    rows = cut(encoded(docs, path_a, path_b, groups, id_col, text_col), within)
    pairs = cut(pair_counts(rows, size_b).select("code", F.col("documents").alias("count"), "best"), within)
    postings = rows.where("kind = 0").select("container", "kind", "code", "planes").join(pairs, "code").select("container", "kind", "planes", F.col("count").alias("documents"), "best")
    kept = ("doc_id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if groups else []), "groups_sha256")
    both = postings.unionByName(rows.where("kind = 1").select("container", "kind", "slot", *kept), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            containers, kinds = batch.column("container").to_numpy(), batch.column("kind").to_numpy()
            changes = np.flatnonzero((containers[1:] != containers[:-1]) | (kinds[1:] != kinds[:-1])) + 1 if len(containers) else []
            for start, end in zip([0, *changes], [*changes, len(containers)], strict=True):
                part = batch.slice(start, end - start)
                if not part.num_rows:
                    continue
                if containers[start] != now:
                    now, best, total = containers[start], np.zeros(WORDS * WORD_DOCS, np.int64), np.zeros(WORDS * WORD_DOCS, np.int64)
                if kinds[start] == 0:
                    _scores(part, best, total)
                else:
                    slots = part.column("slot").to_numpy()
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(best[slots]), pa.array(total[slots])], [*kept, "n_best", "count_sum"])

    strings = ("groups", "groups_sha256")
    ddl = ", ".join(f"{k} {'string' if k in strings else 'long'}" for k in (*kept, "n_best", "count_sum"))
    out = cut(both.repartition("container").sortWithinPartitions("container", "kind").mapInArrow(run, ddl))
    discard(docs.sparkSession, within)
    return out
