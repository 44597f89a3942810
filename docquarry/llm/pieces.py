"""Piece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

SPACE = "▁"
#: What a character without a piece loses against the worst piece.
PENALTY = 10.0
_CHUNK = re.compile(r" +[^ ]*|[^ ]+")


class PieceModel:
    """Pieces, scores and byte pieces of a sentencepiece model file, with an automaton over the pieces."""

    def __init__(self, path: str, remembered: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.names)) if model.is_control(i) or model.is_unknown(i)}
        self.scores = {p: (model.get_score(i), i) for i, p in enumerate(self.names) if i not in self.silent and i not in self.byte_of}
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.fallback = min(s for s, _ in self.scores.values()) - PENALTY
        # No piece goes on past a word: then words can be encoded one by one and remembered.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.known: dict[str, array] = {}
        self.remembered = remembered

    def viterbi(self, text: str) -> array:
        """Best-scored segmentation of a text whose spaces are written as pieces write them; ties: the longest last piece.

        The automaton reports, at each position, all pieces that end there (its output links, longest first); each
        relaxes the best score of that position.  A character that is no piece itself costs ``fallback`` and becomes bytes.
        """
        n, scores, fallback = len(text), self.scores, self.fallback
        best = [0.0] + [None] * n
        came = [0] * (n + 1)
        done = 0
        for end, (length, score, i) in self.automaton.iter(text):
            stop = end + 1
            while done < end:
                if text[done] not in scores and (best[done + 1] is None or best[done] + fallback > best[done + 1]):
                    best[done + 1], came[done + 1] = best[done] + fallback, -1
                done += 1
            got = best[stop - length] + score
            if best[stop] is None or got > best[stop]:
                best[stop], came[stop] = got, i
        while done < n:
            if text[done] not in scores and (best[done + 1] is None or best[done] + fallback > best[done + 1]):
                best[done + 1], came[done + 1] = best[done] + fallback, -1
            done += 1
        ids, at = array("i"), n
        while at:
            if came[at] < 0:
                at -= 1
                ids.extend(self.bytes[b] for b in reversed(text[at].encode("utf-8", "surrogatepass")))
            else:
                ids.append(came[at])
                at -= len(self.names[came[at]])
        ids.reverse()
        return ids

    def _chunk(self, chunk: str) -> array:
        body = chunk.lstrip(" ")
        lead = SPACE * (len(chunk) - len(body))
        first, *rest = body.split(SPACE)
        ids = self.viterbi(lead + first)
        for part in rest:  # a literal mark is spelt in bytes, so that it is not read back as a space
            ids.extend(self.bytes[b] for b in SPACE.encode())
            ids.extend(self.viterbi(part))
        return ids

    def encode(self, text: str) -> array:
        """Ids of a text; a space is put before it, as the model expects.  An empty text has none."""
        ids = array("i")
        if not text:
            return ids
        for chunk in _CHUNK.findall(" " + text) if self.by_word else [" " + text]:
            found = self.known.get(chunk)
            if found is None:
                found = self._chunk(chunk)
                if len(chunk) < 64:
                    if len(self.known) >= self.remembered:
                        self.known.clear()
                    self.known[chunk] = found
            ids.extend(found)
        return ids

    def decode(self, ids) -> str:
        """The text of ids: exact for what ``encode`` gives; control pieces say nothing, bad bytes become U+FFFD."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.silent:
                out += self.names[i].replace(SPACE, " ").encode()
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _lists(found: list[array]) -> pa.ListArray:
    """Ids of several texts as one column, without Python numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in found])))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for rows in rows_of(batches, 64):
            ids = _lists([model.encode(r["text"] or "") for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), ids], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for rows in rows_of(batches, 64):
            texts = [model.decode(r["ids"] or ()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(texts)], ["doc_id", "text"])

    return run


def _round_trip(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for rows in rows_of(batches, 64):
            out = []
            for r in rows:
                text = r["text"] or ""
                ids = model.encode(text)
                back = model.decode(ids)
                out.append((len(ids), zlib.crc32(np.frombuffer(ids, np.int32).astype("<i4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text, ids if with_ids else None))
            kinds = (("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()))
            columns, names = [pa.array([r["doc_id"] for r in rows], pa.int64()), *[pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)]], ["doc_id", *[c for c, _ in kinds]]
            if with_ids:
                columns, names = [*columns, _lists([x[4] for x in out])], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the best-scored segmentation of each whole text into the model's pieces.

    A null or empty text has no ids.  Each row stands alone; repeated rows are equal, other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; null ids give an empty text."""
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")


def piece_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip`` and, if asked, ``ids``: digests of each text's ids and of what they decode to.

    Both ways run in one pass.  Nulls, empty texts and repeated rows are as in ``encode_pieces``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_round_trip(path, with_ids), schema)
