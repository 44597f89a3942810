"""Language identification by a byte-level convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, rows_of

#: Bytes of a window; dimensions of a byte; filter widths and filters of each width.
WINDOW, DIMS, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 12
#: Windows overlap by the widest filter less one, so that every run of bytes is seen whole in one of them.
STEP = WINDOW - max(WIDTHS) + 1
#: Bounds of the training sample: documents, and windows of each, spread over its whole text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 6
#: Epochs and steps of training, at least.
EPOCHS, STEPS = 4, 500


def has_letter(text: str) -> bool:
    """Whether a character is of the Unicode category of letters; signs such as ², ½ or Ⅷ are not."""
    return any(map(str.isalpha, text))


def windows_of(text: str) -> np.ndarray:
    """The lower-cased text's bytes (0 as padding) in fixed-length windows that cover all of it."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    count = max(1, -(-(len(raw) - max(WIDTHS) + 1) // STEP))
    padded = np.zeros((count - 1) * STEP + WINDOW, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


class ByteNet:
    """Byte embedding, filters of several widths, max pooling over a window, softmax over languages."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, wide, n = langs, max(WIDTHS), len(WIDTHS) * FILTERS
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DIMS)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
        self.filters = (rng.normal(0, 0.3, (wide * DIMS, n)).astype(np.float32)) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = max(WIDTHS)
        at = self.embed[windows]
        patches = np.concatenate([at[:, j : WINDOW - wide + 1 + j] for j in range(wide)], axis=2)
        conv = (patches.reshape(-1, wide * DIMS) @ self.filters).reshape(len(windows), WINDOW - wide + 1, -1)
        return patches, conv, np.maximum(conv.max(axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self._pooled(windows)[2] @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, batch: int = 128, rate: float = 0.004, seed: int = 11) -> ByteNet:
        """Adam on the cross entropy; only the pooled position of each filter has a gradient."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        steps, wide = 0, max(WIDTHS)
        for _ in range(max(EPOCHS, -(-STEPS * batch // len(windows)))):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, y = windows[pick], labels[pick]
                patches, conv, pooled = self._pooled(x)
                logits = pooled @ self.out + self.out_bias
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (pooled > 0)
                where = conv.argmax(axis=1)
                best = patches[np.arange(len(x))[:, None], where]  # window x filter x patch
                g_patch = back[:, :, None] * self.filters.T[None]
                g_embed = np.zeros_like(self.embed)
                spots = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(wide)]
                np.add.at(g_embed, spots.ravel(), g_patch.reshape(-1, DIMS))
                g_embed[0] = 0
                grads = {"embed": g_embed, "filters": np.einsum("bfp,bf->pf", best, back) * self.mask, "bias": back.sum(0), "out": pooled.T @ p, "out_bias": p.sum(0)}
                steps += 1
                for k in names:
                    m, v = state[k]
                    m += 0.1 * (grads[k] - m)
                    v += 0.001 * (grads[k] ** 2 - v)
                    getattr(self, k)[...] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        return self

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and probability of each text: the mean of its windows' log-probabilities, all windows of all texts in batches."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if has_letter(t)]
        sums = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                logs = self.log_probabilities(np.concatenate([w for _, w in held]))
                at = 0
                for i, w in held:
                    sums[i] += logs[at : at + len(w)].sum(axis=0)
                    counts[i] += len(w)
                    at += len(w)
                held.clear()

        size = 0
        for i in asked:
            windows = windows_of(texts[i])
            for at in range(0, len(windows), 256):
                held.append((i, windows[at : at + 256]))
                size += len(held[-1][1])
                if size >= 256:
                    flush()
                    size = 0
        flush()
        for i in asked:
            mean = sums[i] / counts[i]
            p = np.exp(mean - mean.max())
            p /= p.sum()
            out[i] = (self.langs[int(p.argmax())], float(p.max()))
        return out


def train(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """Fits the network on at most ``SAMPLE_DOCS`` labelled rows among those that ``learn`` admits; None without any.

    The sample are the rows with the least hashes of id, text and language, repeated ones once; of each, at most ``SAMPLE_WINDOWS`` windows,
    spread evenly.  A language that no sampled row has is not learned and never predicted.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    usable = rows.where("learn and lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches):
            part = [r for r in part if has_letter(r["text"])]
            found = [(w := windows_of(r["text"]))[np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))].tobytes() for r in part]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in part], pa.int64()), pa.array([r["lang"] for r in part], pa.string()), pa.array(found, pa.binary())], ["doc_id", "lang", "windows"])

    sample = least_hashed(usable, SAMPLE_DOCS).mapInArrow(cut_windows, "doc_id long, lang string, windows binary").distinct()
    sample = sample.orderBy(F.xxhash64("doc_id", "lang", "windows")).limit(SAMPLE_DOCS).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["windows"])))
    langs = sorted({r["lang"] for r in sample})
    windows = np.concatenate([np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in sample])
    labels = np.concatenate([np.full(len(r["windows"]) // WINDOW, langs.index(r["lang"])) for r in sample])
    return ByteNet(langs).fit(windows, labels)


def predict_language(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text; ``und`` with score 0 where text is null or has no letter, or without a network.

    Windows of many texts share a batch; a long text adds up over as many batches as it needs.  One row per input row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 128):
            texts = [r["text"] or "" for r in rows]
            found = net.predict(texts) if net else [("und", 0.0)] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteNet | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more; one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                found = net.predict([t or "" for t in part.column(at).to_pylist()]) if net else [("und", 0.0)] * part.num_rows
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found]))

    return docs.mapInArrow(run, docs.schema)


def remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from rows with crc32(id) mod 3 other than 1 and predicts every row: ``doc_id, held_out, lang_pred, score``.

    Null texts, texts without a letter (``und``), null languages (not learned from) and null ids (not learned from, not held
    out) are defined; equal texts get equal predictions; other columns are not read; an empty table gives an empty result.
    """
    net = train(docs, remainder(id_col, 3) != 1, id_col, text_col, lang_col)
    found = predict_language(docs, net, id_col, text_col)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
