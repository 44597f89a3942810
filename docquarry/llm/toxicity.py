"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, rows_of
from .langid import remainder

#: Hashed terms (a power of two) and factors of each.
TERMS, FACTORS = 1 << 17, 4
#: Bound of the training sample, in labelled documents; a term is learned from so many of them at least, if its chi-square with the label is so high.
SAMPLE_DOCS, LEAST_DOCS, LEAST_CHI = 12_000, 3, 20.0
#: Terms that say nothing alone count if they do beside one of so many associated terms: by this chi-square among the documents that have it,
#: with so many of either label at least and in so many documents.
PARTNERS, PARTNER_CHI, PARTNER_DOCS = 256, 50.0, 20
#: Steps of training, at least.
STEPS = 1500
#: Word beginnings that are terms beside the word itself, so that inflected forms share a term.
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Hashed terms of a word, remembered up to a limit."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        names = [f"w {word}"] + [f"b {word[:n]}" for n in BEGINNINGS if len(word) >= n]
        value = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % TERMS for x in names)
        return value


def terms_of(text: str | None, known: Terms) -> np.ndarray:
    """Distinct hashed terms of a whole text, ascending."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.array([t for w in words for t in known[w]], np.int32))


def _chi_square(docs: list[np.ndarray], labels: np.ndarray, least: int = LEAST_DOCS) -> np.ndarray:
    """Each term's chi-square with the label; 0 for a term that too few documents have."""
    n, marked = len(docs), labels.sum()
    all_, with_ = (np.bincount(np.concatenate(part) if part else np.empty(0, np.int32), minlength=TERMS).astype(float) for part in (docs, [d for d, y in zip(docs, labels, strict=True) if y > 0]))
    expected = all_ * marked / max(n, 1)
    spread = expected * (1 - all_ / max(n, 1)) * (1 - marked / max(n, 1))
    return np.where((all_ >= least) & (spread > 1e-9), (with_ - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)


def _associated(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms with a chi-square that chance rarely gives, alone or in the company of a term that has one."""
    alone = _chi_square(docs, labels)
    useful = alone >= LEAST_CHI
    having: dict[int, list[int]] = {}
    partners = {int(t) for t in np.argsort(-alone, kind="stable")[:PARTNERS] if useful[t]}
    for i, d in enumerate(docs):
        for t in partners.intersection(d.tolist()):
            having.setdefault(t, []).append(i)
    for _, places in sorted(having.items()):
        if PARTNER_DOCS <= labels[places].sum() <= len(places) - PARTNER_DOCS:
            useful |= _chi_square([docs[i] for i in places], labels[places], PARTNER_DOCS) >= PARTNER_CHI
    return useful


class FactorizationMachine:
    """Bias, a weight and ``FACTORS`` factors per term: linear sum plus all pairwise interactions, through a logistic link."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(TERMS, np.float32)
        self.factors = rng.normal(0, 0.02, (TERMS, FACTORS)).astype(np.float32)

    def raw(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the link, and factor sums, of documents whose terms follow each other from ``starts``."""
        ends = np.append(starts[1:], len(terms))
        total = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])[np.stack([starts, ends])], axis=0)[0]
        v = self.factors[terms]
        sums = total(v)
        return self.bias + total(self.weights[terms]) + 0.5 * ((sums**2).sum(1) - total((v**2).sum(1))), sums

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, batch: int = 64, rate: float = 0.1, shrink: float = 1e-3, seed: int = 3) -> FactorizationMachine:
        """AdaGrad on the logistic loss with soft thresholds on the weights, over terms that tell something about the label."""
        rng = np.random.default_rng(seed)
        useful = _associated(docs, labels)
        docs = [d[useful[d]] for d in docs]
        self.factors[~useful] = 0
        epochs = max(4, -(-STEPS * batch // len(docs)))
        base = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(base / (1 - base)))
        g_w, g_v, g_b = np.full(TERMS, 1e-2), np.full((TERMS, FACTORS), 1e-2), 1.0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(docs[i]) for i in pick])
                terms = np.concatenate([docs[i] for i in pick])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                raw, sums = self.raw(terms, starts)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
                g_b += (error.sum()) ** 2
                self.bias -= rate * error.sum() / np.sqrt(g_b)
                seen, inverse = np.unique(terms, return_inverse=True)
                per = np.repeat(error, sizes)
                grad_w = np.bincount(inverse, per, len(seen))
                spread = per[:, None] * (np.repeat(sums, sizes, axis=0) - self.factors[terms])
                grad_v = np.stack([np.bincount(inverse, spread[:, k], len(seen)) for k in range(FACTORS)], 1) + 1e-4 * self.factors[seen]
                g_w[seen] += grad_w**2
                g_v[seen] += grad_v**2
                step = rate / np.sqrt(g_w[seen])
                moved = self.weights[seen] - step * grad_w
                self.weights[seen] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink / len(pick), 0)
                self.factors[seen] -= 0.3 * rate * grad_v / np.sqrt(g_v[seen])
        return self

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        raw, _ = self.raw(np.concatenate(docs), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine | None:
    """Fits the machine on at most ``SAMPLE_DOCS`` labelled rows that ``learn`` admits (least hashes); None without any.

    Repeated rows count once, and however many rows share an id, no more come to the driver.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"), learn.alias("learn")).where("learn and label is not null and doc_id is not null")
    chosen = least_hashed(marked.select("doc_id", "label"), SAMPLE_DOCS).distinct().limit(SAMPLE_DOCS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for rows in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([r["label"] for r in rows], pa.int32()), pa.array([terms_of(r["text"], known).tobytes() for r in rows], pa.binary())], ["doc_id", "label", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = rows.select("doc_id", "label", "text").mapInArrow(hashed, "doc_id long, label int, terms binary").distinct()
    sample = sample.orderBy(F.xxhash64("doc_id", "label", "terms")).limit(SAMPLE_DOCS).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["terms"])))
    return FactorizationMachine().fit([np.frombuffer(r["terms"], np.int32) for r in sample], np.array([r["label"] for r in sample], float))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learns from labelled rows with crc32(id) mod 5 other than 0 and scores every whole text: ``doc_id, held_out, score, predicted``.

    Score is the machine's probability of label 1; a null or empty text has only the bias.  Without usable labels every
    score is 0.  Equal texts get equal scores; a document with two labels is learned from twice; null labels and ids are
    not learned from; a null id is not held out.  Other columns are not read.  An empty table gives an empty result.
    """
    machine = train(docs, labels, remainder(id_col, 5) != 0, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for rows in rows_of(batches, 64):
            found = machine.scores([terms_of(r["text"], known) for r in rows]) if machine else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
