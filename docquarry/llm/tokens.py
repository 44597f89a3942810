"""Token counts from a public tokenizer, in batches balanced by bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Bytes that one call of the tokenizer gets, and the length from which a text is split.
BATCH_BYTES, SPLIT_CHARS = 128 << 10, 32 << 10
#: A text may be split before white space that follows something else: neither words nor special strings cross it.
_SAFE = re.compile(r"(?<=[^\s])(?=[ \n\t\r])")


def split_safely(text: str, most: int = SPLIT_CHARS) -> list[str]:
    """Parts of about ``most`` characters, cut only at safe boundaries; a part without one stays whole."""
    parts, at = [], 0
    while len(text) - at > most:
        found = _SAFE.search(text, at + most)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def balanced(lengths: list[int], most: int = BATCH_BYTES) -> Iterator[list[int]]:
    """Indices in runs whose lengths add up to at most ``most``, longest first; a longer one is alone."""
    run, held = [], 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        if run and held + lengths[i] > most:
            yield run
            run, held = [], 0
        run.append(i)
        held += lengths[i]
    if run:
        yield run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for rows in rows_of(batches, 512):
            texts = [r["text"] or "" for r in rows]
            parts = [(k, p) for k, t in enumerate(texts) for p in ([t] if path.endswith(".model") else split_safely(t))]
            counts = [0] * len(rows)
            for chosen in balanced([len(p.encode("utf-8", "surrogatepass")) for _, p in parts]):
                for i, n in zip(chosen, lengths([parts[i][1] for i in chosen]), strict=True):
                    counts[parts[i][0]] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, as the library for the tokenizer file ``path`` counts.

    No begin, end or added special tokens, no truncation or padding; special strings in texts are the library's default.
    Only lengths leave the Arrow function.  Long texts are split before white space and their counts added, which
    holds for tokenizers whose words end at white space; a sentencepiece model gets whole texts.

    A null or empty text has 0 bytes and 0 tokens.  Each row counts on its own, so repeated rows and ties are equal.
    Other columns are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
