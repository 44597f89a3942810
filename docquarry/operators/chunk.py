"""Chunking: texts into overlapping pieces, natively where the rule is positional, else in Arrow batches per document."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Separators, tried from the first to the last.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CODE_SEPARATORS = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")
LATEX_SEPARATORS = ("\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\begin{", "\n\n", "\n", " ", "")

_CHUNKERS: dict[str, Callable[..., DataFrame]] = {}


def register_chunker(name: str, chunker: Callable[..., DataFrame]) -> None:
    """Makes a chunker known by name: a function of a table, id and text columns that returns ``id, chunk_index, content`` rows."""
    _CHUNKERS[name] = chunker


def chunker(name: str) -> Callable[..., DataFrame]:
    return _CHUNKERS[name]


def chunk_fixed(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, least: int = 50) -> DataFrame:
    """``key, chunk_index, content, start, end``: pieces of ``size`` characters every ``size - overlap``; short ones are left out and not counted."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + size).alias("end"), F.substring(F.col(text), s + 1, F.lit(size)).alias("content")))
    kept = F.filter(pieces, lambda p: F.length(F.trim(p["content"])) >= least)
    out = rows.where(F.length(text) > 0).select(key, F.posexplode(kept).alias("chunk_index", "p"))
    return out.select(key, "chunk_index", "p.content", "p.start", "p.end")


def chunk_tokens(rows: DataFrame, key: str, text: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """Windows of white-space tokens, joined by one space."""
    tokens = rows.select(key, F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)).alias("t")).where("size(t) > 0")
    windows = F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(size - overlap)), lambda s: F.array_join(F.slice("t", s + 1, size), " "))
    return tokens.select(key, F.posexplode(windows).alias("chunk_index", "content"))


def _merged(parts: list[str], joiner: str, size: int, overlap: int) -> list[str]:
    out, held, length = [], [], 0
    for part in parts:
        if held and length + len(joiner) + len(part) > size:
            out.append(joiner.join(held))
            while held and (length > overlap or length + len(joiner) + len(part) > size):
                length -= len(held.pop(0)) + (len(joiner) if held else 0)
        length += len(part) + (len(joiner) if held else 0)
        held.append(part)
    return [*out, joiner.join(held)] if held else out


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that the text has, merges parts up to ``size`` with overlap, and splits longer parts further."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[k], separators[k + 1 :]
    parts = [p for p in (text.split(separator) if separator else list(text)) if p]
    out, small = [], []
    for part in parts:
        if len(part) <= size:
            small.append(part)
            continue
        out += _merged(small, separator, size, overlap)
        small = []
        out += split_recursive(part, size, overlap, rest) if rest else [part]
    return [c for c in (x.strip() for x in out + _merged(small, separator, size, overlap)) if c]


def split_sentences(text: str, size: int, overlap: int, least: int) -> list[str]:
    """Packs sentences, without their end marks before white space, up to ``size``; on overflow the last two ". "-parts go on into the next chunk if there is overlap."""
    out, held = [], ""
    for sentence in filter(None, map(str.strip, re.split(r"[.!?]+\s+", text))):
        if held and len(held) + 1 + len(sentence) > size:
            out.append(held)
            held = ". ".join(held.split(". ")[-2:]) + ". " + sentence if overlap > 0 else sentence
        else:
            held = f"{held} {sentence}" if held else sentence
    return [c.strip() for c in [*out, held] if len(c.strip()) >= least]


def split_at_boundaries(text: str, size: int, overlap: int) -> list[str]:
    """Cuts at the last sentence end beyond 60 % of ``size``, else newline beyond 60 %, else space beyond 70 %, else hard; no chunk twice."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out: dict[str, None] = {}
    start = 0
    while start < len(text):
        piece = text[start : start + size]
        cut = len(piece)
        if start + size < len(text):
            ends = [m.end() for m in re.finditer(r"[.!?]", piece) if m.end() > 0.6 * size]
            newline, space = piece.rfind("\n"), piece.rfind(" ")
            cut = ends[-1] if ends else newline + 1 if newline > 0.6 * size else space + 1 if space > 0.7 * size else size
        if piece[:cut].strip():
            out[piece[:cut].strip()] = None
        if start + cut >= len(text):
            break
        start = max(start + cut - overlap, start + size // 2)
    return list(out)


def _by_document(split: Callable[[str], list[str]]) -> Callable[[DataFrame, str, str], DataFrame]:
    @F.pandas_udf("array<string>")
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split(t) if t else [])

    return lambda rows, key, text: rows.select(key, F.posexplode(pieces(text)).alias("chunk_index", "content"))


def chunk_recursive(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    return _by_document(lambda t: split_recursive(t, size, overlap, separators))(rows, key, text)


def chunk_code(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return chunk_recursive(rows, key, text, size, overlap, CODE_SEPARATORS)


def chunk_latex(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return chunk_recursive(rows, key, text, size, overlap, LATEX_SEPARATORS)


def chunk_semantic(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """The recursive rule under the name ``semantic``."""
    return chunk_recursive(rows, key, text, size, overlap)


def chunk_character(rows: DataFrame, key: str, text: str, separator: str = "\n\n", size: int = 1000, overlap: int = 200) -> DataFrame:
    return _by_document(lambda t: [c for c in _merged([p for p in t.split(separator) if p], separator, size, overlap) if c.strip()])(rows, key, text)


def chunk_sentences(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, least: int = 50) -> DataFrame:
    return _by_document(lambda t: split_sentences(t, size, overlap, least))(rows, key, text)


def chunk_boundary_aware(rows: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    return _by_document(lambda t: split_at_boundaries(t, size, overlap))(rows, key, text)


def chunk_markdown_headers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of a Markdown text: ``key, chunk_index, level, header, content``."""
    sections = F.split(text, r"(?m)(?=^#{1,6} )")
    out = rows.select(key, F.posexplode(sections).alias("chunk_index", "s")).where("trim(s) <> ''")
    head = F.regexp_extract("s", r"^(#{1,6}) ([^\n]*)", 1)
    return out.select(key, "chunk_index", F.length(head).alias("level"), F.regexp_extract("s", r"^(#{1,6}) ([^\n]*)", 2).alias("header"), F.regexp_replace("s", r"^#{1,6} [^\n]*\n?", "").alias("content"))


def chunk_html_headers(rows: DataFrame, key: str, html: str) -> DataFrame:
    """Sections of a page by its headings, markup removed: ``key, chunk_index, level, header, content``."""
    sections = F.split(html, r"(?i)(?=<h[1-6][^>]*>)")
    out = rows.select(key, F.posexplode(sections).alias("chunk_index", "s"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    head = r"(?is)^<h([1-6])[^>]*>(.*?)</h[1-6]>"
    level = F.regexp_extract("s", head, 1)
    return out.select(key, "chunk_index", F.when(level != "", level.cast("int")).otherwise(0).alias("level"), plain(F.regexp_extract("s", head, 2)).alias("header"), plain(F.regexp_replace("s", head, "")).alias("content"))


for _name, _f in {"fixed": chunk_fixed, "recursive": chunk_recursive, "character": chunk_character, "token": chunk_tokens, "sentence": chunk_sentences, "markdown": chunk_markdown_headers, "html": chunk_html_headers, "code": chunk_code, "latex": chunk_latex, "semantic": chunk_semantic, "boundary": chunk_boundary_aware}.items():
    register_chunker(_name, _f)


def quality_control(chunks: DataFrame, least: int = 50, most: int = 2000, discard: bool = True) -> DataFrame:
    """Drops short chunks (if ``discard``) and flags long ones."""
    kept = chunks.where(F.length("content") >= least) if discard else chunks
    return kept.withColumn("too_long", F.length("content") > most)


def merge_small(chunks: DataFrame, key: str, least: int) -> DataFrame:
    """Runs of short chunks are joined by a newline into the run's first; ``merged`` lists their indices."""
    line = Window.partitionBy(key).orderBy("chunk_index")
    small = F.length("content") < least
    starts = F.when(small & F.coalesce(F.lag(F.length("content") < least).over(line), F.lit(False)), 0).otherwise(1)
    runs = chunks.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(line))
    out = runs.groupBy(key, "_run").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    return out.select(key, F.col("m")[0]["chunk_index"].alias("chunk_index"), F.array_join("m.content", "\n").alias("content"), F.col("m.chunk_index").alias("merged"))


def chunk_policy(rows: DataFrame, text: str, models: DataFrame, model: str) -> DataFrame:
    """Chunk size and overlap by the model's token limit: ``models(model, max_tokens)`` is a small table; a token is about 1.55 characters."""
    out = rows.join(F.broadcast(models), model, "left").withColumn("threshold", F.floor(F.coalesce("max_tokens", F.lit(512)) * 0.85).cast("int"))
    size = F.greatest(F.lit(500), F.least(F.lit(15_000), F.floor(F.col("threshold") * 1.55))).cast("int")
    tokens = F.ceil(F.length(text) / 1.55).cast("int")
    return out.withColumns({"tokens": tokens, "chunk_size": size}).withColumns({"chunk_overlap": F.greatest(F.lit(50), F.least(F.lit(2000), F.floor(F.col("chunk_size") * 0.133))).cast("int"), "needs_chunking": tokens > F.col("threshold")})


def to_chunk_rows(chunks: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Chunks with their parents' columns: ids, totals, cut titles and contents.  ``(key, chunk_index)`` is the key."""
    total = F.count("*").over(Window.partitionBy(key))
    rows = chunks.select(key, "chunk_index", F.col("content").alias("_content")).withColumn("total_chunks", total)
    out = rows.join(parents.drop("content"), key)
    title = F.concat(F.coalesce("episode_title", F.lit("")), F.lit(" [Chunk "), F.col("chunk_index") + 1, F.lit("/"), F.col("total_chunks"), F.lit("]"))
    return out.select(key, "chunk_index", F.concat_ws("_", key, "chunk_index").alias("chunk_id"), (F.col(key) * 1000 + F.col("chunk_index")).alias("entry_id"), "novel_id", "episode_number", F.left(title, F.lit(500)).alias("title"), F.left("_content", F.lit(20_000)).alias("content"), "total_chunks", "publication_date")


def to_document_rows(documents: DataFrame, key: str) -> DataFrame:
    """Whole documents as rows of the same table as chunks: no chunk, one piece, and an entry id below zero, so that it meets no chunk's."""
    stamp = F.coalesce(F.unix_timestamp(F.col("publication_date").cast("timestamp")), F.lit(0))
    cells = {"entry_id": -(F.col(key) * 1000 + 999), key: F.col(key), "novel_id": F.col("novel_id"), "episode_number": F.col("episode_number"), "title": F.left("episode_title", F.lit(500)), "content": F.left("content", F.lit(20_000)), "content_length": F.length("content"), "is_chunk": F.lit(False), "chunk_index": F.lit(-1), "total_chunks": F.lit(1), "publication_timestamp": stamp, "publication_date": F.coalesce(F.col("publication_date").cast("string"), F.lit(""))}
    return documents.select(*[c.alias(n) for n, c in cells.items()])


def chunk_statistics(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks, total length and mean of the documents' mean lengths."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.avg(F.length("content")).alias("mean"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), F.round(F.avg("mean"), 6).alias("mean_of_means"))


