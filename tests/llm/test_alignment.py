"""Token alignment against whole texts encoded by the libraries, links by comparing all byte ranges, and counts by sets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docquarry.llm import alignment, common

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        ok = b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
        return (ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()) if ok else None

    found, held = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        t = tokens(text) if text else None
        links = Counter()
        if t:
            ids_a, ids_b, ends_a, ends_b = t
            j = 0
            for i, x in enumerate(ids_a):
                begin, end = ends_a[i - 1] if i else 0, ends_a[i]
                while ends_b[j] <= begin:
                    j += 1
                k = j
                while k < len(ids_b) and (ends_b[k - 1] if k else 0) < end:
                    links[x, ids_b[k]] += 1
                    k += 1
            for pair in links:
                held[pair].add(n)
        found.append((doc_id, t, links))
    highest = defaultdict(int)
    for (x, _), who in held.items():
        highest[x] = max(highest[x], len(who))
    out = []
    for doc_id, t, links in found:
        line, n = "", 0
        if t:
            ids_a, ids_b, ends_a, ends_b = t
            common_ends = sorted(set(ends_a) & set(ends_b))
            at_a, at_b = {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
            parts, p, q = [], 0, 0
            for e in common_ends:
                parts.append(",".join(map(str, ids_a[p : at_a[e]])) + "|" + ",".join(map(str, ids_b[q : at_b[e]])))
                p, q = at_a[e], at_b[e]
            line, n = ";".join(parts), len(parts)
        best = sum(c for (x, y), c in links.items() if len(held[x, y]) == highest[x])
        total = sum(c * len(held[p]) for p, c in links.items())
        out.append((doc_id, len(t[0]) if t else 0, len(t[1]) if t else 0, n, sum(links.values()), best, total, hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def same(df):
    got = alignment.align_tokens(df, A, B)
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_whole_table_equals_whole_texts(spark):
    same(common.table(spark, "/root/testdata/sf0.01", "documents").repartition(5))


def test_odd_texts_and_rows(spark):
    texts = [None, "", " ", "  ", "a ", " a", "a  b   c ", "\n a\t b\r\n  c", "x  y  z ᠎ w\x1c v\x85 u", "▁ piece", "x▁y", "<s>a</s> <unk> <|endoftext|> <0x41>", "a\x00b", "naïve ﬁ ① 😀 👩‍👩‍👧 中文字符 日本語 text", "don't we'll 's 'S  's", "word" * 30_000, "w " * 30_000, "  " * 50, "é é", "…" * 9, "a​ b﻿ c", "1234567 12,345.67"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "twice the same", "en", "s", 0)] * 3 + [(None, "no id", None, None, None)]
    same(spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit(1), "planes": F.lit("x"), "kind": F.lit(0), "container": F.lit(1), "best": F.lit(1)}))


def test_small_containers_give_the_same(spark, monkeypatch):
    df = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = alignment.align_tokens(df, A, B, groups=True).collect()
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows)
    whole = alignment.pair_counts(alignment.encoded(df.coalesce(1), A, B), 32_000)
    parts = alignment.pair_counts(alignment.encoded(df.repartition(9), A, B), 32_000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


@pytest.mark.parametrize("entries", [1, 2_000_000])
def test_bitmaps_give_back_documents_and_links(entries):
    rng, container, held = np.random.default_rng(1), alignment.Container(), Counter()
    for word in range(7):
        keys = np.unique(rng.integers(0, 64, 900) << 32 | rng.integers(0, 60, 900))
        slots, codes, times = keys >> 32, keys & 0xFFFFFFFF, rng.integers(1, 300, len(keys))
        container.add(slots, codes, times)
        for s, c, t in zip(slots.tolist(), codes.tolist(), times.tolist(), strict=True):
            held[c, word * 64 + s] += t
    rows = container.rows()
    assert len(rows["code"]) == len(set(rows["code"])) == 60
    for code, documents, links in zip(rows["code"], rows["documents"], rows["links"], strict=True):
        mine = {s: t for (c, s), t in held.items() if c == code}
        assert documents == len(mine) and links == sum(mine.values())
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"planes": pa.array(rows["planes"], pa.list_(pa.binary())), "documents": pa.array(rows["documents"]), "best": pa.array([True] * 60)})
    best, total = np.zeros(4096, np.int64), np.zeros(4096, np.int64)
    alignment._scores(batch, best, total)
    count = dict(zip(rows["code"], rows["documents"], strict=True))
    assert best.tolist() == [sum(t for (_, s), t in held.items() if s == slot) for slot in range(4096)]
    assert total[5] == sum(t * count[c] for (c, s), t in held.items() if s == 5)


def test_empty(spark):
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA), A, B).collect() == []
