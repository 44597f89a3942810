"""Registered queries that SQL can't say, against plain Python over the same tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover

from docquarry.plans import catalog
from docquarry.plans.views import questions, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, SF, "embeddings").collect()}


def near(vectors, query, k):
    """``(key, cosine)`` of the best ``k``, ties by key."""
    q = vectors[query]
    scores = {i: float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v))) for i, v in vectors.items()}
    return sorted(scores.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]


def by_query(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["query_id"]].append(r)
    return out


def test_diverse_by_score(spark, vectors):
    got = by_query(catalog.queries()["f9_diverse_by_score"](spark, SF).collect())
    for query in [i for i in vectors if i % 50 == 0]:
        kept = []
        for key, s in near(vectors, query, 30):
            if all(1 - abs(s - t) / max(s, t, 1.0) <= 0.97 for _, t in kept):
                kept.append((key, s))
        assert sorted(r["vec_id"] for r in got[query]) == sorted(k for k, _ in kept)


def test_marginal_relevance(spark, vectors):
    got = by_query(catalog.queries()["f10_mmr"](spark, SF).collect())
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    for query in [i for i in vectors if i % 50 == 0]:
        rest, chosen = near(vectors, query, 20), []
        while len(chosen) < 4:
            gains = [0.5 * s - 0.5 * max((float(unit[i] @ unit[j]) for j in chosen), default=0.0) for i, s in rest]
            chosen.append(rest.pop(int(np.argmax(np.round(gains, 12))))[0])
        assert [r["vec_id"] for r in sorted(got[query], key=lambda r: r["rank"])] == chosen


def test_principal_components(spark, vectors):
    rows = {r["vec_id"]: r for r in catalog.queries()["f14_principal_components"](spark, SF).collect()}
    keys = sorted(vectors)
    x = np.array([vectors[i] for i in keys])
    x = x - x.mean(axis=0)
    _, size, turned = np.linalg.svd(x, full_matrices=False)
    shares = size**2 / (size**2).sum()
    squares = (x @ turned[:4].T) ** 2
    for i, want in zip(keys, squares, strict=True):
        assert rows[i]["dims"] == 4
        assert rows[i]["squares"] == pytest.approx(want.tolist(), abs=1e-5)
        assert rows[i]["shares"] == pytest.approx(shares[:4].tolist(), abs=1e-6)


def test_embedded_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    from docquarry.operators import vector

    got = {r["doc_id"]: np.array(r["embedding"], float) for r in vector.embed(table(spark, SF, "documents"), "doc_id", "text").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = np.zeros(64)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h & 0x10000 else -1
        assert got[i] == pytest.approx((want / max(np.linalg.norm(want), 1e-300)).tolist(), abs=1e-6)


@pytest.fixture(scope="module")
def hits(spark):
    """The best ten documents of each question by BM25, by a plain count of words, and all texts."""
    words = lambda t: [w for w in re.findall(r"[^\W]+", t.lower()) if len(w) >= 2]
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    counts = {i: Counter(words(t)) for i, t in texts.items()}
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    mean = sum(sum(c.values()) for c in counts.values()) / len(counts)
    out = {}
    for r in questions(spark, SF).collect():
        asked, scores = Counter(words(r["query"])), {}
        for i, c in counts.items():
            parts = [n * max(0.25, math.log((len(counts) - df[w] + 0.5) / (df[w] + 0.5))) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, n in asked.items() if w in c]
            if parts:
                scores[i] = round(sum(parts), 6)
        out[r["query_id"]] = (r["query"], sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10])
    return out, texts


def jaccard(a, b):
    a, b = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_diverse_by_tokens(spark, hits):
    found, texts = hits
    got = by_query(catalog.queries()["g14_diverse_by_tokens"](spark, SF).collect())
    for query, (_, top) in found.items():
        rest, chosen = list(top), []
        while rest and len(chosen) < 4:
            best = max(range(len(rest)), key=lambda n: (0.6 * rest[n][1] - 0.4 * max((jaccard(texts[rest[n][0]], texts[j]) for j in chosen), default=0.0), -n))
            chosen.append(rest.pop(best)[0])
        assert sorted(r["doc_id"] for r in got[query]) == sorted(chosen)


def test_near_copies_among_hits(spark, hits):
    found, texts = hits
    got = by_query(catalog.queries()["g16_drop_near_copies"](spark, SF).collect())
    for query, (_, top) in found.items():
        kept = []
        for i, _ in top:
            if all(jaccard(texts[i], texts[j]) <= 0.8 for j in kept):
                kept.append(i)
        assert sorted(r["doc_id"] for r in got[query]) == sorted(kept)


def test_pair_tfidf(spark, hits):
    found, texts = hits
    stops = set(StopWordsRemover.loadDefaultStopWords("english"))
    got = {(r["query_id"], r["doc_id"]): r["tfidf"] for r in catalog.queries()["g5_pair_tfidf"](spark, SF).collect()}

    def terms(t):
        w = [x for x in re.findall(r"[^\W]+", t.lower()) if len(x) >= 2 and x not in stops]
        return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])

    for query, (text, top) in found.items():
        for i, _ in top[:5]:
            a, b = terms(text), terms(texts[i])
            idf = lambda w, a=a, b=b: 1.0 if w in a and w in b else 1 + math.log(1.5)
            x, y = ({w: n * idf(w) for w, n in c.items()} for c in (a, b))
            size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
            want = sum(x[w] * y[w] for w in x.keys() & y.keys()) / size if size else 0.0
            assert got[query, i] == pytest.approx(want, abs=2e-6)


def test_sliding_users(spark):
    """With few users the approximate count is exact."""
    users = defaultdict(set)
    for r in table(spark, SF, "events").select("user_id", "ts").collect():
        at = int((r["ts"] - __import__("datetime").datetime(2024, 1, 1)).total_seconds())
        for k in range(at // 300 - 5, at // 300 + 1):
            users[k * 300].add(r["user_id"])
    got = catalog.queries()["n3_active_users"](spark, SF).selectExpr("unix_timestamp(started) - unix_timestamp(timestamp'2024-01-01') as s", "users").collect()
    assert {r["s"]: r["users"] for r in got} == {k: len(v) for k, v in users.items()}
