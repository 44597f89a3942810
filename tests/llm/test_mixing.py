"""Mixing against plain targets and a plain count of each block's words, and its edges."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry.llm import common, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; who is above its cap stops there, and the excess is shared among the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    given, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        for s in free:
            given[s] += share * weight[s]
        left = sum(max(0.0, given[s] - most * sizes[s]) for s in free)
        given = {s: min(g, most * sizes[s]) if s in free else g for s, g in given.items()}
        free = {s for s in free if given[s] < most * sizes[s]}
    return given


def report(df, **more):
    rows = [r.asDict() for r in mixing.mix_report(df, **more).collect()]
    sources = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        by[sources[r["doc_id"]]][0] += r["size"]
        by[sources[r["doc_id"]]][1] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    wanted = plain_targets({s: v[0] for s, v in by.items()})
    for r in rows:
        assert r["source_size"] == by[sources[r["doc_id"]]][0]
        assert r["target"] == pytest.approx(wanted[sources[r["doc_id"]]], abs=1e-6)
    return rows, by, wanted


def test_whole_table_meets_its_targets(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows, by, wanted = report(df)
    assert len(rows) == df.count() and sum(wanted.values()) == pytest.approx(sum(r["size"] for r in rows))
    for source, (_, taken) in by.items():
        assert abs(taken - wanted[source]) <= 0.01 * wanted[source] + mixing.BLOCK_WORDS
    again = mixing.mix_report(df.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r.values()) for r in rows)


def test_report_counts_the_words_of_the_drawn_blocks(spark):
    """Words of a source in order, cut into blocks; every drawn block's text is that block, and documents count what was drawn."""
    df = common.table(spark, "/root/testdata/sf0.001", "documents")
    lines, own = defaultdict(list), {}
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        found = [w for w in r["text"].replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w] if r["text"] else []
        own[r["doc_id"]] = (r["source"], len(lines[r["source"]]), len(found))
        lines[r["source"]] += found
    mixed = mixing.mixed_blocks(df, shard_blocks=100).collect()
    drawn = Counter((r["source"], r["block"]) for r in mixed)
    for r in mixed:
        assert r["text"].split(" ") == lines[r["source"]][64 * r["block"] : 64 * r["block"] + 64]
    taken = {i: sum(drawn[s, p // 64] for p in range(at, at + n)) for i, (s, at, n) in own.items()}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_report(df).collect()} == taken
    # Slots without a gap, shards of about equal size, and no source's blocks all in one shard.
    slots = defaultdict(list)
    for r in mixed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(60 <= len(s) <= 140 for s in slots.values()) and len(slots) == -(-len(mixed) // 100)


def test_blocks_come_equally_often(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(100)), "en", s, 0) for s, ids in (("a", range(40)), ("b", range(100, 103))) for i in ids], SCHEMA)
    drawn = Counter((r["source"], r["block"]) for r in mixing.mixed_blocks(df, block_words=10).collect())
    a, b = ([n for (s, _), n in drawn.items() if s == x] for x in "ab")
    assert set(b) == {3} and len(b) == 30 and max(a) - min(a) <= 1 and sum(a) == 430 - 90


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select(*[mixing.permuted(F.col("id"), F.lit(n), k).alias(f"p{k}") for k in range(2)]).collect()
    for k in ("p0", "p1"):
        assert sorted(r[k] for r in rows) == list(range(n))
    if n >= 97:
        assert [r["p0"] for r in rows] != [r["p1"] for r in rows] and sum(r["p0"] == i for i, r in enumerate(rows)) < 10


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_report(empty).collect() == [] and mixing.mixed_blocks(empty).collect() == []
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "none", 0), (None, "a b", "en", None, 0), (5, "x " * 30_000, "en", "s", 0), (6, "one two", "en", "t", 0), (6, "one two", "en", "t", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "start": F.lit("x"), "size": F.lit(2), "sid": F.lit(0), "at": F.lit(3)})
    got = [r.asDict() for r in mixing.mix_report(df).collect()]
    assert len(got) == len(rows)
    sizes = Counter((r["doc_id"], r["size"]) for r in got)
    assert sizes == Counter({(1, 0): 1, (2, 0): 1, (3, 0): 1, (None, 2): 1, (5, 30_000): 1, (6, 2): 2})
    assert {r["doc_id"]: r["source_size"] for r in got} == {1: 2, None: 2, 2: 30_000, 5: 30_000, 3: 0, 6: 4}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and all(r["taken"] == 3 * r["size"] for r in got if r["doc_id"] in (6, None))
    assert mixing.mix_report(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()[0]["target"] == 0
