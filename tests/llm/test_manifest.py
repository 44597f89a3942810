"""The Merkle manifest against a plain tree over whole tables, and its edges."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import common, manifest, sha

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """Every level as a list, every proof and every folded root by hashing whole runs anew."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        line = sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[k] = (line, climb([leaf_of(r, r["text"]) for r in line]))
    if not names:
        return []
    top = climb([trees[k][1][-1][0] for k in names])
    root, out = top[-1][0], []
    for at, k in enumerate(names):
        line, levels = trees[k]
        for i, r in enumerate(line):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now, siblings = leaf_of(r, text), []
            for tree, place in ((levels, i), (top, at)):
                for level in tree[:-1]:
                    run, j = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    siblings += run[:j] + run[j + 1 :]
                    now, place = digest(*run[:j], now, *run[j + 1 :]), place // 8
            out.append((r["doc_id"], leaf_of(r, r["text"]), levels[-1][0], root, digest(*siblings), now, now == root))
    return sorted(out, key=str)


def same(df):
    got = manifest.manifest(df, manifest.third_by_checksum())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute([r.asDict() for r in df.collect()])
    return rows


def test_states_give_the_library_digests():
    parts = [hashlib.sha256(bytes([i])).digest() for i in range(8)]
    state = sha.START[None]
    for n, part in enumerate(parts, 1):
        state = sha.compressed(state, sha.hex_blocks(sha.words_of([part])))
        assert sha.bytes_of(sha.closed(state, np.array([n])))[0].hex() == digest(*(p.hex() for p in parts[:n]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_equal_a_plain_tree(spark, sf):
    rows = same(common.table(spark, f"/root/testdata/{sf}", "documents"))
    assert 0 < sum(not r[-1] for r in rows) < len(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 513])
def test_sizes_of_one_group(spark, n):
    same(spark.createDataFrame([(i, f"T{i}", "a", "s", 1) for i in range(n)], SCHEMA))


def test_many_groups_nulls_and_repeated_rows(spark):
    rows = [(i, None if i % 5 == 0 else f"Tü{i}" * (i % 3), None if i % 700 == 3 else f"l{i % 700}", "s", 1) for i in range(1500)]
    rows += [(None, "X", None, None, None)] * 3 + [(7, "Q", "l1", None, 3)] * 9 + [(8, "LONG " * 100_000, "", "s", 2)]
    same(spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "place": F.lit("x"), "group": F.lit("g"), "at": F.lit(0)}))


def test_any_change_shows(spark):
    """A changed letter in one document changes its folded root, and no other document's."""
    df = spark.createDataFrame([(i, f"Text {i}", "ab"[i % 2], "s", 1) for i in range(100)], SCHEMA)
    got = {r["doc_id"]: r["verified"] for r in manifest.manifest(df, F.col("doc_id") == 42).collect()}
    assert [i for i, ok in got.items() if not ok] == [42]
