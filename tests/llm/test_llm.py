"""Training-data operators against brute force, exact round trips and held-out accuracy, and their edges."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docquarry.llm import common, decontam, fingerprint, langid, mainhtml, neardup, pieces, shards, substrings, tokens, toxicity
from docquarry.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(n, rng, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, edges."""
    rng, rows = random.Random(3), []
    base = words(120, rng)
    passage = words(60, rng)
    for i in range(40):
        rows.append(words(rng.randrange(1, 200), rng))
    for i in range(12):
        edited = list(base)
        for _ in range(i // 2):
            edited[rng.randrange(len(edited))] = "edited"
        rows.append(edited)
    for _ in range(3):
        own = words(50, rng)
        rows.append(own[:20] + passage + own[20:])
    rows += [rows[0], rows[0], ["one"], ["one"], ["a"] * 100, ["LOUD", "Words", "here"], ["loud", "words", "HERE"]]
    out = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)]
    n = len(out)
    return [*out, (n, "", "en", "s", 0), (n + 1, None, None, None, None), (n + 2, " \t\n", "en", "s", 0), (n + 3, "x " * 30_000, "en", "s", 0), (n + 4, "ünï cödé\x85nbsp\xa0here " * 10, "de", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # Extra columns whose names clash with those inside the operators.
    return spark.createDataFrame(corpus, SCHEMA).withColumns({"row": F.lit(1), "words": F.lit("x"), "key": F.lit(2), "digest": F.lit("d")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, need=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= need * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(docs, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(corpus)


def test_near_duplicates_empty_and_repeated(spark, docs, empty):
    assert neardup.near_duplicates(empty).count() == 0
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert neardup.near_duplicates(twice).count() == 6


def test_cross_component_links_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    sets = {i: sorted({rng.randrange(40) for _ in range(30)}) for i in range(40)}
    named = spark.createDataFrame([(7, i, 0 if i < 15 else i) for i in sets], "key long, id long, root long")
    stored = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in sets.items()], "id long, set binary")
    linked = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))
    for size in (1 << 20, 1000):
        monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
        links = [tuple(r) for r in neardup._across_components(named, lambda ids: stored, 75).collect()]
        assert all(linked(a, b) for a, b in links)
        root = {i: (0 if i < 15 else i) for i in sets}
        for a, b in [*links]:
            x, y = root[a], root[b]
            root = {k: (x if v == y else v) for k, v in root.items()}
        assert all(root[a] == root[b] for a in sets for b in sets if a < b and linked(a, b))


def test_prefixes_show_every_linked_pair():
    rng = random.Random(9)
    for _ in range(3000):
        n, both = rng.randrange(1, 60), 0
        m = rng.randrange(max(1, n * 3 // 4), n * 4 // 3 + 2)
        both = rng.randrange(0, min(n, m) + 1)
        if 100 * both < 75 * (n + m - both):
            continue
        order = [*["both"] * both, *["a"] * (n - both), *["b"] * (m - both)]
        rng.shuffle(order)
        spot = lambda own, order=order: [k for k, x in enumerate(order) if x in ("both", own)]
        shown = [{c: set(spot(own)[:length]) for c, length in neardup.prefix_lengths(size, 75)} for own, size in (("a", n), ("b", m))]
        assert shown[0][neardup.size_class(m)] & shown[1][neardup.size_class(n)]


def test_recall_of_bands_and_estimates_by_similarity():
    """Of pairs at or over 0.75, by band of similarity and also of 1 to 5 shingles, 99 % share a bucket and pass the estimate."""
    rng, pairs = np.random.default_rng(12), []
    for k in range(6000):
        most = (5, 30, 400)[k % 3]
        n = int(rng.integers(1, most + 1))
        m = int(rng.integers(max(1, -(-3 * n // 4)), max(2, 4 * n // 3 + 1)))
        both = int(rng.integers(0, min(n, m) + 1)) if most == 5 else min(n, m, -(-75 * (n + m) // 175) + int(rng.integers(0, max(1, n // 6))))
        share = both / (n + m - both)
        if share >= 0.75:
            pool = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
            pairs.append((share, most, pool[:n], pool[n - both : n - both + m]))
    left, right = (neardup.registers_of([p[k] for p in pairs]) for k in (2, 3))
    sizes = [np.array([len(p[k]) for p in pairs], float) for k in (2, 3)]
    estimated = neardup.joint_estimate(left, right, *sizes) >= 0.75 - neardup.SLACK
    banded = (left == right).reshape(len(pairs), neardup.BANDS, neardup.WIDTH).all(axis=2).any(axis=1)
    for lo, hi in ((0.75, 0.8), (0.8, 0.9), (0.9, 1.01)):
        for most in (5, 30, 400):
            mine = np.array([lo <= p[0] < hi and p[1] == most for p in pairs])
            assert mine.sum() == 0 or (estimated & banded)[mine].mean() >= 0.99, (lo, most, mine.sum())
    assert len(pairs) > 3000


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_semi_and_anti_joins_by_filter(spark, monkeypatch, words):
    monkeypatch.setattr(common, "FILTER_WORDS", words)  # with one word the filter is full: everything is shuffled
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(None, "n"), (5, "again")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 600, 3)] + [(None,), (3,)], "doc_id long")
    plain = lambda how: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows.join(ids, "doc_id", how).collect())
    for how in ("left_semi", "left_anti"):
        got = common.semi_or_anti(rows, ids, "doc_id", how)
        assert got.columns == rows.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got.collect()) == plain(how)
        assert common.semi_or_anti(rows, ids.limit(0), "doc_id", how).count() == (0 if how == "left_semi" else 302)


def test_joint_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.75, 0.9):
        pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        a, b = pool[: int(1000 * (1 + share) / 2)], pool[int(1000 * (1 - share) / 2) : 1000]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        regs = neardup.registers_of([a, b])
        est = neardup.joint_estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - truth) < 0.17
    merged = neardup.registers_of([np.union1d(a, b)])
    assert (merged == np.maximum(regs[0], regs[1])).all()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (1, 1), (None, 2), (5, 4)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 7), (8, 7), (7, 7)}


def brute_repeats(rows, window=35):
    split = {i: WORD.findall(t or "") for i, t, *_ in rows}
    seen = Counter(tuple(w[j : j + window]) for w in split.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("group", [4 << 20, 3000, 200])
def test_repeated_windows(docs, corpus, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)  # small bounds lengthen prefixes once or more
    out = substrings.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute_repeats(corpus)
    assert all((r["kept_text"] is None) == (r["n_removed"] == 0) for r in out)


def test_repeated_windows_of_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = substrings.remove_repeats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), texts=False).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == brute_repeats(rows)


def test_suffix_tree_gives_common_prefixes():
    owner, order, common = substrings.suffix_tree([b"a b c d e", b"a b c d f", b"x b c d e"], 4)
    words = [w for t in ("a b c d e", "a b c d f", "x b c d e") for w in (t.split()[:4], t.split()[1:])]
    assert owner.tolist() == [0, 0, 1, 1, 2, 2] and sorted(order.tolist()) == list(range(6))
    for k, n in enumerate(common, 1):
        a, b = words[order[k - 1]], words[order[k]]
        assert a[:n] == b[:n] and (n == 4 or a[n] != b[n])


def test_repeated_windows_of_empty_and_repeated_rows(docs, empty):
    assert substrings.remove_repeats(empty).count() == 0
    twice = docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5"))
    got = substrings.remove_repeats(twice).collect()
    assert len(got) == 2 and all(r["n_removed"] in (r["n_words"], 0) for r in got)


def test_leaks(spark, empty):
    filler = "some clean words go here and then some more of them follow until the text is long enough "
    item = "A train leaves the old station at 9 with 120 people and returns after 45 minutes to the same place"
    other = item.replace("9", "7").replace("120", "300").replace("45", "20")
    broken = "A train leaves the old station at 9 with 120 people and 9 go on with 120 others while 9 remain in the same place"
    bad = broken.replace("at 9", "at 1").replace("and 9", "and 2").replace("while 9", "while 3").replace("with 120 p", "with 4 p").replace("with 120 o", "with 5 o")
    rows = [(1, filler + item), (2, filler + other + filler), (3, filler * 3), (4, (filler + item).upper()), (5, None), (6, ""), (7, "!!! ".join((filler + item).split())), (8, filler + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(0), "pos": F.lit(1)})
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, broken)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontam.leaks(docs, bench).collect()}
    assert {k for k in got if k[1] == 10} == {(1, 10), (2, 10), (4, 10), (7, 10)}
    assert not got[(1, 10)] and got[(2, 10)]
    assert (8, 13) not in got
    assert decontam.leaks(empty, bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_judge_slots_one_by_one(spark):
    item = "A train leaves the old station at 9 with 12 people who all want to see the long river and comes back to the very same old place again at 9 with 5 people"
    rows = [(1, item[:-15] + item[-15:].replace("9", "8")), (2, item.replace("12", "7").replace("5", "7")), (3, item.replace("9", "4", 1).replace("12", "7"))]
    german = "Der Mann kaufte im Laden ein Brot und gab dem Kind das Brot danach ganz ohne ein Wort wieder zurueck und ging sehr langsam heim"
    rows.append((4, german.replace("das Brot", "das Messer")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, spark.createDataFrame([(10, item), (11, german)], "item_id long, text string")).collect()}
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 11)}
    assert all(r["reworded"] for r in got.values())
    assert got[2, 10]["coverage"] == 1.0 and 0.4 <= got[1, 10]["coverage"] < 1.0


def test_leaks_of_dense_and_short_items(spark):
    filler = "some clean words go here and then some more of them follow until the text is long enough "
    dense, short, five = "Sum 12 + 7 + 3 + 4 + 81 and 9 + 2 + 15 + 6 + 5 then 8", "12 apples cost 30 cents", "the grey heron waits for 20 minutes"
    rows = [(1, filler + dense + ". " + filler), (2, filler + dense.replace("12", "13").replace("81", "80").replace("15", "16")), (3, filler + short), (4, filler + short.replace("30", "31")), (5, five.replace("20", "45")), (6, (filler + short).upper()), (7, filler), (8, "apples"), (9, filler + dense.replace("12", "11", 1))]
    mixed = "An old clerk adds these numbers for the shop 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    rows.append((20, mixed.replace("1 2 3 4 5", "2 3 4 5 1").replace("9 10", "17 18").replace("12 13", "19 20").replace("15 16", "21 22")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, dense), (11, short), (12, five), (13, "unrelated"), (14, ""), (15, mixed)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reworded"] for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 10): False, (9, 10): False, (3, 11): False, (6, 11): False, (5, 12): True, (20, 15): True}


def brute_template(text, names):
    """Tokens and template of a text, token by token."""
    import regex

    tokens, kinds, after_number = [], [], False
    for found in regex.finditer(r"[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*", text):
        word = found[0]
        number = bool(regex.match(r"\p{N}", word))
        unit = after_number is not False and text[after_number : found.start()] in ("", " ") and word.lower() in decontam.UNITS.split("|")
        name = names and regex.fullmatch(r"\p{Lu}\p{Ll}+", word)
        tokens.append(word.lower())
        kinds.append("#" if number else "%" if unit and not name else "@" if name else word.lower())
        after_number = found.end() if number else False
    return tokens, kinds


def brute_windows(text, names, width=8):
    tokens, kinds = brute_template(text, names)
    out = []
    for i in range(len(tokens) - width + 1):
        k, t = kinds[i : i + width], tokens[i : i + width]
        slots = [x in "#%@" for x in k]
        dense = any(slots) and width - sum(slots) < decontam.LITERALS
        out.append((i, ("v", *t) if dense else ("k", *k), None if dense or not any(slots) else tuple(x if s else "" for x, s in zip(t, slots, strict=True)), dense))
    return out


def brute_leaks(docs, items, coverage=decontam.COVERAGE):
    """Pairs by the stated rules, item by item (items of 8 tokens and more)."""
    found, known = {}, {}
    for item, text in items:
        for names in (True, False):
            for pos, key, slots, dense in brute_windows(text, names):
                known.setdefault(key, {}).setdefault(item, []).append((pos, slots, dense))
    sizes = {item: (len(w := brute_windows(text, True)), {p for names in (True, False) for p, _, _, dense in brute_windows(text, names) if not dense}, w) for item, text in items}
    for doc, text in docs:
        lines = {}
        for at, key, slots, _ in brute_windows(text, True):
            for item, places in known.get(key, {}).items():
                for pos, own, dense in places:
                    pairs = [(a, b) for a, b in zip(own, slots or [""] * 8, strict=True) if a] if own else []
                    lines.setdefault((item, at - pos), []).append((pos, dense, pairs))
        held = {}
        for (item, _), windows in lines.items():
            votes = Counter(p for _, _, pairs in windows for p in pairs)
            if all(len({b for a2, b in votes if a2 == a}) == 1 for a, _ in votes):
                fits = windows
            else:
                best = {}
                for (a, b), n in votes.items():
                    best[a] = max(best.get(a, (0, False, "")), (n, a == b, b))
                fits = [w for w in windows if all(a == b for a, b in w[2]) or all(best[a][2] == b for a, b in w[2])]
            held.setdefault(item, set()).update((p, d) for p, d, _ in fits)
        for item, places in held.items():
            whole, open_, _ = sizes[item]
            if len({p for p, _ in places}) / whole >= coverage or open_ and len({p for p, d in places if not d}) / len(open_) >= coverage:
                found.setdefault(doc, set()).add(item)
    return {(d, i) for d, xs in found.items() for i in xs}


def test_reparameterised_items_against_brute_force(spark):
    rng = random.Random(21)
    pool = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ho", "ka", "lu", "mi", "ne") for b in ("ran", "tel", "som", "vik", "dar", "pun", "let")]
    people, units = ["Natalia", "Marta", "Oskar", "Ines", "Pavel", "Greta", "Tomas", "Ruth"], ["km", "kg", "hours", "dollars", "minutes"]

    def item():
        sentences = []
        for _ in range(rng.randrange(2, 5)):
            body = [rng.choice(pool) for _ in range(rng.randrange(6, 11))]
            body.insert(rng.randrange(2, len(body)), f"{{n{rng.randrange(3)}}} {{u{rng.randrange(2)}}}")
            sentences.append(f"{{p{rng.randrange(2)}}} " + " ".join(body) + ".")
        return " ".join(sentences)

    def fill(form, which):
        old = {**{f"n{k}": str(12 + 7 * k) for k in range(3)}, **{f"u{k}": units[k] for k in range(2)}, **{f"p{k}": people[k] for k in range(2)}}
        new = {**{f"n{k}": str(rng.randrange(50, 999)) for k in range(3)}, **{f"u{k}": units[2 + k] for k in range(2)}, **{f"p{k}": people[2 + rng.randrange(3) + 3 * k] for k in range(2)}}
        return form.format(**{k: new[k] if k[0] in which else v for k, v in old.items()})

    forms = [item() for _ in range(500)]
    items = [(i, fill(f, "")) for i, f in enumerate(forms)]
    filler = lambda: " ".join(rng.choice(pool) for _ in range(20)) + ". "
    docs, planted = [], set()
    for i, form in enumerate(forms):
        for which in ("", "n", "np", "nup"):
            docs.append((len(docs), filler() + fill(form, which) + " " + filler()))
            planted.add((len(docs) - 1, i))
    docs += [(len(docs) + k, filler() * 3) for k in range(300)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items)
    assert len(got & planted) / len(planted) >= 0.95
    assert len(got & planted) / len(got) >= 0.99


def test_leaks_of_repeated_rows_and_a_very_long_text(spark):
    item = "Natalia sold 48 clips to her friends in April and then she sold half as many clips in May"
    long = "word " * 200_000 + item.replace("48", "30").replace("Natalia", "Marta") + " word" * 1000
    docs = spark.createDataFrame([(1, long), (1, long), (2, item), (2, "other text of the same id"), (None, item)], "doc_id long, text string").withColumns({"hash": F.lit(1), "w": F.lit(2), "tokens": F.lit("x"), "at": F.lit(0)})
    out = decontam.leaks(docs, spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["reworded"]) for r in out) == [(1, 7, 1.0, True), (1, 8, 1.0, True), (2, 7, 1.0, False), (2, 8, 1.0, False)]


@pytest.mark.parametrize("different", [1, 1000])
def test_leaks_of_a_page_that_lists_a_benchmark(spark, different):
    """One document with one item 800 times, or with 1,000 items: rows as long as a window, no product of its windows and its items."""
    rng = random.Random(8)
    make = lambda i: " ".join(rng.choice(["river", "stone", "cloud", "green", "walks", "under", "seven", "paper", "light", "grain"]) for _ in range(20)) + f" costs {i + 3} euros today"
    texts = [make(i) for i in range(different)]
    page = " ".join(texts * (800 // different or 1))
    began = time.perf_counter()
    out = decontam.leaks(spark.createDataFrame([(1, page), (2, "nothing of it")], "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()
    assert time.perf_counter() - began < 60
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(1, i) for i in range(different)]
    assert all(r["coverage"] == 1.0 for r in out)


def test_each_text_of_an_item_is_judged_alone(spark):
    texts = ["Natalia sold 48 clips to her friends in April and then she sold half as many clips in May", "a wholly other question about seven rivers that run from the hills to the grey sea", "one more form of it that no document has, about trains which leave a station at noon"]
    bench = spark.createDataFrame([(10, t) for t in texts], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before it {t} after it") for i, t in enumerate(texts)] + [(9, "before it and after it")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["coverage"], r["reworded"]) for r in decontam.leaks(docs, bench).collect()) == [(i, 10, 1.0, False) for i in range(3)]


def test_fingerprints(spark, docs, corpus, empty):
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_with_edits(docs).collect()}
    order = sorted(corpus)
    texts = [t or "" for _, t, *_ in order]
    for k, (i, *_) in enumerate(order):
        after = texts[(k + 1) % len(texts)]
        half = len(texts[k]) // 2
        assert out[i]["n_chars"] == len(texts[k])
        assert out[i]["edited_sha256"] == hashlib.sha256((texts[k][: len(texts[k]) - half] + after[:half]).encode()).hexdigest()
    prints = {}
    for k, (i, *_) in enumerate(order):
        assert prints.setdefault(texts[k], out[i]["fingerprint"]) == out[i]["fingerprint"]
    assert fingerprint.fingerprint_with_edits(empty).count() == 0
    twice = docs.where("doc_id in (1, 2)").unionByName(docs.where("doc_id in (1, 2)"))
    assert fingerprint.fingerprint_with_edits(twice).count() == 4


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(5)
    a = {f"t{i}": rng.randrange(1, 6) for i in range(60)}
    b = {f"t{i}": rng.randrange(1, 6) for i in range(20, 80)}
    truth = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
    terms = spark.createDataFrame([(k, t, w) for k, m in (("a", a), ("b", b)) for t, w in m.items()], "k string, term string, weight int")
    sigs = {r["k"]: r["signature"] for r in fingerprint.signatures(terms, ["k"], samples=400).collect()}
    assert abs(sum(x == y for x, y in zip(sigs["a"], sigs["b"], strict=True)) / 400 - truth) < 0.09


def test_shards(docs, corpus, empty):
    out = sorted(shards.balanced_shards(docs, 6).collect(), key=lambda r: r["doc_id"])
    sizes = [len((t or "").encode()) + 8 for _, t, *_ in sorted(corpus)]
    total, upto = sum(sizes), 0
    for r, size, (_, text, *_) in zip(out, sizes, sorted(corpus), strict=True):
        upto += size
        assert (r["size"], r["shard"], r["text_crc32"]) == (size, min(5, (2 * upto - size) * 6 // (2 * total)), zlib.crc32((text or "").encode()))
    for shard in {r["shard"] for r in out}:
        assert [r["slot"] for r in out if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in out)))
    assert shards.balanced_shards(empty).count() == 0


def test_parts_of_shards_agree(docs, monkeypatch):
    whole = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.balanced_shards(docs).collect()}
    monkeypatch.setattr(shards, "PART_ROWS", 7)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.balanced_shards(docs).collect()} == whole


def test_token_counts(docs, corpus, empty):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, TOKENIZER).collect()}
    assert got == {i: (len((t or "").encode()), len(direct.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus}
    special = "ab <|endoftext|> don't  é Σας " * 50
    parts = tokens.split_safely(special, 20)
    assert "".join(parts) == special and len(parts) > 10
    assert sum(len(direct.encode(p, add_special_tokens=False).ids) for p in parts) == len(direct.encode(special, add_special_tokens=False).ids)
    assert tokens.token_counts(empty, TOKENIZER).count() == 0


def slow_viterbi(model, text):
    best = [(0.0, None)] + [None] * len(text)
    for stop in range(1, len(text) + 1):
        for start in range(stop):
            piece = text[start:stop]
            found = model.scores.get(piece)
            score = found[0] if found else model.fallback if stop - start == 1 else None
            if score is not None and best[start] and (best[stop] is None or best[start][0] + score > best[stop][0]):
                best[stop] = (best[start][0] + score, start)
    return best[-1][0]


def test_pieces(docs, corpus, empty):
    model = pieces.PieceModel(PIECES)
    for text in ("▁the", "▁unbelievable", "▁\U0001f600x", "ab" * 10, "▁▁▁a", "日本語テキスト", "กข"):
        ids = model.viterbi(text)
        total, held = 0.0, 0
        for i in ids:
            if i in model.byte_of:
                held += 1
            else:
                total += model.scores[model.names[i]][0]
        raw = sum(model.fallback for c in text if c not in model.scores)
        assert total + (raw if held else 0.0) == pytest.approx(slow_viterbi(model, text))
    for text in ("", " ", "  two  spaces ", "mark ▁ in text▁▁", "new\nline\ttab", "\U0001f600 ü 日本", *[t for _, t, *_ in corpus if t]):
        assert model.decode(model.encode(text)) == text
    out = pieces.piece_round_trip(docs, PIECES).collect()
    assert len(out) == len(corpus) and all(r["round_trip"] for r in out)
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t, *_ in corpus}
    assert pieces.piece_round_trip(empty, PIECES).count() == 0


def test_languages(spark, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "", 0), (10**6 + 1, "12 34 !!", "en", "", 0), (10**6 + 2, "", None, "", 0)], SCHEMA)
    out = langid.identify_languages(table.unionByName(extra))
    und = out.where("doc_id >= 1000000").collect()
    assert [r["lang_pred"] for r in und] == ["und"] * 3
    held = out.where("held_out and doc_id < 1000000").join(table.select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right > 0.97
    assert langid.identify_languages(empty).count() == 0
    assert len(langid.windows_of("x" * 5000)) * langid.STEP + 3 >= 5000


def test_toxicity(spark, empty):
    rng, rows = random.Random(2), []
    for i in range(600):
        toxic = i % 5 == 1
        text = words(40, rng) + (["you", "nastygram", "scoundrelly"] if toxic else ["kind"])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9999, None), (9998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i in held)
    assert sum(out[i]["predicted"] == rows[i][2] for i in held) / len(held) > 0.97
    assert out[9999]["score"] == out[9998]["score"] and 0 <= out[9999]["score"] < 0.5
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), labels.limit(0)).count() == 0


def test_interactions_are_learned():
    """Label 1 only where two terms meet: no linear weights can say that."""
    rng = np.random.default_rng(1)
    docs = [np.array(sorted({*(rng.choice([1, 2], rng.integers(0, 3), False)), 3 + rng.integers(0, 3)}), np.int32) for _ in range(1500)]
    labels = np.array([float({1, 2} <= set(d.tolist())) for d in docs])
    machine = toxicity.FactorizationMachine().fit(docs, labels)
    pair, one, other = machine.scores([np.array([1, 2, 3], np.int32), np.array([1, 3], np.int32), np.array([2, 3], np.int32)])
    assert pair > 0.8 and one < 0.3 and other < 0.3
    assert abs((machine.factors[1] * machine.factors[2]).sum()) > 0.1


def test_pairwise_sum_against_brute_force():
    rng = np.random.default_rng(8)
    machine = toxicity.FactorizationMachine()
    machine.bias, machine.weights[:] = 0.3, rng.normal(0, 1, toxicity.TERMS)
    machine.factors[:] = rng.normal(0, 1, machine.factors.shape)
    docs = [np.sort(rng.choice(toxicity.TERMS, n, False)).astype(np.int32) for n in (0, 1, 2, 9, 40)]
    want = []
    for d in docs:
        raw = machine.bias + sum(float(machine.weights[t]) for t in d) + sum(float(machine.factors[a] @ machine.factors[b]) for k, a in enumerate(d) for b in d[:k])
        want.append(1 / (1 + np.exp(-raw)))
    assert machine.scores(docs[1:]) == pytest.approx(want[1:], abs=1e-4)


def test_a_term_that_is_flat_alone_can_interact():
    """A mention (1) is as common in clean as in toxic texts; beside a mild word (2) it decides, and a strong word (3) needs it not."""
    rng, docs, labels = np.random.default_rng(4), [], []
    for _ in range(3000):
        mention, mild = rng.random() < 0.5, rng.random() < 0.3
        toxic = mild and mention
        strong = not mention and rng.random() < 0.3
        docs.append(np.array(sorted([*[1] * mention, *[2] * mild, *[3] * strong, 4 + int(rng.integers(0, 5))]), np.int32))
        labels.append(float(toxic or strong))
    labels = np.array(labels)
    assert toxicity._chi_square(docs, labels)[1] < toxicity.LEAST_CHI
    assert toxicity._associated(docs, labels)[1]
    machine = toxicity.FactorizationMachine().fit(docs, labels)
    both, mild, alone = machine.scores([np.array(x, np.int32) for x in ([1, 2, 5], [2, 5], [1, 5])])
    assert both > 0.7 and mild < 0.4 and alone < 0.3


def test_toxicity_on_the_given_tables_and_odd_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score_toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    hit, toxic, false, clean = out.agg(F.sum(F.col("toxic") * F.col("predicted")), F.sum("toxic"), F.sum((1 - F.col("toxic")) * F.col("predicted")), F.sum(1 - F.col("toxic"))).head()
    assert hit / toxic > 0.85 and false / clean < 0.01  # 86 of 97, and 1 of 728
    odd = spark.createDataFrame([(1, "bad words here")] * 500 + [(1, f"text {i}") for i in range(500)] + [(2, "long " * 300_000), (None, "x"), (3, None)], "doc_id long, text string").withColumns({"label": F.lit("x"), "score": F.lit(1), "learn": F.lit(2), "h": F.lit(3)})
    marks = spark.createDataFrame([(1, 1)] * 50 + [(2, 0), (None, 1)], "doc_id long, toxic int").withColumn("label", F.lit(9))
    assert toxicity.score_toxicity(odd, marks).count() == 1003


def test_network_against_brute_force():
    rng = np.random.default_rng(3)
    net = langid.ByteNet(["a", "b", "c"])
    net.bias[:] = rng.normal(0, 0.2, net.bias.shape)
    windows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    wide = max(langid.WIDTHS)
    for window, got in zip(windows, net.log_probabilities(windows), strict=True):
        pooled = []
        for f in range(net.filters.shape[1]):
            sums = [sum(float(net.embed[window[at + j]] @ net.filters[j * langid.DIMS : (j + 1) * langid.DIMS, f]) for j in range(wide)) for at in range(langid.WINDOW - wide + 1)]
            pooled.append(max(0.0, max(sums) + float(net.bias[f])))
        logits = np.array(pooled) @ net.out + net.out_bias
        assert got == pytest.approx(logits - np.log(np.exp(logits).sum()), abs=1e-3)


def test_training_lowers_the_loss_along_the_numeric_gradient():
    rng = np.random.default_rng(5)
    windows = rng.integers(1, 256, (4, langid.WINDOW)).astype(np.uint8)
    labels = np.array([0, 1, 0, 1])
    loss = lambda net: -net.log_probabilities(windows)[np.arange(4), labels].mean()
    before = langid.ByteNet(["a", "b"])
    for f in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(before, f, getattr(before, f).astype(np.float64))
    slopes = {}
    for name in ("out", "filters", "embed", "bias"):
        flat = getattr(before, name).reshape(-1)
        for k in rng.choice(len(flat), min(40, len(flat)), False):
            if name == "filters" and before.mask.reshape(-1)[k] == 0:
                continue
            kept, up_down = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = kept + step
                up_down.append(loss(before))
            flat[k] = kept
            slopes[name, k] = (up_down[0] - up_down[1]) / 2e-5
    old = {name: getattr(before, name).copy().reshape(-1) for name in ("out", "filters", "embed", "bias")}
    epochs, steps = langid.EPOCHS, langid.STEPS
    try:
        langid.EPOCHS = langid.STEPS = 1
        before.fit(windows, labels, batch=4, rate=1e-4)
    finally:
        langid.EPOCHS, langid.STEPS = epochs, steps
    moved = {(name, k): getattr(before, name).reshape(-1)[k] - old[name][k] for name, k in slopes}
    steep = [key for key, g in slopes.items() if abs(g) > 1e-4]
    assert len(steep) > 20 and np.mean([np.sign(moved[key]) == -np.sign(slopes[key]) for key in steep]) > 0.95  # Adam's first step is against the gradient's sign


def test_languages_of_odd_rows(spark):
    rows = [(1, "the same text of one id", "en", "s", 0)] * 4000 + [(i, f"ein anderer deutscher Satz {i}", "de", "s", 0) for i in range(2, 60)] + [(100, "lang " * 200_000, "de", "s", 0), (101, "½ ² Ⅷ ①", "en", "s", 0), (None, "text", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "learn": F.lit("x"), "lang_pred": F.lit("y"), "windows": F.lit(0)})
    out = langid.identify_languages(docs)
    assert out.count() == len(rows)
    assert out.where("doc_id = 101").head()["lang_pred"] == "und" and out.where("doc_id = 100").head()["lang_pred"] in ("de", "en")


def weighted_jaccard(a, b):
    a, b = (Counter(WORD.findall(x.lower())) for x in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_likeness_against_the_exact_similarity(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    order = sorted(texts)
    errors, signed = [], []
    for r in fingerprint.fingerprint_with_edits(table).collect():
        text = texts[r["doc_id"]]
        after = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(text) // 2
        for got, other in ((r["near_edited"], text[: len(text) - half] + after[:half]), (r["near_next"], after)):
            errors.append(abs(got - weighted_jaccard(text, other)))
            signed.append(got - weighted_jaccard(text, other))
    assert np.mean(errors) < 0.06 and max(errors) < 0.3 and abs(np.mean(signed)) < 0.02


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="top"><a href="/">Home</a> Site</header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, do accept them all please.</div><div class="sidebar">Other things that are worth your time</div>
<article><h1>Title &amp; more</h1><p><b>First   paragraph with some words in it.<br><p>Second&nbsp;one &lt;tag&gt; goes on.</p><!-- no --><form><input>Subscribe now</form><div class="ad">Buy this</div><p>Short.</p></article>
<section class="comments"><p>A reader says that this is a rather long and detailed comment on the article above.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark, empty):
    want = "Title & more First paragraph with some words in it. Second one <tag> goes on. Short."
    assert mainhtml.main_text(PAGE) == want
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>broken <b"), (5, "u", "<" * 50 + "article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in mainhtml.extract_main_text(rows).collect()}
    assert (out[1]["text"], out[1]["n_chars"]) == (want, len(want))
    assert out[2]["text"] == out[3]["text"] == "" and out[3]["n_chars"] == 0
    assert mainhtml.extract_main_text(rows.limit(0)).count() == 0


def test_main_text_of_hard_markup():
    said = mainhtml.main_text
    first, second = "One long paragraph with words here and there to read.", "Second long paragraph with words to read too."
    for silent in ('<svg class="i"/>', "<svg>", "<iframe>", "<noscript>", "<object>", "<title>"):
        assert said(f"<article><p>{first}</p>{silent}<p>{second}</p></article>") == f"{first} {second}", silent
    assert said(f"<article><p>{first}</p><svg><text>No</text></svg><noscript><p>No</p></noscript><p>{second}</p></article>") == f"{first} {second}"
    for marked in ('<p class="advert">', '<li class="menu-item">', '<h2 id="comments">', '<td role="navigation">', '<span class="share">', "<dd hidden>"):
        assert said(f"<article><p>{first}</p>{marked}Buy our great things here today.</{re.match('[a-z0-9]+', marked[1:])[0]}><p>{second}</p></article>") == f"{first} {second}", marked
    assert said("<article><a href=don't>Link</a><p>Don't lose this text.</p><p>It's here.</p></article>") == "Link Don't lose this text. It's here."
    assert said("a < b and c > d is a comparison of four numbers that everyone can read") == "a < b and c > d is a comparison of four numbers that everyone can read"
    assert said(f'<article><p>{first}<div class="ad">Buy</div>{second}</article>') == f"{first} {second}"
    assert said("<article><p>caf&eacute; &#233;&nbsp;x\n\ty</p></article>") == "café é x y"


@pytest.mark.parametrize("piece", ["<b x ", '<p class="x\' ', "<svg>", "<title>", "<div>", "</x>", "<!--", '<a href="', "<p>a<div class=ad>", "<script>", "&amp", "<li>text "])
def test_broken_markup_takes_linear_time(piece):
    began = time.perf_counter()
    mainhtml.main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20  # 1 MB; quadratic work would take hours


def test_cut_of_many_blocks():
    rng, n = random.Random(1), 40_000
    edges = [(i - 1, i, 3) for i in range(1, n)] + [(max(0, i - 2), i, 6) for i in range(2, n)]
    for costs in ([round(rng.uniform(-15, 15)) or -1 for _ in range(n)], [1 if i < n // 2 else -1 for i in range(n)], [5000] + [-1] * (n - 1)):
        began = time.perf_counter()
        assert len(mainhtml.minimum_cut(costs, edges)) == n
        assert time.perf_counter() - began < 20


def test_classifier_on_hosts_that_it_has_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host = F.pmod(F.crc32(F.regexp_extract("url", "://([^/]+)", 1)), F.lit(5))
    fitted = mainhtml.train(pages, host != 0)
    held = pages.where(host == 0).limit(300).collect()
    right = total = found = wanted = 0
    for r in held:
        for features, shape, content in mainhtml.labelled_blocks(r["html"]):
            odds = sum(fitted.weights.get(f, 0.0) for f in features) + float(fitted.shape @ shape)
            right, total = right + ((odds > 0) == content), total + 1
        truth = Counter(" ".join(b.text for b in mainhtml.blocks_of(r["html"]) if b.around.given > 0).split())
        got = Counter(mainhtml.main_text(r["html"], fitted).split())
        found, wanted, total_got = found + sum((truth & got).values()), wanted + sum(truth.values()), sum(got.values())
        assert total_got <= sum(truth.values())
    assert total > 2000 and right / total > 0.95
    assert found / wanted > 0.999


def test_a_class_word_is_learned():
    page = "<article>" + "<p>" + "some words of the article go on for a while and on " * 3 + "</p>" + '</article><div class="zqx">' + "other words that look quite the same as those do " * 3 + "</div>"
    fitted = mainhtml.Classifier().fit([mainhtml.labelled_blocks(page)] * 40)
    assert fitted.weights["zqx"] < -1
    assert mainhtml.main_text(page.replace("article>", "section>"), fitted).startswith("some words") and "other" not in mainhtml.main_text(page, fitted)


@pytest.mark.parametrize("depth", [5, 300, 5000])
@pytest.mark.parametrize("element", ['div class="box outer row"', "section"])
def test_depth_hides_nothing(depth, element):
    """An advert stays one however many elements and class words are around it."""
    name = element.split()[0]
    inner = "<p>" + "the words of the story go on for a good while " * 4 + '</p><div class="advert">buy the best lamps here today and save a lot of money at once</div><p>' + "and then the story goes on for a while and ends " * 4 + "</p>"
    began = time.perf_counter()
    text = mainhtml.main_text(f"<{element}>" * depth + inner + f"</{name}>" * depth)
    assert text.startswith("the words of the story") and text.endswith("and ends") and "lamps" not in text
    assert time.perf_counter() - began < 5


def test_class_words_that_only_the_fit_can_tell(spark):
    """With every word of class, id and role renamed, the classifier fitted on half of the pages cuts the other half as it does the originals."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    turn = str.maketrans("abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm")
    renamed = [re.sub(r'((?:class|id|role)=")([^"]*)', lambda m: m[1] + m[2].translate(turn), p) for p in pages]
    half = len(pages) // 2
    learn = []
    for page, other in zip(pages[:half], renamed[:half], strict=True):
        marks, blocks = mainhtml.labelled_blocks(page), mainhtml.labelled_blocks(other)
        if len(marks) == len(blocks):
            learn.append([(f, shape, content) for (f, shape, _), (_, _, content) in zip(blocks, marks, strict=True)])
    fitted, plain = mainhtml.Classifier().fit(learn), mainhtml.Classifier()
    words_of = lambda texts: Counter(w for t in texts for w in t.split())
    truth = words_of(mainhtml.main_text(p) for p in pages[half:])
    with_fit, without = (words_of(mainhtml.main_text(p, c) for p in renamed[half:]) for c in (fitted, plain))
    wrong = lambda got: sum((got - truth).values()) + sum((truth - got).values())
    assert wrong(with_fit) <= 0.01 * sum(truth.values())
    assert wrong(with_fit) < 0.5 * wrong(without) or wrong(without) == 0


def test_pages_of_one_id_do_not_gather(spark, monkeypatch):
    monkeypatch.setattr(mainhtml, "SAMPLE_PAGES", 7)
    rows = spark.createDataFrame([(1, "u", f"<article><p>Text {i}</p></article>") for i in range(50)] * 2, "page_id long, url string, html string")
    assert mainhtml.extract_main_text(rows).count() == 100
    long = "<article>" + "<p>word word</p>" * 60_000 + "</article>"
    out = mainhtml.extract_main_text(spark.createDataFrame([(1, "u", long), (1, "u", long)], "page_id long, url string, html string")).collect()
    assert [r["n_chars"] for r in out] == [60_000 * 10 - 1] * 2


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def price(labels, costs=costs, edges=edges):
            return sum(abs(c) for c, y in zip(costs, labels, strict=True) if (c > 0) != y and c) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(mainhtml.minimum_cut(costs, edges)) == pytest.approx(best)


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, kept = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == table.columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    want = brute_components([(i, t) for i, t in kept[0].items()])
    assert set(kept[1]) == {i for i, (_, root, _) in want.items() if root == i}
    digests = brute_repeats(list(kept[1].items()))
    for i, text in kept[2].items():
        assert digests[i][1] == 0 and text == kept[1][i] or hashlib.sha256(text.encode()).hexdigest() == digests[i][2]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert set(kept[3]) == {i for i, t in kept[2].items() if not any(x in plain(t) for x in items)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert len(last) == len(kept[3]) and all(r["round_trip"] for r in last)
    und = [r for r in table.collect() if not re.search(r"[^\W\d_]", r["text"] or "")]
    assert not {r["doc_id"] for r in und} & set(kept[0])
    assert table.count() - len(kept[0]) <= len(und) + 2


def test_pipeline_stages_on_odd_rows(spark, empty):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id that goes on for some words", "en", "s", 48), (5000, None, "en", None, None), (5001, "", None, "s", 0), (5002, "one more text that is there twice", "en", "s", 33), (5002, "one more text that is there twice", "en", "s", 33), (5003, "very long text " * 40_000, "en", "s", 600_000)], SCHEMA)
    docs = real.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == real.columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty(), name
    ids = [r["doc_id"] for r in docs.where("doc_id >= 5000 or doc_id is null").collect()]
    assert ids.count(5002) == 1 and ids.count(5000) == ids.count(5001) == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
