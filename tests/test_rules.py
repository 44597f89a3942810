"""Rules with values worked out by hand, and rules whose SQL dialects differ held against Python's ``re``."""

import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import access, chunk, clean, question, rank, reconcile
from docquarry.sources import tables


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("scores", "words", "entities", "want"), [((1, 0, 0, 0), 2, 0, 0.2), ((0, 0, 0, 1), 2, 9, 0.5), ((1, 0, 0, 0), 5, 3, 0.5), ((0, 0, 1, 0), 20, 3, 0.2), ((0, 1, 0, 0), 11, 2, 0.4), ((0, 0, 0, 1), 11, 0, 0.1), ((0, 1, 0, 0), 5, 1, 0.3)])
def test_hybrid_weights(spark, scores, words, entities, want):
    row = spark.createDataFrame([tuple(map(float, scores))], "v double, b double, t double, s double")
    assert row.select(rank.hybrid_score("v", "b", "t", "s", F.lit(words), F.lit(entities))).head()[0] == pytest.approx(want)


@pytest.mark.parametrize(("text", "kind", "intent"), [
    ('say "x"', "structured", "search"), ("Which one", "question", "question"), ("this one?", "question", "question"), ("please get it", "search", "search"), ("schön", "multilingual", "search"),
    ("plain words", "simple", "search"), ("cats versus dogs", "simple", "comparison"), ("the meaning of it", "simple", "definition"), ("clarify this", "simple", "explanation"),
    ("show me all", "simple", "instruction"), ("an overview", "simple", "summarization"), ("whatever", "question", "question"), ("an isthmus", "simple", "search"), ("please say why? yes", "simple", "search"),
])
def test_types_and_intents(spark, text, kind, intent):
    assert one(spark, text, question.query_type("t")) == kind
    assert one(spark, text, question.intent("t")) == intent


def test_query_annotation(spark):
    assert one(spark, "What is the cost of it for you and me", question.keywords("t")) == ["cost", "you"]
    text = "see https://a.b/c?d me@x.org 2024-01-31 1/2/2024 3-4-2024 1,234.5"
    assert one(spark, text, question.entities("t")) == ["https://a.b/c?d", "me@x.org", "2024-01-31", "1/2/2024", "3-4-2024", "2024", "01", "31", "1", "2", "2024", "3", "4", "2024", "1,234.5"]
    # 19 characters, 4 words, 2 special characters, a question mark, 2 sentences.
    assert one(spark, "Is it so? I say no.", question.complexity("t")) == pytest.approx(0.3 * 0.19 + 0.2 * 6 / 20 + 0.2 * 2 / 10 + 0.1 + 0.2 * 3 / 5)
    assert one(spark, "x" * 500, question.complexity("t")) == pytest.approx(0.3 + 0.2 / 20)
    assert one(spark, "Now or last  week, recently; nowhere", question.temporal_flags("t")) == ["last_week", "recent", "current"]
    found = one(spark, "Cafe nearby in Paris at 12 Main Street", question.locations("t"))
    assert (found["near_me"], found["city"], found["country"], found["address"]) == (["nearby"], ["in Paris"], ["in Paris"], ["12 main street"])
    assert one(spark, "The Anna saw Bob and McDuck. 김철수가 왔다. 사람이 많은 곳", question.name_mentions("t")) == ["McDuck", "Anna", "김철수가", "Bob", "사람이"]


def test_names_and_places_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    for r in docs.select("text", question.name_mentions("text").alias("names"), question.locations("text").alias("p")).collect():
        names = set(re.findall(r"\b[A-Z][a-zA-Z]{1,15}\b", r["text"])) - set(question.NOT_LATIN_NAMES)
        assert r["names"] == sorted(names, key=lambda n: (-len(n), n))[:10]
        assert r["p"]["city"] == re.findall(r"\bin\s+[A-Z][a-z]+\b", r["text"])
        assert r["p"]["address"] == re.findall(r"\b\d+\s+[A-Za-z\s]+\b", r["text"].lower())


def test_feedback_keeps_other_scores(spark):
    history = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None)], "query_id long, success double")
    marks = spark.createDataFrame([(1, 1.0)], "query_id long, success double")
    assert {r["query_id"]: r["success"] for r in question.feedback(history, marks).collect()} == {1: 1.0, 2: 0.7, 3: None}


def test_cleaning_rules(spark):
    assert one(spark, "itâ€™s â€œsoâ€\x9d aÂ b", clean.fix_mojibake(F.col("t"))) == "it's \"so\" a b"
    assert one(spark, "#Head\n**b** *i* __u__ _v_ [l](u) ```c\nd``` `e`", clean.strip_markdown(F.col("t"))) == "Head\nb i u v l  e"
    assert one(spark, "a http://x.y/z b www.q c shop.COM/p d e.g f", clean.remove_urls(F.col("t"))) == "a  b  c  d e.g f"
    assert one(spark, "x" * 200_000, clean.remove_urls(F.col("t"))) == "x" * 200_000
    assert one(spark, "555-123-4567 5551234567 555 123 4567 +44 2071234567 x(555) 123-4567", clean.remove_phones(F.col("t"))) == "     x"  # of the international one the last part goes first
    assert one(spark, "123-45-6789 a@b.co 1111 2222-33334444", access.redact_content("t")) == "[SSN_REDACTED] [EMAIL_REDACTED] [CARD_REDACTED]"


def test_sentences():
    assert chunk.split_sentences("One two. Three four! Five six? Seven.", 20, 0, 1) == ["One two Three four", "Five six Seven."]
    assert chunk.split_sentences("One two. Three four! Five six? Seven.", 20, 5, 1) == ["One two Three four", "One two Three four. Five six", "One two Three four. Five six. Seven."]
    assert chunk.split_sentences("Aa. Bb.", 100, 0, 50) == []


def test_rights_of_any_depth_and_cycles(spark):
    roles = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(30)] + [("r30", None), ("a", "b"), ("b", "a")], "role string, parent string")
    grants = spark.createDataFrame([("r30", "top"), ("r0", "low"), ("a", "pa"), ("b", "pb")], "role string, permission string")
    held = spark.createDataFrame([(1, "r0", None), (2, "r15", None), (3, "a", None)], "user_id int, role string, expires timestamp")
    got = access.effective_permissions(held, roles, grants, "2024-01-01 00:00:00")
    assert {tuple(r) for r in got.collect()} == {(1, "top"), (1, "low"), (2, "top"), (3, "pa"), (3, "pb")}


def test_changes_with_nulls_and_colons(spark):
    old = spark.createDataFrame([(1, None, "x"), (2, "a:b", "c"), (3, "s", "t")], "id int, a string, b string")
    new = spark.createDataFrame([(1, "", "x"), (2, "a", "b:c"), (3, "s", "t")], "id int, a string, b string")
    assert {tuple(r) for r in reconcile.sync_diff(old, new, "id", ["a", "b"]).collect()} == {(1, "updated"), (2, "updated"), (3, "unchanged")}


def test_upsert_of_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (None, "m")], "k int, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {(1, "d"), (None, "m"), (2, "b")}


def test_queries_are_cleaned_by_the_whole_pipeline(spark):
    rows = spark.createDataFrame([(1, "<b>It’s</b> &amp; caf&eacute; — won't   ​GO \U0001f600"), (2, None), (3, "  "), (4, "“I'd”\tsay\r\n\r\n\r\nno")], "id int, q string")
    got = {r["id"]: r["cleaned"] for r in clean.clean_queries(rows, "q").collect()}
    assert got[1] == "it's & café -- will not go"
    assert got[2] is None and got[3] == ""
    assert got[4] == '"i would" say no'


def test_ranks_of_hits(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 4.0), (1, 11, 0.9, 0.0), (1, 12, 0.9, 0.0)], "query_id long, doc_id long, sim double, bm25 double")
    ranked = {r["doc_id"]: (round(r["ranking"], 6), r["rank"]) for r in rank.bm25_hybrid_rank(hits, "bm25", F.lit(4), "sim").collect()}
    assert ranked == {10: (0.7, 1), 11: (0.54, 2), 12: (0.54, 3)}
    assert {r["ranking"] for r in rank.bm25_hybrid_rank(hits, "bm25", F.lit(0), "sim").collect()} == {0.3, 0.54}
    dated = hits.select("query_id", "doc_id", "sim", F.when(F.col("doc_id") == 10, F.lit("2024-01-01").cast("timestamp")).alias("date"), F.lit("2024-01-31").cast("timestamp").alias("got"), F.lit(None).cast("long").alias("v"), F.lit(0).alias("l"), F.lit(0).alias("c"))
    ranked = {r["doc_id"]: r["ranking"] for r in rank.temporal_rank(dated, "sim", "date", "got", "2024-01-31 00:00:00", ("v", "l", "c")).collect()}
    assert ranked[10] == pytest.approx(0.3 + 0.2 * 2.718281828**-1) and ranked[11] == pytest.approx(0.54 + 0.2)


def test_expansion_by_types_and_phrases(spark):
    asked = spark.createDataFrame([(1, "red fox jumps", ["red fox", "fox jumps"], ["DATE", "NONE", "DATE"]), (2, "of it", [], None)], "query_id long, q string, phrases array<string>, types array<string>")
    assert sorted((r["query_id"], r["term"], r["weight"]) for r in question.type_terms(asked, "types").collect()) == [(1, t, 0.7) for t in ("period", "schedule", "time", "when")]
    terms = spark.createDataFrame([(1, "vixen", 0.8, "synonym"), (1, "red", 1.0, "original"), (1, "low", 0.1, "synonym")], "query_id long, term string, weight double, kind string")
    got = {r["query_id"]: r["expanded"] for r in question.expanded_query(asked, terms, "q", phrases="phrases").collect()}
    assert got == {1: "red fox jumps red fox fox jumps vixen", 2: "of it"}
    assert question.expanded_query(asked.where("query_id = 1"), terms, "q", most=20, phrases="phrases").head()["expanded"] == "red fox jumps red"
