"""BM25 from counts made where the texts are read, against the joined postings."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import lexical, rank
from docquarry.plans import catalog
from docquarry.plans.views import questions, table

SF = "/root/testdata/sf0.001"


def scored(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_counts_give_the_scores_of_the_postings_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lexical, "HELD_SCORES", 200)
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "!"), (-4, "x")], "doc_id long, text string"))
    terms = lexical.query_terms(questions(spark, SF), "query")
    counted = lexical.Counted(docs, "doc_id", "text", terms)
    digits = lambda df: df.withColumn("bm25", F.round("bm25", 6))
    for few, idf, mean in ((terms, 0.25, None), (terms.where("length(term) > 3"), None, 100.0)):
        got = counted.scores(few, least_idf=idf, mean_length=mean)
        want = digits(lexical.bm25(docs, "doc_id", "text", few, least_idf=idf, mean_length=mean))
        assert scored(digits(got), "query_id", "doc_id", "bm25") == scored(want, "query_id", "doc_id", "bm25")
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        top = rank.rank_by(want, F.col("bm25")).where("rank <= 3")
        assert scored(counted.scores(few, least_idf=idf, mean_length=mean, best=3), "query_id", "rank", "doc_id", "bm25") == scored(top, "query_id", "rank", "doc_id", "bm25")
    assert counted.scores(terms.limit(0)).count() == 0 == counted.scores(terms.limit(0), best=3).count()
    none = lexical.Counted(docs, "doc_id", "text", terms.limit(0))
    assert none.scores(terms).count() == 0


def test_lists_are_normalised_without_a_shuffle_of_the_hits(spark):
    hits = spark.range(200).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") / 7).alias("bm25"))
    for how in ("minmax", "zscore", "softmax"):
        out = rank.normalize_list(hits, "bm25", how)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 200 and out.columns == ["query_id", "doc_id", "bm25", "normalized"]
    same = {r["normalized"] for r in rank.normalize_list(hits, "bm25", "minmax").where("query_id = 0").collect()}
    assert same == {1.5}


@pytest.mark.parametrize("how", ["minmax", "zscore", "softmax"])
def test_lists_are_normalised_where_they_are_scored(spark, monkeypatch, how):
    monkeypatch.setattr(lexical, "HELD_SCORES", 200)
    odd = [(-1, None), (-2, ""), (-3, "once"), (-4, "twice same"), (-5, "same twice")]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    asked = [(900, "once", 1), (901, "twice", 1), (902, "nowhere", 1)]  # a list of one text, a constant one, none
    terms = lexical.query_terms(questions(spark, SF), "query").where("term not in ('once', 'twice', 'same')").unionByName(spark.createDataFrame(asked, "query_id long, term string, times long"))
    counted = lexical.Counted(docs, "doc_id", "text", terms)
    got = {r[:2]: r[2] for r in counted.normalized(terms, how).select("query_id", "doc_id", "normalized").collect()}
    want = {r[:2]: r[2] for r in rank.normalize_list(counted.scores(terms, digits=6), "bm25", how).select("query_id", "doc_id", F.round("normalized", 6)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-6 for k in want)
    assert sum(got[k] != want[k] for k in want) <= 0.001 * len(want)  # sums in another order may tip a rounding
    assert {k for k in got if k[0] > 899} == {(900, -3), (901, -4), (901, -5)}
    assert counted.normalized(terms.limit(0), how).count() == 0


def test_a_text_is_cut_into_tokens_once(spark, monkeypatch):
    plans, frame = [], type(spark.range(0))
    through = frame.mapInArrow

    def seen(self, *a, **b):
        plans.append((out := through(self, *a, **b))._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(frame, "mapInArrow", seen)
    docs = spark.createDataFrame([(1, "a bb cc bb"), (2, None), (3, ""), (4, "a !"), (5, "dd")], "doc_id long, text string")
    terms = spark.createDataFrame([(7, "bb", 1)], "query_id long, term string, times long")
    counted = lexical.Counted(docs, "doc_id", "text", terms)
    assert plans[0].count("regexp_extract_all(") == 1
    assert sorted(tuple(r) for r in counted.rows.collect()) == [(1, 3, [0], [2]), (5, 1, [], [])]


def test_the_registered_lists_are_neither_joined_nor_rounded_again(spark):
    for name in ("g8_minmax", "g8_zscore", "g8_softmax"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "round(" not in plan and plan.count("MapInArrow") == 1


def test_shared_terms_without_a_cross_join(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, ["a", "c"]), (8, [])], "query_id long, terms array<string>")
    got = lexical.shared_terms(docs, "doc_id", lexical.tokenize("text"), asked)
    want = [(7, 1, 1, 2, 2), (7, 2, 0, 2, 0), (7, 3, None, 2, None), (7, 4, 1, 2, 1), (8, 1, 0, 0, 2), (8, 2, 0, 0, 0), (8, 3, None, 0, None), (8, 4, 0, 0, 1)]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
