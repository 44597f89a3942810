"""Annotation and expansion of query texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import tokenize

# Words and patterns that mark a query's kind, intent, times and places, and words that tell nothing.
TYPE_QUESTION_WORDS = ("what", "how", "why", "when", "where", "who", "which")
SEARCH_WORDS = ("find", "search", "look for", "get", "retrieve")
QUESTION_STARTS = (
    "what", "how", "why", "when", "where", "who", "which", "whose", "can", "could", "would", "should", "will", "do", "does", "did",
    "is", "are", "was", "were",
)
COMPARISONS = ("vs", "versus", "compare", "difference", "better", "worse", "more", "less", "than", "between")
DEFINITIONS = ("what is", "what are", "define", "definition", "meaning", "explain", "describe")
EXPLANATIONS = ("how does", "why does", "explain", "describe", "detail", "elaborate", "clarify")
INSTRUCTION_STARTS = ("how to", "tell me", "show me", "help me", "teach me", "guide me", "instruct", "demonstrate")
SUMMARIES = ("summarize", "summary", "overview", "brief", "outline", "key points", "main points")
KEYWORD_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "what", "how", "when", "where", "why", "who", "which",
)
TEMPORAL = {
    "today": r"\btoday\b", "yesterday": r"\byesterday\b", "tomorrow": r"\btomorrow\b", "last_week": r"\blast\s+week\b",
    "next_week": r"\bnext\s+week\b", "last_month": r"\blast\s+month\b", "next_month": r"\bnext\s+month\b",
    "last_year": r"\blast\s+year\b", "next_year": r"\bnext\s+year\b", "recent": r"\brecent\b|\brecently\b",
    "current": r"\bcurrent\b|\bnow\b",
}
NEAR_ME, CITY, ADDRESS = r"\bnear\s+me\b|\bnearby\b", r"\bin\s+[A-Z][a-z]+\b", r"\b\d+\s+[A-Za-z\s]+\b"
_URL, _MAIL = r"https?://[^\s<>\"{}|\\^`\[\]]+", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_DATES = (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{1,2}-\d{1,2}-\d{4}\b")
_NUMBER = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"
HANGUL_NAME, LATIN_NAME = r"([가-힣]{2,4})(?=[이가는을를에게서와과]?\s)", r"\b[A-Z][a-zA-Z]{1,15}\b"
NOT_HANGUL_NAMES = tuple(
    """그것 이것 저것 무엇 여기 저기 거기 어디 언제 어떻게 왜 누구 무엇 어느 몇 많은 작은 큰 새로운 오래된 좋은 나쁜 빠른 느린
    하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉 열 시간 장소 사람 물건 일 날 밤 아침 저녁 마을 도시 나라 세상 하늘 땅 바다 산 강
    학교 집 회사 상점 병원 은행 역 공항 어제 오늘 내일 지금 나중 처음 마지막 정말 진짜 아마 분명 아직 벌써 다시 또
    한번 두번 세번 여러번 항상 가끔 자주 드물게 모든 어떤 이런 저런 그런 다른 같은 비슷한""".split()
)
NOT_LATIN_NAMES = tuple(
    """The And But For Not You All Can Had Her Was One Our Out Day Get Has Him His How Man New Now Old See Two Way Who Boy Did
    Its Let Put She Too Use Sir May Say God Yes No Ok Oh Ah Eh Um Er Mm Hmm""".split()
)
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may")
SCRIPTS = (("ko", r"[\x{AC00}-\x{D7A3}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"), ("ja", r"[\x{3040}-\x{30FF}]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("el", r"[\x{0370}-\x{03FF}]"), ("he", r"[\x{0590}-\x{05FF}]"), ("ar", r"[\x{0600}-\x{06FF}]"))


def query_text(c: str) -> Column:
    """Plain text, or the query, text or question of a JSON object."""
    return F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("query", "text", "question")], F.col(c))


def validation(c: str, most: int = 2048) -> Column:
    """Null for a valid query, else what is wrong."""
    return F.when(F.col(c).isNull() | (F.trim(c) == ""), "empty query").when(F.length(c) > most, "query too long")


def _has(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(low, F.lit(m)) for m in marks])


def _begins(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, [F.startswith(low, F.lit(m)) for m in marks])


def query_type(c: str) -> Column:
    """Structured marks, then a question word at the start or a question mark at the end, search words, letters beyond ASCII."""
    low, col = F.lower(c), F.col(c)
    asks = _begins(low, TYPE_QUESTION_WORDS) | F.endswith(col, F.lit("?"))
    return F.when(col.rlike(r'[{}:"]'), "structured").when(asks, "question").when(_has(low, SEARCH_WORDS), "search").when(col.rlike(r"[^\x00-\x7F]"), "multilingual").otherwise("simple")


def intent(c: str) -> Column:
    """The first intent whose marks the query has; questions and instructions by how it begins, or by a question mark at the end."""
    low = F.lower(c)
    out = F.when(_begins(low, QUESTION_STARTS) | F.endswith(F.col(c), F.lit("?")), "question").when(_has(low, COMPARISONS), "comparison").when(_has(low, DEFINITIONS), "definition")
    return out.when(_has(low, EXPLANATIONS), "explanation").when(_begins(low, INSTRUCTION_STARTS), "instruction").when(_has(low, SUMMARIES), "summarization").otherwise("search")


def script_language(c: str) -> Column:
    """By script; Chinese characters win over kana, so Japanese with kanji is ``zh``."""
    out = F.lit("en")
    for lang, pattern in reversed(SCRIPTS):
        out = F.when(F.col(c).rlike(pattern), lang).otherwise(out)
    return out


def entities(c: str) -> Column:
    """Addresses, mails, dates in three shapes, and numbers, in this order."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (_URL, _MAIL, *_DATES, _NUMBER)])


def keywords(c: str) -> Column:
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*KEYWORD_STOP_WORDS))
    return F.array_distinct(words)


def complexity(c: str) -> Column:
    """0 to 1: 0.3 for 100 characters, 0.2 for 20 words, 0.2 for 10 special characters, 0.1 for a question mark, 0.2 for 5 sentences."""
    count = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    share = lambda n, of, most: F.least(n / float(of), F.lit(1.0)) * most
    sentences = count(r"[.!?]+") + 1
    marks = F.when(F.contains(c, F.lit("?")), 0.1).otherwise(0.0) + F.when(sentences > 1, share(sentences, 5, 0.2)).otherwise(0.0)
    return F.least(F.lit(1.0), share(F.length(c), 100, 0.3) + share(count(r"\S+"), 20, 0.2) + share(count(r"[^\p{L}\p{N}_\p{Z}\s]"), 10, 0.2) + marks)


def temporal_flags(c: str) -> Column:
    """Names of the temporal marks that a query has."""
    return F.filter(F.array(*[F.when(F.lower(c).rlike(p), F.lit(n)) for n, p in TEMPORAL.items()]), lambda x: x.isNotNull())


def locations(c: str) -> Column:
    """``near_me``, ``city``, ``country`` and ``address``: what the query says of places.  Cities and countries look alike; they need capitals, so the query's own case counts."""
    every = lambda text, p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    cities = every(F.col(c), CITY)
    return F.struct(every(F.lower(c), NEAR_ME).alias("near_me"), cities.alias("city"), cities.alias("country"), every(F.lower(c), ADDRESS).alias("address"))


def duplicate_queries(queries: DataFrame, c: str) -> DataFrame:
    return queries.groupBy(F.left(F.sha2(F.col(c), 256), F.lit(16)).alias("query_hash")).agg(F.count("*").alias("times")).where("times > 1")


def name_mentions(c: str, most: int = 10) -> Column:
    """Capitalised words of 2 to 16 letters and Korean names before a particle, without common words, longest first, then by text.

    Names in quoted speech are among the text's names, so speech needs no rule of its own.
    """
    found = F.concat(F.regexp_extract_all(c, F.lit(LATIN_NAME), F.lit(0)), F.regexp_extract_all(c, F.lit(HANGUL_NAME), F.lit(1)))
    names = F.array_distinct(F.array_except(found, F.array(*[F.lit(s) for s in (*NOT_LATIN_NAMES, *dict.fromkeys(NOT_HANGUL_NAMES))])))
    order = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.slice(F.transform(order, lambda x: x["n"]), 1, most)


# -- expansion: long tables query_id, term, weight, kind, source ------------------------------------


def _terms(rows: DataFrame, weight: Column, kind: str) -> DataFrame:
    return rows.select("query_id", "term", weight.cast("double").alias("weight"), F.lit(kind).alias("kind"))


def base_terms(queries: DataFrame, c: str) -> DataFrame:
    words = F.array_distinct(F.filter(tokenize(c, 2), lambda w: ~w.isin(*STOP_WORDS)))
    return _terms(queries.select("query_id", F.explode(words).alias("term")), F.lit(1.0), "original")


def synonym_terms(base: DataFrame, synonyms: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` synonyms of each term; ``synonyms(term, synonym)`` is a user's table."""
    hits = base.select("query_id", "term").join(F.broadcast(synonyms), "term")
    line = Window.partitionBy("query_id", "term").orderBy("synonym")
    return _terms(hits.withColumn("n", F.row_number().over(line)).where(F.col("n") <= most).select("query_id", F.col("synonym").alias("term")).distinct(), F.lit(0.8 * 0.8), "synonym")


def neighbour_terms(pairs: DataFrame, most: int, least: float = 0.6) -> DataFrame:
    """Terms near in meaning: ``pairs(query_id, term, score)`` from a vector search over term embeddings."""
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "term")
    near = pairs.where(F.col("score") >= least).withColumn("n", F.row_number().over(line)).where(F.col("n") <= most // 2)
    return _terms(near, F.col("score") * 0.7, "semantic")


# Terms that go with the type of an entity.
TYPE_TERMS = {
    "PERSON": ("individual", "people", "person", "human"), "ORG": ("company", "organization", "business", "corporation"), "GPE": ("location", "place", "country", "city"),
    "MONEY": ("cost", "price", "amount", "value"), "DATE": ("time", "period", "when", "schedule"), "PRODUCT": ("item", "goods", "service", "offering"),
}


def type_terms(queries: DataFrame, types: str) -> DataFrame:
    """Terms that go with each distinct entity type of a query (an array column, from whatever finds entities), weight 0.7."""
    known = F.create_map(*[x for name, terms in TYPE_TERMS.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in terms]))])
    each = F.flatten(F.transform(F.array_distinct(types), lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>"))))
    return _terms(queries.select("query_id", F.explode(each).alias("term")), F.lit(0.7), "entity_type")


def entity_terms(queries: DataFrame, found: str, words: str) -> DataFrame:
    first = lambda c, w, k: _terms(queries.select("query_id", F.explode(F.slice(c, 1, 5)).alias("term")).select("query_id", F.lower("term").alias("term")).distinct(), F.lit(w), k)
    return first(found, 0.8, "entity").unionByName(first(words, 0.7, "keyword"))


def context_terms(hits: DataFrame, content: str, documents: int = 10, most: int = 10) -> DataFrame:
    """Most frequent terms of the first documents; weight min(0.8, 10 * share)."""
    words = hits.where(F.col("rank") <= documents).select("query_id", F.explode(tokenize(content, 3)).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
    counts = words.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    line = Window.partitionBy("query_id").orderBy(F.desc("n"), "term")
    top = counts.withColumns({"total": total, "place": F.row_number().over(line)}).where(F.col("place") <= most)
    return _terms(top, F.least(F.lit(0.8), F.col("n") / F.col("total") * 10), "context")


def personal_terms(history: DataFrame, as_of: str, days: int = 30, least_queries: int = 5, share: float = 0.2, most: int = 5) -> DataFrame:
    """``user_id, term, weight``: terms of more than ``share`` of a user's recent successful queries; ``history(user_id, query, score, timestamp)``."""
    recent = history.where(F.col("timestamp") >= F.expr(f"timestamp'{as_of}' - interval {days} days"))
    users = recent.groupBy("user_id").agg(F.count("*").alias("asked"), F.count_if(F.col("score") > 0.7).alias("good")).where(F.col("asked") >= least_queries)
    words = recent.where("score > 0.7").select("user_id", F.explode(F.array_distinct(tokenize("query", 3))).alias("term")).groupBy("user_id", "term").agg(F.count("*").alias("n"))
    line = Window.partitionBy("user_id").orderBy(F.desc("n"), "term")
    rates = words.join(users, "user_id").withColumn("rate", F.col("n") / F.col("good")).where(F.col("rate") > share)
    return rates.withColumn("place", F.row_number().over(line)).where(F.col("place") <= most).select("user_id", "term", (F.col("rate") * 0.6).alias("weight"))


def merged_terms(parts: list[DataFrame]) -> DataFrame:
    """One row for each term of a query; the first part that has it wins."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    line = Window.partitionBy("query_id", "term").orderBy("_part", F.desc("weight"))
    return every.withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n", "_part")


def optimised_weights(terms: DataFrame, query: str) -> DataFrame:
    """Mean of a term's weight and its share of the query's term vector; phrases count 1.2 times; rescaled to 2 at most.  ``query`` is a column of the terms."""
    by = Window.partitionBy("query_id")
    tf = F.size(F.filter(tokenize(query), lambda t: t == F.col("term")))
    out = terms.withColumn("_tf", tf).withColumn("_norm", F.sqrt(F.sum(F.col("_tf") * F.col("_tf")).over(by)))
    out = out.withColumn("weight", (F.col("weight") + F.when(F.col("_norm") > 0, F.col("_tf") / F.col("_norm")).otherwise(0.0)) / 2 * F.when(F.contains("term", F.lit(" ")), 1.2).otherwise(1.0))
    top = F.max("weight").over(by)
    return out.withColumn("_top", top).withColumn("weight", F.when(F.col("_top") > 2, F.col("weight") * 2 / F.col("_top")).otherwise(F.col("weight"))).drop("_tf", "_norm", "_top")


def expanded_query(queries: DataFrame, terms: DataFrame, query: str, least: float = 0.7, most_terms: int = 10, most: int = 500, phrases: str | None = None) -> DataFrame:
    """The query, its phrases (an array column of ``queries``) and its best further terms, cut at a word boundary."""
    picked = terms.where((F.col("weight") >= least) & (F.col("kind") != "original")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))).alias("t"))
    said = [F.col(phrases)] if phrases else []
    text = F.regexp_replace(F.concat_ws(" ", F.col(query), *said, F.array_join(F.slice("t.term", 1, most_terms), " ")), r"\s+", " ")
    cut = F.when(F.length("expanded") > most, F.regexp_replace(F.left("expanded", F.lit(most)), r"\s+\S*$", "")).otherwise(F.col("expanded"))
    return queries.join(picked, "query_id", "left").withColumn("expanded", F.trim(text)).select("query_id", cut.alias("expanded"))


def reordered(queries: DataFrame, terms: DataFrame, query: str) -> DataFrame:
    """Words by weight plus a bonus for early positions; ties keep their order."""
    words = queries.select("query_id", F.posexplode(F.split(query, r"\s+")).alias("pos", "word"))
    scored = words.join(terms.select("query_id", F.col("term").alias("_term"), "weight"), (words.query_id == terms.query_id) & (F.lower("word") == F.col("_term")), "left").select(words.query_id, "pos", "word", (F.coalesce("weight", F.lit(0.5)) + 0.1 / (F.col("pos") + 1)).alias("s"))
    line = scored.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.round("s", 9)).alias("s"), "pos", "word"))).alias("w"))
    return line.select("query_id", F.array_join("w.word", " ").alias("reordered"))


def phrases(c: str) -> Column:
    """Neighbouring words without stop words, as pairs."""
    t = tokenize(c)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.when(~a.isin(*STOP_WORDS) & ~b.isin(*STOP_WORDS) & (F.length(a) > 1) & (F.length(b) > 1), F.concat(a, F.lit(" "), b)))
    return F.filter(pairs, lambda x: x.isNotNull())


def feedback(history: DataFrame, marks: DataFrame) -> DataFrame:
    """History rows with the success scores of matching feedback; others keep theirs.  ``marks(query_id, success)`` has one row for each query."""
    own = F.col("success") if "success" in history.columns else F.lit(None)
    new = marks.select("query_id", F.col("success").alias("_new"))
    return history.withColumn("success", own).join(new, "query_id", "left").withColumn("success", F.coalesce("_new", "success")).drop("_new")
