"""Queries over query texts: annotation and expansion."""

from pyspark.sql import functions as F

from ..operators import question as Q
from .registry import query
from .views import QUESTIONS, messages, questions, table

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_STOP = "(" + ", ".join(f"'{w}'" for w in Q.STOP_WORDS) + ")"


def _users(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


_USERS = "FROM conversations WHERE role = 'user'"


@query("SELECT event_id, coalesce(json_extract_string(j, '$.query'), j) AS q FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"query\": \"' || event_type || '\"}' ELSE event_type END AS j FROM events WHERE event_id % 2 = 0) UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 <> 0")
def h1_query_text(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"query": "'), "event_type", F.lit('"}'))).otherwise(F.col("event_type")).alias("j"))
    return e.select("event_id", Q.query_text("j").alias("q"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty query' WHEN length(text) > 2048 THEN 'query too long' END AS problem FROM documents")
def h2_validation(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.validation("text").alias("problem"))


def _starts(words):
    return " OR ".join(f"starts_with(lower(text), '{w}')" for w in words.split(","))


def _holds(words):
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words.split(","))


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[{{}}:"]') THEN 'structured' WHEN {_starts("what,how,why,when,where,who,which")} OR suffix(text, '?') THEN 'question'
    WHEN {_holds("find,search,look for,get,retrieve")} THEN 'search' WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'multilingual' ELSE 'simple' END AS kind {_USERS}"""
)
def h3_query_type(spark, d):
    return _users(spark, d).select("conv_id", "turn", Q.query_type("text").alias("kind"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN {_starts("what,how,why,when,where,who,which,whose,can,could,would,should,will,do,does,did,is,are,was,were")} OR suffix(text, '?') THEN 'question'
    WHEN {_holds("vs,versus,compare,difference,better,worse,more,less,than,between")} THEN 'comparison' WHEN {_holds("what is,what are,define,definition,meaning,explain,describe")} THEN 'definition'
    WHEN {_holds("how does,why does,explain,describe,detail,elaborate,clarify")} THEN 'explanation' WHEN {_starts("how to,tell me,show me,help me,teach me,guide me,instruct,demonstrate")} THEN 'instruction'
    WHEN {_holds("summarize,summary,overview,brief,outline,key points,main points")} THEN 'summarization' ELSE 'search' END AS intent {_USERS}"""
)
def h4_intent(spark, d):
    return _users(spark, d).select("conv_id", "turn", Q.intent("text").alias("intent"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{lang}'" for lang, p in Q.SCRIPTS) + f" ELSE 'en' END AS lang {_USERS}")
def h5_script_language(spark, d):
    return _users(spark, d).select("conv_id", "turn", Q.script_language("text").alias("lang"))


@query(r"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(text, 'https?://[^\s<>"{}|\\^`[\]]+'), regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'), regexp_extract_all(text, '\b\d{1,2}/\d{1,2}/\d{4}\b'), regexp_extract_all(text, '\b\d{1,2}-\d{1,2}-\d{4}\b'), regexp_extract_all(text, '\b\d+(?:,\d{3})*(?:\.\d+)?\b')), '|') AS found FROM documents""")
def h6_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.entities("text"), "|").alias("found"))


@query(rf"WITH {QUESTIONS}, w AS (SELECT query_id, unnest(string_split_regex(lower(query), '\s+')) AS w, generate_subscripts(string_split_regex(lower(query), '\s+'), 1) AS p FROM v_query), f AS (SELECT query_id, w, min(p) AS p FROM w WHERE length(w) > 2 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','to','was','will','with','what','how','when','where','why','who','which') GROUP BY 1, 2) SELECT query_id, string_agg(w, ' ' ORDER BY p) AS words FROM f GROUP BY 1")
def h7_keywords(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.keywords("query"), " ").alias("words")).where("words <> ''")


@query(r"SELECT conv_id, turn, round(least(1.0, 0.3 * least(length(text) / 100.0, 1.0) + 0.2 * least(len(regexp_extract_all(text, '[^\s]+')) / 20.0, 1.0) + 0.2 * least(len(regexp_extract_all(text, '[^\p{L}\p{N}_\p{Z}\s]')) / 10.0, 1.0) + CASE WHEN contains(text, '?') THEN 0.1 ELSE 0.0 END + CASE WHEN regexp_matches(text, '[.!?]') THEN 0.2 * least((len(regexp_extract_all(text, '[.!?]+')) + 1) / 5.0, 1.0) ELSE 0.0 END), 6)::DOUBLE AS complexity " + _USERS)
def h8_complexity(spark, d):
    return _users(spark, d).select("conv_id", "turn", F.round(Q.complexity("text"), 6).alias("complexity"))


_EDGE = (r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])")
_TIMES = {"today": "today", "yesterday": "yesterday", "tomorrow": "tomorrow", **{f"{a}_{b}": rf"{a}\s+{b}" for b in ("week", "month", "year") for a in ("last", "next")}, "recent": "(recent|recently)", "current": "(current|now)"}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_EDGE[0]}{p}{_EDGE[1]}') THEN '{n}' END" for n, p in _TIMES.items()) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def h9_temporal_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.temporal_flags("text"), ",").alias("flags"))


@query()  # the dialects differ in what stands beside a word; tests hold it against Python's
def h10_locations(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.locations("text").alias("p")).select("doc_id", *[F.array_join(f"p.{k}", ",").alias(k) for k in ("near_me", "city", "country", "address")])


@query("SELECT left(sha256(text), 16) AS query_hash, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1")
def h11_duplicate_queries(spark, d):
    return Q.duplicate_queries(table(spark, d, "documents"), "text")


@query()  # the dialects differ in what stands beside a word; tests hold it against Python's
def h12_name_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(Q.name_mentions("text"), ",").alias("names")).where("names <> ''")


_BASE = f"b AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM v_query) WHERE length(term) >= 2 AND term NOT IN {_STOP})"


@query(f"WITH {QUESTIONS}, {_BASE} SELECT query_id, term, 1.0::DOUBLE AS weight FROM b")
def i1_base_terms(spark, d):
    return Q.base_terms(questions(spark, d), "query").drop("kind")


_SYNONYMS = [("that", "which"), ("that", "who"), ("erent", "erens"), ("re", "ren"), ("there", "yonder")]


def _synonyms(spark):
    return spark.createDataFrame(_SYNONYMS, "term string, synonym string")


_SYN = f"{QUESTIONS}, {_BASE}, s(term, synonym) AS (VALUES " + ", ".join(str(x) for x in _SYNONYMS) + ")"


@query(f"WITH {_SYN} SELECT DISTINCT query_id, synonym AS term, round(0.8 * 0.8, 6)::DOUBLE AS weight FROM b JOIN s USING (term)")
def i2_synonym_terms(spark, d):
    return Q.synonym_terms(Q.base_terms(questions(spark, d), "query"), _synonyms(spark)).drop("kind").withColumn("weight", F.round("weight", 6))


@query(rf"""WITH {QUESTIONS}, w AS (SELECT query_id, unnest(string_split_regex(lower(query), '\s+')) AS w, generate_subscripts(string_split_regex(lower(query), '\s+'), 1) AS p FROM v_query), f AS (SELECT query_id, w, min(p) AS p FROM w WHERE length(w) > 2 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','to','was','will','with','what','how','when','where','why','who','which') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS n FROM f), x AS (SELECT query_id, list_concat(regexp_extract_all(query, 'https?://[^\s<>"{{}}|\\^`[\]]+'), regexp_extract_all(query, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}\b'), regexp_extract_all(query, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), regexp_extract_all(query, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b'), regexp_extract_all(query, '\b\d{{1,2}}-\d{{1,2}}-\d{{4}}\b'), regexp_extract_all(query, '\b\d+(?:,\d{{3}})*(?:\.\d+)?\b')) AS found FROM v_query)
    SELECT query_id, w AS term, 0.7::DOUBLE AS weight FROM r WHERE n <= 5 UNION ALL SELECT query_id, term, 0.8::DOUBLE FROM (SELECT DISTINCT query_id, lower(unnest(found[1:5])) AS term FROM x)""")
def i4_entity_terms(spark, d):
    q = questions(spark, d).select("query_id", Q.entities("query").alias("e"), Q.keywords("query").alias("k"))
    return Q.entity_terms(q, "e", "k").drop("kind")


@query("""WITH t(name, terms) AS (VALUES ('PERSON', ['individual', 'people', 'person', 'human']), ('ORG', ['company', 'organization', 'business', 'corporation']), ('DATE', ['time', 'period', 'when', 'schedule'])), q AS (SELECT item_id AS query_id, unnest(CASE item_id % 3 WHEN 0 THEN ['PERSON'] WHEN 1 THEN ['ORG', 'DATE'] ELSE ['OTHER'] END) AS name FROM benchmark)
    SELECT query_id, unnest(terms) AS term, 0.7::DOUBLE AS weight FROM q JOIN t USING (name)""")
def i4_type_terms(spark, d):
    kind = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("PERSON"), F.lit("PERSON"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("ORG"), F.lit("DATE"))).otherwise(F.array(F.lit("OTHER")))
    return Q.type_terms(questions(spark, d).select("query_id", kind.alias("types")), "types").drop("kind")


@query(f"""WITH {QUESTIONS}, t AS (SELECT query_id, {_TOKENS.format('query')} AS t FROM v_query), p AS (SELECT query_id, i, t[i] AS a, t[i + 1] AS b FROM (SELECT query_id, t, unnest(range(1, len(t))) AS i FROM t)),
    g AS (SELECT query_id, string_agg(a || ' ' || b, ' ' ORDER BY i) AS said FROM p WHERE a NOT IN {_STOP} AND b NOT IN {_STOP} AND length(a) > 1 AND length(b) > 1 GROUP BY 1), {_BASE}, s(term, synonym) AS (VALUES {", ".join(str(x) for x in _SYNONYMS)}),
    e AS (SELECT query_id, string_agg(DISTINCT synonym, ' ' ORDER BY synonym) AS more FROM b JOIN s USING (term) WHERE synonym NOT IN (SELECT term FROM b c WHERE c.query_id = b.query_id) GROUP BY 1)
    SELECT query_id, trim(query || ' ' || coalesce(said || ' ', '') || coalesce(more, '')) AS expanded FROM v_query LEFT JOIN g USING (query_id) LEFT JOIN e USING (query_id)""")
def i9_expanded_with_phrases(spark, d):
    asked = questions(spark, d).withColumn("phrases", Q.phrases("query"))
    return Q.expanded_query(asked, _merged(spark, d), "query", least=0.6, most=1_000_000, phrases="phrases")


# Every document is a hit of the question of its language's and source's group, in the order of its length.
_CONTEXT = f"""w AS (SELECT query_id, unnest({_TOKENS.format('text')}) AS term FROM (SELECT lang || source AS query_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 10),
    c AS (SELECT query_id, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN {_STOP} GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS p FROM c)"""


@query(f"WITH {_CONTEXT} SELECT query_id, term, round(least(0.8, n::DOUBLE / total * 10), 6) AS weight FROM r WHERE p <= 10")
def i5_context_terms(spark, d):
    from pyspark.sql import Window

    line = Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")
    hits = table(spark, d, "documents").select(F.concat("lang", "source").alias("query_id"), "text", F.row_number().over(line).alias("rank"))
    return Q.context_terms(hits, "text").drop("kind").withColumn("weight", F.round("weight", 6))


@query(f"""WITH h AS (SELECT conv_id % 7 AS user_id, text AS query, (turn % 4) / 3.0 AS score, to_timestamp(1704067200 + conv_id * 1000 + turn)::TIMESTAMP AS timestamp FROM conversations WHERE role = 'user'), r AS (SELECT * FROM h WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 DAYS),
    u AS (SELECT user_id, count(*) FILTER (score > 0.7) AS good FROM r GROUP BY 1 HAVING count(*) >= 5), w AS (SELECT user_id, term, count(*) AS n FROM (SELECT user_id, unnest(list_distinct(list_filter({_TOKENS.format('query')}, lambda t: length(t) >= 3))) AS term FROM r WHERE score > 0.7) GROUP BY 1, 2),
    t AS (SELECT user_id, term, n::DOUBLE / good AS rate, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, term) AS p FROM w JOIN u USING (user_id) WHERE n::DOUBLE / good > 0.2) SELECT user_id, term, round(rate * 0.6, 6) AS weight FROM t WHERE p <= 5""")
def i6_personal_terms(spark, d):
    m = messages(spark, d).where("role = 'user'")
    history = m.select("user_id", F.col("text").alias("query"), ((F.col("turn") % 4) / 3.0).alias("score"), "timestamp")
    return Q.personal_terms(history, "2024-01-20 00:00:00").withColumn("weight", F.round("weight", 6))


def _merged(spark, d):
    base = Q.base_terms(questions(spark, d), "query")
    return Q.merged_terms([base, Q.synonym_terms(base, _synonyms(spark))])


_MERGED = f"{_SYN}, m AS (SELECT query_id, term, max(weight) AS weight FROM (SELECT query_id, term, 1.0::DOUBLE AS weight FROM b UNION ALL SELECT query_id, synonym, 0.64::DOUBLE FROM b JOIN s USING (term)) GROUP BY 1, 2)"


@query(f"WITH {_MERGED} SELECT query_id, term, round(weight, 6) AS weight FROM m")
def i7_merged_terms(spark, d):
    return _merged(spark, d).select("query_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_MERGED}, t AS (SELECT m.query_id, term, weight, len(list_filter({_TOKENS.format('query')}, lambda x: x = term)) AS tf FROM m JOIN v_query USING (query_id)), n AS (SELECT *, sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS norm FROM t)
    SELECT query_id, term, round((weight + CASE WHEN norm > 0 THEN tf / norm ELSE 0.0 END) / 2, 6) AS weight FROM n""")
def i8_optimised_weights(spark, d):
    terms = _merged(spark, d).join(F.broadcast(questions(spark, d)), "query_id")
    return Q.optimised_weights(terms, "query").select("query_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_SYN}, e AS (SELECT query_id, string_agg(DISTINCT synonym, ' ' ORDER BY synonym) AS more FROM b JOIN s USING (term) WHERE synonym NOT IN (SELECT term FROM b c WHERE c.query_id = b.query_id) GROUP BY 1) SELECT query_id, trim(query || ' ' || coalesce(more, '')) AS expanded FROM v_query LEFT JOIN e USING (query_id)")
def i9_expanded_query(spark, d):
    return Q.expanded_query(questions(spark, d), _merged(spark, d), "query", least=0.6)


@query(rf"""WITH {QUESTIONS}, {_BASE}, w AS (SELECT query_id, unnest(string_split_regex(query, '\s+')) AS w, generate_subscripts(string_split_regex(query, '\s+'), 1) - 1 AS p FROM v_query), s AS (SELECT w.query_id, w, p, CASE WHEN term IS NULL THEN 0.5 ELSE 1.0 END + 0.1 / (p + 1) AS s FROM w LEFT JOIN b ON w.query_id = b.query_id AND lower(w) = term)
    SELECT query_id, string_agg(w, ' ' ORDER BY round(s, 9) DESC, p) AS reordered FROM s GROUP BY 1""")
def i10_reordered(spark, d):
    return Q.reordered(questions(spark, d), Q.base_terms(questions(spark, d), "query"), "query")


@query(f"""WITH {QUESTIONS}, t AS (SELECT query_id, {_TOKENS.format('query')} AS t FROM v_query), p AS (SELECT query_id, i, t[i] AS a, t[i + 1] AS b FROM (SELECT query_id, t, unnest(range(1, len(t))) AS i FROM t))
    SELECT query_id, string_agg(a || ' ' || b, ',' ORDER BY i) AS phrases FROM p WHERE a NOT IN {_STOP} AND b NOT IN {_STOP} AND length(a) > 1 AND length(b) > 1 GROUP BY 1""")
def i11_phrases(spark, d):
    return questions(spark, d).select("query_id", F.array_join(Q.phrases("query"), ",").alias("phrases")).where("phrases <> ''")


@query("SELECT item_id AS query_id, coalesce(quality, item_id % 3)::INTEGER AS success FROM benchmark LEFT JOIN labels ON item_id = doc_id")
def i12_feedback(spark, d):
    history = questions(spark, d).withColumn("success", (F.col("query_id") % 3).cast("int"))
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").cast("int").alias("success"))
    return Q.feedback(history, marks).select("query_id", "success")
