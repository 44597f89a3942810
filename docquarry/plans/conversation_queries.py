"""Queries over conversations."""

from pyspark.sql import functions as F

from ..operators import convo
from .registry import query
from .views import MESSAGES, messages

_LAST = "last3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM v_message) WHERE back <= 3)"


@query(f"WITH {MESSAGES}, {_LAST} SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM last3")
def m1_last_messages(spark, d):
    return convo.last_messages(messages(spark, d), 3).select("conv_id", "turn", "role", "text", "position")


def _conversations(spark, d):
    return messages(spark, d).select("conv_id", "user_id").distinct()


@query(f"WITH {MESSAGES} SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id DESC) AS INTEGER) AS place FROM (SELECT conv_id, user_id, count(*) AS messages, max(timestamp) AS updated_at FROM v_message GROUP BY 1, 2)")
def m2_conversation_list(spark, d):
    return convo.conversation_list(_conversations(spark, d), messages(spark, d))


@query(f"WITH {MESSAGES} SELECT DISTINCT conv_id, user_id FROM v_message WHERE conv_id % 2 = 0 UNION SELECT DISTINCT conv_id, CAST(99 AS BIGINT) FROM v_message WHERE conv_id % 3 = 0 AND conv_id % 2 <> 0")
def m3_create_if_absent(spark, d):
    both = _conversations(spark, d)
    return convo.create_if_absent(both.where("conv_id % 2 = 0"), both.where("conv_id % 3 = 0").select("conv_id", F.lit(99).cast("long").alias("user_id")))


@query(f"WITH {MESSAGES} SELECT conv_id, greatest(min(timestamp), max(timestamp) FILTER (turn >= 2)) AS updated_at FROM v_message GROUP BY 1")
def m4_add_messages(spark, d):
    m = messages(spark, d)
    return convo.add_messages(m.groupBy("conv_id").agg(F.min("timestamp").alias("updated_at")), m.where("turn >= 2"))


@query(f"WITH {MESSAGES} SELECT conv_id, turn FROM v_message WHERE conv_id % 5 <> 0")
def m5_delete_conversations(spark, d):
    m = messages(spark, d)
    return convo.delete_conversations(m.select("conv_id", "turn"), m.where("conv_id % 5 = 0"))


@query(f"WITH {MESSAGES}, l AS (SELECT conv_id, max(turn) AS last FROM v_message GROUP BY 1) SELECT conv_id, turn, text FROM v_message UNION ALL SELECT conv_id, last + 1, 'added' FROM l WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, last + 2, 'later' FROM l WHERE conv_id % 2 = 0")
def m4_append_messages(spark, d):
    m = messages(spark, d)
    ends = m.where("conv_id % 2 = 0").groupBy("conv_id", "user_id").agg(F.max("timestamp").alias("t"))
    new = lambda text, s: ends.select("conv_id", F.lit("user").alias("role"), F.lit(text).alias("text"), (F.col("t") + F.expr(f"interval {s} seconds")).alias("timestamp"), "user_id")
    return convo.append_messages(m, new("later", 9).unionByName(new("added", 5))).select("conv_id", "turn", "text")


@query(f"""WITH {MESSAGES}, c AS (SELECT DISTINCT conv_id FROM v_message), t AS (SELECT conv_id, arg_min(left(text, 30), turn) AS title FROM v_message WHERE role = 'user' AND conv_id % 3 <> 0 GROUP BY 1)
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'en' END AS lang, coalesce(title, CASE WHEN conv_id % 2 = 0 THEN 'old' END) AS title FROM c LEFT JOIN t USING (conv_id)""")
def m6_merge_metadata(spark, d):
    m = messages(spark, d)
    own = m.select("conv_id").distinct().withColumn("metadata", F.when(F.col("conv_id") % 2 == 0, F.lit('{"lang": "en", "title": "old"}')))
    merged = convo.merge_metadata(own, convo.with_title(m.where("conv_id % 3 <> 0")))
    return merged.select("conv_id", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("lang", "title")])


@query(f"WITH {MESSAGES}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM v_message) SELECT conv_id, turn, back FROM n WHERE back <= 5")
def m8_recent_turns(spark, d):
    return convo.recent_turns(messages(spark, d)).select("conv_id", "turn", "back")


@query(f"WITH {MESSAGES} SELECT conv_id, arg_min(left(text, 30), turn) AS title FROM v_message WHERE role = 'user' GROUP BY 1")
def m6_titles(spark, d):
    return convo.with_title(messages(spark, d)).select("conv_id", F.get_json_object("metadata", "$.title").alias("title"))


_PAIRS = """p AS (SELECT u.conv_id, CAST(row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) AS INTEGER) AS pair, u.text AS question,
    (SELECT min(a.turn) FROM v_message a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn) AS reply_turn FROM v_message u WHERE u.role = 'user'),
    r AS (SELECT p.conv_id, pair, question, a.text AS reply, reply_turn FROM p LEFT JOIN v_message a ON a.conv_id = p.conv_id AND a.turn = reply_turn)"""


@query(f"WITH {MESSAGES}, {_PAIRS} SELECT * FROM r")
def m7_paired_turns(spark, d):
    return convo.paired_turns(messages(spark, d))


@query(f"WITH {MESSAGES} SELECT conv_id, count(*) AS turns, max(timestamp) < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOURS AS expired, count(*) >= 6 AS is_full, max(timestamp) >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOURS AS is_active FROM v_message GROUP BY 1")
def m8_session_state(spark, d):
    return convo.session_state(messages(spark, d), "2024-01-05 00:00:00", max_turns=6)


@query(f"""WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM v_message)
    SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || left(text, 200), chr(10) ORDER BY n) AS digest FROM n WHERE n <= 6 GROUP BY 1""")
def m9_digest(spark, d):
    return convo.digest(messages(spark, d))


@query(f"""WITH {MESSAGES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM v_message) WHERE back <= 2 AND role = 'user'),
    q AS (SELECT DISTINCT conv_id FROM v_message) SELECT q.conv_id, trim(coalesce(string_agg(text, ' ' ORDER BY turn), '') || ' what next') AS query FROM q LEFT JOIN l USING (conv_id) GROUP BY 1""")
def h13_conversational_query(spark, d):
    m = messages(spark, d)
    return convo.conversational_query(m, m.select("conv_id", F.lit("what next").alias("query")).distinct())


_COUNT = r"CAST(len(regexp_extract_all(coalesce({0}, ''), '[^\s]+')) AS INTEGER)"


@query(f"WITH {MESSAGES}, {_PAIRS} SELECT conv_id, pair, {_COUNT.format('question')} AS prompt_tokens, {_COUNT.format('reply')} AS completion_tokens, {_COUNT.format('question')} + {_COUNT.format('reply')} AS total_tokens FROM r")
def m11_token_estimate(spark, d):
    return convo.token_estimate(convo.paired_turns(messages(spark, d)))


@query(f"WITH {MESSAGES} SELECT conv_id, turn FROM v_message WHERE user_id = 2 AND conv_id % 2 = 0")
def m12_owned(spark, d):
    m = messages(spark, d)
    claims = m.where("conv_id % 2 = 0").select("conv_id", F.lit(2).cast("long").alias("user_id")).distinct()
    return convo.owned(m, claims).select("conv_id", "turn")


@query(f"""WITH {MESSAGES}, l AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS m FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM v_message) WHERE back <= 2 GROUP BY 1),
    s AS (SELECT doc_id % 40 AS conv_id, 'doc ' || doc_id AS title, (doc_id % 10) / 10.0::DOUBLE AS score FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, title) AS n FROM s), b AS (SELECT conv_id, string_agg('[' || title || '] ' || printf('%.2f', score), chr(10) ORDER BY n) AS s FROM r WHERE n <= 3 GROUP BY 1)
    SELECT conv_id, m || coalesce(chr(10) || s, '') AS prompt FROM l LEFT JOIN b USING (conv_id)""")
def m10_prompt_context(spark, d):
    from .views import table

    sources = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("conv_id"), F.concat(F.lit("doc "), "doc_id").alias("title"), ((F.col("doc_id") % 10) / 10.0).alias("score"))
    return convo.prompt_context(messages(spark, d), sources, 2, 3)
