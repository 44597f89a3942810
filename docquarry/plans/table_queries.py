"""Queries over sources, filters and table edits."""

import uuid

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..sources import tables as T
from ..sources.scratch import shared_dir
from .registry import query
from .sync_queries import old_and_new
from .views import EPISODES, episodes, table


@query(f"WITH {EPISODES} SELECT episode_id, content, episode_number, episode_title, publication_date, novel_id FROM v_episode WHERE novel_id IN ('src1', 'src2', 'src3') ORDER BY novel_id, episode_number, episode_id LIMIT 20 OFFSET 5")
def a1_extract_documents(spark, d):
    return T.extract_documents(episodes(spark, d), groups=["src1", "src2", "src3"], limit=20, offset=5)


@query("SELECT event_id AS id, event_type AS content, '{\"user_id\":' || user_id || '}' AS metadata, ts AS modified_date FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def a2_incremental(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return T.incremental(e, "ts", "2024-01-20 00:00:00", "event_id", "event_type")


@query("""SELECT c_custkey, c_name, CAST(c_acctbal + 1 AS DECIMAL(18, 2)) AS bal FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 = 0
    UNION ALL SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18, 2)) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18, 2)) FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 10 = 0""")
def a7_upsert(spark, d):
    old, new = old_and_new(spark, d)
    return T.upsert(old, new, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, 99, 1.0 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0)")
def a8_replace_by_parent(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = line.where("l_orderkey % 4 = 0").select("l_orderkey", F.lit(99).alias("l_linenumber"), F.lit(1.0).alias("l_quantity")).distinct()
    return T.replace_by_parent(line, new, "l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 200000 AND o_orderstatus = 'F', false)")
def a9_delete_where(spark, d):
    return T.delete_where(table(spark, d, "orders"), (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT count(*) AS \"rows\", count(*) - count(DISTINCT vec_id) AS repeated_keys, count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, count(*) FILTER (embedding IS NULL OR label IS NULL) AS incomplete FROM embeddings")
def a10_validate_collection(spark, d):
    return T.validate_collection(table(spark, d, "embeddings"), "vec_id", "embedding", 64, ["embedding", "label"])


@query("SELECT vec_id, CASE WHEN label < 5 THEN label ELSE 1700000000 END::BIGINT AS created_at, CAST(1700000000 AS BIGINT) AS updated_at, '{}' AS metadata, '{}' AS permissions, '[]' AS group_ids FROM embeddings")
def a11_fill_defaults(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") < 5, F.col("label").cast("long")).alias("created_at"))
    return T.fill_entry_defaults(e, 1_700_000_000)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src7')")
def a12_partitions(spark, d):
    return T.in_partitions(table(spark, d, "documents").select("doc_id", "source"), "source", ["src0", "src7"])


@query("""SELECT 'c_custkey' AS column_name, 'bigint' AS type, true AS nullable, count(*) AS "rows", count(*) - count(c_custkey) AS nulls, count(DISTINCT c_custkey) AS distinct_values FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', true, count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_nationkey', 'int', true, count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey) FROM customer""")
def a14_profile_table(spark, d):
    return T.profile_table(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def a14_sample_rows(spark, d):
    return T.sample_rows(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


_KEYS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"))


@query("SELECT * FROM (SELECT 'lineitem' AS table_name, 'orders,part' AS refers_to, '' AS referred_by, (SELECT count(*) FROM lineitem) AS \"rows\" UNION ALL SELECT 'orders', 'customer', 'lineitem', (SELECT count(*) FROM orders) UNION ALL SELECT 'part', '', 'lineitem', (SELECT count(*) FROM part) UNION ALL SELECT 'customer', '', 'orders', (SELECT count(*) FROM customer))")
def a15_relationships(spark, d):
    keys = spark.createDataFrame([(child, parent) for child, _, parent, _ in _KEYS], "table_name string, refers_to string")
    sizes = T.table_sizes({t: table(spark, d, t) for t in ("lineitem", "orders", "part", "customer")})
    return T.relationships(keys).join(sizes, "table_name")


@query(
    " UNION ALL ".join(
        f"SELECT '{child}' AS child, '{parent}' AS parent, count({key}) AS linked_rows, count(DISTINCT {key}) AS keys, count(DISTINCT {key}) FILTER ({key} NOT IN (SELECT {parent_key} FROM {parent})) AS unknown_keys FROM {child}" for child, key, parent, parent_key in _KEYS
    )
)
def a15_links(spark, d):
    parts = [T.links_of(table(spark, d, child), key, table(spark, d, parent), parent_key).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "linked_rows", "keys", "unknown_keys") for child, key, parent, parent_key in _KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT lower(o_orderpriority) AS name FROM orders WHERE lower(o_orderpriority) NOT IN (SELECT lower(o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority < '3') UNION SELECT DISTINCT lower(n_name) FROM nation")
def a16_missing_tables(spark, d):
    names = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"))
    expected = names.select(F.lower("name").alias("name")).distinct().unionByName(table(spark, d, "nation").select(F.lower("n_name").alias("name")).distinct())
    return T.missing_tables(names.where("o_orderkey % 2 = 0 and name < '3'").select(F.upper("name").alias("name")).distinct(), expected)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def b1_filters(spark, d):
    return table(spark, d, "orders").where(P.filters_to_column({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})).select("o_orderkey")


@query(f"WITH {EPISODES} SELECT episode_id, publication_date FROM v_episode WHERE novel_id IN ('src0', 'src1') AND episode_number BETWEEN 3 AND 40 AND publication_date BETWEEN DATE '2024-02-01' AND DATE '2024-10-31'")
def b2_document_filter(spark, d):
    return episodes(spark, d).where(P.document_filter(groups=["src0", "src1"], number_from=3, number_to=40, date_from="2024-02-01", date_to="2024-10-31")).select("episode_id", "publication_date")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_type NOT IN ('ECONOMY') AND contains(p_name, 'e') AND regexp_matches(p_brand, '#1')")
def b3_predicates(spark, d):
    rows = table(spark, d, "part")
    return rows.where(P.predicate("p_size", {"gte": 10, "lt": 40}) & P.predicate("p_type", {"nin": ["ECONOMY"]}) & P.predicate("p_name", {"contains": "e"}) & P.predicate("p_brand", {"regex": "#1"})).select("p_partkey")


@query("WITH e AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS kind, value FROM events) SELECT event_id FROM e WHERE (kind IS NULL OR kind IN ('view', 'click')) AND (value IS NULL OR (value > 10 AND value <= 50))")
def b4_custom_filters(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("kind"), "value")
    return e.where(P.custom_filters({"kind": ["view", "click"], "value": {"gt": 10, "lte": 50}})).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 25")
def b5_scalar_query(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000 and c_mktsegment = 'MACHINERY'").orderBy("c_custkey").limit(25).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 60")
def b7_paginate(spark, d):
    return P.paginate(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30, 60).select("o_orderkey", "o_totalprice", "total")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) > 0 AND length(text) BETWEEN 50 AND 10000")
def b8_valid_documents(spark, d):
    return P.valid_documents(table(spark, d, "documents"), "text").select("doc_id")


@query(r"""SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') AS is_url, regexp_matches(replace(url, '/', '@'), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS is_email FROM pages""")
def b10_contacts(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.replace("url", F.lit("/"), F.lit("@")).alias("mail"))
    return p.select("page_id", P.is_url("url").alias("is_url"), P.is_email("mail").alias("is_email"))


@query(r"""SELECT page_id, CASE WHEN length(html) <= 120 THEN html ELSE left(html, 117) || '...' END AS short, trim(regexp_replace(regexp_replace(html, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS sane,
    regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '_+', '_', 'g') AS filename FROM pages""")
def b11_text_helpers(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", P.truncate_text("html", 120).alias("short"), P.sanitize_text("html").alias("sane"), P.clean_filename("url").alias("filename"))


@query("SELECT doc_id, source, lang FROM documents")
def b6_output_fields(spark, d):
    return P.output_fields(table(spark, d, "documents"), ["doc_id"], metadata=["source", "lang"])


@query("SELECT event_id, round(value / 100, 6) AS score FROM events WHERE round(value / 100, 6) >= 0.3")
def b9_score_threshold(spark, d):
    return P.score_threshold(table(spark, d, "events").select("event_id", F.round(F.col("value") / 100, 6).alias("score")), "score", 0.3)


@query("SELECT doc_id, text FROM documents")
def a5_decode_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b")).select("doc_id", T.decode_bytes("b").alias("text"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT label, count(*) AS rows, (SELECT count(*) FROM embeddings) AS written FROM embeddings GROUP BY 1")
def a6_written_partitions(spark, d):
    """Vectors written in partitions, read back by partition, with the number that the write reports."""
    path = _folder(spark, "vectors")
    written = T.write_rows(table(spark, d, "embeddings"), path, ["label"], "overwrite")
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("rows")).withColumn("written", F.lit(written).cast("long"))


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS digest FROM documents")
def a13_json_round_trip(spark, d):
    docs, path = table(spark, d, "documents"), _folder(spark, "json")
    T.export_json(docs, path)
    return T.import_json(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))
