"""Queries over sources, registries and stored rows."""

from pyspark.sql import functions as F

from ..operators import reconcile
from .registry import query
from .views import EPISODES, episodes, table


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')")
def k1_orphans(spark, d):
    return reconcile.orphans(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").where("source <> 'src3'"), "doc_id")


_FAILED = """SELECT doc_id, CAST(length(text) AS INTEGER) AS length, CASE WHEN length(text) > 10000 THEN 'too long' WHEN length(trim(text)) = 0 THEN 'empty' ELSE 'unknown' END AS cause
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def _failed(spark, d):
    return reconcile.failed_documents(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "text")


@query(_FAILED)
def k2_failed_documents(spark, d):
    return _failed(spark, d)


@query(f"WITH f AS ({_FAILED}), g AS (SELECT f.*, source FROM f JOIN documents USING (doc_id) WHERE source = 'src1') SELECT doc_id, length, cause, source, (SELECT count(*) FROM g) AS total FROM g ORDER BY doc_id LIMIT 20 OFFSET 5")
def k2_failed_page(spark, d):
    """The second page of one source's failed documents, with their number."""
    failed = _failed(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return reconcile.failed_page(failed, ["doc_id"], 20, 5, ("source", "src1"))


@query(f"WITH f AS ({_FAILED}) SELECT cause, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM f), 4)::DOUBLE AS percent FROM f GROUP BY 1")
def k3_common_causes(spark, d):
    return reconcile.common_causes(_failed(spark, d))


_STATUS = """count(*) AS total, count(has) AS processed, greatest(0, count(*) - count(has)) AS failed, count(*) FILTER (length(content) > 2000) AS chunked, round(100.0 * count(has) / count(*), 4)::DOUBLE AS success_percent,
    CASE WHEN count(has) = 0 THEN 'pending' WHEN count(has) < count(*) THEN 'partial' ELSE 'completed' END AS status FROM v_episode LEFT JOIN (SELECT DISTINCT doc_id, 1 AS has FROM labels) ON episode_id = doc_id"""


@query(f"WITH {EPISODES} SELECT novel_id, {_STATUS} GROUP BY 1")
def k4_group_status(spark, d):
    return reconcile.group_status(episodes(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "episode_id"), "episode_id", ["novel_id"], "content", 2000)


@query(f"WITH {EPISODES} SELECT {_STATUS}")
def k5_global_status(spark, d):
    return reconcile.group_status(episodes(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "episode_id"), "episode_id", [], "content", 2000)


@query("SELECT o_orderkey + 7 AS doc_id, o_orderkey + 7 IN (SELECT doc_id FROM documents) AS found FROM orders")
def k6_requested(spark, d):
    return reconcile.requested(table(spark, d, "orders").select((F.col("o_orderkey") + 7).alias("doc_id")), table(spark, d, "documents"), "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def k6_touched_groups(spark, d):
    return reconcile.touched_groups(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), "doc_id", "source")


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOURS THEN 'failed' WHEN event_type = 'view' THEN 'processing' ELSE event_type END AS status FROM events")
def k7_stuck(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return reconcile.stuck(rows, "2024-01-20 00:00:00").select("event_id", "status")


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def k8_row_counts(spark, d):
    return reconcile.row_counts({t: table(spark, d, t) for t in ("orders", "customer", "documents")})


_OLD_NEW = """o AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18, 2)) AS bal FROM customer WHERE c_custkey % 11 <> 0),
    n AS (SELECT c_custkey, c_name, CAST(c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(18, 2)) AS bal FROM customer WHERE c_custkey % 10 <> 0)"""
_DIFF = """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' WHEN md5(o.c_name || ':' || o.bal) <> md5(n.c_name || ':' || n.bal) THEN 'updated' ELSE 'unchanged' END AS change
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"""


def old_and_new(spark, d, customers=None):
    c = table(spark, d, "customer") if customers is None else customers
    money = lambda x: x.cast("decimal(18,2)").alias("bal")
    old = c.where("c_custkey % 11 <> 0").select("c_custkey", "c_name", money(F.col("c_acctbal")))
    return old, c.where("c_custkey % 10 <> 0").select("c_custkey", "c_name", money(F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)))


@query(f"WITH {_OLD_NEW} {_DIFF}")
def k9_sync_diff(spark, d):
    return reconcile.sync_diff(*old_and_new(spark, d), "c_custkey", ["c_name", "bal"])


@query(f"WITH {_OLD_NEW}, d AS ({_DIFF}) SELECT change, count(*) AS records FROM d GROUP BY 1")
def k10_sync_counts(spark, d):
    return reconcile.sync_counts(reconcile.sync_diff(*old_and_new(spark, d), "c_custkey", ["c_name", "bal"]))


def _runs(spark, d):
    e = table(spark, d, "events").where("event_id % 3 = 0")
    begun = F.col("ts").cast("timestamp")
    return e.select((F.col("user_id") % 40).alias("source_id"), F.col("event_id").alias("run_id"), begun.alias("started"), F.when(F.col("event_id") % 5 != 0, begun + F.expr("make_dt_interval(0, 0, 0, event_id % 90)")).alias("ended"), F.col("event_id").alias("processed"), (F.col("event_id") % 7).alias("added"), (F.col("event_id") % 4).alias("updated"), (F.col("event_id") % 2).alias("deleted"), F.when(F.col("event_type") == "error", F.lit("broken")).alias("error"))


_RUNS = """r AS (SELECT user_id % 40 AS source_id, event_id AS run_id, ts AS started, CASE WHEN event_id % 5 <> 0 THEN ts + to_seconds(event_id % 90) END AS ended, event_id AS processed, event_id % 7 AS added, event_id % 4 AS updated, event_id % 2 AS deleted,
    CASE WHEN event_type = 'error' THEN 'broken' END AS error FROM events WHERE event_id % 3 = 0),
    l AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN ended IS NULL THEN 'running' ELSE 'completed' END AS status, epoch(ended) - epoch(started) AS duration FROM r)"""


@query(f"WITH {_RUNS} SELECT source_id, run_id, status, round(duration, 3) AS duration FROM l")
def k10_sync_log(spark, d):
    return reconcile.sync_log(_runs(spark, d)).select("source_id", "run_id", "status", F.round("duration", 3).alias("duration"))


@query(
    f"""WITH {_RUNS}, n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started DESC, run_id DESC) = 1), g AS (SELECT source_id, max(ended) FILTER (status = 'completed') AS good FROM l GROUP BY 1)
    SELECT source_id, CAST(floor(coalesce(epoch(good), 0)) AS BIGINT) AS last_sync, status, processed, added, updated, deleted, round(duration, 3) AS duration FROM n JOIN g USING (source_id)
    UNION ALL SELECT 100 + n_nationkey, 0::BIGINT, 'completed', 1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0.5::DOUBLE FROM nation"""
)
def k10_sync_state(spark, d):
    keys = table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("source_id")).unionByName(_runs(spark, d).select("source_id").distinct())
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    state = keys.select("source_id", F.timestamp_seconds(F.lit(0)).alias("last_sync"), F.lit("completed").alias("status"), one.alias("processed"), one.alias("added"), none.alias("updated"), none.alias("deleted"), F.lit(0.5).alias("duration"), F.lit(None).cast("string").alias("error"))
    return reconcile.sync_state(state, _runs(spark, d)).withColumns({"last_sync": F.unix_timestamp("last_sync"), "duration": F.round("duration", 3)}).drop("error")


@query(
    """WITH c AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS processed_date, count(*) AS chunk_count, count(*) FILTER (l_quantity > 10) AS vector_count, arg_max(l_returnflag, (l_shipdate, l_returnflag)) AS flag FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN chunk_count > 0 THEN 'processed' ELSE 'uploading' END AS status, CAST(processed_date AS TIMESTAMP) AS processed_date, coalesce(chunk_count, 0) AS chunk_count, coalesce(vector_count, 0) AS vector_count, coalesce(flag, 'none') AS flag, o_orderstatus AS state FROM orders LEFT JOIN c USING (o_orderkey)"""
)
def k11_life_cycle(spark, d):
    docs = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("state"), F.col("o_orderstatus"), F.lit("flag"), F.lit("none")).alias("metadata"))
    done = F.col("l_shipdate").cast("timestamp")
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), done.alias("done_at"), (F.col("l_quantity") > 10).alias("has_vector"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("metadata"))
    return reconcile.life_cycle(docs, chunks, "o_orderkey").withColumns({"flag": F.col("metadata")["flag"], "state": F.col("metadata")["state"]}).drop("metadata")


@query("SELECT count(*) AS runs, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 4)::DOUBLE AS success_rate, round(avg(value), 4) AS average FROM events")
def k12_run_statistics(spark, d):
    return reconcile.run_statistics(table(spark, d, "events"), F.col("event_type") != "error", "value")


@query("SELECT doc_id, source FROM documents WHERE '/data/' || source || '.txt' NOT IN ('/data/src1.txt', '/data/src2.txt', '/data/src4.txt')")
def k13_missing_files(spark, d):
    listing = spark.createDataFrame([(f"/data/src{i}.txt",) for i in (1, 2, 4)], "path string")
    registry = table(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("/data/"), "source", F.lit(".txt")).alias("path"))
    return reconcile.orphans(registry, listing, "path").select("doc_id", "source")


@query("""SELECT event_id FROM events WHERE contains(props, '"k": 7')""")
def k14_marked_rows(spark, d):
    return reconcile.marked_in_json(table(spark, d, "events"), "props", '"k": 7').select("event_id")
