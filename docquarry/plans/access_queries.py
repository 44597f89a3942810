"""Queries over access control."""

from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import vector as V
from .registry import query
from .views import AS_OF, VECTORS, table, vectors

_ROLES = [("admin", "manager"), ("manager", "user"), ("user", None), ("editor", "user")]
_GRANTS = [("admin", "delete"), ("manager", "write"), ("user", "read"), ("editor", "publish")]
_ROLE_OF = {0: "admin", 1: "manager", 2: "user", 3: "editor", 4: "guest"}
_USER_ROLE = "CASE user_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _ROLE_OF.items()) + " END"
_USERS = f"u AS (SELECT DISTINCT user_id, {_USER_ROLE} AS role, CASE WHEN user_id % 11 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS expires FROM events)"
_TABLES = f"""{_USERS}, r(role, parent) AS (VALUES ('admin', 'manager'), ('manager', 'user'), ('user', NULL), ('editor', 'user')), g(role, permission) AS (VALUES ('admin', 'delete'), ('manager', 'write'), ('user', 'read'), ('editor', 'publish'))"""


def _role(c):
    out = F.lit(_ROLE_OF[4])
    for k in range(4):
        out = F.when(c % 5 == k, _ROLE_OF[k]).otherwise(out)
    return out


def user_roles(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", _role(F.col("user_id")).alias("role"), F.when(F.col("user_id") % 11 == 0, F.lit("2023-01-01 00:00:00").cast("timestamp")).alias("expires"))


def _tables(spark):
    return spark.createDataFrame(_ROLES, "role string, parent string"), spark.createDataFrame(_GRANTS, "role string, permission string")


# Every user has one role by the user id, as classified data see it.
_CLEARANCE = "CASE user_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'Manager' WHEN 2 THEN 'employee' WHEN 3 THEN 'contractor' WHEN 4 THEN 'guest' ELSE 'editor' END"
_LEVEL = f"CASE lower({_CLEARANCE}) WHEN 'admin' THEN 4 WHEN 'manager' THEN 3 WHEN 'employee' THEN 2 WHEN 'contractor' THEN 1 ELSE 0 END"


@query(f"SELECT event_id, user_id FROM events WHERE {_LEVEL} >= CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 WHEN 'signup' THEN 4 ELSE 1 END")
def j1_classification(spark, d):
    """Events that their own users are cleared for, over all users and events."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    levels = A.role_levels(events.select("user_id").distinct().withColumn("role", F.expr(_CLEARANCE)))
    kinds = {"view": "public", "purchase": "restricted", "error": "confidential", "signup": "SECRET"}
    kind = F.lit(None).cast("string")
    for name, value in kinds.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    return events.join(levels, "user_id").where(A.cleared(F.col("level"), kind)).select("event_id", "user_id")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src5') AND source <> 'src2'")
def j2_sources(spark, d):
    return A.allowed_sources(table(spark, d, "documents").select("doc_id", "source"), "source", ["src1", "src2", "src5"], ["src2"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '[REDACTED]' END AS internal_id, '[REDACTED]' AS personal_data, c_mktsegment AS segment FROM customer")
def j3_redact_fields(spark, d):
    c = table(spark, d, "customer")
    meta = F.create_map(F.lit("internal_id"), "c_name", F.lit("personal_data"), F.lit("x"), F.lit("segment"), "c_mktsegment")
    rights = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("field:internal_id:read"))).otherwise(F.array().cast("array<string>"))
    out = c.select("c_custkey", meta.alias("m"), rights.alias("p")).select("c_custkey", A.redact_fields("m", "p").alias("m"))
    return out.select("c_custkey", F.col("m")["internal_id"].alias("internal_id"), F.col("m")["personal_data"].alias("personal_data"), F.col("m")["segment"].alias("segment"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b', '[SSN_REDACTED]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'), '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b', '[CARD_REDACTED]', 'g') AS text FROM documents")
def j4_redact_content(spark, d):
    return table(spark, d, "documents").select("doc_id", A.redact_content("text").alias("text"))


_DECIDE = "SELECT doc_id, CASE WHEN lang = 'es' THEN 'base' WHEN n_chars > 3000 THEN 'classification' WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'source' ELSE 'granted' END AS reason FROM documents"


def _decided(spark, d):
    checks = [("base", F.col("lang") != "es"), ("classification", F.col("n_chars") <= 3000), ("source", F.col("source").isin("src1", "src2", "src3"))]
    return A.decide(table(spark, d, "documents"), checks).select("doc_id", "reason")


@query(_DECIDE)
def j5_decide(spark, d):
    return _decided(spark, d)


@query(f"WITH d AS ({_DECIDE}) SELECT reason, count(*) AS n FROM d GROUP BY 1")
def j13_filter_stats(spark, d):
    return A.filter_stats(_decided(spark, d))


def _owned(rows):
    return rows.withColumns({"owner": F.col("user_id"), "group_ids": F.array(F.concat(F.lit("g"), "grp")), "is_public": F.col("vec_id") % 9 == 0, "shared_with": F.array(F.col("vec_id") % 13)})


_VISIBLE = "(user_id = 3 OR grp = 4 OR vec_id % 9 = 0 OR vec_id % 13 = 3)"


@query(f"WITH {VECTORS} SELECT vec_id FROM v_corpus_vec WHERE {_VISIBLE}")
def j6_visible(spark, d):
    return A.secured(_owned(vectors(spark, d)[1]), A.visible(3, ["g4"], False, ["read_public"])).select("vec_id")


_RULE = "rule_id int, active boolean, permissions array<string>, allow_users array<long>, deny_users array<long>, allow_groups array<string>, deny_groups array<string>, conditions map<string,string>"
#: Readers named or in a group, one denied, one whose group is denied; conditions for all readers and for writers; an inactive rule.
_RULE_ROWS = [
    (1, True, ["read"], [0, 2, 4, 6, 8], [4], ["g1"], ["g5"], None),
    (2, False, ["read"], [1], [0], None, None, {"lang": "de"}),
    (3, True, ["write"], [1], None, None, None, {"source": "src1"}),
    (4, True, ["read", "write"], None, None, None, None, {"lang": "en"}),
]


def _contexts(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", F.array(F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string"))).alias("group_ids"), (F.col("user_id") % 10 == 9).alias("is_admin"))


@query("""WITH u AS (SELECT DISTINCT user_id, user_id % 7 AS g, user_id % 10 = 9 AS is_admin FROM events)
    SELECT user_id, NOT (user_id = 4 OR g = 5) AS allowed, CASE WHEN is_admin THEN 'lang=en,source=src1' ELSE 'lang=en' END AS conditions FROM u""")
def j7_rule_verdicts(spark, d):
    found = A.rule_verdicts(spark.createDataFrame(_RULE_ROWS, _RULE), _contexts(spark, d), "read")
    return found.select("user_id", "allowed", F.array_join(F.transform("conditions", lambda c: F.concat(c["key"], F.lit("="), c["value"])), ",").alias("conditions"))


@query("""WITH q AS (SELECT DISTINCT user_id FROM events WHERE NOT (user_id = 4 OR user_id % 7 = 5)), u AS (SELECT user_id, user_id % 10 = 9 AS is_admin FROM q)
    SELECT is_admin, doc_id, count(*) AS readers FROM u JOIN (SELECT doc_id, lang, source FROM documents) ON lang = 'en' AND (source = 'src1' OR NOT is_admin) GROUP BY 1, 2""")
def j7_readable_documents(spark, d):
    """How many users, admins or not, may read each document by its fields: verdicts meet documents by their distinct conditions."""
    verdicts = A.rule_verdicts(spark.createDataFrame(_RULE_ROWS, _RULE), _contexts(spark, d), "read").where("allowed").join(_contexts(spark, d), "user_id")
    kinds = verdicts.groupBy("is_admin", "conditions").agg(F.count("*").alias("readers"))  # as many as there are sets of conditions in the rules
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    met = docs.crossJoin(F.broadcast(kinds)).where(A.meets_conditions(F.col("conditions"), {"lang": F.col("lang"), "source": F.col("source")}))
    return met.groupBy("is_admin", "doc_id").agg(F.sum("readers").alias("readers"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND source = 'src1'")
def j7_rule_predicate(spark, d):
    """What an admin reads: the compiled condition reaches the scan."""
    rules = spark.createDataFrame(_RULE_ROWS, _RULE)
    return A.secured(table(spark, d, "documents"), A.rule_predicate(rules, 9, ["g2"], True, "read", ["lang", "source"])).select("doc_id", "lang")


@query(f"""WITH {VECTORS}, s AS (SELECT query_id, vec_id, list_dot_product(query_vec, embedding) AS score FROM v_query_vec, v_corpus_vec WHERE {_VISIBLE}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def j8_secured_search(spark, d):
    q, c = vectors(spark, d)
    found = V.vector_topk(q, A.secured(_owned(c), A.visible(3, ["g4"], False, ["read_public"])), 5, "ip")
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_EFFECTIVE = f"WITH RECURSIVE {_TABLES}, e AS (SELECT user_id, role FROM u WHERE expires IS NULL OR expires > TIMESTAMP '{AS_OF}' UNION SELECT user_id, parent FROM e JOIN r USING (role) WHERE parent IS NOT NULL), p AS (SELECT DISTINCT user_id, permission FROM e JOIN g USING (role))"


def _effective(spark, d):
    roles, grants = _tables(spark)
    return A.effective_permissions(user_roles(spark, d), roles, grants, AS_OF)


@query(f"{_EFFECTIVE} SELECT * FROM p")
def j9_effective_permissions(spark, d):
    return _effective(spark, d)


@query(f"{_EFFECTIVE} SELECT user_id, count(*) FILTER (permission IN ('read', 'write')) > 0 AS has_any, count(*) FILTER (permission IN ('read', 'write')) = 2 AS has_all FROM p GROUP BY 1")
def j10_has_permissions(spark, d):
    return A.has_permissions(_effective(spark, d), ["read", "write"])


@query(f"{_EFFECTIVE}, q AS (SELECT DISTINCT user_id, unnest(['read', 'write', 'admin']) AS resource FROM p) SELECT q.user_id, resource, 'use' AS action, max((p.permission IS NOT NULL)::INT) = 1 AS allowed FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.permission = resource GROUP BY 1, 2")
def j10_check_access(spark, d):
    rights = _effective(spark, d).select("user_id", F.concat("permission", F.lit(":*")).alias("permission"))
    asked = rights.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(x) for x in ("read", "write", "admin")])).alias("resource"), F.lit("use").alias("action"))
    return A.check_access(asked, rights)


@query(f"WITH {_USERS} SELECT user_id, 'user ' || user_id AS name, role AS roles FROM u WHERE role = 'editor'")
def j11_user_list(spark, d):
    roles = user_roles(spark, d)
    return A.user_list(roles.select("user_id", F.concat(F.lit("user "), "user_id").alias("name")), roles, "editor")


@query(f"WITH {_USERS} SELECT user_id, 'user ' || user_id AS name, role AS roles FROM u WHERE role = 'editor' AND user_id % 4 <> 0")
def j11_active_users(spark, d):
    roles = user_roles(spark, d)
    return A.user_list(roles.select("user_id", F.concat(F.lit("user "), "user_id").alias("name"), (F.col("user_id") % 4 != 0).alias("is_active")), roles, "editor", True)


@query(f"WITH {_TABLES} SELECT user_id, u.role, CASE WHEN expires < TIMESTAMP '{AS_OF}' THEN 'expired' ELSE 'active' END AS status, coalesce(permission, '') AS permissions FROM u LEFT JOIN g ON u.role = g.role")
def j12_membership_report(spark, d):
    return A.membership_report(user_roles(spark, d), _tables(spark)[1], AS_OF)
