"""Access rules worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import access as A

RULE = "rule_id int, active boolean, permissions array<string>, allow_users array<long>, deny_users array<long>, allow_groups array<string>, deny_groups array<string>, conditions map<string,string>"


@pytest.mark.parametrize(("roles", "level"), [(["guest"], 0), (["Contractor"], 1), (["employee", "guest"], 2), (["manager", "employee"], 3), (["ADMIN"], 4), (["editor", "user", "viewer"], 0), ([None], 0)])
def test_best_role(spark, roles, level):
    rows = spark.createDataFrame([(1, r) for r in roles], "user_id long, role string")
    assert A.role_levels(rows).head()["level"] == level


@pytest.mark.parametrize(("kind", "least"), [("public", 0), (None, 1), ("internal", 1), ("Confidential", 2), ("restricted", 3), ("secret", 4), ("unheard of", 1)])
def test_clearance(spark, kind, least):
    rows = spark.range(5).select(F.col("id").cast("int").alias("level"))
    assert sorted(r[0] for r in rows.where(A.cleared(F.col("level"), F.lit(kind).cast("string"))).collect()) == list(range(least, 5))


def rule(n, active=True, permissions=("read",), allow=(), deny=(), groups=(), no_groups=(), conditions=None):
    return n, active, list(permissions), list(allow), list(deny), list(groups), list(no_groups), conditions


#: Rules, whether the user 1 of group a may read, and under which conditions.
CASES = [
    ([], True, []),
    ([rule(1, allow=[1])], True, []),
    ([rule(1, allow=[2])], True, []),  # says nothing to user 1, and restricts nothing
    ([rule(1, deny=[1])], False, []),
    ([rule(1, allow=[1], deny=[1])], False, []),
    ([rule(1, allow=[1]), rule(2, deny=[1])], False, []),
    ([rule(1, groups=["a"])], True, []),
    ([rule(1, allow=[1], no_groups=["a", "b"])], False, []),
    ([rule(1, no_groups=["b"])], True, []),
    ([rule(1, active=False, deny=[1])], True, []),
    ([rule(1, permissions=["write"], deny=[1])], True, []),
    ([rule(1, conditions={"lang": "en"})], True, [("lang", "en")]),
    ([rule(1, deny=[1], conditions={"lang": "en"})], False, [("lang", "en")]),
    ([rule(1, allow=[1], conditions={"lang": "en"}), rule(2, conditions={"lang": "de"})], True, [("lang", "de"), ("lang", "en")]),
]


@pytest.mark.parametrize(("rules", "allowed", "conditions"), CASES)
def test_rules(spark, rules, allowed, conditions):
    users = spark.createDataFrame([(1, ["a"], False), (3, [], False), (None, None, None)], "user_id long, group_ids array<string>, is_admin boolean")
    found = {r["user_id"]: r for r in A.rule_verdicts(spark.createDataFrame(rules, RULE), users, "read").collect()}
    assert found[1]["allowed"] == allowed and [tuple(c) for c in found[1]["conditions"]] == conditions
    predicate = A.rule_predicate(spark.createDataFrame(rules, RULE), 1, ["a"], False, "read", ["lang"])
    docs = spark.createDataFrame([("en",), ("de",), (None,)], "lang string")
    langs = {r["lang"] for r in docs.where(predicate).collect()}
    wanted = {v for _, v in conditions}
    assert langs == (set() if not allowed or len(wanted) > 1 else wanted or {"en", "de", None})


def test_all_rules_bind_an_admin(spark):
    rules = spark.createDataFrame([rule(1, permissions=["write"], deny=[1])], RULE)
    users = spark.createDataFrame([(1, [], True), (2, [], True)], "user_id long, group_ids array<string>, is_admin boolean")
    assert {r["user_id"]: r["allowed"] for r in A.rule_verdicts(rules, users, "read").collect()} == {1: False, 2: True}


def test_compiled_rules_reach_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    predicate = A.rule_predicate(spark.createDataFrame([rule(1, conditions={"lang": "en"})], RULE), 1, [], False, "read", ["lang"])
    plan = A.secured(docs, predicate)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert docs.where(A.rule_predicate(spark.createDataFrame([rule(1, conditions={"rank": "1"})], RULE), 1, [], False, "read", ["lang"])).count() == 0
