"""Row and field level access control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

# Role and classification levels; a role that isn't named here has level 0.
ROLE_LEVELS = {"admin": 4, "manager": 3, "employee": 2, "contractor": 1, "guest": 0}
CLASSIFICATIONS = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "secret": 4}
PROTECTED_FIELDS = ("internal_id", "personal_data", "confidential_notes")


def _level(c: Column, levels: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, level in levels.items():
        out = F.when(F.lower(c) == name, level).otherwise(out)
    return out


def role_levels(user_roles: DataFrame) -> DataFrame:
    """``user_id, level``: the level of each user's best role."""
    return user_roles.groupBy("user_id").agg(F.max(_level(F.col("role"), ROLE_LEVELS, 0)).alias("level"))


def cleared(level: Column, classification: Column) -> Column:
    """Whether a level reaches a row's classification; an unset one is internal."""
    return level >= _level(F.coalesce(classification, F.lit("internal")), CLASSIFICATIONS, 1)


def allowed_sources(rows: DataFrame, column: str, allowed: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """Rows of allowed sources (None: all) that are not denied."""
    out = rows.where(F.col(column).isin(*allowed)) if allowed is not None else rows
    return out.where(~F.coalesce(F.col(column).isin(*denied), F.lit(False))) if denied else out


def redact_fields(metadata: str, permissions: str) -> Column:
    """Protected fields of a map are masked without the permission ``field:<name>:read``."""
    return F.transform_values(metadata, lambda k, v: F.when(k.isin(*PROTECTED_FIELDS) & ~F.array_contains(permissions, F.concat(F.lit("field:"), k, F.lit(":read"))), F.lit("[REDACTED]")).otherwise(v))


def redact_content(c: str) -> Column:
    # What is masked, and by what.
    out = F.regexp_replace(c, r"\b\d{3}-\d{2}-\d{4}\b", "[SSN_REDACTED]")
    out = F.regexp_replace(out, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]")
    return F.regexp_replace(out, r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[CARD_REDACTED]")


def decide(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason``: the first check, in order, that a row fails; ``granted`` if none."""
    reason = F.lit("granted")
    for name, passes in reversed(checks):
        reason = F.when(~F.coalesce(passes, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def filter_stats(decided: DataFrame) -> DataFrame:
    return decided.groupBy("reason").agg(F.count("*").alias("n"))


def visible(user_id, groups: list[str], admin: bool, permissions: list[str]) -> Column:
    """Owner, group member, public with the right to read public rows, or shared with the user; an admin sees all."""
    if admin:
        return F.lit(True)
    mine = F.col("owner") == user_id
    public = F.col("is_public") & F.lit("read_public" in permissions)
    shared = F.array_contains("shared_with", F.lit(user_id))
    member = F.arrays_overlap("group_ids", F.array(*[F.lit(g) for g in groups])) if groups else F.lit(False)
    return F.coalesce(mine, F.lit(False)) | F.coalesce(member, F.lit(False)) | F.coalesce(public, F.lit(False)) | F.coalesce(shared, F.lit(False))


def _rule_clauses(rules: DataFrame, users: DataFrame, permission: str) -> DataFrame:
    """A row for each user and rule that says something to the user: ``clause`` (true, false, or null where only conditions speak) and ``conditions``."""
    active = rules.where(F.col("active")).select("rule_id", "permissions", "allow_users", "deny_users", "allow_groups", "deny_groups", F.coalesce("conditions", F.create_map().cast("map<string,string>")).alias("conditions"))
    within = lambda names, value: F.coalesce(F.array_contains(names, F.col(value)), F.lit(False))
    meets = lambda names: F.coalesce(F.arrays_overlap(names, "group_ids"), F.lit(False))
    denied = within("deny_users", "user_id") | meets("deny_groups")
    allowed = within("allow_users", "user_id") | meets("allow_groups")
    both = users.select("user_id", "group_ids", "is_admin").crossJoin(F.broadcast(active)).where(F.array_contains("permissions", permission) | F.col("is_admin"))
    said = both.select("user_id", "rule_id", F.when(denied, False).when(allowed, True).alias("clause"), "conditions")
    return said.where(F.col("clause").isNotNull() | (F.size("conditions") > 0))


def rule_verdicts(rules: DataFrame, users: DataFrame, permission: str) -> DataFrame:
    """``user_id, allowed, conditions``: what the active rules that carry the permission (for an admin: all active rules) ask of the user's rows.

    ``rules(rule_id, active, permissions, allow_users, deny_users, allow_groups, deny_groups, conditions)`` is a small table, ``conditions`` a map
    of fields to values; ``users(user_id, group_ids, is_admin)``.  Within a rule a deny replaces the allow; its conditions stay.  A rule that
    neither names the user nor has conditions says nothing.  All that is said must hold: one deny hides everything, and a row must meet every
    condition, of which two of one field may contradict each other.
    """
    said = _rule_clauses(rules, users, permission)
    pairs = F.flatten(F.collect_list(F.map_entries("conditions")))
    verdict = said.groupBy("user_id").agg(F.bool_and(F.coalesce("clause", F.lit(True))).alias("allowed"), F.array_sort(F.array_distinct(pairs)).alias("conditions"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return users.join(verdict, "user_id", "left").select("user_id", F.coalesce("allowed", F.lit(True)).alias("allowed"), F.coalesce("conditions", none).alias("conditions"))


def meets_conditions(conditions: Column, fields: dict[str, Column]) -> Column:
    """Whether a row's ``fields`` have all values of a verdict's ``conditions``; a condition on a field that isn't there is not met."""
    known = F.create_map(*[x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))]) if fields else F.create_map().cast("map<string,string>")
    return F.forall(conditions, lambda c: F.coalesce(F.try_element_at(known, c["key"]) == c["value"], F.lit(False)))


def rule_predicate(rules: DataFrame, user_id: int, groups: list[str], admin: bool, permission: str, fields: list[str]) -> Column:
    """The rules compiled to one condition on the rows for one user context, so that it reaches the scan; a column named in ``fields`` is compared as text.

    The rules table is small: its clauses for this user come to the driver.
    """
    context = rules.sparkSession.createDataFrame([(user_id, groups, admin)], "user_id long, group_ids array<string>, is_admin boolean")
    verdict = rule_verdicts(rules, context, permission).head()
    if not verdict["allowed"] or any(key not in fields for key, _ in verdict["conditions"]):
        return F.lit(False)
    out = F.lit(True)
    for key, value in verdict["conditions"]:
        out = out & (F.col(key) == F.lit(value))
    return out


def secured(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that the condition lets through (an unknown one doesn't); it runs before any search on them, at the scan where it can."""
    return rows.where(condition)


def role_closure(roles: DataFrame) -> DataFrame:
    """``role, above``: each role with itself and all its ancestors, over any number of levels; cycles end.

    Paths are doubled in each round, so a chain of n levels takes about log n of them; the tables are small and written between rounds.
    """
    named = roles.select("role").unionByName(roles.where("parent is not null").select(F.col("parent").alias("role"))).distinct()
    paths = named.select("role", F.col("role").alias("above")).unionByName(roles.where("parent is not null").select("role", F.col("parent").alias("above"))).distinct()
    known = -1
    while True:
        paths = written(paths)
        now = paths.count()
        if now == known:
            return paths
        known = now
        onward = paths.select(F.col("role").alias("above"), F.col("above").alias("top"))
        paths = paths.unionByName(paths.join(onward, "above").select("role", F.col("top").alias("above"))).distinct()


def effective_permissions(user_roles: DataFrame, roles: DataFrame, role_permissions: DataFrame, as_of: str) -> DataFrame:
    """``user_id, permission`` over unexpired roles and all their ancestors, however many levels up.

    The role table is closed first, so memberships are joined once.
    """
    held = user_roles.where(F.col("expires").isNull() | (F.col("expires") > F.expr(f"timestamp'{as_of}'"))).select("user_id", "role").distinct()
    granted = role_closure(roles).join(role_permissions.withColumnRenamed("role", "above"), "above").select("role", "permission").distinct()
    return held.join(granted, "role").select("user_id", "permission").distinct()


def has_permissions(effective: DataFrame, wanted: list[str]) -> DataFrame:
    """Whether each user has any or all of the wanted permissions."""
    n = F.countDistinct(F.when(F.col("permission").isin(*wanted), F.col("permission")))
    return effective.groupBy("user_id").agg((n > 0).alias("has_any"), (n == len(set(wanted))).alias("has_all"))


def has_role(user_roles: DataFrame, role: str, as_of: str) -> DataFrame:
    """Whether each user has the role now: a membership that has not expired."""
    open_ = F.col("expires").isNull() | (F.col("expires") > F.expr(f"timestamp'{as_of}'"))
    return user_roles.groupBy("user_id").agg(F.coalesce(F.bool_or((F.col("role") == role) & open_), F.lit(False)).alias("has_role"))


def check_access(requests: DataFrame, effective: DataFrame) -> DataFrame:
    """``requests(user_id, resource, action)`` with ``allowed``: the user has the permission ``resource:action``, ``resource:*`` or ``*``."""
    wanted = F.explode(F.array(F.concat("resource", F.lit(":"), "action"), F.concat("resource", F.lit(":*")), F.lit("*")))
    rights = effective.select("user_id", "permission").distinct()
    found = requests.select("user_id", "resource", "action").distinct().withColumn("permission", wanted).join(rights.withColumn("_has", F.lit(True)), ["user_id", "permission"], "left")
    verdict = found.groupBy("user_id", "resource", "action").agg(F.coalesce(F.bool_or("_has"), F.lit(False)).alias("allowed"))
    return requests.join(verdict, ["user_id", "resource", "action"])


def user_list(users: DataFrame, user_roles: DataFrame, role: str | None = None, active: bool | None = None) -> DataFrame:
    """Users with their roles as one text; optionally only those with a role, and only active or inactive ones (column ``is_active``)."""
    users = users if active is None else users.where(F.col("is_active") == active)
    rows = users.join(user_roles.select("user_id", "role"), "user_id")
    out = rows.groupBy("user_id", "name").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max(F.col("role") == F.lit(role or "")).alias("_has"))
    return (out.where("_has") if role else out).drop("_has")


def membership_report(user_roles: DataFrame, role_permissions: DataFrame, as_of: str) -> DataFrame:
    """Each membership with its status at ``as_of`` and the role's permissions as one text."""
    names = role_permissions.groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("permission")), ",").alias("permissions"))
    status = F.when(F.col("expires") < F.expr(f"timestamp'{as_of}'"), "expired").otherwise("active")
    return user_roles.join(F.broadcast(names), "role", "left").select("user_id", "role", status.alias("status"), F.coalesce("permissions", F.lit("")).alias("permissions"))


