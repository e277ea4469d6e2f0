"""Permission strings ``category:action[:target]``: parsing, risk, conflicts and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import PERMISSION

#: Permissions that are high-risk as they stand.
HIGH_RISK = [
    "fs:delete:/", "fs:write:/", "fs:execute:/", "net:connect:*", "net:http:*", "exec:execute:*",
    "exec:admin:*", "system:admin", "system:shutdown", "secret:read:*", "secret:write:*",
]
#: Actions that are high-risk without a narrow target.
OPEN_RISK = {"fs": ["delete", "execute"], "exec": ["execute"], "system": ["admin", "shutdown"], "secret": ["read", "write"]}
#: Usual actions by category.
ACTIONS = {
    "fs": ["read", "write", "delete", "execute", "list", "create"],
    "net": ["connect", "http", "https", "ssh", "list"],
    "db": ["query", "read", "write", "delete", "create", "update", "admin"],
    "exec": ["execute", "list"],
    "env": ["read", "write", "list"],
    "secret": ["read", "write", "list"],
    "agent": ["control", "query", "configure"],
    "system": ["info", "configure", "admin", "shutdown"],
}
#: Usual targets by category.
TARGETS = {
    "fs": r"^/[a-zA-Z0-9_/.-]*$",
    "net": r"^[a-zA-Z0-9.-]+(:\d+)?$",
    "db": r"^[a-zA-Z0-9_-]+$",
    "exec": r"^[a-zA-Z0-9_/-]+$",
    "env": r"^[A-Z_][A-Z0-9_]*$",
    "secret": r"^[a-zA-Z0-9_-]+$",
}


def parse(df: DataFrame, permission: str = "permission") -> DataFrame:
    """Add (is_valid, category, action, target, high_risk, usual_action, usual_target)."""
    p = F.col(permission)
    parts = F.split(p, ":")
    valid = F.coalesce(p.rlike(PERMISSION), F.lit(False))
    part = lambda k: F.when(valid, F.try_element_at(parts, F.lit(k)))
    df = df.withColumns({"is_valid": valid, "category": part(1), "action": part(2), "target": part(3)})
    open_risk = F.lit(False)
    for category, actions in OPEN_RISK.items():
        open_risk = open_risk | ((F.col("category") == category) & F.col("action").isin(actions))
    narrow = F.col("target").isNotNull() & ~F.col("target").isin("*", "/", "all")
    risk = p.isin(HIGH_RISK) | F.coalesce(F.col("target").isin("*", "/"), F.lit(False)) | (open_risk & ~narrow)
    usual = ~F.col("category").isin(list(ACTIONS))
    for category, actions in ACTIONS.items():
        usual = usual | ((F.col("category") == category) & F.col("action").isin(actions))
    fits = F.col("target").isNull() | ~F.col("category").isin(list(TARGETS))
    for category, pattern in TARGETS.items():
        fits = fits | ((F.col("category") == category) & F.col("target").rlike(pattern))
    return df.withColumns({"high_risk": valid & F.coalesce(risk, F.lit(False)), "usual_action": F.when(valid, usual), "usual_target": F.when(valid, fits)})


def warnings(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``warnings``: what is unusual about a valid permission, ``action`` and ``target``, in that order."""
    found = F.array(F.when(~F.col("usual_action"), F.lit("action")), F.when(~F.col("usual_target"), F.lit("target")))
    return parsed.withColumn("warnings", F.filter(found, lambda x: x.isNotNull()))


def summary(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Per key: counts, high-risk count, categories in order, whether all are valid."""
    return parsed.groupBy(key).agg(
        F.count("*").alias("total_count"),
        F.count_if("high_risk").alias("high_risk_count"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.bool_and("is_valid").alias("is_valid"),
    )


#: Actions that clash on one target.
CLASHES = {("read", "delete"): "read_delete_conflict", ("write", "execute"): "write_execute_conflict"}


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of parsed permissions of different owners that clash on the same category and target.

    The equality on (category, target) and on the action that clashes is the join
    key, so only clashing pairs are formed.
    """
    side = lambda df, s: df.select("category", "target", F.col("id").alias(f"id_{s}"), F.col("action").alias(f"action_{s}"), F.col("permission").alias(f"permission_{s}"))
    kind, against = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (x, y), name in CLASHES.items():
        kind = F.when(F.col("action_a").isin(x, y), F.lit(name)).otherwise(kind)
        against = F.when(F.col("action_a") == x, F.lit(y)).when(F.col("action_a") == y, F.lit(x)).otherwise(against)
    left, right = side(a, "a").withColumn("against", against).where("against is not null"), side(b, "b")
    same = (left["category"] == right["category"]) & left["target"].eqNullSafe(right["target"]) & (left["against"] == right["action_b"])
    return left.join(right, same).where("id_a < id_b").select("id_a", "id_b", kind.alias("type"), "permission_a", "permission_b")


#: Parameter keys by resource and verbs by action, first match first.
RESOURCES = {
    "fs": ["path", "file", "directory", "filename"],
    "net": ["url", "host", "endpoint", "domain"],
    "db": ["query", "database", "table", "sql"],
    "exec": ["command", "cmd", "shell", "exec"],
    "env": ["env", "variable", "config"],
}
VERBS = {
    "read": ["read", "get", "fetch", "list", "show", "check"],
    "write": ["write", "create", "add", "insert", "update", "set", "commit", "push"],
    "delete": ["delete", "remove", "drop", "clean"],
    "run": ["run", "execute", "start", "launch", "build", "deploy"],
}


def tool_skill(tool: Column) -> Column:
    """``git_commit`` -> ``git:commit``; names with a colon stay."""
    return F.when(tool.contains(":"), tool).otherwise(F.replace(tool, F.lit("_"), F.lit(":")))


def resource_type(keys: Column) -> Column:
    out = F.lit("unknown")
    for name, hints in reversed(RESOURCES.items()):
        out = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, hints))), F.lit(name)).otherwise(out)
    return out


def action_type(tool: Column) -> Column:
    out = F.lit("unknown")
    for name, verbs in reversed(VERBS.items()):
        out = F.when(F.lower(tool).rlike("|".join(verbs)), F.lit(name)).otherwise(out)
    return out


def intercept(actions: DataFrame, declared: DataFrame, granted: DataFrame, strict: bool = False) -> DataFrame:
    """(action_id, allowed, reason) of ``actions`` (action_id, skill_id, session_id, resource, action, target).

    ``declared`` (skill_id, category, action, target) and ``granted``
    (session_id, category, action, target).  An action must match a declared
    permission of its skill, and every declared permission must lie within what
    its session was granted; a target ``*`` covers all, and in ``fs`` one that ends in
    ``*`` covers what begins with the rest.  Where a skill declares nothing, or a session was granted nothing, that
    check passes, unless ``strict``.
    """

    def covers(category: str, wide: Column, narrow: Column) -> Column:
        within = (F.col(category) == "fs") & wide.endswith("*") & narrow.startswith(F.rtrim(wide, F.lit("*")))
        return F.coalesce((wide == "*") | (wide == narrow) | within, F.lit(False))

    d = declared.select(F.col("skill_id").alias("ds"), F.col("category").alias("dc"), F.col("action").alias("da"), F.coalesce("target", F.lit("*")).alias("dt"))
    g = granted.select(F.col("session_id").alias("gs"), F.col("category").alias("gc"), F.col("action").alias("ga"), F.coalesce("target", F.lit("*")).alias("gt"))
    with_d = actions.join(d, F.col("skill_id") == F.col("ds"), "left")
    matched = with_d.groupBy("action_id").agg(F.count("ds").alias("n_declared"), F.count_if((F.col("resource") == F.col("dc")) & (F.col("action") == F.col("da")) & covers("dc", F.col("dt"), F.coalesce("target", F.lit("")))).alias("n_matched"))
    has_grant = g.select(F.col("gs").alias("hs")).distinct()
    exceed = (
        with_d.where("ds is not null").join(g, (F.col("session_id") == F.col("gs")) & (F.col("dc") == F.col("gc")) & (F.col("da") == F.col("ga")), "left")
        .groupBy("action_id", "session_id", "dc", "da", "dt").agg(F.count_if(covers("dc", F.col("gt"), F.col("dt"))).alias("n_cover"))
        .join(has_grant, F.col("session_id") == F.col("hs"), "left")
        .where(F.col("n_cover") == 0).where(F.lit(strict) | F.col("hs").isNotNull())
        .groupBy("action_id").agg(F.count("*").alias("n_exceed"))
    )
    out = matched.join(exceed, "action_id", "left")
    undeclared = (F.col("n_matched") == 0) & (F.lit(strict) | (F.col("n_declared") > 0))
    reason = F.when(undeclared, "not declared").when(F.coalesce("n_exceed", F.lit(0)) > 0, "exceeds authorization").otherwise("")
    return out.select("action_id", (reason == "").alias("allowed"), reason.alias("reason"))


def suggestion(code: Column, skill: Column, resource: Column, action: Column) -> Column:
    """What to do about a denied action, by its error code."""
    review = F.lit("Review skill permissions and session authorization")
    more = F.concat(F.lit("Request additional permission: "), resource, F.lit(":"), action)
    load = F.concat(F.lit("Request skill '"), skill, F.lit("' to be loaded into context"))
    return F.when(code == "PERMISSION_DENIED", F.coalesce(more, review)).when(code == "SKILL_NOT_IN_CONTEXT", load).otherwise(review)
