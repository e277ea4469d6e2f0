"""Manifest rules and static code checks as rule tables over columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EDGE_WEIGHT, HINT_TYPES, PERMISSION, SKILL_ID

#: Fixed value: a version.
SEMVER = r"^\d+\.\d+\.\d+(-[a-zA-Z0-9]+)?$"


def rules(m: str = "") -> list[tuple[str, str, Column]]:
    """(field, rule, holds) for each required field."""
    c = lambda x: F.col(f"{m}{x}")
    yes = lambda x: F.coalesce(x, F.lit(False))
    size = F.length(c("intent_description"))
    return [
        ("skill_id", "required", c("skill_id").isNotNull()),
        ("skill_id", "pattern", c("skill_id").isNull() | yes(c("skill_id").rlike(SKILL_ID))),
        ("version", "required", c("version").isNotNull()),
        ("version", "pattern", c("version").isNull() | yes(c("version").rlike(SEMVER))),
        ("intent_description", "required", c("intent_description").isNotNull()),
        ("intent_description", "length", c("intent_description").isNull() | size.between(50, 500)),
        ("permissions", "required", c("permissions").isNotNull()),
        ("permissions", "min_items", c("permissions").isNull() | (F.size(c("permissions")) >= 1)),
        ("permissions", "item_pattern", c("permissions").isNull() | F.forall(c("permissions"), lambda p: p.rlike(PERMISSION))),
    ]


def errors(df: DataFrame, m: str = "") -> DataFrame:
    """Add ``errors``: ``field:rule`` of every rule that fails, and ``is_valid``."""
    found = F.array_compact(F.array(*(F.when(~ok, F.lit(f"{f}:{r}")) for f, r, ok in rules(m))))
    return df.withColumn("errors", found).withColumn("is_valid", F.size("errors") == 0)


def hint_edges(df: DataFrame, uid: str, hints: str) -> DataFrame:
    """(source, target, edge_type, weight) from a struct of hint lists."""

    def edge(e: str):
        return lambda t: F.struct(t.alias("target"), F.lit(e).alias("edge_type"), F.lit(EDGE_WEIGHT[e]).alias("weight"))

    none = F.array().cast("array<string>")
    parts = [F.transform(F.coalesce(F.col(f"{hints}.{k}"), none), edge(e)) for k, e in HINT_TYPES.items()]
    return df.select(F.col(uid).alias("source"), F.explode(F.concat(*parts)).alias("x")).select("source", "x.target", "x.edge_type", "x.weight")


def hint_warnings(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``hint_warnings`` of a manifest given as JSON: hints that are no mapping, kinds that are no list, unknown kinds."""
    text = F.get_json_object(raw, "$.topology_hints")
    hints = F.from_json(text, "map<string,string>")
    names = F.array_sort(F.map_keys(hints))
    lists = lambda k: F.col(raw).isNotNull() & F.coalesce(F.element_at(hints, k).startswith("["), F.lit(False))
    wrong = F.transform(F.filter(names, lambda k: k.isin(list(HINT_TYPES)) & ~lists(k)), lambda k: F.concat(F.lit("topology_hints."), k, F.lit(":list")))
    unknown = F.transform(F.filter(names, lambda k: ~k.isin(list(HINT_TYPES))), lambda k: F.concat(F.lit("topology_hints."), k, F.lit(":unknown")))
    none = F.array().cast("array<string>")
    out = F.when(text.isNull(), none).when(~text.startswith("{"), F.array(F.lit("topology_hints:mapping"))).otherwise(F.concat(F.coalesce(wrong, none), F.coalesce(unknown, none)))
    return df.withColumn("hint_warnings", out)


#: The static checks as (language, rule, severity, pattern); every hit is an issue on its line.
CODE_RULES = [
    ("bash", "unquoted_variable", "warning", r"\$([A-Za-z_][A-Za-z0-9_]*)[^\"'\w]"),
    ("javascript", "console_log", "info", r"console\.log\("),
    ("typescript", "implicit_any", "warning", r":\s*any\b"),
    ("rust", "unsafe_block", "warning", r"unsafe\s*\{"),
    ("java", "empty_catch", "error", r"catch\s*\([^)]+\)\s*\{\s*\}"),
]
#: Marks of error handling in Bash; patterns of an assigned and of a checked error in Go.
BASH_SAFE = ["set -e", "set -o errexit", "|| exit", "trap"]
GO_ASSIGNED, GO_CHECKED = r"err\s*:=|err\s*,", r"if\s+err\s*!=\s*nil|err\s*==\s*nil"
#: The complexity above which a block is reported, and functions that need no docstring.
COMPLEX, PLAIN_NAMES = 5.0, ["__init__", "__str__", "__repr__"]
SEVERITIES = ["error", "warning", "info"]
MARK = "\u0001"


def _issue(rule: str, severity: str, line: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.cast("int").alias("line"))


def _hits(text: Column, pattern: str, rule: str, severity: str, start: Column) -> Column:
    """An issue per match, on the line where the match begins (``start`` is the number of the first line)."""
    lines = F.split(F.regexp_replace(text, f"({pattern})", MARK + "$0"), "\n")
    per_line = F.transform(lines, lambda x, k: F.array_repeat(_issue(rule, severity, start + k), F.length(x) - F.length(F.replace(x, F.lit(MARK), F.lit("")))))
    return F.flatten(per_line)


def code_issues(df: DataFrame, language: str = "language", code: str = "code", line_start: str | None = None, facts: str | None = None) -> DataFrame:
    """Add ``issues``: array of struct(rule, severity, line), in order of rule and line.

    ``line_start`` names the column of a block's first line (1 without it).
    With ``facts`` (a column of code_facts) Python blocks are also checked for
    an entry point, complexity and docstrings.  Null code counts as empty.
    """
    lang, text = F.col(language), F.translate(F.coalesce(F.col(code), F.lit("")), MARK, "")
    start = F.coalesce(F.col(line_start), F.lit(1)) if line_start else F.lit(1)
    none = F.array().cast("array<struct<rule:string,severity:string,line:int>>")
    parts = [F.when(lang == name, _hits(text, pattern, rule, severity, start)) for name, rule, severity, pattern in CODE_RULES]
    safe = F.lit(False)
    for mark in BASH_SAFE:
        safe = safe | text.contains(mark)
    parts.append(F.when((lang == "bash") & ~safe, F.array(_issue("missing_error_handling", "warning", start))))
    unchecked = text.rlike(GO_ASSIGNED) & ~text.rlike(GO_CHECKED)
    parts.append(F.when((lang == "go") & unchecked, F.slice(_hits(text, GO_ASSIGNED, "unhandled_error", "error", start), 1, 1)))
    if facts:
        functions, python = F.col(f"{facts}.functions"), lang == "python"
        parts.append(F.when(python & ~F.exists(functions, lambda f: f["is_entry"]), F.array(_issue("missing_entrypoint", "warning", start))))
        parts.append(F.when(python & (facts_complexity(facts) > COMPLEX), F.array(_issue("high_complexity", "warning", start))))
        bare = F.filter(functions, lambda f: ~f["docstring"] & ~f["name"].isin(PLAIN_NAMES))
        parts.append(F.when(python, F.transform(bare, lambda f: _issue("missing_docstring", "info", f["line_start"]))))
    return df.withColumn("issues", F.concat(*(F.coalesce(p, none) for p in parts)))


def severity_counts(df: DataFrame, issues: str = "issues") -> DataFrame:
    """Add error_count, warning_count, info_count, has_errors and has_warnings of a column of ``code_issues``."""
    count = lambda level: F.size(F.filter(issues, lambda i: i["severity"] == level)).cast("long")
    out = df.withColumns({f"{level}_count": count(level) for level in SEVERITIES})
    return out.withColumns({"has_errors": F.col("error_count") > 0, "has_warnings": F.col("warning_count") > 0})


def facts_complexity(facts: str = "facts") -> Column:
    """The complexity of a column of code_facts."""
    functions = F.col(f"{facts}.functions")
    parameters = F.aggregate(functions, F.lit(0), lambda t, f: t + F.size(f["params"]))
    asyncs = F.size(F.filter(functions, lambda f: f["is_async"]))
    return complexity(F.size(functions), parameters, F.size(f"{facts}.imports"), F.size(f"{facts}.variables"), asyncs)


def complexity(functions: Column, parameters: Column, imports: Column, variables: Column, asyncs: Column) -> Column:
    """A score of 0 to 9: capped terms of the counts of functions, parameters, imports, variables and async functions."""
    term = lambda n, w, most: F.least(n * F.lit(w), F.lit(most))
    return F.round(term(functions, 0.5, 3.0) + term(parameters, 0.1, 2.0) + term(imports, 0.2, 2.0) + term(variables, 0.1, 1.0) + term(asyncs, 0.3, 1.0), 6)


#: Optional manifest fields, as a JSON schema; what breaks it is a warning only.
OPTIONAL = {
    "properties": {
        "tags": {"type": "array", "items": {"type": "string"}},
        "author": {"type": "string"},
        "created_at": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?"},
        "updated_at": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?"},
        "min_agent_version": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        "max_agent_version": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        "deprecated": {"type": "boolean"},
        "deprecation_message": {"type": "string"},
        "success_rate": {"type": "number", "minimum": 0.0, "maximum": 1.0},
        "avg_latency_ms": {"type": "integer", "minimum": 0},
        "topology_hints": {"type": "object"},
    }
}
REQUIRED = ["skill_id", "version", "intent_description", "permissions"]


def json_type(value: Column) -> Column:
    """The JSON type of a value given as JSON text: null, boolean, integer, number, string, array or object."""
    v = F.trim(value)
    kinds = [("string", v.startswith('"')), ("array", v.startswith("[")), ("object", v.startswith("{")), ("boolean", v.isin("true", "false")), ("integer", v.rlike(r"^-?\d+$")), ("number", v.rlike(r"^-?\d"))]
    out = F.lit("null")
    for name, holds in reversed(kinds):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def _fits(kind: Column, wanted: str) -> Column:
    """Integers are numbers, and a truth value passes as an integer."""
    return kind.isin({"number": ["number", "integer"], "integer": ["integer", "boolean"]}.get(wanted, [wanted]))


def warnings(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``warnings`` of a manifest given as JSON: ``field:rule`` of optional fields that break it, ``field:unknown`` of others."""
    out = schema_errors(df, raw, OPTIONAL)
    broken = F.transform("schema_errors", lambda e: F.concat(F.regexp_replace(e["path"], r"^\$\.?", ""), F.lit(":"), e["validator"]))
    known = [*REQUIRED, *OPTIONAL["properties"]]
    names = F.coalesce(F.map_keys(F.from_json(raw, "map<string,string>")), F.array().cast("array<string>"))
    unknown = F.transform(F.filter(F.array_sort(names), lambda k: ~k.isin(known) & ~k.startswith("_")), lambda k: F.concat(k, F.lit(":unknown")))
    return out.withColumn("warnings", F.concat(broken, unknown)).drop("schema_errors")


def schema_errors(df: DataFrame, value: str, schema: dict) -> DataFrame:
    """Add ``schema_errors``: array of struct(path, validator) where a JSON text breaks a schema.

    ``schema`` is a JSON schema of draft 7; type, required, properties, enum,
    pattern, minLength, maxLength, minimum, maximum, minItems, items and
    additionalProperties are checked, as columns.  The plan is as large as the
    schema, not the data.  Text that isn't JSON has the one error ``$``, ``json``.
    """
    root = F.try_parse_json(value)

    def at(parent: Column, key: str) -> Column:
        return F.try_variant_get(parent, f"$['{key}']", "variant")

    def check(v: Column, s: dict, path: Column, deep: int) -> list[Column]:
        found = []
        here = v.isNotNull()
        text = F.to_json(v)
        kind = json_type(text)

        def fail(holds: Column, name: str) -> None:
            found.append(F.when(here & F.coalesce(holds, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(name).alias("validator")))))

        if "type" in s:
            wanted = s["type"] if isinstance(s["type"], list) else [s["type"]]
            ok = F.lit(False)
            for w in wanted:
                ok = ok | _fits(kind, w)
            fail(~ok, "type")
        plain = F.try_variant_get(v, "$", "string")
        if "enum" in s:
            fail(~text.isin([json.dumps(x, ensure_ascii=False) for x in s["enum"]]), "enum")
        if "pattern" in s:
            fail((kind == "string") & ~plain.rlike(s["pattern"]), "pattern")
        for key, worse in (("minLength", lambda n, m: n < m), ("maxLength", lambda n, m: n > m)):
            if key in s:
                fail((kind == "string") & worse(F.length(plain), s[key]), key)
        for key, worse in (("minimum", lambda n, m: n < m), ("maximum", lambda n, m: n > m)):
            if key in s:
                fail(_fits(kind, "number") & worse(F.try_variant_get(v, "$", "double"), s[key]), key)
        items = F.try_variant_get(v, "$", "array<variant>")
        if "minItems" in s:
            fail((kind == "array") & (F.size(items) < s["minItems"]), "minItems")
        if "items" in s and deep:
            inner = F.transform(items, lambda x, k: F.flatten(F.array_compact(F.array(*check(x, s["items"], F.concat(path, F.lit("["), k.cast("string"), F.lit("]")), deep - 1)))))
            found.append(F.when(here & (kind == "array"), F.flatten(inner)))
        for key in s.get("required", []):
            found.append(F.when(here & (kind == "object") & at(v, key).isNull(), F.array(F.struct(F.concat(path, F.lit(f".{key}")).alias("path"), F.lit("required").alias("validator")))))
        for key, sub in s.get("properties", {}).items():
            found += check(at(v, key), sub, F.concat(path, F.lit(f".{key}")), deep)
        if s.get("additionalProperties") is False:
            names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
            more = F.filter(F.array_sort(names), lambda k: ~k.isin(list(s.get("properties", {}))))
            found.append(F.when(here & (kind == "object"), F.transform(more, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("validator")))))
        return found

    none = F.array().cast("array<struct<path:string,validator:string>>")
    parts = F.flatten(F.array_compact(F.array(none, *check(root, schema, F.lit("$"), 2))))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("validator")))
    return df.withColumn("schema_errors", F.when(root.isNull(), broken).otherwise(parts))
