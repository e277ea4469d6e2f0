"""Query text functions: cleaning, enrichment, intents, token counts and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Environment flags and the words they add, in order.
ENVIRONMENT = {"git_repo": "git repository", "database_connected": "database", "docker_available": "docker", "k8s_cluster": "kubernetes"}

#: Intent categories and the substrings that show them.
INTENTS = {
    "git": ["git", "commit", "push", "pull", "branch", "merge", "clone", "checkout", "rebase"],
    "database": ["database", "query", "sql", "table", "insert", "update", "delete", "select", "postgres", "mysql"],
    "file": ["file", "read", "write", "delete", "copy", "move", "directory", "path", "folder"],
    "network": ["http", "api", "request", "fetch", "download", "upload", "url", "endpoint"],
    "docker": ["docker", "container", "image", "compose", "volume", "build"],
    "test": ["test", "pytest", "unittest", "coverage", "assert", "mock"],
    "deploy": ["deploy", "kubernetes", "k8s", "helm", "service", "ingress"],
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: str | Column) -> Column:
    """Collapse white space, trim, drop all but word characters and spaces, lower-case.

    Unicode classes are used, as for Python's ``\\w``.  Runs of spaces can come
    back, since characters are dropped after collapsing.
    """
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(col(text), r"(?U)\s+", " ")), r"(?U)[^\w\s]", ""))


def enrich(text: str | Column, environment: str | Column) -> Column:
    """Append the words of the flags set in a map<string,boolean>."""
    words = F.array_compact(F.array(*(F.when(F.coalesce(col(environment)[k], F.lit(False)), F.lit(w)) for k, w in ENVIRONMENT.items())))
    return F.when(F.size(words) > 0, F.concat(col(text), F.lit(" context: "), F.array_join(words, ", "))).otherwise(col(text))


def intents(text: str | Column) -> Column:
    """The categories with a pattern in the lower-cased text, in fixed order."""
    low = F.lower(col(text))

    def any_of(patterns: list[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | low.contains(p)
        return found

    return F.array_compact(F.array(*(F.when(any_of(p), F.lit(k)) for k, p in INTENTS.items())))


def preprocess(text: str | Column, environment: str | Column, previous: str | Column | None = None) -> Column:
    """struct(original, cleaned, enriched, intent_keywords, previous_skills): the whole query pre-processing.

    Intents are those of the enriched text; previous skills are carried along.
    """
    cleaned = clean(text)
    enriched = enrich(cleaned, environment)
    before = F.coalesce(col(previous), F.array().cast("array<string>")) if previous is not None else F.array().cast("array<string>")
    return F.struct(col(text).alias("original"), cleaned.alias("cleaned"), enriched.alias("enriched"), intents(enriched).alias("intent_keywords"), before.alias("previous_skills"))


def word_tokens(text: str | Column) -> Column:
    """floor(words * 1.3); 0 for null and blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.floor(F.size(F.split(t, " ")) * F.lit(1.3)).cast("int"))


def char_tokens(text: str | Column) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("int")


def bpe_tokens(text: str | Column, vocabulary: str) -> Column:
    """The ids that the tokenizer of a vocabulary file makes of a text, counted; 0 for null and empty texts.

    The file is read by the tasks, so its path must be known to all executors.
    """

    def count(texts):
        import pyarrow as pa
        from tokenizers import Tokenizer

        if vocabulary not in made:
            made[vocabulary] = Tokenizer.from_file(vocabulary)
        found = made[vocabulary].encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return pa.array([len(x.ids) for x in found], pa.int64())

    made: dict = {}
    return F.arrow_udf(count, "long")(col(text))


def query_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def content(description: str | Column, uid: str | Column) -> Column:
    """A skill's text: its description, or its id where there is none."""
    return F.coalesce(F.when(F.trim(col(description)) != "", col(description)), F.concat(F.lit("Skill: "), col(uid).cast("string")))


def bullets(items: Column) -> Column:
    """One line per struct(id, text), the first line of the text cut to 80 characters; empty without items."""
    lines = F.transform(F.filter(items, lambda x: x["text"] != ""), lambda x: F.concat(F.lit("• "), x["id"].cast("string"), F.lit(": "), F.substring(F.split(x["text"], "\n")[0], 1, 80)))
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.concat_ws("\n", F.lit("Relevant knowledge:"), lines))


def inject(*parts: str | Column) -> Column:
    """Prompt parts in order, empty ones dropped, blank lines between."""
    return F.concat_ws("\n\n", F.filter(F.array(*map(col, parts)), lambda x: x.isNotNull() & (x != "")))


#: Patterns of personal data by kind, the longer numbers first.
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "id_card": r"\b\d{17}[\dXx]\b",
    "card": r"\b\d{16}\b",
    "phone": r"\b1[3-9]\d{9}\b",
    "key": r"\bsk-[A-Za-z0-9]{16,}\b",
}
#: Characters at the end that a partial mask leaves.
VISIBLE = {"email": 3, "id_card": 4, "card": 4, "phone": 4, "key": 4}


def mask_personal(text: str | Column, mode: str = "redact", kinds: list[str] | None = None) -> Column:
    """The text with personal data masked; null counts as empty.

    ``redact`` puts ``[kind]`` in its place, ``full`` a star per character,
    ``partial`` stars but for the last characters, ``hash`` the first 12 digits of
    its SHA-256.
    """
    out = F.coalesce(col(text), F.lit(""))
    for kind in kinds or PERSONAL:
        pattern = PERSONAL[kind]
        if mode == "redact":
            out = F.regexp_replace(out, pattern, f"[{kind}]")
            continue
        shown = VISIBLE[kind]
        masked = {
            "full": lambda x: F.repeat(F.lit("*"), F.length(x)),
            "partial": lambda x: F.concat(F.repeat(F.lit("*"), F.greatest(F.length(x) - shown, F.lit(0))), F.right(x, F.lit(shown))),
            "hash": lambda x: F.substring(F.sha2(x, 256), 1, 12),
        }[mode]
        # The text between hits, and the hits, which stand between them.
        rest, hits = F.split(out, pattern), F.regexp_extract_all(out, F.lit(f"({pattern})"), 1)
        pairs = F.zip_with(rest, F.transform(hits, masked), lambda r, h: F.concat(F.coalesce(r, F.lit("")), F.coalesce(h, F.lit(""))))
        out = F.array_join(pairs, "")
    return out


#: Code that raises a risk level, the worst level first.
RISKS = {"critical": r"(?i)(rm\s+-rf|mkfs|shutdown|drop\s+table)", "high": r"(?i)(eval\s*\(|exec\s*\(|sudo|chmod\s+777)", "medium": r"(?i)(subprocess|os\.system|requests?\.|curl|wget)"}


def code_risk(code: str | Column) -> Column:
    level = F.lit("low")
    for name, pattern in reversed(RISKS.items()):
        level = F.when(col(code).rlike(pattern), F.lit(name)).otherwise(level)
    return level


def infer_uid(path: str | Column) -> Column:
    """``grandparent:parent`` of a file's path."""
    parts = F.split(col(path), "/")
    return F.concat(F.try_element_at(parts, F.lit(-3)), F.lit(":"), F.try_element_at(parts, F.lit(-2)))


#: Other names of languages.
ALIASES = {"py": "python", "sh": "bash", "shell": "bash", "js": "javascript", "ts": "typescript", "golang": "go", "rs": "rust", "c++": "cpp", "cplusplus": "cpp"}


def language(name: str | Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(table[F.lower(col(name))], F.lower(col(name)))
