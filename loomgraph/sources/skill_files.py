"""Skill files: directory scans, front matter, fenced blocks."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import ship

FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
#: Fixed value: a fenced block with its language and metadata.
BLOCK = r"```(\w+)?(?:\s+\{([^}]*)\})?\s*\n(.*?)\n```"
BLOCKS = "array<struct<language:string,code:string,line_start:int,line_end:int,metadata:map<string,string>,is_entrypoint:boolean>>"


def scan(spark: SparkSession, path: str, name: str = "SKILL.md", recursive: bool = True, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, hash) of the files with exactly that name; ``ignore`` are glob patterns of paths left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = files.select("path", F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("hash"))
    for g in ignore:
        out = out.where(~F.col("path").rlike(".*" + re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"))
    return out


def split(files: DataFrame, text: str = "text") -> DataFrame:
    """Add (front_matter, body, body_line): the YAML head, what follows, and the line before it."""
    head = F.regexp_extract(text, FRONT_MATTER, 1)
    whole = F.regexp_extract(text, FRONT_MATTER, 0)
    lines = F.when(whole != "", F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 3).otherwise(0)
    return files.withColumns({"front_matter": head, "body": F.substring(F.col(text), F.length(whole) + 1, F.length(F.col(text))), "body_line": lines})


def _yaml(texts: pd.Series) -> pd.Series:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(t):
        try:
            x = yaml.load(t, Loader=loader) if t else {}
        except yaml.YAMLError as e:
            line = re.search(r"line\s+(\d+)", str(e))
            return json.dumps({"_error": "yaml", "_line": int(line[1]) if line else 2})
        return json.dumps(x if isinstance(x, dict) else {"_error": "not a mapping"}, default=str)

    return texts.map(one)


MANIFEST = (
    "skill_id string, version string, intent_description string, permissions array<string>, tags array<string>, author string, deprecated boolean, "
    "topology_hints struct<requires:array<string>,conflicts_with:array<string>,enhances:array<string>,substitutes:array<string>>, _error string, _line int"
)


def manifests(files: DataFrame) -> DataFrame:
    """Add ``raw`` (front matter as JSON) and ``manifest`` (its known fields); errors are in manifest._error."""
    ship(files.sparkSession)
    return split(files).withColumn("raw", F.pandas_udf(_yaml, "string")("front_matter")).withColumn("manifest", F.from_json("raw", MANIFEST))


def metadata(text: str) -> dict[str, str]:
    """``k=v, k2="v2"`` as a map; quotes go, truth values are lower-cased."""
    out = {}
    for pair in text.split(","):
        k, eq, v = pair.strip().partition("=")
        v = v.strip()
        if eq:
            out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v.lower() if v.lower() in ("true", "false") else v
    return out


def fenced(text: str | None) -> list[tuple]:
    """The fenced blocks of a text, with lines counted from 1."""
    out, at, first = [], 0, 1
    for m in re.finditer(BLOCK, text or "", re.DOTALL):
        meta = metadata(m[2] or "")
        first, at = first + text.count("\n", at, m.start()), m.start()
        out.append((m[1] or "text", m[3].strip(), first, first + m[3].count("\n") + 2, meta, meta.get("entrypoint") not in (None, "", "false", "0")))
    return out


def blocks(files: DataFrame, text: str = "body") -> DataFrame:
    """Add ``blocks``, the fenced blocks of a text column."""
    ship(files.sparkSession)
    return files.withColumn("blocks", F.arrow_udf(_fenced, BLOCKS)(text))


BLOCK_KIND = pa.list_(pa.struct([("language", pa.string()), ("code", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())), ("is_entrypoint", pa.bool_())]))


def _fenced(texts: pa.Array) -> pa.Array:
    names = ("language", "code", "line_start", "line_end", "metadata", "is_entrypoint")
    return pa.array([[dict(zip(names, (*b[:4], list(b[4].items()), b[5]), strict=True)) for b in fenced(t)] for t in texts.to_pylist()], BLOCK_KIND)


def by_language(blocks: str | Column, language: str | Column) -> Column:
    """The blocks of a ``blocks`` column that are in a language."""
    wanted = F.lower(F.lit(language)) if isinstance(language, str) else F.lower(language)
    return F.filter(blocks, lambda b: F.lower(b["language"]) == wanted)


def entrypoint(blocks: str | Column) -> Column:
    """The first block marked as an entry point, or null."""
    return F.try_element_at(F.filter(blocks, lambda b: b["is_entrypoint"]), F.lit(1))
