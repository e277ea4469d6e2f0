"""Incremental import: a stored graph follows its skill files, and only changed ones are read and parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.mutations import file_changes
from loomgraph.operators.validation import hint_edges
from loomgraph.plans.ingest import parse
from loomgraph.sources.store import Change, Store, Table
from loomgraph.storage import cut

#: Every row carries the file it comes from, so that a file's rows leave with it.
TABLES = {
    "files": Table("path string, hash string, is_valid boolean, modified timestamp, length long", ("path",)),
    "nodes": Table(
        "path string, uid string, version string, intent_description string, permissions array<string>, execution_success_rate double, execution_count long, "
        "is_deprecated boolean, tags array<string>, author string",
        ("path",),
    ),
    "edges": Table("path string, source string, target string, edge_type string, weight double", ("path", "source", "target", "edge_type"), spread=("path",)),
    "errors": Table("path string, error string", ("path", "error"), spread=("path",)),
    "vectors": Table("path string, uid string, vector array<double>", ("path",)),
}


def graph_store(spark: SparkSession, path: str) -> Store:
    """The store of an imported graph, made where there is none."""
    return Store.create(spark, path, TABLES)


def folder(store: Store, path: str, name: str = "*.md") -> DataFrame:
    """(path, text, hash, modified, length) of the files below a folder.

    Files whose time and length are those of the last import are not opened: they
    keep the stored hash and come without text.
    """
    files = store.spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path)
    now = files.select("path", F.col("modificationTime").alias("modified"), "length")  # without the content, which is not read then
    known = store.read("files").select("path", "modified", "length", "hash")
    same = ["path", "modified", "length"]
    changed = cut(now.join(known.select(*same), same, "left_anti"))
    since = changed.agg(F.min("modified")).first()[0]
    kept = now.join(known, same).select("path", F.lit(None).cast("string").alias("text"), "hash", "modified", "length")
    if since is None:
        return kept
    opened = files.where(F.col("modificationTime") >= F.lit(since)).join(changed.select("path"), "path", "left_semi")
    return kept.unionByName(opened.select("path", F.decode("content", "UTF-8").alias("text"), F.md5("content").alias("hash"), F.col("modificationTime").alias("modified"), "length"))


def sync(store: Store, files: DataFrame, batch: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Make the store's graph that of ``files`` (path, text, hash) and return the version that holds it.

    Hashes are compared with those stored; created and modified files are parsed,
    and the nodes, edges, errors and vectors of these and of deleted files are
    exchanged in one commit.  So every version equals a full import of its files:
    a file that became invalid leaves only errors, and is not parsed again until
    it changes.  The statistics of a known file's node stay.  ``embed`` makes
    (path, uid, vector) from valid rows (path, uid, intent_description).  A batch
    that is in changes nothing; a commit by another import meanwhile is a
    ``Conflict`` if it changed the same buckets.  Repeated paths are one file.
    """
    if (done := store.committed(batch)) is not None:
        return done
    base = store.manifest()["version"]
    files = files.dropDuplicates(["path"])
    for c, kind in (("modified", "timestamp"), ("length", "long")):
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast(kind))
    changes = cut(file_changes(store.read("files", base).select("path", "hash"), files.select("path", "hash")).where("change <> 'unchanged'"))
    touched = changes.select("path")
    rows = cut(parse(files.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")))
    good = rows.where("is_valid")
    m = F.col("manifest")
    nodes = good.select(
        "path", m["skill_id"].alias("uid"), m["version"].alias("version"), m["intent_description"].alias("intent_description"), m["permissions"].alias("permissions"), F.lit(1.0).alias("execution_success_rate"),
        F.lit(0).cast("long").alias("execution_count"), F.coalesce(m["deprecated"], F.lit(False)).alias("is_deprecated"), m["tags"].alias("tags"), m["author"].alias("author"),
    )
    hinted = good.select(F.struct("path", m["skill_id"].alias("uid")).alias("of"), m["topology_hints"].alias("hints"))
    edges = hint_edges(hinted, "of", "hints").select("source.path", F.col("source.uid").alias("source"), "target", "edge_type", "weight").where("source <> target")
    errors = rows.where("not is_valid").select("path", F.explode("errors").alias("error"))
    done = {
        "files": Change(rows.select("path", "hash", "is_valid", "modified", "length"), changes.where("change = 'deleted'").select("path")),
        "nodes": Change(nodes, touched, keep=("execution_success_rate", "execution_count")),
        "edges": Change(edges, clear=touched),
        "errors": Change(errors, clear=touched),
    }
    if embed is not None:
        done["vectors"] = Change(embed(nodes.select("path", "uid", "intent_description")), touched)
    return store.commit(batch, done, base)


def graph(store: Store, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a version; of several files with one uid the first path counts."""
    first = store.read("nodes", version).groupBy("uid").agg(F.min("path").alias("path"))
    nodes = store.read("nodes", version).join(first, ["uid", "path"], "left_semi")
    return nodes, store.read("edges", version).join(first.select("path"), "path", "left_semi").drop("path")


def import_report(store: Store, version: int) -> DataFrame:
    """(table, created, updated, deleted): what a version changed."""
    parts = []
    for name in store.manifest(version)["changed"]:
        put = store.changed(name, version).agg(F.count_if("is_new").alias("created"), F.count_if(~F.col("is_new")).alias("updated"))
        gone = store.removed(name, version).agg(F.count("*").alias("deleted"))
        parts.append((name, *put.first(), *gone.first()))
    return store.spark.createDataFrame(parts, "table string, created long, updated long, deleted long")
