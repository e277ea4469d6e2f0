"""Shared storage for the operators of this package."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import ship

__all__ = ["delete", "fresh", "materialise", "new_path", "same_text", "scrap", "shared_folder", "ship", "shuffles_dropped"]

#: Spark then removes the shuffle files of an execution as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where unset, one of our own on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_loomgraph_folder", None)
    if own is None:
        own = f"file:{tempfile.gettempdir()}/checkpoints/loomgraph-{uuid.uuid4().hex}"
        spark.sparkContext._loomgraph_folder = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    A plain scan also lets Spark split a skewed partition of a later join,
    which it can't below an aggregate.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def scrap(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables of ``materialise`` whose last reader has run.

    Collections of Python's and then the JVM's garbage let Spark's cleaner remove
    the shuffle files of jobs that are over too; what is still referred to stays.
    """
    for df in written:
        delete(spark, df._written_to)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files, whatever still refers to them and whenever garbage is collected.

    A frame made in the block has that property for good, and a second action on
    it would compute its shuffles anew: frames that are handed out are made outside.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def same_text(text: str | Column) -> Column:
    """A row's text as a string column, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")
