"""Where iterative plans cut their lineage: tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let executors import this package, however the driver found it (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    made = Path(tempfile.mkdtemp(prefix="loomgraph-ship-"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    where = made / "loomgraph_code.zip"
    where.write_bytes(packed.getvalue())
    sc.addPyFile(str(where))  # read by the driver only, which serves it to the executors
    sc._loomgraph_shipped = True


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where unset, one of our own on a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_loomgraph_cuts", None)
    if own is None:
        own = sc._loomgraph_cuts = f"file:{tempfile.gettempdir()}/checkpoints/loomgraph-{uuid.uuid4().hex}"
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder, deleted when the driver's JVM ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read back, which computes it once; deleted when the driver's JVM ends."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
