"""Delta-maintained token counts by source, language and tokenizer version."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._shared import delete, same_text, ship
from loomgraph.llm._words import Words, buffers, chunks
from loomgraph.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


COUNTED = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long"


def _words_of(column) -> np.ndarray:
    data, offsets = buffers(column)
    parts = [np.diff(Words(data, offsets[lo : hi + 1]).word_of) for lo, hi in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _count(tokenizers: dict[str, str | None]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist() if any(tokenizers.values()) else []
            for name, path in tokenizers.items():
                n = _words_of(batch.column("text")) if path is None else [len(encoder(path).encode(t)) // 4 for t in texts]
                columns = {k: batch.column(k) for k in ("doc_id", "source", "lang")}
                columns |= {"tokenizer": pa.repeat(name, batch.num_rows), "n_tokens": pa.array(n, pa.int64()), "n_chars": batch.column("n_chars")}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def count_tokens(docs: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_chars): a row per row of ``docs`` (doc_id, source, lang, text) and tokenizer.

    ``tokenizers`` has the vocabulary file of each version's name, or None for
    words apart by white space; all count in one pass over the texts.  Null texts
    count as empty; null ids, sources and languages stay null; repeated rows
    count as often as they come; a very long text is counted whole; an empty
    table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), same_text("text").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")).mapInArrow(_count(tokenizers), COUNTED)


def changes(inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed rows of count_tokens() rows: inserts add, deletes take off, a revision (old, new) does both."""
    signed = [(inserts, 1), (deletes, -1)] + ([(revised[0], -1), (revised[1], 1)] if revised else [])
    parts = [df.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), *((F.col(c) * sign).alias(c) for c in SUMS[1:])) for df, sign in signed if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class TokenRollup:
    """Additive totals kept as one folder of deltas a batch, under ``path``.

    A commit aggregates its signed rows (map-side first, so a hot source moves
    as one row a task), writes the few delta rows aside and renames their folder
    to that of its batch id, which fails where there is one: of two drivers that
    apply one batch, one wins.  A batch that has its folder is not applied again;
    what a lost driver left aside is never read.  ``totals`` sums all batches.
    The file system must rename folders as a whole, as HDFS and local ones do.

    Null sources and languages are keys like others.  A batch without rows
    commits and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        place, fs = self._place(f"batch={batch}")
        return fs.exists(place)

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Apply ``signed`` (changes() rows) once; False if the batch was committed before."""
        if not batch or any(c in batch for c in "/=\\ "):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        deltas = signed.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        aside = f"_aside-{uuid.uuid4().hex}"
        deltas.coalesce(8).write.parquet(f"{self.path}/{aside}")
        source, fs = self._place(aside)
        target, _ = self._place(f"batch={batch}")
        sc = self.spark.sparkContext
        files = sc._jvm.org.apache.hadoop.fs
        options = sc._gateway.new_array(files.Options.Rename, 0)
        try:
            files.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(source, target, options)
        except Py4JJavaError as e:
            delete(self.spark, f"{self.path}/{aside}")
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def batches(self) -> list[str]:
        root, fs = self._place("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def totals(self) -> DataFrame:
        """The totals per source, language and tokenizer; groups without documents are left out."""
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        deltas = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        summed = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return summed.where(" or ".join(f"{c} <> 0" for c in SUMS))
