"""A corpus pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last keep the
columns of documents, whatever further ones there are and whatever their names.
In all stages null and empty texts are alike, a null doc_id is a value of its
own, very long texts are worked on whole and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._shared import fresh, materialise
from loomgraph.llm.exact_dedup import kept_documents
from loomgraph.llm.jaccard_join import ngram_jaccard_join
from loomgraph.llm.mixing import mixed_documents
from loomgraph.llm.packing import pack
from loomgraph.llm.toxicity import score_documents, train

#: Documents that score this or more are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents of the input (a bounded sample) and drop those that score as toxic.

    Repeated rows score alike and stay or go together.  Without labelled
    documents of both classes there is nothing to learn: with none all stay.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    (score,) = fresh(docs.columns, "score")
    return score_documents(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, keep the row with the smallest doc_id.

    Of rows repeated with that id just one is kept; null texts count as empty
    ones, so one row of them all stays.
    """
    return kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays.

    Texts without words link with nothing and stay.  Repeated rows of a kept
    document all stay (the stage before leaves none).
    """
    found = ngram_jaccard_join(docs, n=5, percent=80)
    d, h = fresh(docs.columns, "d", "h")
    keep = found.where("stays").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    return docs.join(keep.hint("shuffle_hash"), same, "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources come near their target words.

    Documents without words go, as the mix can take nothing of them.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids (little-endian, unsigned 32-bit), placed in sequences of at most 1024.

    A text without tokens is a piece of its end token alone; repeated rows are
    packed as often as they come.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Models, hashed draws and packing have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
