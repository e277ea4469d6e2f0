"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import delete, new_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each end of ``edges`` (a long, b long).

    Every round is two aggregations and joins over at most as many edges as
    there were, and O(log^2) rounds suffice; nothing is collected but a count
    and a checksum.  Nulls are ignored, repeated edges and self-edges are
    harmless, and no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    before, old = None, None
    while True:
        path = new_path(spark, "components")
        pairs.write.parquet(path)
        pairs = spark.read.schema("u long, v long").parquet(path)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if old:
            delete(spark, old)
        old = path
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select("v", "v").distinct()
            )
        before = now
        # Large star: larger neighbours of u move to u's smallest neighbour (or u).
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        ).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.union(least.select("u", F.col("m").alias("v"))).distinct()
