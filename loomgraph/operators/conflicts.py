"""Conflict graphs and greedy independent sets inside each request's pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scoring import local_edges


def conflict_edges(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, a, b) with a < b: conflicting or substitutable candidates of one request."""
    typed = edges.where("edge_type in ('CONFLICTS_WITH', 'SUBSTITUTES')")
    inner = local_edges(pool, typed)
    return inner.select("request_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()


#: Candidates in order of score; ``x.nb`` are the conflicting ids.  A protected candidate turns out the
#: unprotected ones it conflicts with, yields to a protected one, and otherwise the earlier one stays.
PROTECTED = """
aggregate(items, struct(cast(array() AS array<bigint>) AS kept, cast(array() AS array<bigint>) AS safe),
  (s, x) -> case
    when not arrays_overlap(s.kept, x.nb) then struct(array_append(s.kept, x.id) AS kept, if(x.protected, array_append(s.safe, x.id), s.safe) AS safe)
    when x.protected and not arrays_overlap(s.safe, x.nb) then struct(array_append(array_except(s.kept, x.nb), x.id) AS kept, array_append(s.safe, x.id) AS safe)
    else s end,
  s -> s.kept)
"""


def independent_set(scored: DataFrame, edges: DataFrame, protect: bool = True) -> DataFrame:
    """(request_id, id, position): the candidates kept, in order of score and id.

    One fold per request over its pool (a few dozen candidates); with
    ``protect`` seeds are protected.
    """
    pairs = conflict_edges(scored, edges)
    both = pairs.select("request_id", F.col("a").alias("id"), F.col("b").alias("nb")).union(pairs.select("request_id", "b", "a"))
    near = both.groupBy("request_id", "id").agg(F.collect_set("nb").alias("nb"))
    nodes = scored.join(near, ["request_id", "id"], "left").withColumn("nb", F.coalesce("nb", F.expr("cast(array() as array<bigint>)")))
    item = F.struct((-F.col("score")).alias("order"), "id", "nb", (F.col("is_seed") & F.lit(protect)).alias("protected"))
    folded = nodes.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("kept", F.expr(PROTECTED))
    # The kept ids, in the order of the items.
    ordered = F.filter(F.transform("items", lambda x: x["id"]), lambda i: F.array_contains("kept", i))
    return folded.select("request_id", F.posexplode(ordered).alias("position", "id"))


def violations(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Conflicting pairs that are both kept: empty for an independent set."""
    return conflict_edges(kept.select("request_id", "id"), edges)
