"""Ordering, budgeted packing and the response of each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import bullets, content, word_tokens
from loomgraph.operators.scoring import local_edges

BUDGET, RESERVED = 4096, 500


def priority(is_seed: str = "is_seed", edge_type: str = "edge_type", score: str = "score"):
    """+200 and +50 for seeds, +100 if reached over REQUIRES, +10 * score, -20 if over ENHANCES."""
    seed = F.col(is_seed)
    return (
        F.when(seed, 250.0).otherwise(0.0)
        + F.when(F.col(edge_type) == "REQUIRES", 100.0).otherwise(0.0)
        + F.col(score) * 10.0
        - F.when((F.col(edge_type) == "ENHANCES") & ~seed, 20.0).otherwise(0.0)
    )


def topological(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, id, level, topo): dependencies first, by longest path inside the kept set, then id.

    Levels come from relaxing the inner REQUIRES edges as often as the longest
    chain needs (each request's set is small); a node on a cycle stays at the
    last level reached.
    """
    inner = local_edges(kept, edges.where("edge_type = 'REQUIRES'")).select("request_id", "source", "target").distinct()
    arcs = inner.groupBy("request_id").agg(F.collect_list(F.struct("source", "target")).alias("arcs"))
    nodes = kept.groupBy("request_id").agg(F.array_sort(F.collect_set("id")).alias("ids")).join(arcs, "request_id", "left")
    start = F.expr("map_from_arrays(ids, transform(ids, x -> 0))")
    step = """aggregate(sequence(1, size(ids)), level0, (m, k) -> if(arcs is null, m, map_from_arrays(ids,
        transform(ids, x -> coalesce(array_max(transform(filter(arcs, e -> e.source = x), e -> m[e.target] + 1)), 0)))))"""
    leveled = nodes.withColumn("level0", start).withColumn("levels", F.expr(step))
    out = leveled.select("request_id", F.explode("levels").alias("id", "level"))
    return out.withColumn("topo", F.row_number().over(Window.partitionBy("request_id").orderBy("level", "id")) - 1)


PACK = """
aggregate(items, struct(cast(array() AS array<bigint>) AS ids, 0 AS used),
  (s, x) -> if(s.used + x.tokens <= {budget}, struct(array_append(s.ids, x.id) AS ids, s.used + x.tokens AS used), s))
"""


def pack_budget(items: DataFrame, budget: int = BUDGET, reserved: int = RESERVED) -> DataFrame:
    """(request_id, ids, used) from ``items`` (request_id, id, priority, topo, tokens).

    In order of priority each item is added if it still fits; later, smaller
    ones may fit after one that didn't.
    """
    room = max(0, budget - reserved)
    item = F.struct((-F.col("priority")).alias("order"), "topo", "id", F.col("tokens").cast("int").alias("tokens"))
    grouped = items.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.withColumn("p", F.expr(PACK.format(budget=room))).select("request_id", F.col("p.ids").alias("ids"), F.col("p.used").cast("long").alias("used"))


def assemble(kept: DataFrame, scored: DataFrame, skills: DataFrame, edges: DataFrame, budget: int = BUDGET, reserved: int = RESERVED) -> DataFrame:
    """(request_id, ids, used, assembled_text) of the kept candidates, seeds first, dependencies before dependents."""
    known = kept.select("request_id", "id").join(scored, ["request_id", "id"]).join(skills.select("id", "uid", "description"), "id")
    rows = known.join(topological(kept, edges), ["request_id", "id"]).withColumn("text", content("description", "uid"))
    rows = rows.withColumns({"tokens": word_tokens("text"), "priority": priority()})
    packed = pack_budget(rows, budget, reserved)
    chosen = packed.select("request_id", "used", F.explode_outer("ids").alias("id")).join(rows, ["request_id", "id"], "left")
    item = F.struct((~F.col("is_seed")).alias("a"), "topo", F.struct(F.col("uid").alias("id"), "text").alias("x"), F.col("id").alias("id"))
    out = chosen.groupBy("request_id", "used").agg(F.array_sort(F.collect_list(F.when(F.col("topo").isNotNull(), item))).alias("items"))
    return out.select("request_id", F.transform("items", lambda i: i["id"]).alias("ids"), "used", bullets(F.transform("items", lambda i: i["x"])).alias("assembled_text"))


CAP = """
aggregate(pushed, top, (t, s) ->
  if(exists(t, x -> not x.is_seed and x.similarity < s.similarity),
     transform(t, x -> if(x = array_min(filter(t, y -> not y.is_seed and y.similarity < s.similarity)), s, x)), t))
"""


def cap(selected: DataFrame, k: int = 5) -> DataFrame:
    """(request_id, id): the k best by score; a seed pushed out takes the place of the least similar weaker non-seed."""
    item = F.struct("similarity", "id", "is_seed", "score")
    order = F.struct((-F.col("score")).alias("order"), "id", item.alias("x"))
    g = selected.groupBy("request_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    g = g.select("request_id", F.transform("all", lambda a: a["x"]).alias("all"))
    g = g.withColumns({"top": F.slice("all", 1, k), "rest": F.expr(f"slice(all, {k + 1}, greatest(0, size(all) - {k}))")}).withColumn("pushed", F.filter("rest", lambda x: x["is_seed"]))
    return g.select("request_id", F.explode(F.expr(CAP)).alias("x")).select("request_id", "x.id", "x.is_seed")
