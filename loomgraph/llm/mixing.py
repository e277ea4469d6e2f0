"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._shared import fresh, materialise, same_text

#: Documents of a leaf, about, and residuals of an inner node of the reduction tree.
FAN_IN = 64


def word_count(text: str | Column = "text") -> Column:
    """Runs of characters outside space and \\x09-\\x0D; null counts as 0."""
    return F.regexp_count(same_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that a rerun draws again for the same keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, max_copies: int = 3) -> DataFrame:
    """(source, source_size, units, weight, target) of ``sized`` (source, size).

    Sources in order of code point, null last, weigh 1, 2, 3, repeating, and
    share the total size by weight.  No target exceeds ``max_copies`` times its
    source's size; the excess is shared again by weight, one sum over the sources
    a round, until none is above.  Sources are ranked by a range partitioning and
    the counts of its parts, so their number may grow with the data.  An empty
    table has no sources.
    """
    order = F.col("source").asc_nulls_last()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    ranged = per.repartitionByRange(order).sortWithinPartitions(order)
    parts = materialise(ranged.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() % (1 << 33)), "sources")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    caps = parts.join(before, "part").select("source", "source_size", "units", ((F.col("before") + F.col("k")) % 3 + 1).alias("weight"), (F.col("source_size") * max_copies).alias("cap"))
    caps = materialise(caps, "source-caps")
    level, capped = None, None
    while True:
        full = F.lit(False) if level is None else F.col("cap") < F.col("weight") * level
        now = caps.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if now["weight"] is None:
            level = None  # every source is capped, or there is none
            break
        if now["n"] == capped:
            break
        level, capped = (now["total"] - (now["cap"] or 0)) / now["weight"], now["n"]
    share = F.col("cap").cast("double")
    target = share if level is None else F.least(share, F.col("weight") * F.lit(float(level)))
    return caps.select("source", "source_size", "units", "weight", target.alias("target"))


#: Fold of one node.  State: the open document (its index and share) and those taken.  A step moves
#: words between the open document a and the next one b until one of them is all in or all out; the
#: direction is drawn so that either share keeps its mean, and the words of both stay the same in sum.
FOLD = """
aggregate(
  sequence(0, size(u) - 1),
  named_struct('open', -1, 'p', 0D, 'won', cast(array() AS array<int>)),
  (s, i) -> if(s.open < 0, named_struct('open', i, 'p', u[i].p, 'won', s.won),
    transform(array(named_struct('a', u[s.open].w, 'b', u[i].w, 'q', u[i].p,
        'up', least((1 - s.p) * u[s.open].w, u[i].p * u[i].w),
        'down', least(s.p * u[s.open].w, (1 - u[i].p) * u[i].w))),
      v -> if(u[i].h * (v.up + v.down) < v.down,
        if((1 - s.p) * v.a <= v.q * v.b,
          named_struct('open', i, 'p', greatest(0D, v.q - v.up / v.b), 'won', array_append(s.won, s.open)),
          named_struct('open', s.open, 'p', least(1D, s.p + v.up / v.a), 'won', s.won)),
        if(s.p * v.a <= (1 - v.q) * v.b,
          named_struct('open', i, 'p', least(1D, v.q + v.down / v.b), 'won', s.won),
          named_struct('open', s.open, 'p', greatest(0D, s.p - v.down / v.a), 'won', array_append(s.won, i)))))[0]))
"""


def _node(items: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, block, u, f) per node: its items, the largest first, and the fold's end."""
    item = F.struct((-F.col("w")).alias("order"), uniform(F.lit(seed), F.lit(level), "source", "doc_id", "size", "leaf").alias("h"), "doc_id", "size", "m", "w", "p", "leaf")
    return items.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("u")).withColumn("f", F.expr(FOLD))


def mix(docs: DataFrame, max_copies: int = 3, fan_in: int = FAN_IN, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) per row of ``docs`` (doc_id, source, text).

    A source's target over its size is each document's expected number of
    copies.  Its whole part is given to all; the fraction is settled by pivotal
    rounding: two documents pass words to each other until one is all in or all
    out, and the other goes on.  Every fold keeps the source's sum of words; the
    last open document is drawn by its share, so each document keeps its expected
    copies and the words taken miss the target by one document at most.

    Leaves hold about ``fan_in`` documents by a hash of the id, whatever the
    source's size, largest first; the one open document of each goes up a tree
    of the same fan-in to its root.  So a hot source is many
    groups, and none grows.  Draws are hashes of ids: reruns agree.

    Rows repeated with one id, source and size share their copies.  Documents
    without words (null text too) take nothing; null ids and sources are values
    like others, null sources come last.  Very long documents are documents like
    others.  An empty table gives an empty result.  Other columns are ignored.
    """
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "sizes")
    targets = materialise(source_targets(sized, max_copies), "targets")
    named = targets.select(F.col("source").alias("s"), "source_size", "target", "units")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("whole", F.floor(rate)).withColumn("p", rate - F.col("whole"))
    settled = (F.col("size") == 0) | (F.col("p") <= 1e-12)
    out = ["doc_id", "source", "size", "source_size", "target", "copies"]

    units = rows.where(~settled).groupBy("source", "doc_id", "size", "p", "units").agg(F.count("*").alias("m"))
    leaf = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.ceil(F.col("units") / fan_in))
    leaves = materialise(_node(units.withColumn("leaf", leaf).withColumn("block", F.col("leaf")).withColumn("w", F.col("size") * F.col("m")), 0, seed), "leaves")

    # Up the tree: the number of levels follows the largest source.
    most = targets.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]
    blocks, level, settled_above, nodes = -(-most // fan_in), 0, None, leaves
    while blocks > 1:
        level += 1
        open_ = F.col("u")[F.col("f.open")]
        items = nodes.select("source", F.floor(F.col("block") / fan_in).alias("block"), open_["doc_id"].alias("doc_id"), open_["size"].alias("size"), open_["m"].alias("m"), open_["w"].alias("w"), F.col("f.p").alias("p"), open_["leaf"].alias("leaf"))
        nodes = materialise(_node(items, level, seed), "residuals")
        done = nodes.select("source", F.posexplode("u").alias("i", "x"), "f").where("i <> f.open").select("source", F.col("x.leaf").alias("leaf"), F.array_contains("f.won", F.col("i")).alias("taken"))
        settled_above = done if settled_above is None else settled_above.unionByName(done)
        blocks = -(-blocks // fan_in)
    root = nodes.select("source", F.col("u")[F.col("f.open")]["leaf"].alias("leaf"), (uniform(F.lit(seed), F.lit("root"), F.col("source")) < F.col("f.p")).alias("taken"))
    settled_above = root if settled_above is None else settled_above.unionByName(root)

    above = settled_above.select(F.col("source").alias("s"), "leaf", "taken")
    closed = leaves.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("leaf")), "left").select("source", F.posexplode("u").alias("i", "x"), "f", "taken")
    chosen = closed.select("source", F.explode(F.expr("sequence(1L, x.m)")).alias("nth"), F.col("x.doc_id").alias("doc_id"), F.col("x.size").alias("size"), F.when(F.col("i") == F.col("f.open"), F.col("taken")).otherwise(F.array_contains("f.won", F.col("i"))).alias("extra"))
    rounded = chosen.join(named, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.floor(rate) + F.col("extra").cast("long"))
    return rounded.select(out).unionByName(rows.where(settled).withColumn("copies", F.when(F.col("size") > 0, F.round(rate).cast("long")).otherwise(F.lit(0).cast("long"))).select(out))


def mixed_documents(docs: DataFrame, max_copies: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns.

    Documents without words (null and blank texts too) go, as the mix takes
    nothing of them; repeated rows share their copies; an empty table stays empty.
    """
    d, s, n, c, w, k = fresh(docs.columns, "d", "s", "n", "c", "w", "k")
    copies = mix(docs, max_copies).groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n)).agg(F.max("copies").alias(c)).where(F.col(c) > 0)
    joined = docs.withColumn(w, word_count()).join(
        copies.hint("shuffle_hash"),
        F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").cast("string").eqNullSafe(F.col(s)) & (F.col(w) == F.col(n)),
    )
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(*docs.columns)
