"""Dependency graphs: closure, cycles, levels, orders and paths.

All functions take edges (source, target), source depending on target.  Loops
run on the driver over whole tables and cut lineage with checkpoints every few
rounds; nothing but counts is collected.  ``closure`` holds all pairs with a path,
``would_cycle`` and ``neighbours`` pairs of a start and a node, within their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import cut


def closure(edges: DataFrame) -> DataFrame:
    """(source, target): every pair with a path of at least one edge; a node on a cycle reaches itself."""
    pairs = cut(edges.select("source", "target").distinct())
    n = pairs.count()
    while True:
        step = pairs.alias("a").join(pairs.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source"), F.col("b.target"))
        pairs = cut(pairs.union(step).distinct())
        m = pairs.count()
        if m == n:
            return pairs
        n = m


def nodes(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """(id): the ends of all edges and the given tables' id."""
    out = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    for o in others:
        out = out.union(o.select("id"))
    return out.distinct()


#: Rounds of a loop that run as one job before its lineage is cut; a round names its table twice, so few.
ROUNDS = 2


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of the sources that reach no cycle, and the edges (source, target) of the others.

    Each round keeps the edges whose target still has edges of its own, so a
    source's depth, the edges of its longest path, is the number of rounds that
    it lasts.  Tables only shrink; the rounds are as many as the depth.
    """
    left = cut(edges.select("source", "target").distinct())
    n, k, ages = left.count(), 0, None
    while n:
        own = []
        step = left
        for _ in range(ROUNDS):
            k += 1
            own.append(step.select(F.col("source").alias("id"), F.lit(k).cast("long").alias("depth")))
            step = step.join(step.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
        block = own[0]
        for o in own[1:]:
            block = block.unionByName(o)
        block = cut(block.groupBy("id").agg(F.max("depth").alias("depth")))
        ages = block if ages is None else ages.unionByName(block)
        left = cut(step)
        m = left.count()
        if m == n:
            break
        n = m
    if ages is None:
        return left.select(F.col("source").alias("id"), F.lit(0).cast("long").alias("depth")), left
    depth = ages.groupBy("id").agg(F.max("depth").alias("depth")).join(left.select(F.col("source").alias("id")).distinct(), "id", "left_anti")
    return depth, left


def core(edges: DataFrame) -> DataFrame:
    """The edges on or between cycles: those that stay when nodes without a way in or out are taken off again and again."""
    left = cut(edges.select("source", "target").distinct())
    n = left.count()
    while n:
        step = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        left = cut(step.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
        m = left.count()
        if m == n:
            break
        n = m
    return left


def components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes on cycles with the smallest node of their strongly connected component.

    In the ``core`` each node takes the smallest node that reaches it as its colour; the nodes of a
    colour that reach back to that smallest node are its component.  What is left
    goes round again.  No table exceeds the edges; a self-edge alone is not a
    cycle here.
    """
    rest = edges.where("source <> target")
    done = None
    while True:
        rest = core(rest)
        if rest.isEmpty():
            return done if done is not None else rest.select(F.col("source").alias("id"), F.col("target").alias("component"))
        colour = cut(nodes(rest).withColumn("c", F.col("id")))
        before = None
        while (now := colour.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]) != before:
            before = now
            for _ in range(ROUNDS):
                sent = rest.join(colour.toDF("source", "c"), "source").select(F.col("target").alias("id"), "c")
                colour = colour.unionByName(sent).groupBy("id").agg(F.min("c").alias("c"))
            colour = cut(colour)
        inner = rest.join(colour.toDF("source", "c"), "source").join(colour.toDF("target", "d"), "target").where("c = d").select("source", "target", "c")
        inner = cut(inner)
        found = cut(colour.where("id = c"))
        n = 0
        while (m := found.count()) != n:
            n = m
            for _ in range(ROUNDS):
                back = inner.join(found.toDF("target", "f"), "target").select(F.col("source").alias("id"), "c")
                found = found.unionByName(back).distinct()
            found = cut(found)
        whole = found.join(found.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "c").select("id", F.col("c").alias("component"))
        done = whole if done is None else done.unionByName(whole)
        gone = found.select("id")
        rest = rest.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select("source", "target")


def cycle_edges(edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """Edges inside a strongly connected component: cutting them breaks its cycles."""
    c = scc if scc is not None else components(edges)
    return edges.join(c.toDF("source", "ca"), "source").join(c.toDF("target", "cb"), "target").where("ca = cb").select("source", "target", F.col("ca").alias("component"))


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(component, path): a shortest cycle through each component's smallest node; ties go to the smallest path."""
    inner = cut(cycle_edges(edges).distinct())
    paths = inner.where("source = component").select("component", F.array("source", "target").alias("path"))
    done = None
    while not paths.isEmpty():
        closed = paths.where("element_at(path, -1) = component")
        done = closed if done is None else done.unionByName(closed)
        open_ = paths.where("element_at(path, -1) <> component").join(done.select("component").distinct(), "component", "left_anti")
        grown = open_.join(inner, "component").where("element_at(path, -1) = source and (target = component or not array_contains(path, target))")
        grown = grown.select("component", F.concat("path", F.array("target")).alias("path"))
        paths = cut(grown.groupBy("component", F.element_at("path", -1)).agg(F.min("path").alias("path")).select("component", "path"))
    if done is None:
        return paths
    return done.groupBy("component").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x")).select("component", "x.path")


def would_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """``proposed`` (source, target) with creates_cycle: the target already reaches the source, or is it.

    Only the targets start a search, and each ends when its sources are found.
    A node that reaches no cycle is followed only while it is deeper than some
    source that its start looks for, since paths lead to smaller depths.
    """
    e = cut(edges.select("source", "target").distinct())
    depth, left = peel(e)
    level = cut(nodes(e).join(depth, "id", "left").join(left.select(F.col("source").alias("id"), F.lit(True).alias("loops")).distinct(), "id", "left").select("id", F.when(F.col("loops").isNull(), F.coalesce("depth", F.lit(0))).alias("depth")))
    asked = cut(proposed.select(F.col("target").alias("start"), F.col("source").alias("goal")).where("start <> goal").distinct())
    goals = asked.join(level.toDF("goal", "low"), "goal")
    least = cut(goals.groupBy("start").agg(F.min(F.coalesce("low", F.lit(0))).alias("least")))
    seen = front = cut(least.select("start", F.col("start").alias("id")))
    found = None
    while not front.isEmpty():
        step = front.join(e, F.col("id") == F.col("source")).select("start", F.col("target").alias("id")).distinct()
        step = step.join(level, "id").join(least, "start").where("depth is null or depth >= least").select("start", "id")
        front = cut(step.join(seen, ["start", "id"], "left_anti"))
        hit = front.join(asked.toDF("s", "goal"), (F.col("start") == F.col("s")) & (F.col("id") == F.col("goal"))).select("start", "goal")
        found = cut(hit if found is None else found.unionByName(hit))
        seen = cut(seen.unionByName(front))
        open_ = asked.join(found, ["start", "goal"], "left_anti").select("start").distinct()
        front = cut(front.join(open_, "start", "left_semi"))
    none = F.lit(False)
    if found is None:
        return proposed.select("source", "target", (F.col("source") == F.col("target")).alias("creates_cycle"))
    back = found.select(F.col("goal").alias("source"), F.col("start").alias("target"), F.lit(True).alias("back"))
    return proposed.join(back, ["source", "target"], "left").select("source", "target", (F.coalesce("back", none) | (F.col("source") == F.col("target"))).alias("creates_cycle"))


#: Nodes whose reachers are found in one pass, a bit each: so many blocks of so many words of 64.
WORDS, BLOCKS = 16, 16


def _numbered(ids: DataFrame) -> DataFrame:
    """(id, k): nodes (id, depth) numbered from 0 by depth and id, so that what most nodes reach lies in few blocks."""
    return cut(execution_order(ids).select("id", F.col("position").alias("k")))


def _upward(edges: DataFrame, start: DataFrame, merge: list[Column], depth: DataFrame | None = None, keys: tuple[str, ...] = (), mark: Column | None = None) -> DataFrame:
    """What each node holds once what its targets hold has come up every path; ``start`` is what each sends of its own.

    On an acyclic graph each edge is used once, in order of its source's depth;
    otherwise (no ``depth``) rounds go on until the sum of ``mark`` (a hash of all without one) stays.
    """
    names = [c for c in start.columns if c != "id"]
    if depth is None:
        held, before = None, None
        while True:
            known = start if held is None else start.unionByName(held)
            step = edges.join(known.toDF("target", *names), "target").select(F.col("source").alias("id"), *names)
            held = cut(step.groupBy("id", *keys).agg(*merge))
            now = held.agg(F.sum((F.xxhash64("id", *names) if mark is None else mark).cast("decimal(38,0)"))).first()[0]
            if now == before:
                return held
            before = now
    deep = cut(edges.join(depth.toDF("source", "depth"), "source"))
    sent, held = start, None
    for k in range(1, (deep.agg(F.max("depth")).first()[0] or 0) + 1):
        step = deep.where(F.col("depth") == k).join(sent.toDF("target", *names), "target").select(F.col("source").alias("id"), *names)
        new = cut(step.groupBy("id", *keys).agg(*merge))
        held = new if held is None else held.unionByName(new)
        sent = sent.unionByName(new)
    return held if held is not None else start.limit(0)


def reach_counts(edges: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """(id, n_transitive): how many other nodes each source reaches, without a table of pairs.

    Nodes are numbered and taken ``64 * WORDS * BLOCKS`` at a time: an edge then carries a
    bit a node, merged by OR on the way up.  On an acyclic graph (``depth`` of
    ``peel``, if it is known) a pass uses each edge once, in order of depth; with
    cycles, until nothing changes.  A pass holds up to ``BLOCKS`` rows a node, so
    the work is nodes times edges over 64 and the space that of the edges.
    """
    e = cut(edges.where("source <> target").select("source", "target").distinct())
    if depth is None:
        depth, left = peel(e)
        depth = cut(depth) if left.isEmpty() else None
    every = nodes(e) if depth is None else nodes(e).join(depth, "id", "left")
    numbered = _numbered(every.withColumn("depth", F.coalesce("depth", F.lit(0)) if depth is not None else F.lit(0)))
    n, total, block = numbered.count(), None, 64 * WORDS
    words = [f"w{i}" for i in range(WORDS)]
    merge = [F.bit_or(w).alias(w) for w in words]
    own = [F.expr(f"if(k % {block} div 64 = {i}, shiftleft(1L, cast(k % 64 as int)), 0L)").alias(w) for i, w in enumerate(words)]
    for first in range(0, n, block * BLOCKS):
        start = cut(numbered.where(F.col("k").between(first, first + block * BLOCKS - 1)).select("id", F.expr(f"k div {block}").alias("block"), *own))
        held = _upward(e, start, merge, depth, ("block",))
        itself = held.join(start.toDF("id", "block", *(f"own_{w}" for w in words)), ["id", "block"], "left")  # a node of a cycle is not counted itself
        bits = sum((F.bit_count(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"own_{w}", F.lit(0))))) for w in words), F.lit(0))
        counted = cut(itself.groupBy("id").agg(F.sum(bits.cast("long")).alias("c")))
        total = counted if total is None else total.unionByName(counted)
    if total is None:
        return e.select(F.col("source").alias("id"), F.lit(0).cast("long").alias("n_transitive"))
    return total.groupBy("id").agg(F.sum("c").alias("n_transitive"))


def reach_sketch(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """(id, n_transitive): the same estimated by a sketch of distinct nodes a source, merged on the way up.

    Of 2^lg_k registers, so the standard error is about 0.83 / sqrt(2^lg_k), 1.3 %
    at 12; one pass over the edges for all nodes at once.  A node of a cycle counts
    itself; with cycles, rounds go on until the estimates stay.
    """
    e = cut(edges.where("source <> target").select("source", "target").distinct())
    depth, left = peel(e)
    depth = cut(depth) if left.isEmpty() else None
    start = nodes(e).groupBy("id").agg(F.hll_sketch_agg("id", lg_k).alias("s"))
    held = _upward(e, cut(start), [F.hll_union_agg("s").alias("s")], depth, mark=F.hll_sketch_estimate("s"))
    return held.select("id", F.hll_sketch_estimate("s").alias("n_transitive"))


def levels(edges: DataFrame, extra: DataFrame | None = None, transitive: bool = False) -> DataFrame:
    """(id, depth, level, n_dependencies, n_dependents, is_leaf, is_root) of every node.

    depth: edges of the longest path to a leaf.  level: ``root`` at depth 0,
    ``shallow`` at 1, ``medium`` up to 3, ``deep`` beyond; on or above a cycle
    ``unknown`` with depth 0.  is_leaf: no dependencies; is_root: no dependents.
    ``transitive`` adds n_transitive, the nodes that it reaches (see ``reach_counts``).
    """
    e = cut(edges.select("source", "target").distinct())
    depth, left = peel(e)
    depth = cut(depth)
    bad = left.select(F.col("source").alias("id")).distinct()
    every = nodes(e, extra) if extra is not None else nodes(e)
    out = (
        every.join(depth, "id", "left")
        .join(bad.withColumn("bad", F.lit(True)), "id", "left")
        .join(e.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_dependencies")), "id", "left")
        .join(e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_dependents")), "id", "left")
    )
    counts = ["n_dependencies", "n_dependents"]
    if transitive:
        counts.append("n_transitive")
        out = out.join(reach_counts(e, depth if left.isEmpty() else None), "id", "left")
    d, unknown = F.coalesce("depth", F.lit(0)), F.coalesce("bad", F.lit(False))
    return out.select(
        "id",
        d.alias("depth"),
        F.when(unknown, "unknown").when(d == 0, "root").when(d == 1, "shallow").when(d <= 3, "medium").otherwise("deep").alias("level"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        (F.col("n_dependencies").isNull() & ~unknown).alias("is_leaf"),
        F.col("n_dependents").isNull().alias("is_root"),
    )


def level_counts(leveled: DataFrame) -> DataFrame:
    """(level, n): how many nodes are on each level."""
    return leveled.groupBy("level").agg(F.count("*").alias("n"))


def most_needed(edges: DataFrame) -> DataFrame:
    """(id, n): the node that most others depend on; of several the smallest."""
    e = edges.select("source", "target").distinct()
    return e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1)


def execution_order(leveled: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, position) by depth, then id; a valid topological order of an acyclic graph.

    Positions are a global rank: nodes are dealt by ranges of (depth, id) and
    ranked inside their part, and the counts of the parts before it are added.
    """
    order = [F.col("depth").desc(), F.col("id").desc()] if reverse else [F.col("depth"), F.col("id")]
    ranged = leveled.select("id", "depth").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("k")))
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(before, "part").select("id", (F.coalesce("before", F.lit(0)) + F.col("k")).alias("position"))


def critical_path(edges: DataFrame) -> DataFrame:
    """(step, id): from the deepest node along its deepest dependencies, in order of execution."""
    depth = levels(edges).select("id", "depth")
    best = edges.join(depth.toDF("target", "d"), "target").groupBy("source").agg(F.max(F.struct("d", (-F.col("target")).alias("t"))).alias("x")).select("source", (-F.col("x.t")).alias("target"))
    best = cut(best)
    here = depth.groupBy().agg(F.max(F.struct("depth", (-F.col("id")).alias("k"))).alias("x")).select((-F.col("x.k")).alias("id"), F.col("x.depth").alias("step"))
    out = here = cut(here)
    for _ in range(int(here.agg(F.coalesce(F.max("step"), F.lit(0))).first()[0])):
        here = cut(here.join(best, F.col("id") == F.col("source")).select(F.col("target").alias("id"), (F.col("step") - 1).alias("step")))
        out = out.unionByName(here)
    return out.select("step", "id")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(start, id): distinct nodes within ``depth`` edges of each start (id), either way, the start left out."""
    e = edges.where(F.col("edge_type").isin(types)) if types else edges
    both = e.select("source", "target").union(e.select("target", "source")).toDF("a", "b").distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id"))
    for _ in range(depth):
        step = seen.join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id"))
        seen = seen.union(step).distinct()
    return seen.where("start <> id")


def partners(edges: DataFrame) -> DataFrame:
    """(id, other): distinct pairs of nodes that an edge joins, from either end."""
    return edges.select("source", "target").union(edges.select("target", "source")).toDF("id", "other").distinct()


def tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, path, depth): every dependency path from the roots (id) up to a depth, without repeats on it."""
    e = edges.select("source", "target").distinct()
    paths = out = roots.select(F.col("id").alias("root"), F.array("id").alias("path"), F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        paths = paths.join(e, F.element_at("path", -1) == F.col("source")).where("not array_contains(path, target)").select("root", F.concat("path", F.array("target")).alias("path"), F.lit(k).alias("depth"))
        out = out.unionByName(paths)
    return out


def missing(edges: DataFrame, available: DataFrame) -> DataFrame:
    """(source, target): dependencies that are not available (id)."""
    return edges.select("source", "target").distinct().join(available.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target")


def isolated(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes without an edge."""
    return all_nodes.select("id").join(nodes(edges), "id", "left_anti")


def report(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """One row: node and edge counts, cycles, nodes on them, self-edges, isolated nodes, depth, validity."""
    e = cut(edges.select("source", "target").distinct())
    scc = components(e)
    cyc = scc.agg(F.count_distinct("component").alias("n_cycles"), F.count("*").alias("n_on_cycles"))
    own = e.agg(F.count("*").alias("n_edges"), F.count_if(F.col("source") == F.col("target")).alias("n_self"))
    deep = peel(e)[0].agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    alone = isolated(all_nodes, e).agg(F.count("*").alias("n_isolated"))
    total = nodes(e, all_nodes).agg(F.count("*").alias("n_nodes"))
    return total.crossJoin(own).crossJoin(cyc).crossJoin(alone).crossJoin(deep).withColumn("is_valid", (F.col("n_cycles") == 0) & (F.col("n_self") == 0))


def typed_report(edges: DataFrame, edge_type: str = "REQUIRES") -> DataFrame:
    """``report`` of the edges of one type of ``edges`` (source, target, edge_type), with the nodes of all types."""
    return report(edges.where(F.col("edge_type") == edge_type), nodes(edges))


def new_cycles(edges: DataFrame, added: DataFrame) -> DataFrame:
    """(component, n_nodes, n_added): the cycles of ``edges`` and ``added`` together that an added edge lies on."""
    scc = cut(components(edges.select("source", "target").union(added.select("source", "target"))))
    inside = cycle_edges(added.select("source", "target").distinct(), scc).groupBy("component").agg(F.count("*").alias("n_added"))
    return scc.groupBy("component").agg(F.count("*").alias("n_nodes")).join(inside, "component")


def added_cycles(edges: DataFrame, added: DataFrame, depth: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``new_cycles`` of acyclic ``edges``, and how many nodes were looked at to find them.

    Depths (id, depth; those of ``peel`` unless they are kept from before) fall
    along every edge, so a cycle has an added edge along which they do not, and lies between
    the lowest source and the highest target of such edges.  Only nodes
    in that range are searched, down from the targets and up from the sources at
    once; cycles are looked for among those that both searches meet.
    """
    new = cut(added.select("source", "target").where("source <> target").distinct())
    old = edges.select("source", "target").where("source <> target").distinct()
    if depth is None:
        depth, left = peel(old)
        if not left.isEmpty():
            raise ValueError("the edges have cycles already")
    level = cut(nodes(old, nodes(new)).join(depth, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth")))
    rising = cut(new.join(level.toDF("source", "low"), "source").join(level.toDF("target", "high"), "target").where("low <= high"))
    low, high = rising.agg(F.min("low"), F.max("high")).first()
    kind = edges.schema["source"].dataType
    if low is None:
        none = edges.select(F.col("source").cast(kind).alias("component"), F.lit(0).cast("long").alias("n_nodes"), F.lit(0).cast("long").alias("n_added")).limit(0)
        return none, 0
    inside = cut(level.where(F.col("depth").between(low, high)).select("id"))
    near = cut(old.unionByName(new).distinct().join(inside.toDF("source"), "source", "left_semi").join(inside.toDF("target"), "target", "left_semi").select("source", "target"))

    def reach(start: DataFrame, a: str, b: str) -> DataFrame:
        seen = front = cut(start.distinct())
        while not front.isEmpty():
            step = front.join(near.select(F.col(a).alias("id"), F.col(b).alias("next")), "id").select(F.col("next").alias("id")).distinct()
            front = cut(step.join(seen, "id", "left_anti"))
            seen = cut(seen.unionByName(front))
        return seen

    down = reach(rising.select(F.col("target").alias("id")), "source", "target")
    up = reach(rising.select(F.col("source").alias("id")), "target", "source")
    both = down.join(up, "id", "left_semi")
    candidates = near.join(both.toDF("source"), "source", "left_semi").join(both.toDF("target"), "target", "left_semi").select("source", "target")
    scc = cut(components(candidates))
    found = cycle_edges(new, scc).groupBy("component").agg(F.count("*").alias("n_added"))
    return scc.groupBy("component").agg(F.count("*").alias("n_nodes")).join(found, "component"), down.union(up).distinct().count()
