"""Queries over stored tables: versions, commits of several tables, incremental imports, vector collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import fixtures as fx
from loomgraph.fixtures import table, with_
from loomgraph.operators import graph, mutations
from loomgraph.operators.collection import Collection
from loomgraph.plans import sync
from loomgraph.registry import query
from loomgraph.sources.store import Change, Store, Table
from loomgraph.storage import new_folder
from loomgraph.streaming import stateful

NODES = Table("id long, uid string, category int, rate double", ("id",), 8)
EDGES = Table("source long, target long, edge_type string, weight double", ("source", "target", "edge_type"), 8, spread=("source",))


@query(
    "store_versions",
    f"""{with_("skills", "edges")}, directed AS (FROM edges WHERE edge_type IN ('REQUIRES', 'ENHANCES')), v1 AS (SELECT id, category, execution_success_rate AS rate FROM skills),
    v2 AS (SELECT id, CASE WHEN id % 5 = 0 THEN 99 ELSE category END AS category, rate FROM v1 WHERE id % 7 <> 3 OR id % 5 = 0 UNION ALL SELECT 1000000 + id, 77, 0.25::DOUBLE FROM v1 WHERE id % 50 = 0),
    kept AS (SELECT source, target, edge_type, max(weight) AS weight FROM directed GROUP BY 1, 2, 3),
    v3 AS (SELECT * FROM v2 WHERE id % 11 <> 0), gone AS (SELECT id FROM v2 WHERE id % 11 = 0), e3 AS (SELECT source, count(*) AS n FROM kept WHERE source NOT IN (FROM gone) AND target NOT IN (FROM gone) GROUP BY 1), e1 AS (SELECT source, count(*) AS n FROM kept GROUP BY 1)
    SELECT 1::INT AS version, id, category::INT AS category, rate, coalesce(n, 0)::BIGINT AS n_out FROM v1 LEFT JOIN e1 ON e1.source = id UNION ALL
    SELECT 3, id, category, rate, coalesce(n, 0) FROM v3 LEFT JOIN e3 ON e3.source = id""",
)
def store_versions(spark, d):
    """Three batches of nodes and directed edges, the second one replayed; the first and the last version are read."""
    s = fx.skills(spark, d).selectExpr("id", "uid", "cast(category as int) category", "execution_success_rate rate")
    store = Store.create(spark, new_folder(spark, "graph"), {"nodes": NODES, "edges": EDGES})
    store.commit("load", {"nodes": Change(s), "edges": Change(fx.edges(spark, d).where("edge_type in ('REQUIRES', 'ENHANCES')"))})
    changed = s.where("id % 5 = 0").selectExpr("id", "uid", "99 category", "0.0D rate", "1 turn").unionByName(s.where("id % 5 = 0").selectExpr("id", "uid", "98 category", "0.0D rate", "0 turn"))
    new = s.where("id % 50 = 0").selectExpr("1000000 + id id", "uid", "77 category", "0.25D rate", "0 turn")
    second = {"nodes": Change(changed.unionByName(new), s.where("id % 7 = 3"), order="turn", keep=("rate",))}
    store.commit("change", second)
    store.commit("change", second)
    gone = store.read("nodes").where("id % 11 = 0").select("id")
    lost = store.read("edges").join(gone.toDF("source"), "source", "left_semi").unionByName(store.read("edges").join(gone.toDF("target"), "target", "left_semi"))
    last = store.commit("cascade", {"nodes": Change(deletes=gone), "edges": Change(deletes=lost)}, base=2)
    out = None
    for v in (1, last):
        n = store.read("edges", v).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
        one = store.read("nodes", v).join(n, "id", "left").select(F.lit(v).alias("version"), "id", "category", "rate", F.coalesce("n", F.lit(0)).cast("long").alias("n_out"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dual_write", "SELECT p_partkey AS id, (p_size + 1)::INT AS value, (p_size + 0.5)::DOUBLE AS first FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0)")
def dual_write(spark, d):
    """Nodes and vectors in one commit each: a load, a batch that fails and leaves neither, then creations, updates of known ids and deletions."""
    p = table(spark, d, "part").selectExpr("p_partkey id", "p_size value", "array(p_size + 0.0D) vector")
    store = Store.create(spark, new_folder(spark, "dual"), {"nodes": Table("id long, value int", ("id",), 4), "vectors": Table("id long, vector array<double>", ("id",), 4)})
    old = p.where("id % 2 = 0")
    store.commit("load", {"nodes": Change(old), "vectors": Change(old)})
    broken = p.selectExpr("id", "-1 value"), p.selectExpr("nullif(id, 1) id", "vector")
    try:
        store.commit("writes", {"nodes": Change(broken[0]), "vectors": Change(broken[1])})
    except ValueError:
        pass
    new = p.selectExpr("id", "value + 1 value", "array(value + 0.5D) vector")
    store.commit("create", {n: Change(new.where("id % 3 = 0")) for n in store.tables})
    store.commit("update", {n: Change(new.where("id % 3 = 1"), only="known") for n in store.tables})
    store.commit("delete", {n: Change(deletes=new.where("id % 3 = 2")) for n in store.tables})
    return store.read("nodes").join(store.read("vectors"), "id").select("id", "value", F.col("vector")[0].alias("first"))


_IMPORTED = """SELECT '{name}' AS state, 'ns' || (p_partkey % 5) || ':s' || p_partkey AS uid, {version} || p_size AS version, 1 + (p_partkey % 3 = 0)::BIGINT AS n_edges, 0::BIGINT AS n_errors FROM part WHERE {files} AND {valid}
    UNION ALL SELECT '{name}', NULL, NULL, 0, count(*) FILTER (WHERE NOT ({valid})) FROM part WHERE {files}"""


@query(
    "incremental_import",
    _IMPORTED.format(name="first", version="'1.0.'", files="p_partkey % 7 <> 0", valid="p_partkey % 11 <> 0")
    + " UNION ALL "
    + _IMPORTED.format(name="last", version="CASE WHEN p_partkey % 13 = 0 THEN '2.0.' ELSE '1.0.' END", files="p_partkey % 4 <> 0", valid="(p_partkey % 13 = 0 OR (p_partkey % 17 <> 0 AND p_partkey % 11 <> 0))"),
)
def incremental_import(spark, d):
    """Three states of a folder, imported one after the other: new files, changed ones that become valid or invalid, deleted ones."""
    from loomgraph.queries import skill_texts

    texts = skill_texts(spark, d)
    later = texts.withColumn(
        "text",
        F.when(F.expr("id % 13 = 0"), F.regexp_replace("text", "version: v?1", "version: 2")).when(F.expr("id % 17 = 0"), F.regexp_replace("text", "version: v?1", "version: x1")).otherwise(F.col("text")),
    )
    states = texts.where("id % 7 <> 0"), later, later.where("id % 4 <> 0")
    store = sync.graph_store(spark, new_folder(spark, "import"))
    for k, files in enumerate(states):
        sync.sync(store, files.select("path", "text", F.md5("text").alias("hash")), f"state-{k}")
    out = None
    for name, v in (("first", 1), ("last", 3)):
        nodes, edges = sync.graph(store, v)
        n = edges.groupBy(F.col("source").alias("uid")).agg(F.count("*").alias("n_edges"))
        rows = nodes.join(n, "uid", "left").select(F.lit(name).alias("state"), "uid", "version", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), F.lit(0).cast("long").alias("n_errors"))
        bad = store.read("errors", v).agg(F.count_distinct("path").alias("n_errors")).select(F.lit(name).alias("state"), F.lit(None).cast("string").alias("uid"), F.lit(None).cast("string").alias("version"), F.lit(0).cast("long").alias("n_edges"), "n_errors")
        out = rows.unionByName(bad) if out is None else out.unionByName(rows).unionByName(bad)
    return out


def _collection(spark, d) -> Collection:
    """All vectors with label and id as attributes, probes measured."""
    v = table(spark, d, "embeddings").selectExpr("vec_id id", "embedding vector", "label category", "vec_id number")
    found = Collection.create(spark, new_folder(spark, "vectors"), 64, v, "category int, number long")
    found.upsert("load", v)
    found.tune()
    return found


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id request_id", "embedding query_vector")


@query("ann_topk")
def ann_topk(spark, d):
    """The ten nearest by probing, of every vector whose id is divisible by 50; tests compare with the exact ones."""
    return _collection(spark, d).search(_queries(spark, d), 10).select("request_id", "id", "similarity", "rank")


@query(
    "vector_collection",
    """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN list_transform(embedding, lambda x: -x::DOUBLE) ELSE embedding::DOUBLE[] END AS vector, CASE WHEN vec_id % 9 = 0 THEN 3 ELSE label END AS category, vec_id AS number FROM embeddings WHERE vec_id % 7 <> 2),
    q AS (SELECT vec_id AS request_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT request_id, id, round(list_cosine_similarity(q::DOUBLE[], vector), 6) + 0 AS similarity FROM q, v WHERE category = 3 AND number >= 10)
    SELECT request_id, id, similarity, (row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id))::INT AS rank FROM s QUALIFY rank <= 5""",
)
def vector_collection(spark, d):
    """Exact search with a condition on a collection that was made, loaded with rows of wrong lengths, changed twice and thinned."""
    found = _collection(spark, d)
    v = found.rows()
    found.upsert("wrong", v.selectExpr("id", "slice(vector, 1, 63) vector", "-1 category", "number"))
    turned = v.where("id % 9 = 0").selectExpr("id", "transform(vector, x -> -x) vector", "3 category", "number", "1 turn")
    found.upsert("change", turned.unionByName(turned.withColumn("category", F.lit(8)).withColumn("turn", F.lit(0))), order="turn")
    found.delete("thin", v.where("id % 7 = 2").select("id"))
    again = Collection.create(spark, found.store.path, 64, v)
    return again.exact(_queries(spark, d), 5, where="category = 3 and number >= 10")


# Sessions, windows and files ------------------------------------------------

OPS = "case event_type when 'signup' then 'create' when 'error' then 'terminate' when 'view' then 'context' else 'call' end"


@query(
    "sessions",
    f"""WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t, {OPS} AS op, value FROM events),
    n AS (SELECT *, sum((op = 'create')::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nth FROM l),
    p AS (SELECT *, lag(t) OVER w AS pt, lag(op) OVER w AS pop FROM n WHERE nth > 0 WINDOW w AS (PARTITION BY user_id, nth ORDER BY t, event_id)),
    o AS (SELECT *, max((coalesce(t - pt > 43200000000, false) OR coalesce(pop = 'terminate', false))::INT) OVER (PARTITION BY user_id, nth ORDER BY t, event_id) AS off FROM p),
    g AS (SELECT user_id, nth, min(t) AS a, max(t) AS z, arg_max(op, (t, event_id)) AS last_op, count(*) FILTER (WHERE op = 'call') AS n_calls, count(*) FILTER (WHERE op = 'context') AS n_contexts, arg_max(value, (t, event_id)) FILTER (WHERE op = 'context') AS context FROM o WHERE off = 0 GROUP BY 1, 2),
    f AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY nth) AS nxt FROM g)
    SELECT user_id AS session_id, a AS opened, z AS last_used, CASE WHEN last_op = 'terminate' THEN 'terminated' WHEN nxt - z <= 43200000000 THEN 'replaced' WHEN coalesce(nxt, (SELECT max(t) FROM l)) - z > 43200000000 THEN 'expired' ELSE 'live' END AS ended,
      n_calls, n_contexts, round(context, 2) AS context FROM f""",
)
def sessions(spark, d):
    """Sessions of half a day in the event log: signups open them, errors end them."""
    log = table(spark, d, "events").selectExpr("user_id session_id", "ts", "event_id", f"{OPS} op", "value")
    found = stateful.sessions(log, 43_200)
    return found.withColumns({"opened": F.unix_micros("opened"), "last_used": F.unix_micros("last_used"), "context": F.round("context", 2)})


@query(
    "windowed_cooccurrence",
    f"""{with_("executions")}, p AS (SELECT x.skill_id AS a, y.skill_id AS b, y.ts, x.ok AND y.ok AS ok, (epoch_us(y.ts) - epoch_us(x.ts)) / 1e6 AS gap FROM executions x JOIN executions y ON x.session_id = y.session_id AND x.skill_id <> y.skill_id AND y.ts > x.ts AND epoch_us(y.ts) - epoch_us(x.ts) <= 21600000000)
    SELECT epoch_us(ts) // 604800000000 * 604800 AS start, a, b, count(*) AS n, round(avg(ok::INT), 6) AS success FROM p GROUP BY 1, 2, 3""",
)
def windowed_cooccurrence(spark, d):
    """Skills that follow each other in a session within six hours, per window of seven days."""
    return stateful.windowed_cooccurrence(fx.executions(spark, d), 21_600).select(F.unix_seconds("start").alias("start"), "a", "b", "n", "success")


@query(
    "accepted_events",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
    f AS (SELECT user_id, event_id, t AS last, true AS took, k FROM e WHERE k = 1 UNION ALL SELECT f.user_id, e.event_id, CASE WHEN e.t - f.last >= 43200000000 THEN e.t ELSE f.last END, e.t - f.last >= 43200000000, e.k FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, event_id FROM f WHERE took""",
)
def accepted_events(spark, d):
    """The events that debouncing by half a day lets through."""
    return mutations.accepted(table(spark, d, "events"), 43_200, "user_id").select("user_id", "event_id")


@query(
    "moved_files",
    """WITH was AS (SELECT page_id, '/a/' || (page_id % 5) || '/' || page_id || '.md' AS path, md5((page_id % 40)::VARCHAR) AS h FROM pages WHERE page_id % 7 <> 0), now AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN '/b/' || (page_id % 5) || '/' || page_id || '.md' WHEN page_id % 6 = 1 THEN '/a/' || (page_id % 5) || '/new-' || page_id || '.md' ELSE '/a/' || (page_id % 5) || '/' || page_id || '.md' END AS path,
      md5(CASE WHEN page_id % 11 = 0 THEN 'x' || page_id ELSE (page_id % 40)::VARCHAR END) AS h FROM pages WHERE page_id % 13 <> 0),
    ch AS (SELECT coalesce(o.path, n.path) AS path, o.h AS oh, n.h AS nh FROM was o FULL JOIN now n ON n.path = o.path),
    g AS (SELECT path, oh AS h, regexp_extract(path, '[^/]*$') AS name FROM ch WHERE nh IS NULL), c AS (SELECT path, nh AS h, regexp_extract(path, '[^/]*$') AS name FROM ch WHERE oh IS NULL),
    m1 AS (SELECT c.path, g.path AS old_path FROM (SELECT *, row_number() OVER (PARTITION BY h, name ORDER BY path) AS k FROM g) g JOIN (SELECT *, row_number() OVER (PARTITION BY h, name ORDER BY path) AS k FROM c) c USING (h, name, k)),
    m2 AS (SELECT c.path, g.path AS old_path FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM g WHERE path NOT IN (SELECT old_path FROM m1)) g JOIN (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM c WHERE path NOT IN (SELECT path FROM m1)) c USING (h, k)),
    m AS (FROM m1 UNION ALL FROM m2)
    SELECT path, 'moved' AS kind, old_path FROM m UNION ALL SELECT path, 'created', NULL FROM c WHERE path NOT IN (SELECT path FROM m) UNION ALL SELECT path, 'deleted', NULL FROM g WHERE path NOT IN (SELECT old_path FROM m) UNION ALL SELECT path, 'modified', NULL FROM ch WHERE oh <> nh""",
)
def moved_files(spark, d):
    """Two states of a folder: files moved to another folder or name, several of them equal, changed, new and gone."""
    p = table(spark, d, "pages").select("page_id")
    path = "concat('/a/', page_id % 5, '/', page_id, '.md')"
    old = p.where("page_id % 7 <> 0").selectExpr(f"{path} path", "md5(cast(page_id % 40 as string)) hash")
    new = p.where("page_id % 13 <> 0").selectExpr(
        f"case when page_id % 6 = 0 then concat('/b/', page_id % 5, '/', page_id, '.md') when page_id % 6 = 1 then concat('/a/', page_id % 5, '/new-', page_id, '.md') else {path} end path",
        "md5(case when page_id % 11 = 0 then concat('x', page_id) else cast(page_id % 40 as string) end) hash",
    )
    return mutations.moved_files(old, new)


# Graphs ---------------------------------------------------------------------

_UP = "SELECT vec_id // 4 AS source, vec_id AS target FROM embeddings WHERE vec_id % 50 = 25"


@query(
    "added_cycles",
    f"""WITH RECURSIVE old AS (SELECT vec_id AS source, vec_id // 2 AS target FROM embeddings WHERE vec_id > 0 AND vec_id <> vec_id // 2), up AS ({_UP}), e AS (FROM old UNION FROM up),
    r AS (SELECT target AS source, source AS id FROM up UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.id), b AS (SELECT source, source AS id FROM up UNION SELECT b.source, e.source FROM b JOIN e ON e.target = b.id),
    p AS (SELECT id AS x, id AS y FROM (SELECT id FROM r INTERSECT SELECT id FROM b) UNION SELECT p.x, e.target FROM p JOIN e ON e.source = p.y),
    scc AS (SELECT p.x AS id, least(p.x, min(p.y)) AS component FROM p JOIN p q ON q.x = p.y AND q.y = p.x AND p.x <> p.y GROUP BY 1, p.x)
    SELECT s.component, count(*) AS n_nodes, (SELECT count(*) FROM up JOIN scc a ON a.id = up.source JOIN scc c ON c.id = up.target AND c.component = a.component WHERE a.component = s.component) AS n_added FROM scc s GROUP BY 1""",
)
def added_cycles(spark, d):
    """Cycles that added edges close in a tree of dependencies, searched between the ends of the added edges alone."""
    v = table(spark, d, "embeddings").select("vec_id")
    old = v.selectExpr("vec_id source", "vec_id div 2 target").where("source > 0 and source <> target")
    return graph.added_cycles(old, v.where("vec_id % 50 = 25").selectExpr("vec_id div 4 source", "vec_id target"))[0]


@query("reach_estimate")
def reach_estimate(spark, d):
    """Transitive dependencies by sketches; tests compare them with the exact counts."""
    return graph.reach_sketch(fx.requires(spark, d)).withColumn("n_transitive", F.col("n_transitive").cast("long"))
