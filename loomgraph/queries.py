"""One query per operator over the test tables, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import fixtures as fx
from loomgraph.fixtures import table, with_
from loomgraph.functions import permissions as perm
from loomgraph.functions import text as tx
from loomgraph.operators import assembly, code_facts, conflicts, graph, mutations, relations, reliability, retrieval, runtime, scoring, validation
from loomgraph.plans import ingest
from loomgraph.plans import route as routing
from loomgraph.registry import ORACLES, QUERIES, query
from loomgraph.sources import skill_files
from loomgraph.streaming import telemetry

# Retrieval ------------------------------------------------------------------

SIMS = """sims AS (SELECT r.request_id, s.id, s.is_deprecated, round(list_cosine_similarity(r.query_vector::DOUBLE[], s.vector::DOUBLE[]), 6) + 0 AS similarity FROM requests r CROSS JOIN skills s),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id) AS rk FROM sims)"""
SEEDS = SIMS + """, near AS (SELECT request_id, id, greatest(0, least(1, similarity)) AS similarity FROM ranked WHERE rk <= 10 AND NOT is_deprecated),
    kept AS (SELECT *, max(CASE WHEN similarity >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS any_ok FROM near),
    seeds AS (SELECT * FROM (SELECT request_id, id, similarity, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id) AS rank FROM kept WHERE similarity >= 0.3 OR any_ok = 0) WHERE rank <= 5)"""
POOL = SEEDS + """, hops AS (SELECT z.request_id, e.target AS id, z.rank, e.edge_type, row_number() OVER (PARTITION BY z.request_id, e.target ORDER BY z.rank, CASE e.edge_type WHEN 'REQUIRES' THEN 1 ELSE 3 END) AS k
        FROM seeds z JOIN (SELECT DISTINCT source, target, edge_type FROM edges WHERE edge_type IN ('REQUIRES', 'ENHANCES')) e ON e.source = z.id JOIN skills s ON s.id = e.target AND NOT s.is_deprecated
        WHERE NOT EXISTS (SELECT 1 FROM seeds y WHERE y.request_id = z.request_id AND y.id = e.target)),
    pool AS (SELECT request_id, id, similarity, 0 AS depth, true AS is_seed, NULL::VARCHAR AS edge_type FROM seeds
        UNION ALL SELECT h.request_id, h.id, greatest(0, least(1, m.similarity)), 1, false, h.edge_type FROM hops h JOIN sims m ON m.request_id = h.request_id AND m.id = h.id WHERE k = 1)"""
SCORED = POOL + """, scored AS (SELECT p.request_id, p.id, p.similarity, p.is_seed, p.edge_type, s.execution_success_rate AS reliability,
        round(0.8 * p.similarity + 0.1 * s.execution_success_rate, 6) AS score FROM pool p JOIN skills s ON s.id = p.id WHERE s.execution_success_rate >= 0.5)"""
CLASH = SCORED + """, clash AS (SELECT DISTINCT p.request_id, least(e.source, e.target) AS a, greatest(e.source, e.target) AS b FROM edges e JOIN scored p ON p.id = e.source JOIN scored q ON q.id = e.target AND q.request_id = p.request_id
        WHERE e.edge_type IN ('CONFLICTS_WITH', 'SUBSTITUTES') AND e.source <> e.target)"""


def _mwis(protect: bool) -> str:
    safe = "o.is_seed" if protect else "false"
    return CLASH + f""", near_ids AS (SELECT s.request_id, s.id, list(DISTINCT CASE WHEN c.a = s.id THEN c.b ELSE c.a END) FILTER (WHERE c.a IS NOT NULL) AS nb FROM scored s LEFT JOIN clash c ON c.request_id = s.request_id AND s.id IN (c.a, c.b) GROUP BY ALL),
    ordered AS (SELECT s.request_id, s.id, s.is_seed, coalesce(n.nb, []::BIGINT[]) AS nb, row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.id) AS k FROM scored s JOIN near_ids n ON n.request_id = s.request_id AND n.id = s.id),
    folds AS (SELECT DISTINCT request_id, 0::BIGINT AS k, []::BIGINT[] AS kept, []::BIGINT[] AS safe FROM ordered
        UNION ALL SELECT f.request_id, o.k,
          CASE WHEN NOT list_has_any(f.kept, o.nb) THEN list_append(f.kept, o.id)
               WHEN {safe} AND NOT list_has_any(f.safe, o.nb) THEN list_append(list_filter(f.kept, lambda x: NOT list_contains(o.nb, x)), o.id) ELSE f.kept END,
          CASE WHEN {safe} AND NOT list_has_any(f.safe, o.nb) THEN list_append(f.safe, o.id) ELSE f.safe END
        FROM folds f JOIN ordered o ON o.request_id = f.request_id AND o.k = f.k + 1),
    final AS (SELECT f.request_id, f.kept FROM folds f JOIN (SELECT request_id, max(k) AS k FROM folds GROUP BY 1) m ON m.request_id = f.request_id AND m.k = f.k),
    mwis AS (SELECT o.request_id, o.id, row_number() OVER (PARTITION BY o.request_id ORDER BY o.k) - 1 AS position FROM ordered o JOIN final f ON f.request_id = o.request_id WHERE list_contains(f.kept, o.id))"""


BASE = with_("skills", "edges", "requests", recursive=True)


def _inputs(spark: SparkSession, d: str):
    return fx.requests(spark, d), fx.skills(spark, d), fx.edges(spark, d)


@query("vector_topk", f"{with_('skills', 'requests')}, {SIMS} SELECT request_id, id, similarity, rk::INT AS rank FROM ranked WHERE rk <= 10")
def vector_topk(spark, d):
    r, s, _ = _inputs(spark, d)
    return retrieval.top_k(r, s, 10)


@query("seed_recall", f"{with_('skills', 'requests')}, {SEEDS} SELECT request_id, id, similarity, rank::INT AS rank FROM seeds")
def seed_recall(spark, d):
    r, s, _ = _inputs(spark, d)
    return retrieval.recall(r, s)


@query("seed_recall_fallback", f"{with_('skills', 'requests')}, {SEEDS.replace('0.3', '1.1')} SELECT request_id, id, similarity, rank::INT AS rank FROM seeds")
def seed_recall_fallback(spark, d):
    """No similarity passes a threshold over 1, so every request is served without it."""
    r, s, _ = _inputs(spark, d)
    return retrieval.recall(r, s, threshold=1.1)


@query("hybrid_expand", f"{BASE}, {POOL} SELECT request_id, id, similarity, depth::INT AS depth, is_seed, edge_type FROM pool")
def hybrid_expand(spark, d):
    r, s, e = _inputs(spark, d)
    return retrieval.expand(retrieval.recall(r, s), e, s, r)


@query("hybrid_vr_only", f"{BASE}, {SEEDS} SELECT request_id, id, similarity, 0::INT AS depth, true AS is_seed, NULL::VARCHAR AS edge_type FROM seeds")
def hybrid_vr_only(spark, d):
    r, s, e = _inputs(spark, d)
    return retrieval.expand(retrieval.recall(r, s), e, s, vector_only=True)


@query("vector_point_lookup", f"{with_('skills', 'requests')} SELECT r.request_id, s.uid, s.category FROM requests r JOIN skills s ON s.id = r.request_id + 1")
def vector_point_lookup(spark, d):
    r, s, _ = _inputs(spark, d)
    return r.select("request_id", (F.col("request_id") + 1).alias("id")).join(s, "id").select("request_id", "uid", "category")


@query("vector_filter_scan", f"{with_('skills')} SELECT id, uid FROM skills WHERE category = 3 AND NOT is_deprecated ORDER BY id LIMIT 100")
def vector_filter_scan(spark, d):
    return fx.skills(spark, d).where("category = 3 and not is_deprecated").orderBy("id").limit(100).select("id", "uid")


@query("vector_stats", "SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
def vector_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("min_dim"), F.max(F.size("embedding")).cast("long").alias("max_dim"))


@query("node_page", f"{with_('skills')} SELECT id, uid, (SELECT count(*) FROM skills) AS total FROM skills ORDER BY uid LIMIT 100 OFFSET 50")
def node_page(spark, d):
    s = fx.skills(spark, d)
    return s.orderBy("uid").offset(50).limit(100).join(F.broadcast(s.agg(F.count("*").alias("total")))).select("id", "uid", "total")


@query("raw_query", f"{with_('skills')} SELECT category, count(*) AS n FROM skills WHERE id >= 10 GROUP BY category")
def raw_query(spark, d):
    return spark.sql("SELECT category, count(*) AS n FROM {s} WHERE id >= :low GROUP BY category", args={"low": 10}, s=fx.skills(spark, d))


@query("node_lookup", f"{with_('skills')} SELECT id, uid, is_deprecated FROM skills WHERE id IN (1, 17, 34)")
def node_lookup(spark, d):
    return fx.skills(spark, d).where(F.col("id").isin(1, 17, 34)).select("id", "uid", "is_deprecated")


# Scoring and pruning --------------------------------------------------------


@query("constraint_filter", f"{BASE}, {POOL} SELECT p.request_id, p.id FROM pool p JOIN skills s ON s.id = p.id WHERE s.execution_success_rate >= 0.5 AND p.id NOT IN (1, 2, 3)")
def constraint_filter(spark, d):
    r, s, e = _inputs(spark, d)
    pool = retrieval.expand(retrieval.recall(r, s), e, s, r)
    return retrieval.constrain(pool, s, excluded=[1, 2, 3]).select("request_id", "id")


def _scored(spark, d):
    r, s, e = _inputs(spark, d)
    seeds, scored = routing.candidates(r, s, e, centrality=False)
    return seeds, scored, s, e


@query("score_similarity", f"{BASE}, {SCORED} SELECT request_id, id, similarity, is_seed FROM scored")
def score_similarity(spark, d):
    return _scored(spark, d)[1].select("request_id", "id", "similarity", "is_seed")


@query("score_composite", f"{BASE}, {SCORED} SELECT request_id, id, score FROM scored")
def score_composite(spark, d):
    return _scored(spark, d)[1].select("request_id", "id", "score")


@query("score_category", f"{BASE}, {SCORED} SELECT s.category, count(*) AS n, round(avg(score), 6) AS avg_score FROM scored JOIN skills s USING (id) GROUP BY 1")
def score_category(spark, d):
    return _scored(spark, d)[1].groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("pagerank_local")
def pagerank_local(spark, d):
    _, scored, _, e = _scored(spark, d)
    return scoring.pagerank(scored, e).withColumn("pagerank", F.round("pagerank", 6))


@query("conflict_graph", f"{BASE}, {CLASH} SELECT request_id, a, b FROM clash")
def conflict_graph(spark, d):
    _, scored, _, e = _scored(spark, d)
    return conflicts.conflict_edges(scored, e)


@query("mwis_greedy", f"{BASE}, {_mwis(False)} SELECT request_id, id, position::INT AS position FROM mwis")
def mwis_greedy(spark, d):
    _, scored, _, e = _scored(spark, d)
    return conflicts.independent_set(scored, e, protect=False)


@query("mwis_protected", f"{BASE}, {_mwis(True)} SELECT request_id, id, position::INT AS position FROM mwis")
def mwis_protected(spark, d):
    _, scored, _, e = _scored(spark, d)
    return conflicts.independent_set(scored, e)


@query("mwis_violations", "SELECT 0::BIGINT AS request_id, 0::BIGINT AS a, 0::BIGINT AS b WHERE false")
def mwis_violations(spark, d):
    _, scored, _, e = _scored(spark, d)
    return conflicts.violations(conflicts.independent_set(scored, e), e)


@query("enhancement_score", f"""{BASE}, {_mwis(True)} SELECT m.request_id, round(avg(s.score) - coalesce(avg(s.score) FILTER (WHERE s.is_seed), 0) + 1e-8, 6) AS signed, round(greatest(0, avg(s.score) - coalesce(avg(s.score) FILTER (WHERE s.is_seed), 0)) + 1e-8, 6) AS enhancement,
    bool_or(NOT s.is_seed) AS improved FROM mwis m JOIN scored s ON s.request_id = m.request_id AND s.id = m.id GROUP BY 1""")
def enhancement_score(spark, d):
    _, scored, _, e = _scored(spark, d)
    found = scoring.enhancement(conflicts.independent_set(scored, e).join(scored, ["request_id", "id"]))
    # Means of six-place scores end in halves of the sixth place: a little more makes both engines round alike.
    return found.withColumns({c: F.round(F.col(c) + 1e-8, 6) for c in ("signed", "enhancement")})


@query("route_confidence", f"""{BASE}, {_mwis(True)} SELECT m.request_id, round(least(1, avg(s.score)), 6) AS confidence, count(*) AS n FROM mwis m JOIN scored s ON s.request_id = m.request_id AND s.id = m.id GROUP BY 1""")
def route_confidence(spark, d):
    _, scored, _, e = _scored(spark, d)
    kept = conflicts.independent_set(scored, e).join(scored, ["request_id", "id"])
    return kept.groupBy("request_id").agg(F.round(F.least(F.lit(1.0), F.avg("score")), 6).alias("confidence"), F.count("*").alias("n"))


# Assembly -------------------------------------------------------------------


@query("token_count", r"""SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) = '' THEN 0
    ELSE floor(len(string_split(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) * 1.3::DOUBLE)::INT END AS tokens, (length(coalesce(text, '')) // 4)::INT AS char_tokens FROM documents""")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_tokens("text").alias("tokens"), tx.char_tokens("text").alias("char_tokens"))


PRIORITY = "CASE WHEN is_seed THEN 250.0 ELSE 0.0 END + CASE WHEN edge_type = 'REQUIRES' THEN 100.0 ELSE 0.0 END + score * 10.0 - CASE WHEN edge_type = 'ENHANCES' AND NOT is_seed THEN 20.0 ELSE 0.0 END"


@query("pack_priority", f"{BASE}, {SCORED} SELECT request_id, id, round({PRIORITY}, 6)::DOUBLE AS priority FROM scored")
def pack_priority(spark, d):
    return _scored(spark, d)[1].select("request_id", "id", F.round(assembly.priority(), 6).alias("priority"))


@query("pack_budget", f"""{BASE}, {SCORED}, items AS (SELECT request_id, id, (id % 7 + 1) * 10 AS tokens, row_number() OVER (PARTITION BY request_id ORDER BY {PRIORITY} DESC, id) AS k FROM scored),
    steps AS (SELECT DISTINCT request_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS n FROM items
        UNION ALL SELECT s.request_id, i.k, CASE WHEN s.used + i.tokens <= 120 THEN s.used + i.tokens ELSE s.used END, s.n + CASE WHEN s.used + i.tokens <= 120 THEN 1 ELSE 0 END
        FROM steps s JOIN items i ON i.request_id = s.request_id AND i.k = s.k + 1)
    SELECT request_id, max(used) AS used, max(n) AS n_packed FROM steps GROUP BY 1""")
def pack_budget(spark, d):
    items = _scored(spark, d)[1].select("request_id", "id", assembly.priority().alias("priority"), F.lit(0).alias("topo"), F.expr("(id % 7 + 1) * 10").alias("tokens"))
    return assembly.pack_budget(items, 620, 500).select("request_id", "used", F.size("ids").cast("long").alias("n_packed"))


@query("topo_order", f"""{BASE}, {_mwis(True)}, inner_edges AS (SELECT DISTINCT m.request_id, e.source, e.target FROM mwis m JOIN edges e ON e.source = m.id AND e.edge_type = 'REQUIRES' JOIN mwis o ON o.request_id = m.request_id AND o.id = e.target),
    walk AS (SELECT request_id, id, id AS at, 0 AS level FROM mwis UNION ALL SELECT w.request_id, w.id, e.target, w.level + 1 FROM walk w JOIN inner_edges e ON e.request_id = w.request_id AND e.source = w.at)
    SELECT request_id, id, max(level)::INT AS level FROM walk GROUP BY 1, 2""")
def topo_order(spark, d):
    _, scored, _, e = _scored(spark, d)
    return assembly.topological(conflicts.independent_set(scored, e), e).select("request_id", "id", "level")


@query("assembled_text")
def assembled_text(spark, d):
    _, scored, s, e = _scored(spark, d)
    out = assembly.assemble(conflicts.independent_set(scored, e), scored, s, e)
    return out.select("request_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "used", "assembled_text")


DECIDED = f"""{BASE}, {_mwis(True)}, surv AS (SELECT s.* FROM scored s JOIN mwis m ON m.request_id = s.request_id AND m.id = s.id),
    flags AS (SELECT z.request_id, coalesce(bool_or(NOT s.is_seed), false) AS improved FROM (SELECT DISTINCT request_id FROM seeds) z LEFT JOIN surv s ON s.request_id = z.request_id GROUP BY 1)"""


@query("route_mode", f"{DECIDED} SELECT request_id, CASE WHEN improved THEN 'enhanced' ELSE 'baseline' END AS mode FROM flags")
def route_mode(spark, d):
    seeds, scored, _, e = _scored(spark, d)
    return routing.decide(seeds, scored, e).select("request_id", "mode").distinct()


_ITEM = "{'similarity': similarity, 'id': id, 'is_seed': is_seed, 'score': score}"
SELECTED = DECIDED + f""", so AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS k FROM surv),
    pushed AS (SELECT request_id, similarity, {_ITEM} AS x, row_number() OVER (PARTITION BY request_id ORDER BY k) AS p FROM so WHERE k > 5 AND is_seed),
    capping AS (SELECT request_id, 0::BIGINT AS p, list({_ITEM}) AS t FROM so WHERE k <= 5 GROUP BY 1
        UNION ALL SELECT request_id, p, CASE WHEN len(weaker) = 0 THEN t ELSE list_append(list_filter(t, lambda y: y.id <> least_id), x) END
        FROM (SELECT *, weaker[1].id AS least_id FROM (SELECT c.request_id, u.p, c.t, u.x, list_sort(list_filter(c.t, lambda y: NOT y.is_seed AND y.similarity < u.similarity)) AS weaker FROM capping c JOIN pushed u ON u.request_id = c.request_id AND u.p = c.p + 1))),
    capped AS (SELECT c.request_id, unnest(c.t) AS x FROM capping c JOIN (SELECT request_id, max(p) AS p FROM capping GROUP BY 1) m ON m.request_id = c.request_id AND m.p = c.p),
    selected AS (SELECT c.request_id, x.id AS id, x.similarity AS similarity, x.is_seed AS is_seed, x.score AS score, 'enhanced' AS mode FROM capped c JOIN flags f ON f.request_id = c.request_id WHERE improved
        UNION ALL SELECT z.request_id, z.id, z.similarity, true, z.similarity, 'baseline' FROM seeds z JOIN flags f ON f.request_id = z.request_id WHERE NOT improved)"""


@query("route_selected", f"{SELECTED} SELECT request_id, id, similarity, is_seed, score, mode FROM selected")
def route_selected(spark, d):
    seeds, scored, _, e = _scored(spark, d)
    return routing.decide(seeds, scored, e)


@query("route_metrics", f"""{SELECTED}, left_over AS (SELECT request_id, count(*) AS n FROM (SELECT DISTINCT p.request_id, least(e.source, e.target) AS a, greatest(e.source, e.target) AS b FROM edges e JOIN selected p ON p.id = e.source JOIN selected q ON q.id = e.target AND q.request_id = p.request_id
        WHERE e.edge_type IN ('CONFLICTS_WITH', 'SUBSTITUTES') AND e.source <> e.target) GROUP BY 1), per AS (SELECT request_id, any_value(mode) AS mode, count(*) AS n_selected, count(*) FILTER (WHERE is_seed) AS n FROM selected GROUP BY 1)
    SELECT z.request_id, p.mode, coalesce(n_selected, 0) AS n_selected, round(coalesce(p.n, 0) / z.n, 6) AS seed_coverage, coalesce(l.n, 0) AS n_conflicts FROM (SELECT request_id, count(*) AS n FROM seeds GROUP BY 1) z LEFT JOIN per p ON p.request_id = z.request_id LEFT JOIN left_over l ON l.request_id = z.request_id""")
def route_metrics(spark, d):
    """Without the confidence, which ``route_confidence`` compares."""
    seeds, scored, _, e = _scored(spark, d)
    return routing.metrics(routing.decide(seeds, scored, e), seeds, e).drop("confidence")


@query("route_full")
def route_full(spark, d):
    r, s, e = _inputs(spark, d)
    return routing.route(r, s, e).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("vector_only_fallback", f"{with_('skills', 'requests')}, {SEEDS} SELECT request_id, id, similarity, 0.5::DOUBLE AS confidence, 0::BIGINT AS tokens FROM seeds")
def vector_only_fallback(spark, d):
    r, s, _ = _inputs(spark, d)
    return routing.vector_only(r, s)


@query("pool_statistics", f"{BASE}, {POOL} SELECT request_id, count(*) AS total, count(*) FILTER (WHERE is_seed) AS seeds, count(*) FILTER (WHERE depth = 1) AS depth_1 FROM pool GROUP BY 1")
def pool_statistics(spark, d):
    r, s, e = _inputs(spark, d)
    pool = retrieval.expand(retrieval.recall(r, s), e, s, r)
    return pool.groupBy("request_id").agg(F.count("*").alias("total"), F.count_if("is_seed").alias("seeds"), F.count_if(F.col("depth") == 1).alias("depth_1"))


# Graph ----------------------------------------------------------------------

REQ = f"{with_('edges', recursive=True)}, req AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'REQUIRES' AND source <> target)"
CLOSED = REQ + ", reach AS (SELECT source, target FROM req UNION SELECT r.source, e.target FROM reach r JOIN req e ON e.source = r.target)"
LEVELS = CLOSED + """, walk AS (SELECT source, target, 1 AS len FROM req UNION SELECT w.source, e.target, w.len + 1 FROM walk w JOIN req e ON e.source = w.target),
    ids AS (SELECT source AS id FROM req UNION SELECT target FROM req), depths AS (SELECT i.id, coalesce(max(w.len), 0)::BIGINT AS depth FROM ids i LEFT JOIN walk w ON w.source = i.id GROUP BY 1)"""
CYC = f"""{with_('cyclic', recursive=True)}, ce AS (SELECT DISTINCT source, target FROM cyclic WHERE source <> target),
    reach AS (SELECT source, target FROM ce UNION SELECT r.source, e.target FROM reach r JOIN ce e ON e.source = r.target),
    scc AS (SELECT a.source AS id, least(a.source, min(a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.source)"""


def _req(spark, d):
    return fx.requires(spark, d).where("source <> target")


@query("deps_direct", f"{REQ} SELECT source, count(*) AS n, max(target) AS last FROM req GROUP BY 1")
def deps_direct(spark, d):
    return _req(spark, d).distinct().groupBy("source").agg(F.count("*").alias("n"), F.max("target").alias("last"))


@query("deps_transitive", f"{CLOSED} SELECT source, target FROM reach")
def deps_transitive(spark, d):
    return graph.closure(_req(spark, d))


@query("neighbors_depth_n", f"""{with_('edges')}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), starts AS (SELECT vec_id AS start FROM embeddings WHERE vec_id % 25 = 0),
    one AS (SELECT start, b AS id FROM starts JOIN both_ways ON a = start), two AS (SELECT o.start, w.b AS id FROM one o JOIN both_ways w ON w.a = o.id)
    SELECT DISTINCT start, id FROM (SELECT * FROM one UNION SELECT * FROM two) WHERE start <> id""")
def neighbors_depth_n(spark, d):
    return graph.neighbours(fx.edges(spark, d), fx.requests(spark, d).select(F.col("request_id").alias("id")), 2)


@query("conflicts_of_node", f"{with_('edges')} SELECT id, count(DISTINCT other) AS n FROM (SELECT source AS id, target AS other FROM edges WHERE edge_type = 'CONFLICTS_WITH' UNION SELECT target, source FROM edges WHERE edge_type = 'CONFLICTS_WITH') GROUP BY 1")
def conflicts_of_node(spark, d):
    e = fx.edges(spark, d).where("edge_type = 'CONFLICTS_WITH'")
    return graph.partners(e).groupBy("id").agg(F.count("*").alias("n"))


@query("cycle_nodes", f"{CYC} SELECT id, component FROM scc")
def cycle_nodes(spark, d):
    return graph.components(fx.cyclic(spark, d))


@query("cycle_edges", f"{CYC} SELECT e.source, e.target, a.component FROM ce e JOIN scc a ON a.id = e.source JOIN scc b ON b.id = e.target AND b.component = a.component")
def cycle_edges(spark, d):
    return graph.cycle_edges(fx.cyclic(spark, d).distinct())


@query("cycle_paths", f"{CYC}, closed AS (SELECT s.component, ce.target AS at, s.component || '->' || ce.target AS path FROM scc s JOIN ce ON ce.source = s.id JOIN scc t ON t.id = ce.target AND t.component = s.component WHERE s.id = s.component) SELECT c.component, min(c.path || '->' || c.component) AS path FROM closed c JOIN ce ON ce.source = c.at AND ce.target = c.component GROUP BY 1")
def cycle_paths(spark, d):
    return graph.cycle_paths(fx.cyclic(spark, d)).select("component", F.array_join(F.transform("path", lambda x: x.cast("string")), "->").alias("path"))


@query("edge_would_cycle", f"{CLOSED}, proposed AS (SELECT vec_id // 3 AS source, vec_id AS target FROM embeddings WHERE vec_id % 5 = 0) SELECT p.source, p.target, p.source = p.target OR EXISTS (SELECT 1 FROM reach r WHERE r.source = p.target AND r.target = p.source) AS creates_cycle FROM proposed p")
def edge_would_cycle(spark, d):
    proposed = table(spark, d, "embeddings").where("vec_id % 5 = 0").selectExpr("vec_id div 3 source", "vec_id target")
    return graph.would_cycle(_req(spark, d), proposed)


@query("dag_report", f"""{CYC}, bad AS (SELECT id FROM scc UNION SELECT r.source FROM reach r JOIN scc s ON s.id = r.target), ok AS (SELECT * FROM ce WHERE source NOT IN (SELECT id FROM bad)),
    good AS (SELECT source, target, 1 AS len FROM ok UNION SELECT g.source, o.target, g.len + 1 FROM good g JOIN ok o ON o.source = g.target) SELECT (SELECT count(*) FROM embeddings) AS n_nodes, (SELECT count(*) FROM ce) AS n_edges, 0::BIGINT AS n_self, (SELECT count(DISTINCT component) FROM scc) AS n_cycles, (SELECT count(*) FROM scc) AS n_on_cycles,
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT source FROM ce UNION SELECT target FROM ce)) AS n_isolated,
    (SELECT coalesce(max(len), 0)::BIGINT FROM good) AS max_depth, (SELECT count(*) FROM scc) = 0 AS is_valid""")
def dag_report(spark, d):
    return graph.report(fx.cyclic(spark, d), fx.skills(spark, d))


@query("isolated_nodes", f"{with_('edges')} SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT source FROM edges WHERE edge_type = 'ENHANCES' UNION SELECT target FROM edges WHERE edge_type = 'ENHANCES')")
def isolated_nodes(spark, d):
    return graph.isolated(fx.skills(spark, d), fx.edges(spark, d).where("edge_type = 'ENHANCES'"))


@query("dep_levels", f"""{LEVELS} SELECT i.id, i.depth, CASE WHEN i.depth = 0 THEN 'root' WHEN i.depth = 1 THEN 'shallow' WHEN i.depth <= 3 THEN 'medium' ELSE 'deep' END AS level,
    (SELECT count(*) FROM req WHERE source = i.id) AS n_dependencies, (SELECT count(*) FROM req WHERE target = i.id) AS n_dependents, (SELECT count(*) FROM reach WHERE source = i.id) AS n_transitive,
    i.depth = 0 AS is_leaf, NOT EXISTS (SELECT 1 FROM req WHERE target = i.id) AS is_root FROM depths i""")
def dep_levels(spark, d):
    return graph.levels(_req(spark, d), transitive=True)


@query("level_histogram", f"""{LEVELS} SELECT CASE WHEN depth = 0 THEN 'root' WHEN depth = 1 THEN 'shallow' WHEN depth <= 3 THEN 'medium' ELSE 'deep' END AS level, count(*) AS n FROM depths GROUP BY 1""")
def level_histogram(spark, d):
    return graph.level_counts(graph.levels(_req(spark, d)))


@query("typed_dag_report", f"""{LEVELS} SELECT (SELECT count(*) FROM (SELECT source FROM edges UNION SELECT target FROM edges)) AS n_nodes, (SELECT count(*) FROM req) AS n_edges, 0::BIGINT AS n_self, (SELECT count(*) FROM reach WHERE source = target) AS n_cycles,
    (SELECT count(*) FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM ids)) AS n_isolated, (SELECT max(depth) FROM depths) AS max_depth, true AS is_valid""")
def typed_dag_report(spark, d):
    return graph.typed_report(fx.edges(spark, d).where("source <> target")).drop("n_on_cycles")


@query("new_cycles", f"""{CYC} SELECT s.component, count(*) AS n_nodes, any_value(a.n_added) AS n_added FROM scc s JOIN (SELECT x.component, count(*) AS n_added FROM (SELECT vec_id // 2 AS source, vec_id AS target FROM embeddings WHERE vec_id % 50 = 1 AND vec_id > 1 AND vec_id % 100 = 1) e
    JOIN scc x ON x.id = e.source JOIN scc y ON y.id = e.target AND y.component = x.component GROUP BY 1) a ON a.component = s.component GROUP BY 1""")
def new_cycles(spark, d):
    e = fx.cyclic(spark, d)
    added = e.where("target % 100 = 1 and target > source")
    return graph.new_cycles(e.join(added, ["source", "target"], "left_anti"), added)


@query("dep_metrics", f"""{LEVELS} SELECT count(*) AS n_nodes, (SELECT count(*) FROM req) AS n_edges, max(depth) AS max_depth, round((SELECT count(*) FROM req)::DOUBLE / count(*), 2) AS avg_dependencies, count(*) FILTER (WHERE depth = 0) AS n_leaves FROM depths""")
def dep_metrics(spark, d):
    return graph.levels(_req(spark, d)).agg(F.count("*").alias("n_nodes"), F.sum("n_dependencies").alias("n_edges"), F.max("depth").alias("max_depth"), F.round(F.avg("n_dependencies"), 2).alias("avg_dependencies"), F.count_if("is_leaf").alias("n_leaves"))


@query("exec_order", f"{LEVELS} SELECT id, row_number() OVER (ORDER BY depth, id) - 1 AS position FROM depths")
def exec_order(spark, d):
    return graph.execution_order(graph.levels(_req(spark, d)))


@query("load_order", f"{LEVELS} SELECT id, row_number() OVER (ORDER BY depth DESC, id DESC) - 1 AS position FROM depths")
def load_order(spark, d):
    return graph.execution_order(graph.levels(_req(spark, d)), reverse=True)


@query("critical_path", f"""{LEVELS}, best AS (SELECT source, target FROM (SELECT r.source, r.target, row_number() OVER (PARTITION BY r.source ORDER BY d.depth DESC, r.target) AS k FROM req r JOIN depths d ON d.id = r.target) WHERE k = 1),
    line AS (SELECT * FROM (SELECT depth AS step, id FROM depths ORDER BY depth DESC, id LIMIT 1) UNION ALL SELECT l.step - 1, b.target FROM line l JOIN best b ON b.source = l.id) SELECT step, id FROM line""")
def critical_path(spark, d):
    return graph.critical_path(_req(spark, d))


@query("bottleneck", f"{REQ} SELECT target AS id, count(*) AS n FROM req GROUP BY 1 ORDER BY n DESC, id LIMIT 1")
def bottleneck(spark, d):
    return graph.most_needed(_req(spark, d))


@query("missing_deps", f"{REQ} SELECT source, target FROM req WHERE target % 17 = 0")
def missing_deps(spark, d):
    return graph.missing(_req(spark, d), fx.skills(spark, d).where("not is_deprecated"))


@query("dep_tree", f"""{REQ}, tree AS (SELECT vec_id AS root, vec_id AS at, vec_id::VARCHAR AS path, 0 AS depth FROM embeddings WHERE vec_id % 25 = 0
    UNION ALL SELECT t.root, r.target, t.path || '>' || r.target, t.depth + 1 FROM tree t JOIN req r ON r.source = t.at WHERE t.depth < 3) SELECT root, path, depth::INT AS depth FROM tree""")
def dep_tree(spark, d):
    roots = fx.requests(spark, d).select(F.col("request_id").alias("id"))
    return graph.tree(_req(spark, d), roots, 3).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


# Feedback -------------------------------------------------------------------

EXE = with_("executions", recursive=True)
FOLDED = EXE + """, steps AS (SELECT skill_id, ok, row_number() OVER (PARTITION BY skill_id ORDER BY ts, event_id) AS k FROM executions),
    folds AS (SELECT DISTINCT skill_id, 0::BIGINT AS k, 1.0::DOUBLE AS r, false AS d FROM steps UNION ALL
      SELECT skill_id, k, r, CASE WHEN r < 0.3 THEN true WHEN d AND ok AND r >= 0.8 THEN false ELSE d END FROM (
        SELECT f.skill_id, s.k, greatest(0.1, least(1.0, 0.95::DOUBLE * f.r + (1 - 0.95::DOUBLE) * CASE WHEN s.ok THEN 1.0 ELSE 0.0 END)) AS r, f.d, s.ok FROM folds f JOIN steps s ON s.skill_id = f.skill_id AND s.k = f.k + 1)),
    folded AS (SELECT f.skill_id, f.k AS n_events, round(f.r, 6) AS reliability, f.d AS is_deprecated FROM folds f JOIN (SELECT skill_id, max(k) AS k FROM folds GROUP BY 1) m ON m.skill_id = f.skill_id AND m.k = f.k)"""


@query("ewma_reliability", f"{FOLDED} SELECT skill_id, n_events, reliability FROM folded")
def ewma_reliability(spark, d):
    return reliability.fold(fx.executions(spark, d)).drop("is_deprecated")


@query("ewma_deprecation", f"{FOLDED} SELECT skill_id, is_deprecated FROM folded")
def ewma_deprecation(spark, d):
    return reliability.fold(fx.executions(spark, d)).select("skill_id", "is_deprecated")


@query("deprecation_writes", f"{FOLDED} SELECT f.skill_id, f.is_deprecated, CASE WHEN f.is_deprecated THEN 'low_reliability' END AS deprecation_reason, CASE WHEN f.is_deprecated THEN f.reliability END AS deprecation_reliability FROM folded f WHERE f.is_deprecated <> (f.skill_id % 17 = 0)")
def deprecation_writes(spark, d):
    return reliability.deprecation_writes(fx.skills(spark, d), reliability.fold(fx.executions(spark, d)))


@query("ewma_batch_update", f"""{EXE}, latest AS (SELECT skill_id, arg_max(ok, (ts, event_id)) AS ok FROM executions GROUP BY 1)
    SELECT e.vec_id AS skill_id, round(greatest(0.1, least(1.0, 0.95::DOUBLE * (1.0::DOUBLE - (e.vec_id % 7) * 0.1::DOUBLE) + (1 - 0.95::DOUBLE) * CASE WHEN coalesce(l.ok, true) THEN 1.0 ELSE 0.0 END)), 6) AS reliability
    FROM embeddings e LEFT JOIN latest l ON l.skill_id = e.vec_id""")
def ewma_batch_update(spark, d):
    latest = fx.executions(spark, d).groupBy("skill_id").agg(F.max_by("ok", F.struct("ts", "event_id")).alias("ok"))
    current = fx.skills(spark, d).select(F.col("id").alias("skill_id"), F.col("execution_success_rate").alias("reliability"))
    return reliability.batch_update(current, latest)


@query("consecutive_failures", f"{EXE}, t AS (SELECT skill_id, sum(ok::INT) OVER (PARTITION BY skill_id ORDER BY ts DESC, event_id DESC) AS good FROM executions) SELECT skill_id, count(*) AS failures FROM t WHERE good = 0 GROUP BY 1 HAVING count(*) >= 2")
def consecutive_failures(spark, d):
    return reliability.failing(fx.executions(spark, d))


COOC = EXE + """, pairs AS (SELECT x.skill_id AS a, y.skill_id AS b, (x.ok AND y.ok)::INT AS good, epoch_us(y.ts) / 1e6 - epoch_us(x.ts) / 1e6 AS gap FROM executions x JOIN executions y ON x.session_id = y.session_id AND x.skill_id <> y.skill_id AND y.ts > x.ts WHERE epoch_us(y.ts) / 1e6 - epoch_us(x.ts) / 1e6 <= 864000),
    cooc AS (SELECT a, b, count(*) AS n, round(avg(good), 6) AS success, round(avg(gap), 3) AS avg_gap FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("cooccurrence", f"{COOC} SELECT a, b, n, success FROM cooc")
def cooccurrence(spark, d):
    return reliability.cooccurrence(fx.executions(spark, d), 864_000).select("a", "b", "n", "success")


@query("implicit_edges", f"{COOC} SELECT a AS source, b AS target, CASE WHEN avg_gap < 5 AND success > 0.8 THEN 'REQUIRES' ELSE 'ENHANCES' END AS edge_type, round(least(n / 100, 1.0) * success, 6) AS confidence FROM cooc")
def implicit_edges(spark, d):
    return reliability.implicit_edges(reliability.cooccurrence(fx.executions(spark, d), 864_000))


@query("edge_reinforcement", f"""{with_('edges', 'executions', recursive=True)}, en AS (SELECT source, target, weight FROM edges WHERE edge_type = 'ENHANCES'), steps AS (SELECT skill_id, ok, row_number() OVER (PARTITION BY skill_id ORDER BY ts, event_id) AS k FROM executions),
    folds AS (SELECT source, target, 0::BIGINT AS k, weight::DOUBLE AS w FROM en UNION ALL SELECT f.source, f.target, s.k, greatest(0.1, least(1.0, f.w + CASE WHEN s.ok THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END)) FROM folds f JOIN steps s ON s.skill_id = f.target AND s.k = f.k + 1)
    SELECT source, target, round(arg_max(w, k), 6) AS weight FROM folds GROUP BY 1, 2""")
def edge_reinforcement(spark, d):
    return reliability.reinforce(fx.edges(spark, d).where("edge_type = 'ENHANCES'"), fx.executions(spark, d))


@query("edge_promotion", f"""{with_('edges')}, w AS (SELECT source, target, edge_type, CASE WHEN source % 8 = 1 THEN 0.9 ELSE weight END AS weight FROM edges)
    SELECT source, target, 'REQUIRES' AS edge_type, weight::DOUBLE AS weight FROM w WHERE edge_type = 'ENHANCES' AND weight >= 0.85 AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.edge_type = 'REQUIRES' AND r.source = w.source AND r.target = w.target)""")
def edge_promotion(spark, d):
    e = fx.edges(spark, d).withColumn("weight", F.expr("case when source % 8 = 1 then 0.9D else weight end"))
    return reliability.promote(e)


@query("event_sampling")
def event_sampling(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.expr("case when event_type = 'error' then 'SKILL_FAILED' else 'SKILL_SUCCESS' end"))
    return telemetry.sampled(e, "event_id", "kind").select("event_id", "kind")


@query("event_codes", "SELECT event_id, CASE event_type WHEN 'error' THEN 'E003' WHEN 'purchase' THEN 'E002' WHEN 'click' THEN 'E001' END AS code FROM events")
def event_codes(spark, d):
    kind = F.expr("case event_type when 'error' then 'SKILL_FAILED' when 'purchase' then 'SKILL_SUCCESS' when 'click' then 'SKILL_CALLED' else 'OTHER' end")
    return table(spark, d, "events").select("event_id", telemetry.event_code(kind).alias("code"))


@query("latency_percentiles", f"""{EXE} SELECT round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.9), 6) AS p90, round(quantile_cont(duration_ms, 0.99), 6) AS p99, round(max(duration_ms), 6) AS max_ms,
    round(avg((NOT ok)::INT), 6) AS error_rate, count(*) AS n, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0), 6) AS per_second FROM executions""")
def latency_percentiles(spark, d):
    return reliability.latencies(fx.executions(spark, d))


@query("event_windows", f"{EXE} SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failures FROM executions GROUP BY 1")
def event_windows(spark, d):
    return telemetry.windowed_counts(fx.executions(spark, d))


@query("debounced_events", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS last, 0::BIGINT AS n FROM e UNION ALL SELECT f.user_id, e.k, CASE WHEN f.last IS NULL OR e.t - f.last >= 86400000000 THEN e.t ELSE f.last END, f.n + CASE WHEN f.last IS NULL OR e.t - f.last >= 86400000000 THEN 1 ELSE 0 END
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, max(n) AS accepted FROM f GROUP BY 1""")
def debounced_events(spark, d):
    return mutations.debounced(table(spark, d, "events"), 86_400, "user_id")


# Text and validation --------------------------------------------------------

CLEAN = r"lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s]', '', 'g'))"


@query("clean_query", rf"SELECT conv_id, turn, {CLEAN} AS cleaned FROM conversations")
def clean_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.clean("text").alias("cleaned"))


@query("enrich_query", "SELECT conv_id, turn, text || CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN ' context: git repository, docker' WHEN conv_id % 2 = 0 THEN ' context: git repository' WHEN turn % 2 = 0 THEN ' context: docker' ELSE '' END AS enriched FROM conversations")
def enrich_query(spark, d):
    env = F.create_map(F.lit("git_repo"), F.expr("conv_id % 2 = 0"), F.lit("docker_available"), F.expr("turn % 2 = 0"))
    return table(spark, d, "conversations").withColumn("env", env).select("conv_id", "turn", tx.enrich("text", "env").alias("enriched"))


def _intent_sql() -> str:
    parts = [f"CASE WHEN {' OR '.join(f'contains(lower(text), {p!r})' for p in patterns)} THEN {name!r} END" for name, patterns in tx.INTENTS.items()]
    return f"SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ','), '') AS intents FROM documents"


@query("query_preprocess", rf"""WITH c AS (SELECT conv_id, turn, text, {CLEAN} AS cleaned FROM conversations), e AS (SELECT *, cleaned || CASE WHEN conv_id % 2 = 0 THEN ' context: git repository' ELSE '' END AS enriched FROM c)
    SELECT conv_id, turn, text AS original, cleaned, enriched, (CASE WHEN regexp_matches(enriched, 'git|commit|push|pull|branch|merge|clone|checkout|rebase') THEN 'git ' ELSE '' END) || (CASE WHEN regexp_matches(enriched, 'test|pytest|unittest|coverage|assert|mock') THEN 'test' ELSE '' END) AS intents FROM e""")
def query_preprocess(spark, d):
    env = F.create_map(F.lit("git_repo"), F.expr("conv_id % 2 = 0"))
    q = table(spark, d, "conversations").withColumn("q", tx.preprocess("text", env))
    some = lambda k, shown: F.when(F.array_contains("q.intent_keywords", k), shown).otherwise("")
    return q.select("conv_id", "turn", "q.original", "q.cleaned", "q.enriched", F.concat(some("git", "git "), some("test", "test")).alias("intents"))


@query("intent_keywords", _intent_sql())
def intent_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.intents("text"), ",").alias("intents"))


@query("query_hash", "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents")
def query_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.query_hash("text").alias("hash"))


@query("mask_pii", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\b\d{17}[\dXx]\b', '[id_card]', 'g'), '\b\d{16}\b', '[card]', 'g'), '\b1[3-9]\d{9}\b', '[phone]', 'g'), '\bsk-[A-Za-z0-9]{16,}\b', '[key]', 'g')) AS masked_md5 FROM documents")
def mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.mask_personal("text")).alias("masked_md5"))


@query("code_risk", r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)(rm\s+-rf|mkfs|shutdown|drop\s+table)') THEN 'critical' WHEN regexp_matches(html, '(?i)(eval\s*\(|exec\s*\(|sudo|chmod\s+777)') THEN 'high'
    WHEN regexp_matches(html, '(?i)(subprocess|os\.system|requests?\.|curl|wget)') THEN 'medium' ELSE 'low' END AS risk FROM pages""")
def code_risk(spark, d):
    return table(spark, d, "pages").select("page_id", tx.code_risk("html").alias("risk"))


PARSED = with_("permissions") + r""", p AS (SELECT id, permission, regexp_matches(permission, '^[a-z]+:[a-z]+(:[a-zA-Z0-9_/.-]+)?$') AS is_valid, string_split(permission, ':') AS parts FROM permissions),
    q AS (SELECT id, permission, is_valid, CASE WHEN is_valid THEN parts[1] END AS category, CASE WHEN is_valid THEN parts[2] END AS action, CASE WHEN is_valid THEN parts[3] END AS target FROM p),
    r AS (SELECT *, is_valid AND coalesce(target IN ('*', '/'), false) OR is_valid AND permission IN ('system:admin', 'system:shutdown') OR (is_valid AND target IS NULL AND ((category = 'fs' AND action IN ('delete', 'execute')) OR (category = 'exec' AND action = 'execute') OR (category = 'system' AND action IN ('admin', 'shutdown')) OR (category = 'secret' AND action IN ('read', 'write')))) AS high_risk FROM q)"""


@query("permission_parse", f"{PARSED} SELECT id, permission, is_valid, category, action, target FROM r")
def permission_parse(spark, d):
    return perm.parse(fx.permissions(spark, d)).select("id", "permission", "is_valid", "category", "action", "target")


@query("permission_high_risk", f"{PARSED} SELECT id, permission FROM r WHERE high_risk")
def permission_high_risk(spark, d):
    return perm.parse(fx.permissions(spark, d)).where("high_risk").select("id", "permission")


@query("permission_warnings", f"""{PARSED}, u AS (SELECT *, CASE category WHEN 'fs' THEN action IN ('read', 'write', 'delete', 'execute', 'list', 'create') WHEN 'net' THEN action IN ('connect', 'http', 'https', 'ssh', 'list') WHEN 'db' THEN action IN ('query', 'read', 'write', 'delete', 'create', 'update', 'admin')
      WHEN 'exec' THEN action IN ('execute', 'list') WHEN 'env' THEN action IN ('read', 'write', 'list') WHEN 'secret' THEN action IN ('read', 'write', 'list') WHEN 'system' THEN action IN ('info', 'configure', 'admin', 'shutdown') ELSE true END AS ua,
    target IS NULL OR CASE category WHEN 'fs' THEN regexp_matches(target, '^/[a-zA-Z0-9_/.-]*$') WHEN 'net' THEN regexp_matches(target, '^[a-zA-Z0-9.-]+(:[0-9]+)?$') WHEN 'db' THEN regexp_matches(target, '^[a-zA-Z0-9_-]+$') WHEN 'exec' THEN regexp_matches(target, '^[a-zA-Z0-9_/-]+$')
      WHEN 'env' THEN regexp_matches(target, '^[A-Z_][A-Z0-9_]*$') WHEN 'secret' THEN regexp_matches(target, '^[a-zA-Z0-9_-]+$') ELSE true END AS ut FROM r)
    SELECT id, permission, concat_ws(',', CASE WHEN is_valid AND NOT ua THEN 'action' END, CASE WHEN is_valid AND NOT ut THEN 'target' END) AS warnings FROM u""")
def permission_warnings(spark, d):
    return perm.warnings(perm.parse(fx.permissions(spark, d))).select("id", "permission", F.array_join("warnings", ",").alias("warnings"))


@query("permission_summary", f"{PARSED} SELECT id, count(*) AS total_count, count(*) FILTER (WHERE high_risk) AS high_risk_count, coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), ','), '') AS categories, bool_and(is_valid) AS is_valid FROM r GROUP BY 1")
def permission_summary(spark, d):
    return perm.summary(perm.parse(fx.permissions(spark, d)))


@query("permission_conflicts", f"""{PARSED}, s AS (SELECT * FROM r) SELECT a.id AS id_a, b.id AS id_b, CASE WHEN (a.action, b.action) IN (('read', 'delete'), ('delete', 'read')) THEN 'read_delete_conflict' ELSE 'write_execute_conflict' END AS type, a.permission AS permission_a, b.permission AS permission_b
    FROM s a JOIN s b ON a.id < b.id AND a.category = b.category AND a.target IS NOT DISTINCT FROM b.target WHERE (a.action, b.action) IN (('read', 'delete'), ('delete', 'read'), ('write', 'execute'), ('execute', 'write'))""")
def permission_conflicts(spark, d):
    p = perm.parse(fx.permissions(spark, d))
    return perm.conflicts(p, p)


@query("action_parse", """SELECT event_id, CASE event_type WHEN 'view' THEN 'git:fetch:log' WHEN 'click' THEN 'web:click' WHEN 'purchase' THEN 'Run:order' WHEN 'signup' THEN 'user:add' ELSE 'a:b_c' END AS skill,
    CASE event_type WHEN 'view' THEN 'fs' WHEN 'click' THEN 'net' WHEN 'error' THEN 'db' ELSE 'unknown' END AS resource, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'run' WHEN 'signup' THEN 'write' ELSE 'unknown' END AS action FROM events""")
def action_parse(spark, d):
    keys = F.expr("case event_type when 'view' then array('path') when 'click' then array('url', 'x') when 'error' then array('query') else array('x') end")
    tool = F.expr("case event_type when 'view' then 'git_fetch_log' when 'click' then 'web_click' when 'purchase' then 'Run_order' when 'signup' then 'user_add' else 'a:b_c' end")
    return table(spark, d, "events").select("event_id", perm.tool_skill(tool).alias("skill"), perm.resource_type(keys).alias("resource"), perm.action_type(tool).alias("action"))


@query("permission_suggestion", """SELECT event_id, CASE event_type WHEN 'error' THEN 'Request additional permission: fs:' || event_type WHEN 'click' THEN 'Request skill ' || chr(39) || 's' || user_id || chr(39) || ' to be loaded into context' ELSE 'Review skill permissions and session authorization' END AS suggestion FROM events""")
def permission_suggestion(spark, d):
    code = F.expr("case event_type when 'error' then 'PERMISSION_DENIED' when 'click' then 'SKILL_NOT_IN_CONTEXT' when 'view' then 'PERMISSION_DENIED' else 'OTHER' end")
    resource = F.expr("case when event_type = 'error' then 'fs' end")
    return table(spark, d, "events").select("event_id", perm.suggestion(code, F.expr("concat('s', user_id)"), resource, F.col("event_type")).alias("suggestion"))


@query("redact_keys", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[FILTERED]' WHEN 1 THEN '[FILTERED]' ELSE event_type END AS shown FROM events""")
def redact_keys(spark, d):
    key = F.expr("element_at(array('password', 'user_token', 'max_tokens', 'note'), cast(event_id % 4 + 1 as int))")
    return table(spark, d, "events").withColumn("key", key).withColumn("m", F.create_map("key", "event_type")).select("event_id", telemetry.redact(F.col("m"))[F.col("key")].alias("shown"))


@query("manifest_errors", r"""SELECT p_partkey AS id, concat_ws(',', CASE WHEN NOT regexp_matches(sid, '^[a-z0-9_-]+:[a-z0-9_-]+$') THEN 'skill_id:pattern' END, CASE WHEN NOT regexp_matches(ver, '^\d+\.\d+\.\d+(-[a-zA-Z0-9]+)?$') THEN 'version:pattern' END, CASE WHEN length(txt) NOT BETWEEN 50 AND 500 THEN 'intent_description:length' END) AS errors
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Bad' || p_partkey ELSE 'ns:s' || p_partkey END AS sid, CASE WHEN p_partkey % 4 = 0 THEN '1.0' ELSE '1.0.' || p_size END AS ver, repeat(p_name || ' ', 1 + (p_partkey % 60)::INT) AS txt FROM part)""")
def manifest_errors(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey id", "case when p_partkey % 3 = 0 then concat('Bad', p_partkey) else concat('ns:s', p_partkey) end skill_id", "case when p_partkey % 4 = 0 then '1.0' else concat('1.0.', p_size) end version", "repeat(concat(p_name, ' '), cast(1 + p_partkey % 60 as int)) intent_description", "array('fs:read:/x') permissions")
    return validation.errors(p).select("id", F.array_join("errors", ",").alias("errors"))


_MANIFEST = """concat('{"skill_id": "a:b", "version": "1.0.0"', case when p_partkey % 3 = 0 then ', "author": 7' else ', "author": "x"' end, case when p_partkey % 4 = 0 then ', "success_rate": 1.5' when p_partkey % 4 = 1 then ', "success_rate": 1' else '' end,
    case when p_partkey % 5 = 0 then ', "created_at": "yesterday"' else ', "created_at": "2024-01-02"' end, case when p_partkey % 6 = 0 then ', "tags": ["a", 3]' else ', "tags": []' end, case when p_partkey % 7 = 0 then ', "colour": 1' else '' end, '}')"""


@query("manifest_warnings", f"""SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 6 = 0 THEN 'tags[1]:type' END, CASE WHEN p_partkey % 3 = 0 THEN 'author:type' END, CASE WHEN p_partkey % 5 = 0 THEN 'created_at:pattern' END,
    CASE WHEN try_cast(json_extract(m, '$.success_rate') AS DOUBLE) > 1 THEN 'success_rate:maximum' END, CASE WHEN list_contains(json_keys(m), 'colour') THEN 'colour:unknown' END) AS warnings FROM (SELECT p_partkey, ({_MANIFEST})::JSON AS m FROM part)""")
def manifest_warnings(spark, d):
    return validation.warnings(table(spark, d, "part").selectExpr("p_partkey id", f"{_MANIFEST} raw")).select("id", F.array_join("warnings", ",").alias("warnings"))


_REQUEST = """case when p_partkey % 9 = 0 then 'not json' else concat('{', case when p_partkey % 2 = 0 then concat('"query": "', repeat('find ', cast(p_partkey % 4 as int)), '"') else '"x": 1' end,
    case when p_partkey % 3 = 0 then ', "max_tokens": 100' when p_partkey % 3 = 1 then ', "max_tokens": "many"' else ', "max_tokens": 4096' end, case when p_partkey % 5 = 0 then ', "mode": "odd"' else ', "mode": "fast"' end, '}') end"""
_SCHEMA = {"type": "object", "required": ["query"], "properties": {"query": {"type": "string", "minLength": 10, "maxLength": 2000}, "max_tokens": {"type": "integer", "minimum": 256, "maximum": 32000}, "mode": {"enum": ["fast", "exact"]}}, "additionalProperties": False}


@query("schema_validation", f"""SELECT p_partkey AS id, CASE WHEN r = 'not json' THEN '$ json' ELSE concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN '$.query required' END, CASE WHEN p_partkey % 2 = 0 AND length(regexp_extract(r, '"query": "([^"]*)"', 1)) < 10 THEN '$.query minLength' END,
    CASE WHEN p_partkey % 3 = 1 THEN '$.max_tokens type' END, CASE WHEN p_partkey % 3 = 0 THEN '$.max_tokens minimum' END, CASE WHEN p_partkey % 5 = 0 THEN '$.mode enum' END, CASE WHEN p_partkey % 2 = 1 THEN '$.x additionalProperties' END) END AS errors FROM (SELECT p_partkey, {_REQUEST} AS r FROM part)""")
def schema_validation(spark, d):
    found = validation.schema_errors(table(spark, d, "part").selectExpr("p_partkey id", f"{_REQUEST} raw"), "raw", _SCHEMA)
    return found.select("id", F.array_join(F.transform("schema_errors", lambda e: F.concat(e["path"], F.lit(" "), e["validator"])), ",").alias("errors"))


ISSUES = with_("code") + r""", hits AS (
    SELECT id, 'unquoted_variable' AS rule, 'warning' AS severity, len(regexp_extract_all(code, '\$([A-Za-z_][A-Za-z0-9_]*)[^"''\w]')) AS n FROM code WHERE language = 'bash'
    UNION ALL SELECT id, 'console_log', 'info', len(regexp_extract_all(code, 'console\.log\(')) FROM code WHERE language = 'javascript'
    UNION ALL SELECT id, 'implicit_any', 'warning', len(regexp_extract_all(code, ':\s*any\b')) FROM code WHERE language = 'typescript'
    UNION ALL SELECT id, 'unsafe_block', 'warning', len(regexp_extract_all(code, 'unsafe\s*\{')) FROM code WHERE language = 'rust'
    UNION ALL SELECT id, 'empty_catch', 'error', len(regexp_extract_all(code, 'catch\s*\([^)]+\)\s*\{\s*\}')) FROM code WHERE language = 'java'
    UNION ALL SELECT id, 'missing_error_handling', 'warning', 1 FROM code WHERE language = 'bash' AND NOT contains(code, 'set -e')
    UNION ALL SELECT id, 'unhandled_error', 'error', 1 FROM code WHERE language = 'go' AND NOT contains(code, 'if err')
    UNION ALL SELECT id, 'missing_entrypoint', 'warning', 1 FROM code WHERE language = 'python' AND NOT contains(code, 'def main')
    UNION ALL SELECT id, 'missing_docstring', 'info', len(regexp_extract_all(code, 'def f')) FROM code WHERE language = 'python')"""


def _issues(spark, d):
    found = code_facts.code_facts(fx.code(spark, d))
    return validation.code_issues(found, line_start="line_start", facts="facts")


@query("static_issue_counts", f"{ISSUES} SELECT id, rule, severity, n FROM hits WHERE n > 0")
def static_issue_counts(spark, d):
    return _issues(spark, d).select("id", F.explode("issues").alias("i")).groupBy("id", "i.rule", "i.severity").agg(F.count("*").alias("n"))


@query("static_issue_lines", """SELECT p_partkey AS id, (p_partkey % 5 + 1 + CASE p_partkey % 7 WHEN 5 THEN 3 + k WHEN 2 THEN 1 + k ELSE 5 END)::INT AS line FROM part, range(0, 4) t(k) WHERE (p_partkey % 7 = 5 AND k < p_partkey % 3) OR (p_partkey % 7 = 2 AND k < p_partkey % 4) OR (p_partkey % 7 = 4 AND p_partkey % 2 = 1 AND k = 0) OR (p_partkey % 7 = 6 AND k = 0)""")
def static_issue_lines(spark, d):
    return _issues(spark, d).select("id", F.explode("issues").alias("i")).where("i.rule in ('unsafe_block', 'console_log', 'unhandled_error', 'empty_catch')").select("id", "i.line")


@query("issue_severities", f"{ISSUES} SELECT c.id, coalesce(sum(n) FILTER (WHERE severity = 'error'), 0)::BIGINT AS error_count, coalesce(sum(n) FILTER (WHERE severity = 'warning'), 0)::BIGINT AS warning_count, coalesce(sum(n) FILTER (WHERE severity = 'info'), 0)::BIGINT AS info_count, coalesce(sum(n) FILTER (WHERE severity = 'error'), 0) > 0 AS has_errors FROM code c LEFT JOIN hits h ON h.id = c.id GROUP BY 1")
def issue_severities(spark, d):
    return validation.severity_counts(_issues(spark, d)).select("id", "error_count", "warning_count", "info_count", "has_errors")


@query("complexity_score", "SELECT p_partkey AS id, round(least(p_size * 0.5, 3.0) + least(p_partkey % 30 * 0.1, 2.0) + least(p_size % 7 * 0.2, 2.0) + least(p_partkey % 13 * 0.1, 1.0) + least(p_size % 5 * 0.3, 1.0), 6)::DOUBLE AS score FROM part")
def complexity_score(spark, d):
    c = F.expr
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), validation.complexity(c("p_size"), c("p_partkey % 30"), c("p_size % 7"), c("p_partkey % 13"), c("p_size % 5")).alias("score"))


@query("language_alias", "SELECT p_partkey AS id, (['python', 'bash', 'javascript', 'typescript', 'go', 'rust', 'cpp', 'python', 'kotlin'])[p_partkey % 9 + 1] AS language FROM part")
def language_alias(spark, d):
    names = F.expr("element_at(array('py', 'SH', 'js', 'ts', 'GoLang', 'rs', 'c++', 'Python', 'Kotlin'), cast(p_partkey % 9 + 1 as int))")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.language(names).alias("language"))


# Ingestion and synchronisation ----------------------------------------------


def skill_texts(spark, d):
    """Skill files written as text from part rows: front matter, a paragraph and a fenced block."""
    return table(spark, d, "part").selectExpr(
        "concat('/skills/ns', p_partkey % 5, '/s', p_partkey, '/SKILL.md') path",
        """concat('---\nskill_id: ns', p_partkey % 5, ':s', p_partkey, '\nversion: ', case when p_partkey % 11 = 0 then 'v' else '' end, '1.0.', p_size, '\nintent_description: ', repeat('does a thing well and then rests ', 2), p_partkey,
           '\npermissions:\n  - fs:read:/data\ntopology_hints:\n  requires:\n    - ns', p_partkey % 5, ':s', p_partkey div 2, case when p_partkey % 3 = 0 then '\n  enhances:\n    - ns0:s1' else '' end,
           '\n---\n# Title\n\n```', case p_partkey % 3 when 0 then 'python {entrypoint=true}' when 1 then 'bash {name=x, entrypoint=false}' else 'go' end, '\nimport os\n\nx = 1\n```\n', case when p_partkey % 2 = 0 then '```js {entrypoint=yes}\nf()\n```\n' else '' end) text""",
        "p_partkey id",
    )


@query("frontmatter_extract", r"SELECT p_partkey AS id, 'ns' || (p_partkey % 5) || ':s' || p_partkey AS skill_id, CASE WHEN p_partkey % 11 = 0 THEN 'v' ELSE '' END || '1.0.' || p_size AS version, p_partkey % 11 <> 0 AS is_valid FROM part")
def frontmatter_extract(spark, d):
    return ingest.parse(skill_texts(spark, d)).select("id", "manifest.skill_id", "manifest.version", "is_valid")


@query("code_blocks", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' ELSE 'go' END AS language, 3::INT AS line_start, 7::INT AS line_end, p_partkey % 3 = 0 AS is_entrypoint FROM part UNION ALL SELECT p_partkey, 'js', 8, 10, true FROM part WHERE p_partkey % 2 = 0")
def code_blocks(spark, d):
    f = skill_files.blocks(skill_files.split(skill_texts(spark, d))).withColumn("b", F.explode("blocks"))
    return f.select("id", "b.language", "b.line_start", "b.line_end", "b.is_entrypoint")


@query("blocks_by_language", "SELECT p_partkey AS id, (p_partkey % 3 = 2)::BIGINT AS n_go, CASE WHEN p_partkey % 3 = 0 THEN 'python' WHEN p_partkey % 2 = 0 THEN 'js' END AS entry_language FROM part")
def blocks_by_language(spark, d):
    f = skill_files.blocks(skill_files.split(skill_texts(spark, d)))
    return f.select("id", F.size(skill_files.by_language("blocks", "Go")).cast("long").alias("n_go"), skill_files.entrypoint("blocks")["language"].alias("entry_language"))


@query("code_fact_counts", """SELECT *, round(least(functions * 0.5, 3.0) + least(parameters * 0.1, 2.0) + least(imports * 0.2, 2.0) + least(variables * 0.1, 1.0) + least(asyncs * 0.3, 1.0), 6)::DOUBLE AS complexity FROM (SELECT p_partkey AS id,
    CASE p_partkey % 7 WHEN 0 THEN p_partkey % 3 + (p_partkey % 2 = 0)::INT WHEN 6 THEN 2 ELSE 1 END::BIGINT AS functions, CASE p_partkey % 7 WHEN 0 THEN p_partkey % 3 * 2 + (p_partkey % 2 = 0)::INT WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 2 END::BIGINT AS parameters,
    CASE p_partkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS imports, CASE p_partkey % 7 WHEN 2 THEN 0 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS variables, CASE WHEN p_partkey % 7 IN (2, 5) THEN 1 ELSE 0 END::BIGINT AS asyncs,
    CASE p_partkey % 7 WHEN 0 THEN (p_partkey % 2 = 0)::INT WHEN 2 THEN 0 ELSE 1 END::BIGINT AS entries FROM part)""")
def code_fact_counts(spark, d):
    f = code_facts.code_facts(fx.code(spark, d))
    functions = F.col("facts.functions")
    n = {"functions": F.size(functions), "parameters": F.aggregate(functions, F.lit(0), lambda t, x: t + F.size(x["params"])), "imports": F.size("facts.imports"), "variables": F.size("facts.variables"), "asyncs": F.size(F.filter(functions, lambda x: x["is_async"])), "entries": F.size(F.filter(functions, lambda x: x["is_entry"]))}
    return f.select("id", *(c.cast("long").alias(k) for k, c in n.items()), validation.facts_complexity().alias("complexity"))


@query("hint_edges", "SELECT 'ns' || (p_partkey % 5) || ':s' || p_partkey AS source, 'ns' || (p_partkey % 5) || ':s' || (p_partkey // 2) AS target, 'REQUIRES' AS edge_type, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT 'ns' || (p_partkey % 5) || ':s' || p_partkey, 'ns0:s1', 'ENHANCES', 0.8 FROM part WHERE p_partkey % 3 = 0")
def hint_edges(spark, d):
    rows = ingest.parse(skill_texts(spark, d)).select(F.col("manifest.skill_id").alias("uid"), F.col("manifest.topology_hints").alias("hints"))
    return validation.hint_edges(rows, "uid", "hints")


@query("import_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 11 <> 0) AS imported, count(*) FILTER (WHERE p_partkey % 11 = 0) AS failed, round(100.0 * count(*) FILTER (WHERE p_partkey % 11 <> 0) / count(*), 2)::DOUBLE AS success_rate FROM part")
def import_stats(spark, d):
    return ingest.statistics(ingest.parse(skill_texts(spark, d)))


INFER = with_("edges") + """, dec AS (SELECT source, target, max(edge_type) AS dt FROM edges WHERE edge_type IN ('REQUIRES', 'ENHANCES') AND source % 2 = 0 GROUP BY 1, 2 HAVING count(DISTINCT edge_type) = 1),
    inf AS (SELECT source, target, CASE WHEN source % 3 = 0 THEN 'CONFLICTS_WITH' WHEN source % 3 = 1 THEN 'REQUIRES' ELSE 'ENHANCES' END AS it, (source % 10 + 1) / 10.0::DOUBLE AS ic FROM (SELECT DISTINCT source, target FROM edges WHERE edge_type IN ('REQUIRES', 'ENHANCES'))),
    res AS (SELECT coalesce(d.source, i.source) AS source, coalesce(d.target, i.target) AS target, dt, it, ic, CASE WHEN it IS NULL THEN 'declared_only' WHEN dt IS NULL THEN CASE WHEN ic >= 0.7 THEN 'inferred_accepted' ELSE 'inferred_rejected' END
      WHEN dt = it THEN 'agreed' WHEN (dt, it) IN (('REQUIRES', 'ENHANCES'), ('ENHANCES', 'REQUIRES')) THEN 'merge' WHEN ic >= 0.9 THEN 'keep_inferred' ELSE 'keep_declared' END AS strategy FROM dec d FULL JOIN inf i ON d.source = i.source AND d.target = i.target)"""


def _relations(spark, d):
    e = fx.edges(spark, d).where("edge_type in ('REQUIRES', 'ENHANCES')")
    dec = e.where("source % 2 = 0").groupBy("source", "target").agg(F.count_distinct("edge_type").alias("n"), F.max("edge_type").alias("edge_type")).where("n = 1").drop("n")
    inf = e.select("source", "target").distinct().selectExpr("source", "target", "case source % 3 when 0 then 'CONFLICTS_WITH' when 1 then 'REQUIRES' else 'ENHANCES' end edge_type", "(source % 10 + 1) / 10.0D confidence")
    return dec, inf


def _resolved(spark, d):
    return relations.resolve(*_relations(spark, d), ladder=("merge", "keep_inferred", "keep_declared"))


@query("relation_resolution", f"{INFER} SELECT source, target, CASE WHEN strategy IN ('inferred_accepted', 'keep_inferred') THEN it ELSE dt END AS edge_type, CASE WHEN strategy IN ('inferred_accepted', 'keep_inferred') THEN ic ELSE 1.0 END AS confidence, strategy FROM res WHERE strategy <> 'inferred_rejected'")
def relation_resolution(spark, d):
    return _resolved(spark, d)


@query("manual_decisions", f"{INFER} SELECT source, target, CASE WHEN source % 4 = 0 THEN 'SUBSTITUTES' ELSE dt END AS edge_type FROM res WHERE strategy IN ('merge', 'keep_inferred', 'keep_declared') AND target % 5 <> 0")
def manual_decisions(spark, d):
    """Every conflict waits for review; some are decided, some dropped."""
    dec, inf = _relations(spark, d)
    waiting = relations.review(relations.resolve(dec, inf, ladder=("manual_review",)))
    decisions = waiting.where("source % 4 = 0 or target % 5 = 0").selectExpr("source", "target", "case when target % 5 <> 0 then 'SUBSTITUTES' end decided")
    return relations.decide(waiting, decisions).select("source", "target", "edge_type")


@query("resolution_summary", f"{INFER} SELECT strategy, count(*) AS n FROM res WHERE strategy <> 'inferred_rejected' GROUP BY 1")
def resolution_summary(spark, d):
    return relations.summary(_resolved(spark, d))


CHANGES = with_("snapshots") + ", ch AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS change FROM snap_old o FULL JOIN snap_new n ON n.path = o.path)"


@query("file_changes", f"{CHANGES} SELECT path, change FROM ch")
def file_changes(spark, d):
    return mutations.file_changes(*fx.snapshots(spark, d))


@query("sync_snapshot", f"{with_('snapshots')} SELECT path, hash FROM snap_new")
def sync_snapshot(spark, d):
    return mutations.apply_changes(*fx.snapshots(spark, d))


@query("node_upsert", f"{with_('skills')} SELECT id, CASE WHEN id % 5 = 0 THEN 99 ELSE category END::INT AS category, execution_success_rate FROM skills UNION ALL SELECT 1000000 + id, 99, 1.0::DOUBLE FROM skills WHERE id % 50 = 0")
def node_upsert(spark, d):
    s = fx.skills(spark, d).select("id", F.col("category").cast("int").alias("category"), "execution_success_rate")
    ch = s.where("id % 5 = 0").selectExpr("id", "99 category", "0.0D execution_success_rate").unionByName(s.where("id % 50 = 0").selectExpr("1000000 + id id", "99 category", "1.0D execution_success_rate"))
    return mutations.upsert(s, ch, "id", keep=("execution_success_rate",))


@query("node_delete_cascade", f"{with_('edges')} SELECT source, target, edge_type, weight FROM edges WHERE source % 17 <> 0 AND target % 17 <> 0")
def node_delete_cascade(spark, d):
    s = fx.skills(spark, d)
    return mutations.delete_nodes(s, fx.edges(spark, d), s.where("is_deprecated"))[1]


@query("edge_normalise", f"{with_('edges')} SELECT source, target, edge_type, max(weight)::DOUBLE AS weight FROM edges WHERE source <> target GROUP BY 1, 2, 3")
def edge_normalise(spark, d):
    e = fx.edges(spark, d)
    turned = e.where("edge_type in ('CONFLICTS_WITH', 'SUBSTITUTES')").select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type", "weight")
    return mutations.normalise_edges(e.unionByName(turned))


@query("edge_upsert", f"{with_('edges')} SELECT source, target, edge_type, CASE WHEN edge_type = 'ENHANCES' THEN 0.5 ELSE weight END::DOUBLE AS weight FROM edges")
def edge_upsert(spark, d):
    e = fx.edges(spark, d)
    new = e.where("edge_type = 'ENHANCES'").withColumn("weight", F.lit(0.5))
    lost = new.limit(5).withColumn("target", F.lit(-1).cast("long"))
    return mutations.edge_upsert(e, new.unionByName(lost), fx.skills(spark, d))


@query("store_reconcile", "SELECT vec_id AS id, 'missing_vector' AS state FROM embeddings WHERE vec_id % 10 = 3 UNION ALL SELECT 5000000 + vec_id, 'extra_vector' FROM embeddings WHERE vec_id % 20 = 1")
def store_reconcile(spark, d):
    s = fx.skills(spark, d).select("id")
    return mutations.reconcile(s, s.where("id % 10 <> 3").unionByName(s.where("id % 20 = 1").selectExpr("5000000 + id id")))


# Runtime --------------------------------------------------------------------


@query("permission_intercept", """WITH a AS (SELECT p_partkey AS action_id, p_partkey % 20 AS skill_id, p_partkey % 7 AS session_id, CASE p_partkey % 2 WHEN 0 THEN 'fs' ELSE 'net' END AS resource, 'read' AS action, '/data/' || (p_partkey % 4) AS target FROM part),
    d AS (SELECT s AS skill_id, 'fs' AS category, 'read' AS action, CASE WHEN s % 2 = 0 THEN '*' ELSE '/data/1' END AS target FROM range(20) t(s) WHERE s % 5 <> 0), g AS (SELECT s AS session_id, 'fs' AS category, 'read' AS action, CASE WHEN s % 2 = 0 THEN '*' ELSE '/data/*' END AS target FROM range(7) t(s) WHERE s <> 6),
    v AS (SELECT a.*, d.target AS dt, g.target AS gt FROM a LEFT JOIN d ON d.skill_id = a.skill_id LEFT JOIN g ON g.session_id = a.session_id),
    r AS (SELECT action_id, CASE WHEN dt IS NOT NULL AND NOT (resource = 'fs' AND (dt = '*' OR dt = target)) THEN 'not declared' WHEN dt IS NOT NULL AND gt IS NOT NULL AND NOT (gt = '*' OR starts_with(dt, '/data/')) THEN 'exceeds authorization' ELSE '' END AS reason FROM v)
    SELECT action_id, reason = '' AS allowed, reason FROM r""")
def permission_intercept(spark, d):
    a = table(spark, d, "part").selectExpr("p_partkey action_id", "p_partkey % 20 skill_id", "p_partkey % 7 session_id", "case p_partkey % 2 when 0 then 'fs' else 'net' end resource", "'read' action", "concat('/data/', p_partkey % 4) target")
    declared = spark.range(20).where("id % 5 <> 0").selectExpr("id skill_id", "'fs' category", "'read' action", "case when id % 2 = 0 then '*' else '/data/1' end target")
    granted = spark.range(7).where("id <> 6").selectExpr("id session_id", "'fs' category", "'read' action", "case when id % 2 = 0 then '*' else '/data/*' end target")
    return perm.intercept(a, declared, granted)


@query("inject_prompt", "SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn % 2 = 0 THEN 'Relevant knowledge' END, nullif(text, '')) AS prompt FROM conversations")
def inject_prompt(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.inject(F.expr("case when turn % 2 = 0 then 'Relevant knowledge' end"), "text").alias("prompt"))


@query("session_history", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3 GROUP BY 1")
def session_history(spark, d):
    return mutations.last_turns(table(spark, d, "conversations"), 3)


@query("kv_live_entries", """WITH l AS (SELECT user_id AS key, event_type AS value, ts, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), m AS (SELECT max(ts) AS now FROM events)
    SELECT key, value, (864000 - (epoch_us(now) // 1000000 - epoch_us(ts) // 1000000))::BIGINT AS ttl_seconds FROM l, m WHERE k = 1 AND 864000 - (epoch_us(now) // 1000000 - epoch_us(ts) // 1000000) > 0""")
def kv_live_entries(spark, d):
    e = table(spark, d, "events")
    log = e.selectExpr("user_id key", "event_type value", "cast(ts as timestamp) ts", "event_id seq", "864000L ttl_seconds").join(F.broadcast(e.agg(F.max("ts").cast("timestamp").alias("now"))))
    return _live(log)


def _live(log: DataFrame) -> DataFrame:
    now = log.first()["now"] if not log.isEmpty() else None
    return mutations.live_entries(log.drop("now"), F.lit(now).cast("timestamp"))


@query("cache_hit_rate", "SELECT event_type, round(count(*) FILTER (WHERE value > 50) * 100.0 / count(*), 2)::DOUBLE AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, d):
    return runtime.hit_rate(table(spark, d, "events"), "event_type", F.col("value") > 50)


@query("counter_increment", "SELECT user_id AS key, sum(event_id % 5)::BIGINT AS total FROM events GROUP BY 1")
def counter_increment(spark, d):
    return runtime.counters(table(spark, d, "events"), F.col("user_id"), F.expr("event_id % 5"))


# Further runtime, audit and design-level operators ---------------------------


@query("http_status", "SELECT p_partkey AS id, CASE p_size * 1000 + p_partkey % 5 WHEN 2001 THEN 504 WHEN 2002 THEN 404 WHEN 3003 THEN 500 WHEN 4004 THEN 500 ELSE CASE p_size WHEN 1 THEN 400 WHEN 2 THEN 500 WHEN 3 THEN 400 WHEN 4 THEN 503 WHEN 5 THEN 403 WHEN 6 THEN 500 WHEN 7 THEN 504 WHEN 8 THEN 401 WHEN 9 THEN 429 ELSE 500 END END::INT AS status FROM part")
def http_status(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), runtime.http_status(F.expr("cast(p_size * 1000 + p_partkey % 5 as int)")).alias("status"))


@query("write_statistics", f"{EXE} SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS succeeded, round(avg(ok::INT) * 100, 2) AS success_rate, count(*) FILTER (WHERE NOT ok) AS rollbacks, round(avg(duration_ms), 2) AS avg_ms FROM executions")
def write_statistics(spark, d):
    e = fx.executions(spark, d)
    return runtime.write_statistics(e.select(F.col("ok").alias("success"), (~F.col("ok")).alias("rolled_back"), F.col("duration_ms").alias("ms")))


@query("audit_page", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT min(ts) FROM events) AND event_type IN ('error', 'click') ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 40")
def audit_page(spark, d):
    return runtime.audit(table(spark, d, "events"), "1970-01-01", "2100-01-01", ["error", "click"], 40, 1).select("event_id", "event_type")


@query("skill_listing", f"{with_('skills')} SELECT id, uid FROM skills WHERE starts_with(uid, 'ns3:') AND NOT is_deprecated ORDER BY uid LIMIT 20 OFFSET 20")
def skill_listing(spark, d):
    return runtime.listing(fx.skills(spark, d), "ns3", False, 20, 1).select("id", "uid")


@query("result_summary", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error: ' || user_id WHEN 'click' THEN 'success' ELSE 'unknown' END AS summary FROM events")
def result_summary(spark, d):
    r = F.expr("""case event_type when 'error' then concat('{"status": "error", "type": "', user_id, '"}') when 'click' then '{"status": "success"}' else '{}' end""")
    return runtime.summaries(table(spark, d, "events").withColumn("result", r)).select("event_id", "summary")


@query("topology_response", "SELECT 's' || p_partkey AS source, 't' || p_size AS target, CASE WHEN p_partkey % 2 = 0 THEN 'REQUIRES' ELSE 'ENHANCES' END AS edge_type, 0.9::DOUBLE AS confidence FROM part WHERE p_partkey % 5 > 1")
def topology_response(spark, d):
    body = F.expr("""case when p_partkey % 5 = 0 then 'not json' else concat('{"topology_map": {"s', p_partkey, '": {"relations": [{"target_uid": "t', p_size, '", "edge_type": "', case when p_partkey % 2 = 0 then 'requires' else 'enhances' end,
        '", "confidence": ', case when p_partkey % 5 = 1 then '0.5' else '0.9' end, '}, {"target_uid": "x", "edge_type": "OTHER", "confidence": 1.0}]}}}') end""")
    return runtime.parse_topology(table(spark, d, "part").select(body.alias("response")))


@query("relation_prompt", f"{with_('skills')} SELECT category, count(*) AS n FROM skills GROUP BY 1")
def relation_prompt(spark, d):
    p = runtime.prompt(fx.skills(spark, d))
    return p.select("category", F.regexp_count("prompt", F.lit('"uid"')).cast("long").alias("n"))


@query("deadlock_pairs", f"{EXE}, bad AS (SELECT session_id, skill_id FROM executions WHERE NOT ok GROUP BY ALL HAVING count(*) >= 2) SELECT x.session_id, x.skill_id AS a, y.skill_id AS b FROM bad x JOIN bad y ON x.session_id = y.session_id AND x.skill_id < y.skill_id")
def deadlock_pairs(spark, d):
    return runtime.deadlocks(fx.executions(spark, d), 2)


@query("version_upgrade", f"{with_('edges')} SELECT CASE WHEN source % 10 = 0 THEN source + 1000000 ELSE source END AS source, CASE WHEN target % 10 = 0 THEN target + 1000000 ELSE target END AS target, edge_type, weight::DOUBLE AS weight FROM edges")
def version_upgrade(spark, d):
    renamed = fx.skills(spark, d).where("id % 10 = 0").selectExpr("id old", "id + 1000000 new")
    return runtime.upgrade(fx.edges(spark, d), renamed)


@query("file_events", f"{CHANGES} SELECT path, change AS kind FROM ch WHERE change <> 'unchanged'")
def file_events(spark, d):
    old, new = fx.snapshots(spark, d)
    return runtime.events_of(new, mutations.file_changes(old, new))


@query("hashed_embedding")
def hashed_embedding(spark, d):
    v = runtime.hashed_embedding(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return v.select("id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x), 6).alias("norm"))


@query("inferred_path_ids", "SELECT p_partkey AS id, 'ns' || (p_partkey % 5) || ':s' || p_partkey AS uid FROM part")
def inferred_path_ids(spark, d):
    return skill_texts(spark, d).select("id", tx.infer_uid("path").alias("uid"))


@query("session_last_calls", f"{EXE} SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS k FROM executions) WHERE k <= 10")
def session_last_calls(spark, d):
    return runtime.latest_first(fx.executions(spark, d), "session_id", ["ts", "event_id"], 10).select("session_id", "event_id")


@query("content_strings", f"{with_('skills')} SELECT id, CASE WHEN id % 4 = 0 THEN 'Skill: ' || uid ELSE description END AS content FROM skills")
def content_strings(spark, d):
    s = fx.skills(spark, d)
    return s.select("id", tx.content(F.expr("case when id % 4 = 0 then ' ' else description end"), "uid").alias("content"))


@query("dag_report_text", f"{CYC} SELECT 'invalid' || chr(10) || 'nodes: ' || (SELECT count(*) FROM embeddings) || chr(10) || 'edges: ' || (SELECT count(*) FROM ce) || chr(10) || 'cycles: ' || (SELECT count(DISTINCT component) FROM scc) || chr(10) || 'isolated: ' || (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT source FROM ce UNION SELECT target FROM ce)) AS report")
def dag_report_text(spark, d):
    return runtime.dag_text(graph.report(fx.cyclic(spark, d), fx.skills(spark, d)))


# Writes, caches and records ---------------------------------------------------


@query("node_update", f"{with_('skills')} SELECT id, (CASE WHEN id % 6 = 0 THEN 77 ELSE category END)::INT AS category, false AS unknown FROM skills UNION ALL SELECT 9000000 + id, NULL, true FROM skills WHERE id % 60 = 0")
def node_update(spark, d):
    s = fx.skills(spark, d).select("id", F.col("category").cast("int").alias("category"))
    ch = s.where("id % 6 = 0").selectExpr("id", "77 category").unionByName(s.where("id % 60 = 0").selectExpr("9000000 + id id", "1 category"))
    out, unknown = mutations.update(s, ch, "id")
    return out.withColumn("unknown", F.lit(False)).unionByName(unknown.selectExpr("id", "cast(null as int) category", "true unknown"))


@query("edge_delete", f"{with_('edges')} SELECT source, target, edge_type FROM edges WHERE NOT (edge_type = 'ENHANCES' AND source % 3 = 0)")
def edge_delete(spark, d):
    e = fx.edges(spark, d)
    return mutations.edge_delete(e, e.where("edge_type = 'ENHANCES' and source % 3 = 0")).select("source", "target", "edge_type")


@query("edge_dangling", f"{with_('edges')} SELECT source, target, edge_type, CASE WHEN source % 17 = 0 AND target % 17 = 0 THEN 'both' WHEN source % 17 = 0 THEN 'source' ELSE 'target' END AS lost FROM edges WHERE source % 17 = 0 OR target % 17 = 0")
def edge_dangling(spark, d):
    return mutations.dangling(fx.edges(spark, d), fx.skills(spark, d).where("not is_deprecated"))


@query("vector_write", "SELECT vec_id AS id, len(embedding) AS dim, round(CASE WHEN vec_id % 5 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) + 0 AS x FROM embeddings WHERE vec_id % 7 <> 0")
def vector_write(spark, d):
    v = fx.skills(spark, d).select("id", "vector")
    up = v.where("id % 5 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"))
    bad = v.where("id % 11 = 0").select("id", F.slice("vector", 1, 3).alias("vector"))
    out = mutations.vector_write(v, up.unionByName(bad), v.where("id % 7 = 0"), dim=64)
    return out.select("id", F.size("vector").cast("long").alias("dim"), (F.round(F.col("vector")[0].cast("double"), 6) + 0.0).alias("x"))


KV = """WITH log AS (SELECT user_id AS key, CASE WHEN event_id % 997 = 0 THEN 'flush' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'purchase' THEN 'expire' ELSE 'set' END AS op, event_id AS value, ts, event_id AS seq FROM events),
    sets AS (SELECT key, arg_max(value, (ts, seq)) AS value, max((ts, seq)) AS at, max(ts) AS ts FROM log WHERE op = 'set' GROUP BY 1), dels AS (SELECT key, max((ts, seq)) AS at FROM log WHERE op = 'delete' GROUP BY 1),
    exps AS (SELECT key, max((ts, seq)) AS at, max(ts) AS ts FROM log WHERE op = 'expire' GROUP BY 1), fl AS (SELECT max((ts, seq)) AS at FROM log WHERE op = 'flush'), now AS (SELECT max(ts) AS now FROM events),
    state AS (SELECT s.key, s.value, (CASE WHEN x.at > s.at THEN 1728000 - (epoch_us(now) // 1000000 - epoch_us(x.ts) // 1000000) ELSE 864000 - (epoch_us(now) // 1000000 - epoch_us(s.ts) // 1000000) END)::BIGINT AS ttl_seconds
        FROM sets s LEFT JOIN dels q ON q.key = s.key LEFT JOIN exps x ON x.key = s.key CROSS JOIN fl CROSS JOIN now WHERE NOT coalesce(q.at > s.at, false) AND NOT coalesce(fl.at > s.at, false)), live AS (SELECT * FROM state WHERE ttl_seconds > 0)"""


def _kv(spark, d):
    e = table(spark, d, "events")
    op = "case when event_id % 997 = 0 then 'flush' when event_type = 'error' then 'delete' when event_type = 'purchase' then 'expire' else 'set' end"
    log = e.selectExpr("user_id key", f"{op} op", "event_id value", "cast(ts as timestamp) ts", "event_id seq", f"case when {op} = 'expire' then 1728000L else 864000L end ttl_seconds")
    return mutations.kv_state(log, F.lit(e.agg(F.max("ts").cast("timestamp")).first()[0]))


@query("kv_state", f"{KV} SELECT key, value, ttl_seconds FROM live")
def kv_state(spark, d):
    return _kv(spark, d)


@query("kv_get", f"{KV} SELECT k.key, l.value, l.key IS NOT NULL AS found, l.ttl_seconds FROM (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0) k LEFT JOIN live l ON l.key = k.key")
def kv_get(spark, d):
    return mutations.kv_get(_kv(spark, d), table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey key"))


@query("result_cache", """SELECT doc_id, 'route:' || left(sha256(doc_id || ' ' || coalesce(text, '')), 16) || ':' || 4096 AS key, doc_id % 3 = 0 AS hit FROM documents""")
def result_cache(spark, d):
    docs = table(spark, d, "documents")
    asked = F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", runtime.cache_key("route", tx.query_hash(asked), F.lit(4096)).alias("key"))
    now = F.timestamp_seconds(F.lit(1000))
    entries = keyed.select("key", F.lit("x").alias("value"), F.timestamp_seconds(F.when(F.col("doc_id") % 3 == 0, 900).otherwise(100)).alias("ts"), F.col("doc_id").alias("seq"), F.lit(600).alias("ttl_seconds"))
    hits, misses = mutations.cached(keyed, entries, now)
    return hits.select("doc_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit")))


@query("json_records", "SELECT event_id, user_id, event_type, value FROM events")
def json_records(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return runtime.from_records(runtime.to_records(e, "event_id"), "event_id long, user_id long, event_type string, value double")


@query("skill_listing_by_tag", f"{with_('skills')} SELECT id, category FROM skills WHERE id % 4 = 1 ORDER BY category DESC, uid LIMIT 15 OFFSET 15")
def skill_listing_by_tag(spark, d):
    s = fx.skills(spark, d).withColumn("tags", F.expr("array(concat('t', id % 4), 'all')"))
    return runtime.listing(s, size=15, page=1, tag="t1", sort="category", descending=True).select("id", "category")


@query("mask_partial", r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\b[0-9]{12}([0-9]{4})\b', '************\1', 'g')) AS masked_md5 FROM documents")
def mask_partial(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.mask_personal("text", "partial", ["card"])).alias("masked_md5"))


# Routing rules and quality -----------------------------------------------------


@query("constraint_required", f"""{BASE}, {POOL}, ok AS (SELECT id FROM skills WHERE execution_success_rate >= 0.5 AND category <= 5 AND id NOT IN (1, 2, 3)), named AS (SELECT id FROM skills WHERE id IN (5, 40)),
    every AS (SELECT request_id, id, similarity, is_seed OR id IN (5, 40) AS is_seed FROM pool WHERE id IN (SELECT id FROM ok UNION SELECT id FROM named) UNION ALL SELECT DISTINCT p.request_id, n.id, 0.0, true FROM pool p, named n WHERE NOT EXISTS (SELECT 1 FROM pool q WHERE q.request_id = p.request_id AND q.id = n.id))
    SELECT request_id, id, round(similarity, 6)::DOUBLE AS similarity, is_seed FROM every""")
def constraint_required(spark, d):
    r, s, e = _inputs(spark, d)
    pool = retrieval.expand(retrieval.recall(r, s), e, s, r)
    return retrieval.constrain(pool, s, [1, 2, 3], required=[5, 40], categories=list(range(6))).select("request_id", "id", "similarity", "is_seed")


@query("score_multiplied", f"{BASE}, {SCORED} SELECT p.request_id, p.id, round((0.8 * p.similarity + 0.1 * p.reliability) * CASE s.category WHEN 3 THEN 0.5 WHEN 4 THEN 1.5 ELSE 1.0 END, 6) AS score FROM scored p JOIN skills s ON s.id = p.id")
def score_multiplied(spark, d):
    r, s, e = _inputs(spark, d)
    return routing.candidates(r, s, e, centrality=False, multipliers={3: 0.5, 4: 1.5})[1].select("request_id", "id", "score")


@query("route_quality", f"""{BASE}, {_mwis(True)}, per AS (SELECT s.request_id, count(*) FILTER (WHERE is_seed) AS ns, count(*) FILTER (WHERE is_seed AND m.id IS NOT NULL) AS ks, count(*) FILTER (WHERE edge_type = 'REQUIRES') AS nr, count(*) FILTER (WHERE edge_type = 'REQUIRES' AND m.id IS NOT NULL) AS kr
        FROM scored s LEFT JOIN mwis m ON m.request_id = s.request_id AND m.id = s.id GROUP BY 1), cl AS (SELECT c.request_id, count(*) AS t, count(*) FILTER (WHERE x.id IS NOT NULL AND y.id IS NOT NULL) AS l FROM clash c LEFT JOIN mwis x ON x.request_id = c.request_id AND x.id = c.a LEFT JOIN mwis y ON y.request_id = c.request_id AND y.id = c.b GROUP BY 1)
    SELECT p.request_id, round(CASE WHEN ns > 0 THEN ks / ns ELSE 0.0 END, 6) AS skill_coverage, round(CASE WHEN nr > 0 THEN kr / nr ELSE 1.0 END, 6) AS dependency_correctness, round(coalesce((t - l) / t, 1.0), 6) AS conflict_resolution FROM per p LEFT JOIN cl c ON c.request_id = p.request_id""")
def route_quality(spark, d):
    _, scored, _, e = _scored(spark, d)
    return routing.quality(scored, conflicts.independent_set(scored, e), e)


@query("hint_warnings", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'topology_hints.requires:list,topology_hints.likes:unknown' WHEN 1 THEN 'topology_hints:mapping' ELSE '' END AS warnings FROM part""")
def hint_warnings(spark, d):
    raw = """case p_partkey % 4 when 0 then concat('{"topology_hints": {"likes": [], "requires": "a:', p_partkey, '", "enhances": ["b:c"]}}') when 1 then concat('{"topology_hints": [', p_partkey, ']}') when 2 then '{"topology_hints": {"requires": ["a:b"]}}' else '{"skill_id": "a:b"}' end"""
    return validation.hint_warnings(table(spark, d, "part").selectExpr("p_partkey id", f"{raw} raw")).select("id", F.array_join("hint_warnings", ",").alias("warnings"))


@query("supported_languages", "SELECT p_partkey AS id, p_partkey % 9 <> 8 AS supported FROM part")
def supported_languages(spark, d):
    names = F.expr("element_at(array('py', 'SH', 'js', 'ts', 'GoLang', 'rs', 'c++', 'Python', 'Kotlin'), cast(p_partkey % 9 + 1 as int))")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), code_facts.supported(names).alias("supported"))


@query("redact_nested", """SELECT event_id, '{"props":' || replace(props, ': ', ':') || ',"user":{"api_key":"[FILTERED]","deep":{"bearer_token":"[FILTERED]","max_tokens":' || user_id || ',"list":[{"token":1}]}},"Secret":"[FILTERED]"}' AS shown FROM events""")
def redact_nested(spark, d):
    """Event properties inside mappings with secrets at several depths; lists stay as they are."""
    body = F.expr("""concat('{"props": ', props, ', "user": {"api_key": "k', user_id, '", "deep": {"bearer_token": [1, 2], "max_tokens": ', user_id, ', "list": [{"token": 1}]}}, "Secret": {"a": 1}}')""")
    return table(spark, d, "events").select("event_id", telemetry.redacted(body).alias("shown"))


@query("relation_prompt_text", f"{with_('skills')} SELECT category, sha256('Name the relations among these skills as JSON:' || chr(10) || '[' || string_agg('{{\"uid\":\"' || uid || '\",\"description\":\"' || description || '\"}}', ',' ORDER BY uid) || ']') AS prompt_sha256 FROM skills GROUP BY 1")
def relation_prompt_text(spark, d):
    return runtime.prompt(fx.skills(spark, d)).select("category", F.sha2("prompt", 256).alias("prompt_sha256"))


from loomgraph import stored_queries  # noqa: E402, F401  registers its own

__all__ = ["ORACLES", "QUERIES"]
