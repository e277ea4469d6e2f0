"""The whole route against a plain one, request by request: centrality, pruning, capping, order, packing and text."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import fixtures as fx
from loomgraph.operators import assembly, conflicts, scoring
from loomgraph.plans import route as routing
from loomgraph.queries import QUERIES


def clamp(x):
    return max(0.0, min(1.0, x))


class Plain:
    def __init__(self, d):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
        self.skills = {r[0]: dict(zip(("id", "uid", "category", "vector", "deprecated", "rate", "description"), r)) for r in con.execute(f"{fx.with_('skills')} FROM skills").fetchall()}
        self.edges = con.execute(f"{fx.with_('edges')} FROM edges").fetchall()
        self.requests = dict(con.execute(f"{fx.with_('requests')} FROM requests").fetchall())
        self.ids = sorted(self.skills)
        v = np.array([self.skills[i]["vector"] for i in self.ids], dtype=np.float64)
        self.unit = v / np.linalg.norm(v, axis=1, keepdims=True)

    def inner(self, ids, *types):
        return [(s, t, k, w) for s, t, k, w in self.edges if k in types and s in ids and t in ids]

    def pool(self, request):
        q = np.array(self.requests[request], dtype=np.float64)
        sim = dict(zip(self.ids, np.round(self.unit @ (q / np.linalg.norm(q)), 6)))
        near = [i for i in sorted(sim, key=lambda i: (-sim[i], i))[:10] if not self.skills[i]["deprecated"]]
        seeds = ([i for i in near if clamp(sim[i]) >= 0.3] or near)[:5]
        pool = {i: {"similarity": clamp(sim[i]), "seed": True, "type": None} for i in seeds}
        for i in seeds:
            hops = sorted({(t, k) for s, t, k, _ in self.edges if s == i and k in ("REQUIRES", "ENHANCES")}, key=lambda x: (x[1] != "REQUIRES", x[0]))
            for t, k in hops:
                if t not in pool and not self.skills[t]["deprecated"]:
                    pool[t] = {"similarity": clamp(sim[t]), "seed": False, "type": k}
        return seeds, {i: x for i, x in pool.items() if self.skills[i]["rate"] >= 0.5}, {i: clamp(sim[i]) for i in seeds}

    def pagerank(self, pool):
        links, ids = self.inner(pool, "REQUIRES"), sorted(pool)
        rank = dict.fromkeys(ids, 1 / len(ids)) if ids else {}
        if not links:
            return rank
        total = {i: sum(w for s, _, _, w in links if s == i) for i in ids}
        for _ in range(100):
            loose = sum(rank[i] for i in ids if not total[i])
            new = {i: 0.85 * (sum(rank[s] * w / total[s] for s, t, _, w in links if t == i) + loose / len(ids)) + 0.15 / len(ids) for i in ids}
            done = sum(abs(new[i] - rank[i]) for i in ids) < len(ids) * 1e-6
            rank = new
            if done:
                break
        return {i: r / max(rank.values()) for i, r in rank.items()}

    def scored(self, pool):
        rank = self.pagerank(pool)
        for i, x in pool.items():
            x["score"] = round(0.8 * x["similarity"] + 0.1 * clamp(rank[i]) + 0.1 * self.skills[i]["rate"], 6)
        return pool

    def kept(self, pool):
        clash = {frozenset((s, t)) for s, t, _, _ in self.inner(pool, "CONFLICTS_WITH", "SUBSTITUTES") if s != t}
        kept, safe = [], set()
        for i in sorted(pool, key=lambda i: (-pool[i]["score"], i)):
            foes = {j for j in pool if frozenset((i, j)) in clash}
            if not foes & set(kept):
                kept.append(i)
                safe |= {i} if pool[i]["seed"] else set()
            elif pool[i]["seed"] and not foes & safe:
                kept = [j for j in kept if j not in foes] + [i]
                safe.add(i)
        return kept

    def cap(self, pool, kept):
        order = sorted(kept, key=lambda i: (-pool[i]["score"], i))
        top, rest = order[:5], order[5:]
        for s in (i for i in rest if pool[i]["seed"]):
            weaker = [i for i in top if not pool[i]["seed"] and pool[i]["similarity"] < pool[s]["similarity"]]
            if weaker:
                top[top.index(min(weaker, key=lambda i: (pool[i]["similarity"], i)))] = s
        return top

    def order(self, ids):
        need = {i: {t for s, t, _, _ in self.inner(ids, "REQUIRES") if s == i} for i in ids}
        level = lambda i: max((level(t) + 1 for t in need[i]), default=0)
        return {i: k for k, i in enumerate(sorted(ids, key=lambda i: (level(i), i)))}, need

    def assembled(self, ids, info, room):
        topo, _ = self.order(ids)
        worth = lambda i: 250 * info[i]["seed"] + 100 * (info[i]["type"] == "REQUIRES") + 10 * info[i]["score"] - 20 * (info[i]["type"] == "ENHANCES" and not info[i]["seed"])
        chosen, used = [], 0
        for i in sorted(ids, key=lambda i: (-worth(i), topo[i], i)):
            tokens = math.floor(len(self.skills[i]["description"].split()) * 1.3)
            if used + tokens <= room:
                chosen.append(i)
                used += tokens
        chosen.sort(key=lambda i: (not info[i]["seed"], topo[i]))
        lines = [f"• {self.skills[i]['uid']}: {self.skills[i]['description'][:80]}" for i in chosen]
        return chosen, used, "\n".join(["Relevant knowledge:", *lines]) if chosen else ""

    def route(self, request, room=4096 - 500):
        seeds, pool, similarity = self.pool(request)
        pool = self.scored(pool)
        kept = self.kept(pool)
        better = any(not pool[i]["seed"] for i in kept)
        if better:
            info = {i: dict(pool[i]) for i in self.cap(pool, kept)}
        else:
            info = {i: {"seed": True, "type": None, "score": similarity[i], "similarity": similarity[i]} for i in seeds}
        ids, used, text = self.assembled(list(info), info, room)
        left = {frozenset((s, t)) for s, t, _, _ in self.inner(info, "CONFLICTS_WITH", "SUBSTITUTES") if s != t}
        mean = sum(x["score"] for x in info.values()) / len(info) if info else 0
        return ("enhanced" if better else "baseline", len(info), round(min(1, mean), 6), round(sum(x["seed"] for x in info.values()) / len(seeds), 6), len(left), ids, used, text)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_route_full(spark, sf):
    d = f"/root/testdata/sf{sf}"
    plain = Plain(d)
    got = {r.request_id: r for r in QUERIES["route_full"](spark, d).collect()}
    assert set(got) == set(plain.requests)
    modes = set()
    for i, r in got.items():
        mode, n, confidence, coverage, clash, ids, used, text = plain.route(i)
        modes.add(mode)
        assert (r["mode"], r.n_selected, r.seed_coverage, r.n_conflicts, r.ids, r.used, r.assembled_text) == (mode, n, coverage, clash, ",".join(map(str, ids)), used, text), i
        assert r.confidence == pytest.approx(confidence, abs=2e-6)
        seeds_first = [plain.skills[x] and x in plain.pool(i)[0] for x in ids]
        assert seeds_first == sorted(seeds_first, reverse=True)
    assert "enhanced" in modes


def test_pagerank_and_assembled_text(spark):
    d = "/root/testdata/sf0.001"
    plain = Plain(d)
    ranks = {(r.request_id, r.id): r.pagerank for r in QUERIES["pagerank_local"](spark, d).collect()}
    want = {(q, i): x for q in plain.requests for i, x in plain.pagerank(plain.pool(q)[1]).items()}
    assert set(ranks) == set(want) and all(abs(ranks[k] - want[k]) <= 2e-6 for k in want) and len(set(want.values())) > 20


@pytest.mark.parametrize("budget", [4096, 535, 520, 505, 100])
def test_budgets(spark, budget):
    d = "/root/testdata/sf0.001"
    plain = Plain(d)
    r, s, e = fx.requests(spark, d), fx.skills(spark, d), fx.edges(spark, d)
    _, scored = routing.candidates(r, s, e)
    got = {x.request_id: (x.ids, x.used, x.assembled_text) for x in assembly.assemble(conflicts.independent_set(scored, e), scored, s, e, budget=budget).collect()}
    for q in plain.requests:
        pool = plain.scored(plain.pool(q)[1])
        if pool:
            ids, used, text = plain.assembled(plain.kept(pool), pool, max(0, budget - 500))
            assert got[q] == (ids, used, text)


def test_scores_of_a_whole_pool(spark):
    d = "/root/testdata/sf0.001"
    plain = Plain(d)
    _, scored = routing.candidates(fx.requests(spark, d), fx.skills(spark, d), fx.edges(spark, d))
    got = {(r.request_id, r.id): r.score for r in scored.collect()}
    want = {(q, i): x["score"] for q in plain.requests for i, x in plain.scored(plain.pool(q)[1]).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert scoring.enhancement(scored.where(F.lit(False))).collect() == []
