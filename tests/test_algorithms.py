"""Golden graphs, brute force, and agreement of the one-task kernels with the distributed loops."""

import heapq
import itertools
import math
import random

import pytest

import weftline as w

DIAMOND = [(0, 1), (0, 2), (1, 2), (2, 0)]
CLIQUES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7), (3, 4)]


def values(expr):
    return {r["id"]: r[next(k for k in r if k != "id")] for r in expr.to_dicts()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=tol), k


def random_graph(seed, n=14, m=40):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 5)) for _ in range(m)] + [(n, n, 1)]


# ---- brute force


def shortest(edges, weighted=False):
    nodes = sorted({x for a, b, *_ in edges for x in (a, b)})
    dist = {s: {s: 0.0} for s in nodes}
    for s in nodes:
        heap = [(0.0, s)]
        done = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            for a, b, x in edges:
                step = d + (x if weighted else 1)
                if a == v and step < dist[s].get(b, math.inf):
                    dist[s][b] = step
                    heapq.heappush(heap, (step, b))
    return dist


def brute_betweenness(edges, weighted=False):
    dist = shortest(edges, weighted)
    nodes = list(dist)

    def paths(s, t):
        """All shortest paths as node lists, parallel edges apart."""
        if s == t:
            return [[s]]
        found = []
        for a, b, x in edges:
            step = x if weighted else 1
            if a == s and b != s and t in dist[b] and abs(step + dist[b][t] - dist[s][t]) < 1e-12:
                found += [[s, *rest] for rest in paths(b, t)]
        return found

    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        if t in dist[s]:
            every = paths(s, t)
            for p in every:
                for v in p[1:-1]:
                    out[v] += 1 / len(every)
    return out


def brute_pagerank(edges, damping, rounds, weighted=False):
    nodes = sorted({x for a, b, *_ in edges for x in (a, b)})
    n = len(nodes)
    strength = dict.fromkeys(nodes, 0.0)
    for a, _, x in edges:
        strength[a] += x if weighted else 1
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        loose = sum(rank[v] for v in nodes if strength[v] <= 0)
        new = dict.fromkeys(nodes, (1 - damping) / n + damping * loose / n)
        for a, b, x in edges:
            if strength[a] > 0:
                new[b] += damping * rank[a] * (x if weighted else 1) / strength[a]
        rank = new
    return rank


def brute_components(edges, strong):
    dist = shortest(edges if strong else edges + [(b, a, x) for a, b, x in edges])
    return {v: min(u for u in dist if u in dist[v] and v in dist[u]) for v in dist}


def brute_triangles(edges):
    pairs = {frozenset((a, b)) for a, b, *_ in edges if a != b}
    nodes = sorted({x for a, b, *_ in edges for x in (a, b)})
    out = dict.fromkeys(nodes, 0)
    for t in itertools.combinations(nodes, 3):
        if all(frozenset(p) in pairs for p in itertools.combinations(t, 2)):
            for v in t:
                out[v] += 1
    return out


def check_all(edges):
    e = w.from_edgelist(edges)
    close(values(w.pagerank(e, max_iter=12, tol=0.0)), brute_pagerank(edges, 0.85, 12))
    close(values(w.pagerank(e, max_iter=12, tol=0.0, weight=w.col("weight"))), brute_pagerank(edges, 0.85, 12, True))
    assert values(w.connected_components(e)) == brute_components(edges, False)
    assert values(w.connected_components(e, mode="strong")) == brute_components(edges, True)
    assert values(w.triangle_count(e)) == brute_triangles(edges)
    for weighted in (False, True):
        dist = shortest(edges, weighted)
        near = {s: (len(d) - 1) / sum(d.values()) if sum(d.values()) else 0.0 for s, d in dist.items()}
        close(values(w.closeness(e, weight=w.col("weight") if weighted else None)), near)
    close(values(w.betweenness(e)), brute_betweenness(edges))
    dist = shortest(edges)
    lengths = [x for s, d in dist.items() for v, x in d.items() if v != s]
    assert w.avg_path_length(e) == pytest.approx(sum(lengths) / len(lengths))
    assert w.diameter(e, approximate=False) == max(lengths) == w.diameter(e)
    weighted = shortest(edges, True)
    for target in (1, 5, 9):
        for d, weight in ((dist, None), (weighted, w.col("weight"))):
            path = w.shortest_path(e, 0, target, weight=weight).to_dicts()
            if target in d.get(0, {}):
                assert path[-1]["cost"] == d[0][target] and path[0]["src"] == 0 and path[-1]["dst"] == target
                assert [p["hop"] for p in path] == list(range(len(path)))
                assert all(p["dst"] == q["src"] for p, q in zip(path, path[1:]))
            else:
                assert path == []


@pytest.mark.parametrize("seed", [1, 2])
def test_kernels_against_brute_force(spark, seed):
    check_all(random_graph(seed))
    close(values(w.betweenness(w.from_edgelist(random_graph(seed)), weight=w.col("weight"))), brute_betweenness(random_graph(seed), True))


def test_distributed_loops_against_brute_force(spark, distributed):
    edges = random_graph(3, n=9, m=18)
    check_all(edges)
    close(values(w.betweenness(w.from_edgelist(edges), weight=w.col("weight"))), brute_betweenness(edges, True))
    with pytest.raises(w.ComputeError):
        w.betweenness(w.from_edgelist([(0, 1, 0), (1, 0, 0)]), weight=w.col("weight")).collect()


def test_distributed_sources_in_blocks(spark, distributed, monkeypatch):
    from weftline.operators import distributed as loops

    monkeypatch.setattr(loops, "PAIRS_A_BLOCK", 0)
    monkeypatch.setattr(loops, "SOURCES_A_BLOCK", 4)
    edges = random_graph(3, n=6, m=12)
    close(values(w.betweenness(w.from_edgelist(edges))), brute_betweenness(edges))


def test_distributed_pagerank_with_hubs(spark, distributed, monkeypatch):
    from weftline.operators import distributed as loops

    edges = [(0, k, 1) for k in range(1, 60)] + [(k, 0, 2) for k in range(1, 60, 2)] + random_graph(6)
    for hubs in (1, 4, 1000):
        monkeypatch.setattr(loops, "HUBS_A_PARTITION", hubs)
        close(values(w.pagerank(w.from_edgelist(edges), max_iter=5, tol=0.0, weight=w.col("weight"))), brute_pagerank(edges, 0.85, 5, True))


def test_diamond(spark):
    e = w.from_edgelist(DIAMOND)
    assert values(w.degree(e)) == {0: 2, 1: 1, 2: 1}
    assert values(w.degree(e, "in")) == {0: 1, 1: 1, 2: 2}
    assert values(w.degree(e, "both")) == {0: 3, 1: 2, 2: 3}
    assert values(w.triangle_count(e)) == {0: 1, 1: 1, 2: 1}
    assert values(w.clustering_coefficient(e)) == {0: 1.0, 1: 1.0, 2: 1.0}
    assert sum(values(w.pagerank(e)).values()) == pytest.approx(1)
    named = w.from_edgelist([("abc"[a], "abc"[b]) for a, b in DIAMOND])
    assert values(w.degree(named, "in")) == {"a": 1, "b": 1, "c": 2}
    close(dict(zip("abc", values(w.pagerank(e)).values())), values(w.pagerank(named)))


def test_loops_and_parallel_edges(spark):
    e = w.from_edgelist([*DIAMOND, (0, 0), (0, 1)])
    assert values(w.triangle_count(e)) == {0: 1, 1: 1, 2: 1}
    assert values(w.degree(e, "both"))[0] == 6


def test_line_and_split(spark):
    line = w.from_edgelist([(0, 1), (1, 2), (2, 3), (3, 4)])
    assert values(w.betweenness(line)) == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    split = w.from_edgelist([(0, 1, 1), (0, 2, 5), (1, 3, 1), (2, 3, 5)])
    assert values(w.betweenness(split))[1] == 0.5
    assert values(w.betweenness(split, weight=w.col("weight"))) == {0: 0, 1: 1, 2: 0, 3: 0}


def test_triangle_lookups_agree():
    import numpy as np

    from weftline.operators import kernels as K

    keys = np.unique(np.random.default_rng(1).integers(0, 5000, 300))
    asked = np.arange(5000)
    want = np.isin(asked, keys)
    assert (K._lookup(keys, 5000)(asked) == want).all() and (K._lookup(keys, 1 << 31)(asked) == want).all()


def test_communities(spark):
    e = w.from_edgelist(CLIQUES)
    for found in (values(w.label_propagation(e, seed=7)), values(w.louvain(e, seed=1))):
        assert len({found[v] for v in range(4)}) == 1 and len({found[v] for v in range(4, 8)}) == 1
    louvain = values(w.louvain(e, seed=1))
    assert louvain[0] != louvain[7] and set(louvain.values()) == {0, 1}
    assert len(set(values(w.louvain(e, resolution=3.0)).values())) >= 2
    with pytest.raises(NotImplementedError):
        w.label_propagation(e, weight=w.col("weight"))


def test_louvain_finds_planted_blocks(spark):
    import numpy as np

    block = np.arange(300) // 50
    hit = np.random.default_rng(3).random((300, 300)) < np.where(block[:, None] == block[None, :], 0.2, 0.004)
    np.fill_diagonal(hit, False)
    s, d = np.nonzero(hit)
    found = values(w.louvain(w.EdgeFrame({"src": s, "dst": d}, src="src", dst="dst"), seed=2))
    assert len({(int(block[v]), c) for v, c in found.items()}) == 6 == len(set(found.values()))


def test_communities_distributed(spark, distributed):
    e = w.from_edgelist(CLIQUES)
    louvain = values(w.louvain(e, seed=1))
    assert len({louvain[v] for v in range(4)}) == 1 and louvain[0] != louvain[7]
    assert len(set(values(w.label_propagation(e, seed=7)).values())) <= 2


def test_louvain_beyond_the_bound_joins_nothing_in_half_sweeps(spark, monkeypatch):
    """Blocks of links, with the last levels in one task or without, find what one task and the loop of joins find."""
    from weftline.operators import distributed, node_values

    rows = [*random_graph(13, n=60, m=400), *((k, k, 2.0) for k in range(0, 60, 7)), (1, 2, 0.0)]
    e = lambda: w.from_edgelist([(f"é{a}", f"é{b}", x / 3) for a, b, x in rows])
    once = values(w.louvain(e(), weight=w.col("weight"), seed=4))
    monkeypatch.setattr(distributed, "BLOCK_LINKS", 200, raising=False)
    joins = node_values.louvain_rounds
    monkeypatch.setattr(node_values, "louvain_rounds", lambda *_: pytest.fail("a loop of joins"))
    try:
        for limit in ("0", "150"):  # at 150 the first level only is beyond the bound
            spark.conf.set("weftline.kernel.edges", limit)
            assert values(w.louvain(e(), weight=w.col("weight"), seed=4)) == once
        assert values(w.louvain(w.from_edgelist([(1, 2, 0.0), (3, 3, 0.0)]), weight=w.col("weight"))) == {1: 0, 2: 1, 3: 2}
        spark.conf.set("weftline.kernel.edges", "0")
        assert values(w.louvain(w.from_edgelist([(1, 2, 0.0), (3, 3, 0.0)]), weight=w.col("weight"))) == {1: 0, 2: 1, 3: 2}
        assert values(w.louvain(w.from_edgelist([(3, 3, 1.0), (5, 5, 1.0)]), weight=w.col("weight"))) == {3: 0, 5: 1}
        rows = random_graph(11)
        blocks = values(w.louvain(e(), weight=w.col("weight"), seed=4))
        monkeypatch.setattr(node_values, "louvain_rounds", joins)
        monkeypatch.setattr(distributed, "SHARED_NODES", 0)
        assert values(w.louvain(e(), weight=w.col("weight"), seed=4)) == blocks
    finally:
        spark.conf.unset("weftline.kernel.edges")


def test_betweenness_enters_a_level_by_the_fewer_edges(monkeypatch):
    """From the newest nodes, or from those not yet reached, source by source, with the sums of all sources at once."""
    import numpy as np

    from weftline.operators import kernels as K

    rng = np.random.default_rng(8)
    src, dst = (rng.integers(0, 400, 4000) ** 2 // 400 for _ in range(2))
    graph, followed = K.Csr(400, src, dst), []
    back, slots = graph.reversed(), K.Csr.out_slots
    monkeypatch.setattr(K.Csr, "out_slots", lambda g, nodes: followed.append((bool(np.array_equal(g.src, back.src)), len(found := slots(g, nodes)))) or found)
    one, together = np.zeros(400), np.zeros(400)
    for k in range(400):
        K.brandes(graph, np.array([k]), one)
    assert {way for way, _ in followed} == {False, True}
    assert sum(n for _, n in followed) < 0.7 * 400 * len(src)
    K.brandes(graph, np.arange(400), together)
    assert one == pytest.approx(together)


def test_betweenness_sample(spark):
    e = w.from_edgelist(random_graph(5))
    assert values(w.betweenness(e, sample=1.0)) == pytest.approx(values(w.betweenness(e)))
    assert values(w.betweenness(e, sample=0.3, seed=4)) == values(w.betweenness(e, sample=0.3, seed=4))


def test_weights(spark):
    e = w.from_edgelist([(0, 1, 1), (0, 2, 9), (1, 0, 1), (2, 0, 1)])
    plain, weighted = values(w.pagerank(e)), values(w.pagerank(e, weight=w.col("weight")))
    assert plain[1] == pytest.approx(plain[2]) and weighted[2] > weighted[1]
    with pytest.raises(w.ComputeError, match="non-negative"):
        w.pagerank(e, weight=w.col("weight") - 5).collect()
    with pytest.raises(w.ColumnNotFoundError):
        w.pagerank(e, weight=w.col("cost")).collect()
    named = w.EdgeFrame([{"src": 0, "dst": 1, "kind": "x", "v": None}, {"src": 1, "dst": 0, "kind": "y", "v": 1.0}], src="src", dst="dst")
    with pytest.raises(w.ComputeError, match="numeric"):
        w.closeness(named, weight=w.col("kind")).collect()
    with pytest.raises(w.ComputeError, match="null"):
        w.pagerank(named, weight=w.col("v")).collect()
    zero = w.from_edgelist([(0, 1, 0.0), (1, 0, 1.0)])
    assert sum(values(w.pagerank(zero, weight=w.col("weight"))).values()) == pytest.approx(1)


def test_distances_of_a_large_graph_keep_a_row_a_node(spark, distributed, monkeypatch):
    """Sources are bits of a node's row, not rows; several words, blocks and picked sources (F7, diameter_approx)."""
    from weftline.operators import distributed as D

    kept, write = [], D.checkpoint
    monkeypatch.setattr(D, "checkpoint", lambda df, *old: kept.append(write(df, *old)) or kept[-1])
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(260)] + [("n1", "n1"), ("n2", "n3"), ("n2", "n3"), ("y", "z")]
    dist = shortest([(a, b, 1) for a, b in edges])
    lengths = {s: [x for v, x in d.items() if v != s] for s, d in dist.items()}
    near = {s: len(x) / sum(x) if x else 0.0 for s, x in lengths.items()}
    for marks in (1024, 64):
        monkeypatch.setattr(D, "MARKS", marks)
        e = w.from_edgelist(edges)
        close(values(w.closeness(e)), near)
        assert w.diameter(e, approximate=False) == max(x for of in lengths.values() for x in of)
        names = sorted(dist)
        k = min(128, len(names))
        picked = [names[min(int(i * max(1.0, len(names) / k)), len(names) - 1)] for i in range(k)]
        assert w.diameter(e) == max(x for s in picked for x in lengths[s])
    assert kept and not any("s" in df.columns for df in kept)  # no rows of a source and a node


@pytest.mark.parametrize("names", [False, True])
def test_triangles_of_a_large_graph_shuffle_no_wedges(spark, distributed, monkeypatch, names):
    """Blocks and broadcasts of a few edges, hubs, parallel and opposite edges, nodes with loops only (F4 clustering, F8 triangles)."""
    from weftline.operators import distributed as D

    rng = random.Random(6)
    edges = [(rng.randrange(70), rng.randrange(70), 1) for _ in range(500)] + [(69, v, 1) for v in range(69)] + [(30, v, 1) for v in range(0, 60, 2)]
    edges += [(b, a, 1) for a, b, _ in edges[:40]] + edges[:40] + [(100, 100, 1), (200, 201, 1), (-5, 3, 1), (-5, 69, 1)]
    edges = [(f"n{a}", f"n{b}", x) for a, b, x in edges] if names else edges
    for name, n in (("BLOCK_EDGES", 100), ("NEAR_EDGES", 60), ("WEDGES", 50)):
        monkeypatch.setattr(D, name, n)
    e = w.from_edgelist(edges)
    triangles = brute_triangles(edges)
    found = w.triangle_count(e).to_spark()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() or names
    assert {r["id"]: r["triangle_count"] for r in found.collect()} == triangles
    k = {v: len({x for a, b, _ in edges if v in (a, b) for x in (a, b)} - {v}) for v in triangles}
    close(values(w.clustering_coefficient(e)), {v: 2 * n / (k[v] * (k[v] - 1)) if k[v] > 1 else 0.0 for v, n in triangles.items()})


def test_weighted_paths_are_found_without_sorts(monkeypatch):
    """Edges in order are not sorted again for each source, nor nodes that came nearer (F6, betweenness_w)."""
    import numpy as np

    from weftline.operators import kernels as K

    edges = sorted(set(random_graph(4)))
    src, dst, x = (np.array(c) for c in zip(*edges))
    graph, total = K.Csr(15, src, dst, x.astype(float)), np.zeros(15)

    def never(*args, **kwargs):
        raise AssertionError("sorted")

    monkeypatch.setattr(np, "lexsort", never)
    monkeypatch.setattr(np, "unique", never)
    for s in range(15):
        K.brandes_weighted(graph, np.array([s]), total)
    close(dict(enumerate(total)), brute_betweenness(edges, True))


def test_hop_of_a_small_graph_shuffles_no_pairs(spark):
    """Pairs of a seed and a node are made task by task; only seeds are shuffled (F2, hop_busy)."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(5, 5), (1, 2), (1, 2)]
    for edges, seeds in ((edges, [*range(0, 60, 3), 3, 99]), ([(f"n{a}", f"n{b}") for a, b in edges], ["n1", "n1", "n7", "x"])):
        e = w.from_edgelist(edges)
        for n in (1, 2, 5):
            for direction in ("out", "both"):
                found = w.hop(e, n, direction=direction).from_(seeds).to_spark()
                assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
                want = []
                steps = edges + [(b, a) for a, b in edges] if direction == "both" else edges
                for seed in seeds:
                    seen = {seed}
                    for _ in range(n):
                        seen |= {b for a, b in steps if a in seen}
                    want += [(seed, v) for v in seen - {seed} if any(seed in pair for pair in edges)]
                assert sorted(map(tuple, found.collect())) == sorted(want)


def test_hop(spark):
    e = w.from_edgelist([(0, 1), (1, 2), (2, 3), (1, 4)])
    reach = lambda h: sorted((r["src"], r["dst"]) for r in h.to_dicts())
    assert reach(w.hop(e, 2).from_([0])) == [(0, 1), (0, 2), (0, 4)]
    assert reach(w.hop(e, 10).from_([0])) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert reach(w.hop(e, 2, direction="in").from_([3])) == [(3, 1), (3, 2)]
    assert reach(w.hop(e, 1, direction="both").from_([1])) == [(1, 0), (1, 2), (1, 4)]
    assert reach(w.hop(e, 1).from_([0, 0, 99])) == [(0, 1), (0, 1)]
    assert reach(w.hop(e, 0).from_([0])) == [] == reach(w.hop(e, 1).from_(["x"]))
    assert reach(w.hop(e, 2).from_([0]).filter(w.dst() > 1).sort("dst").head(1)) == [(0, 2)]
    with pytest.raises(NotImplementedError):
        w.hop(e, 1).collect()
    with pytest.raises(NotImplementedError):
        w.hop(e, 1).from_([0]).group_by("src").agg(w.col("dst").count()).collect()
    with pytest.raises(TypeError):
        w.hop(e, 1).from_([0, "a"]).collect()


def test_shortest_path(spark):
    line = w.from_edgelist([(0, 1), (1, 2), (2, 3)])
    rows = [tuple(r.values()) for r in w.shortest_path(line, 0, 3).to_dicts()]
    assert rows == [(0, 1, 0, 1.0), (1, 2, 1, 2.0), (2, 3, 2, 3.0)]
    assert [(r["src"], r["dst"]) for r in w.shortest_path(line, 3, 0, direction="in").to_dicts()] == [(3, 2), (2, 1), (1, 0)]
    for a, b in ((3, 0), (0, 9), (0, 0), ("0", 3)):
        assert w.shortest_path(line, a, b).to_arrow().column_names == ["src", "dst", "hop", "cost"]
        assert len(w.shortest_path(line, a, b).collect()) == 0
    detour = w.from_edgelist([(0, 1, 1), (1, 3, 1), (0, 3, 5)])
    assert [r["dst"] for r in w.shortest_path(detour, 0, 3).to_dicts()] == [3]
    assert [r["cost"] for r in w.shortest_path(detour, 0, 3, weight=w.col("weight")).to_dicts()] == [1, 2]


def walk_lists(frame):
    out = {}
    for r in frame.sort("step").to_dicts():
        out.setdefault(r["walk_id"], []).append(r["node"])
    return out


@pytest.mark.parametrize("limit", [None, "0"])
def test_random_walk(spark, limit):
    if limit:
        spark.conf.set("weftline.kernel.edges", limit)
    try:
        line = w.from_edgelist([(0, 1), (1, 2), (2, 3)])
        assert walk_lists(w.random_walk(line, [0], 3)) == {0: [0, 1, 2, 3]}
        assert walk_lists(w.random_walk(line, [2], 5)) == {0: [2, 3]}
        assert walk_lists(w.random_walk(line, [77, 1], 0, walks_per_node=2)) == {0: [1], 1: [1]}
        dense = w.from_edgelist([(a, b) for a in range(6) for b in range(6)] + [(0, 5)] * 30)
        first = walk_lists(w.random_walk(dense, [0, 1], 8, walks_per_node=40, seed=3))
        assert first == walk_lists(w.random_walk(dense, [0, 1], 8, walks_per_node=40, seed=3))
        assert first != walk_lists(w.random_walk(dense, [0, 1], 8, walks_per_node=40, seed=4))
        assert len(first) == 80 and all(len(x) == 9 for x in first.values())
        onward = [b for x in first.values() for a, b in zip(x, x[1:]) if a == 0]
        assert onward.count(5) > len(onward) / 2  # parallel edges weigh more
    finally:
        spark.conf.unset("weftline.kernel.edges")


def test_statistics(spark):
    triangle = w.from_edgelist([(0, 1), (1, 2), (2, 0)])
    assert w.density(triangle) == 0.5 and w.avg_path_length(triangle) == 1.5 and w.diameter(triangle) == 2
    assert w.describe(triangle).to_dicts() == [{"n_nodes": 3, "n_edges": 3, "density": 0.5, "avg_degree": 1.0, "n_components": None}]
    pairs = w.from_edgelist([(0, 1), (2, 3)])
    assert w.describe(pairs, full=True).to_dicts()[0]["n_components"] == 2
    assert w.avg_path_length(pairs, sample=0.5) == 1.0 == w.diameter(pairs)
    with pytest.raises(NotImplementedError):
        w.describe(pairs).head(1).collect()


def test_neighbours(spark):
    e = w.from_edgelist([(1, 0), (2, 0), (3, 0)])
    table = [{"id": k, "capacity": c, "region": r} for k, c, r in ((0, 0, "x"), (1, 10, "us"), (2, 20, "us"), (3, None, "eu"), (9, 5, "eu"))]
    nodes = w.NodeFrame(table, id="id")
    c = w.col("capacity")

    def fold(agg, direction="in"):
        return {r["id"]: r["v"] for r in nodes.with_columns(v=w.neighbors(e, direction).agg(agg)).to_dicts()}

    assert fold(c.mean()) == {0: 15.0, 1: None, 2: None, 3: None, 9: None}
    assert fold(c.sum()) == {0: 30.0, 1: 0.0, 2: 0.0, 3: 0.0, 9: None}
    assert fold(c.count())[0] == 2.0 and fold(c.min())[0] == 10.0 and fold(c.max())[0] == 20.0
    assert fold(w.col("region").n_unique()) == {0: 2.0, 1: 0.0, 2: 0.0, 3: 0.0, 9: None}
    assert fold(c.sum(), "both")[1] == 0.0 and fold(c.sum(), "out")[1] == 0.0
    with pytest.raises(w.ComputeError):
        fold(w.col("region").mean())
    with pytest.raises(w.ColumnNotFoundError):
        fold(w.col("nothing").mean())
    odd = w.NodeFrame({"id": [0, 1, 2, 3, 4], "x": [0.0, 0.0, -0.0, float("nan"), float("nan")]}, id="id")
    star = w.from_edgelist([(k, 0) for k in range(1, 5)])
    assert odd.with_columns(v=w.neighbors(star, "in").agg(w.col("x").n_unique())).sort("id").head(1).to_dicts()[0]["v"] == 2.0
    assert odd.with_columns(v=w.neighbors(star, "in").agg(w.col("x").max())).sort("id").head(1).to_dicts()[0]["v"] == 0.0


def test_layout_changes_nothing(spark):
    rows = [{"src": a, "dst": b, "weight": x} for a, b, x in random_graph(8, n=30, m=120)]
    df = w.EdgeFrame(rows, src="src", dst="dst").to_spark()
    results = []
    for parts in (1, 7):
        e = w.from_spark(df.repartition(parts), src="src", dst="dst")
        results.append((values(w.pagerank(e, weight=w.col("weight"))), values(w.connected_components(e)), values(w.label_propagation(e)), e.sample(10, seed=2).to_spark().orderBy("src", "dst", "weight").collect()))
    close(results[0][0], results[1][0])
    assert results[0][1:] == results[1][1:]


def on_both_sides(spark, compute):
    found = []
    for limit in ("4000000", "0"):
        spark.conf.set("weftline.kernel.edges", limit)
        try:
            found.append(compute())
        finally:
            spark.conf.unset("weftline.kernel.edges")
    return found


@pytest.mark.parametrize("named", [False, True])
def test_one_result_on_both_sides_of_the_size_bound(spark, named):
    """Whatever is drawn or tied comes out alike in one task and by joins, and in any layout of the rows."""
    rows = random_graph(11, n=24, m=90)
    name = (lambda k: f"é{k}") if named else (lambda k: k - 5)
    table = [{"src": name(a), "dst": name(b), "weight": x / 3} for a, b, x in rows]
    df = w.EdgeFrame(table, src="src", dst="dst").to_spark()
    start = spark.createDataFrame([(name(k),) for k in (7, 3, 3, 11)], f"id {'string' if named else 'bigint'}")

    def all_of_it(parts):
        e = w.from_spark(df.repartition(parts), src="src", dst="dst")
        seeds = w.NodeFrame(start.repartition(parts), id="id")
        weight = w.col("weight")
        walks = sorted(tuple(r.values()) for r in w.random_walk(e, seeds, 6, walks_per_node=3, seed=5).to_dicts())
        return (
            values(w.label_propagation(e, seed=2)), values(w.louvain(e, weight=weight if named else None, resolution=1.3, seed=4)), walks,
            [tuple(r.values()) for r in w.shortest_path(e, name(0), name(9)).to_dicts()],
        )

    found = on_both_sides(spark, lambda: all_of_it(3))
    assert found[0] == found[1]
    assert found[0] == all_of_it(1) == all_of_it(7)
    assert min(found[0][1].values()) == 0 and len(set(found[0][1].values())) == max(found[0][1].values()) + 1
    assert len(found[0][2]) > 12


def test_draws_are_the_same_in_arrays_and_columns(spark):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from weftline.operators.draws import draw, draw_column, id_number_column, id_numbers

    numbers = [0, 1, -1, 2**62, -(2**63), 2**63 - 1, 12345678901234]
    for seed, step in ((0, 0), (5, 3), (-7, 2**40), (0x5EED5EED5EED5EED, 9)):
        df = spark.createDataFrame([(x,) for x in numbers], "x bigint")
        got = [r[0] for r in df.select(draw_column(seed, F.col("x"), step)).collect()]
        assert got == draw(seed, np.array(numbers), step).tolist() and all(0 <= x < 2**62 for x in got)
    names = ["", "a", "é", "x" * 100, "Ω b"]
    got = spark.createDataFrame([(x,) for x in names], "x string").select(id_number_column("x", "string")).collect()
    assert [r[0] for r in got] == id_numbers(pa.array(names)).tolist()
    many = draw(3, np.arange(20000), 1)
    assert abs((many & 1).mean() - 0.5) < 0.02 and abs((many % 7 == 3).mean() - 1 / 7) < 0.02 and abs(((many >> 61) & 1).mean() - 0.5) < 0.02


def test_weights_of_zero(spark):
    """They count on cheapest paths, in one task and by joins; in circles they are an error."""
    edges = [(0, 2, 0.0), (0, 1, 0.0), (1, 2, 0.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 0.0)]
    for found in on_both_sides(spark, lambda: values(w.betweenness(w.from_edgelist(edges), weight=w.col("weight")))):
        close(found, brute_betweenness(edges, True))
    circle = [(0, 1, 0.0), (1, 0, 0.0), (1, 2, 1.0)]
    for limit in ("4000000", "0"):
        spark.conf.set("weftline.kernel.edges", limit)
        try:
            with pytest.raises(Exception, match="circles"):
                w.betweenness(w.from_edgelist(circle), weight=w.col("weight")).collect().to_arrow()
        finally:
            spark.conf.unset("weftline.kernel.edges")


def test_long_names_count_for_the_size_bound(spark):
    e = w.from_edgelist([("x" * 1000, "y" * 1000)] * 50)
    assert e.topology().small
    spark.conf.set("weftline.kernel.bytes", "50000")
    try:
        assert not w.from_edgelist([("x" * 1000, "y" * 1000)] * 50).topology().small
    finally:
        spark.conf.unset("weftline.kernel.bytes")


def test_betweenness_of_many_sources_together():
    import numpy as np

    from weftline.operators import kernels as K

    for seed, n, m in ((1, 40, 90), (2, 40, 500), (3, 200, 150)):
        rng = np.random.default_rng(seed)
        s, d = rng.integers(0, n, m), rng.integers(0, n, m)
        x = rng.integers(1, 4, m).astype(float)
        g = K.Csr(n, s, d, x)
        want, weighted = brute_betweenness([(int(a), int(b), 1) for a, b in zip(s, d)] if m < 200 else [], False), None
        totals = []
        for size in (1, 8, 64):
            plain, heavy = np.zeros(n), np.zeros(n)
            for k in range(0, n, size):
                K.brandes(g, np.arange(k, min(n, k + size)), plain)
                K.brandes_weighted(g, np.arange(k, min(n, k + size)), heavy)
            totals.append((plain, heavy))
            assert np.allclose(plain, totals[0][0]) and np.allclose(heavy, totals[0][1])
        for v, b in want.items():
            assert totals[0][0][v] == pytest.approx(b)


def test_no_edges(spark):
    e = w.EdgeFrame({"src": [], "dst": []}, src="src", dst="dst")
    for expr in (w.pagerank(e), w.connected_components(e), w.connected_components(e, mode="strong"), w.triangle_count(e), w.closeness(e), w.betweenness(e), w.louvain(e), w.degree(e), w.label_propagation(e)):
        assert expr.to_dicts() == []
    assert w.density(e) == 0.0 and w.avg_path_length(e) == 0.0 and w.diameter(e) == 0
    assert w.hop(e, 2).from_([1]).to_dicts() == [] == w.shortest_path(e, 0, 1).to_dicts()
