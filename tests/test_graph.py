import random
from itertools import product

import pytest

from proofweave.operators import communities, graph

SCHEMA = "edge_id string, subject_id string, object_id string, predicate string, segment_from date, segment_to date"


def network(spark, n=14, m=40, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(m):
        a, b = rnd.sample(range(n), 2)
        rows.append((f"e{i:03d}", f"n{a:02d}", f"n{b:02d}", rnd.choice(["allied_with", "member_of"]), None, None))
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_expand(rows, seeds, hops, budget):
    reached, taken, full, frontier = set(seeds), {}, False, set(seeds)
    for _ in range(hops):
        if full:
            break
        found = sorted((r for r in rows if (r[1] in frontier or r[2] in frontier) and r[0] not in taken), key=lambda r: (r[1], r[2], r[3], r[0]))
        nxt = set()
        for r in found:
            fresh = {r[1], r[2]} - reached
            if len(taken) + len(reached) + len(fresh) + 1 > budget:
                full = True
                break
            taken[r[0]] = r
            reached |= fresh
            nxt |= fresh
        frontier = nxt
    return set(taken), full


@pytest.mark.parametrize("hops,budget", [(1, 2000), (3, 2000), (3, 12), (2, 7), (3, 1)])
def test_expand_many_seed_sets(spark, hops, budget):
    df, rows = network(spark)
    sets = {1: ["n00"], 2: ["n03", "n07"], 3: ["nobody"]}
    seeds = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "set_id int, entity_id string")
    found, state = graph.expand(df, seeds, hops, budget)
    got, cut = {}, {r["set_id"]: r["truncated"] for r in state.collect()}
    for r in found.collect():
        got.setdefault(r["set_id"], set()).add(r["edge_id"])
    for k, vs in sets.items():
        want, full = brute_expand(rows, vs, hops, budget)
        assert got.get(k, set()) == want and cut[k] == full


@pytest.mark.parametrize("budget", [3, 9, 25, 2000])
def test_overview_skips_what_does_not_fit(spark, budget):
    df, rows = network(spark, seed=4)
    nodes, kept = set(), set()
    first = sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0]))[: budget + 1]
    for r in first:
        fresh = {r[1], r[2]} - nodes
        if len(kept) + len(nodes) + len(fresh) + 1 <= budget:
            kept.add(r[0])
            nodes |= fresh
    assert {r["edge_id"] for r in graph.overview(df, budget).collect()} == kept


def brute_paths(rows, source, target, max_hops, max_paths):
    """Level by level from the source, then a stack walk back that sees larger (edge, previous) first."""
    if source == target:
        return [([source], [])]
    depth, parents, frontier = {source: 0}, {}, [source]
    for hop in range(1, max_hops + 1):
        nxt = set()
        for r in rows:
            for near, far in ((r[1], r[2]), (r[2], r[1])):
                if near in frontier and depth[near] == hop - 1 and depth.get(far, hop) == hop:
                    depth[far] = hop
                    nxt.add(far)
                    parents.setdefault(far, []).append((r[0], near))
        frontier = nxt
        if target in depth:
            break
    out, stack = [], [(target, [target], [])] if target in depth else []
    while stack and len(out) < max_paths:
        node, nodes, edges = stack.pop()
        if node == source:
            out.append((nodes[::-1], edges[::-1]))
            continue
        for e, prev in sorted(parents.get(node, [])):
            stack.append((prev, nodes + [prev], edges + [e]))
    return out


@pytest.mark.parametrize("seed,m,max_hops,max_paths", [(1, 40, 5, 25), (2, 22, 5, 25), (3, 60, 5, 2), (4, 20, 3, 25)])
def test_shortest_paths_of_many_pairs(spark, seed, m, max_hops, max_paths):
    df, rows = network(spark, m=m, seed=seed)
    pairs = [(i * 14 + j, f"n{i:02d}", f"n{j:02d}") for i, j in product((0, 1, 5), range(14))]
    got = {}
    for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "pair_id int, source string, target string"), max_hops, max_paths).collect():
        got.setdefault(r["pair_id"], []).append((list(r["nodes"]), list(r["edge_ids"]), r["truncated"]))
    for pid, a, b in pairs:
        want = brute_paths(rows, a, b, max_hops, max_paths)
        assert sorted((n, e) for n, e, _ in got.get(pid, [])) == sorted(want), (a, b)
        assert all(t == (len(want) >= max_paths) for *_, t in got.get(pid, []))


def test_weighted_trails(spark):
    rnd = random.Random(9)
    rows = [(f"e{i}", *(f"n{x}" for x in rnd.sample(range(6), 2)), "L", rnd.choice([1.0, 0.7, 0.4])) for i in range(9)]

    def trails(at, target, used, product, nodes):
        for e, a, b, _, w in rows:
            if e in used or at not in (a, b):
                continue
            far = b if at == a else a
            if far == target:
                yield (used + [e], round(round(product * w, 9), 3), nodes + [far])
            if len(used) < 3:
                yield from trails(far, target, used + [e], product * w, nodes + [far])

    want = sorted(trails("n0", "n1", [], 1.0, ["n0"]), key=lambda t: (-t[1], len(t[0]), t[0]))[:10]
    df = spark.createDataFrame(rows, "edge_id string, source string, target string, layer string, weight double")
    got = graph.weighted_paths(df, spark.createDataFrame([(1, "n0", "n1")], "pair_id int, source string, target string")).orderBy("rank").collect()
    assert [(list(r["edge_ids"]), r["path_confidence"], list(r["nodes"])) for r in got] == want


def test_communities_are_connected_and_no_worse_than_label_propagation(spark):
    rnd = random.Random(8)
    group = {k: k // 12 for k in range(60)}
    rows = [(f"n{a:02d}", f"n{b:02d}", "X", 1.0) for a in range(60) for b in range(a) if rnd.random() < (0.5 if group[a] == group[b] else 0.03)]
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(60)], "node_id string")
    edges = spark.createDataFrame(rows, "source string, target string, layer string, weight double")
    got = {r["node_id"]: r["cluster_id"] for r in communities.detect_communities(nodes, edges).collect()}
    near = {}
    for a, b, _, _ in rows:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def modularity(at):
        spread = {}
        for n in near:
            spread[at[n]] = spread.get(at[n], 0) + len(near[n])
        return sum(at[a] == at[b] for a, b, _, _ in rows) / len(rows) - sum((k / (2 * len(rows))) ** 2 for k in spread.values())

    label = {n: n for n in near}
    for _ in range(20):
        for n in sorted(near):
            counts = {}
            for m in near[n]:
                counts[label[m]] = counts.get(label[m], 0) + 1
            label[n] = max(sorted(counts), key=counts.get)
    assert len(got) == 60 and modularity(got) >= modularity(label) - 1e-9 and modularity(got) > 0.4
    for c in set(got.values()):
        members = {n for n in got if got[n] == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for m in near.get(n, []) if m in members]
        assert seen == members


def test_communities_of_two_cliques(spark):
    rows = []
    for group in ("a", "b"):
        rows += [(f"{group}{i}", f"{group}{j}", layer, 1.0) for i in range(5) for j in range(i) for layer in ("X", "Y")]
    rows.append(("a0", "b0", "X", 0.2))
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(5)] + [("alone",)], "node_id string")
    edges = spark.createDataFrame(rows, "source string, target string, layer string, weight double")
    got = {r["node_id"]: r["cluster_id"] for r in communities.detect_communities(nodes, edges).collect()}
    assert len(got) == 11 and len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1
    assert got["a0"] != got["b0"] and got["alone"] == 2
    again = {r["node_id"]: r["cluster_id"] for r in communities.detect_communities(nodes.repartition(3), edges.repartition(5)).collect()}
    assert again == got
    cells = {r["cluster_id"]: r for r in communities.cell_summary(spark.createDataFrame(list(got.items()), "node_id string, cluster_id int"), edges).collect()}
    assert cells[got["a0"]]["internal_edges"] == 20 and not cells[got["a0"]]["isolated"] and cells[2]["isolated"]


def test_window_and_unknown_category(spark):
    df, rows = network(spark)
    assert graph.edges_in_window(df, "2020-01-01", "2020-02-01").count() == len(rows)  # open bounds always overlap
    assert graph.edges_in_window(df, categories=["nothing_like_it"]).count() == 0


def plain_trails(rows, source, target, max_hops, top):
    def trails(at, used, product, nodes):
        for e, a, b, _, w in rows:
            if e in used or at not in (a, b):
                continue
            far = b if at == a else a
            if far == target:
                yield (used + [e], round(round(product * w, 9), 3), nodes + [far])
            if len(used) + 1 < max_hops:
                yield from trails(far, used + [e], product * w, nodes + [far])

    return sorted(trails(source, [], 1.0, [source]), key=lambda t: (-t[1], len(t[0]), t[0]))[:top]


@pytest.mark.parametrize("max_hops,top,seed", [(1, 3, 1), (2, 2, 2), (3, 4, 3), (4, 10, 4), (4, 2, 5), (5, 3, 6)])
def test_weighted_trails_around_hubs(spark, max_hops, top, seed):
    """Two hubs, parallel edges, all layers, weights that tie after rounding; some pairs have no trail."""
    rnd = random.Random(seed)
    ends = [("h1", f"n{k % 7}") for k in range(10)] + [("h2", f"n{k % 5}") for k in range(6)] + [("h1", "h2")] + [tuple(f"n{x}" for x in rnd.sample(range(7), 2)) for _ in range(6)] + [("x", "y")]
    rows = [(f"e{i:02d}", *e, rnd.choice("LM"), rnd.choice([1.0, 1.0, 0.9999, 0.7, 0.4])) for i, e in enumerate(ends)]
    pairs = [(0, "n0", "n1"), (1, "n2", "h1"), (2, "h1", "h2"), (3, "n3", "x"), (4, "x", "y"), (5, "n4", "n4"), (6, "n5", "none")]
    df = spark.createDataFrame(rows, "edge_id string, source string, target string, layer string, weight double")
    got = graph.weighted_paths(df, spark.createDataFrame(pairs, "pair_id int, source string, target string"), max_hops, top).orderBy("pair_id", "rank").collect()
    for pid, a, b in pairs:
        assert [(list(r["edge_ids"]), r["path_confidence"], list(r["nodes"])) for r in got if r["pair_id"] == pid] == plain_trails(rows, a, b, max_hops, top), pid
    assert all(len(r["layers"]) == r["hops"] == len(r["edge_ids"]) for r in got)


def test_weighted_trails_without_edges(spark):
    df = spark.createDataFrame([], "edge_id string, source string, target string, layer string, weight double")
    assert graph.weighted_paths(df, spark.createDataFrame([(1, "a", "b")], "pair_id int, source string, target string")).count() == 0


def test_pairs_share_balls_and_settle_at_many_depths(spark):
    """A long chain with a hub at one end: pairs of one source at all distances, some out of reach, one in another component."""
    rows = [(f"c{k:02d}", f"x{k:02d}", f"x{k + 1:02d}", "allied_with", None, None) for k in range(7)] + [(f"h{k:03d}", "x00", f"leaf{k:03d}", "allied_with", None, None) for k in range(60)]
    rows += [("p1", "x03", "x04", "allied_with", None, None), ("far", "y0", "y1", "allied_with", None, None)]
    df = spark.createDataFrame(rows, "edge_id string, subject_id string, object_id string, predicate string, segment_from date, segment_to date")
    pairs = [(k, "leaf001", f"x{k:02d}") for k in range(8)] + [(10, "leaf001", "leaf002"), (11, "x00", "y0"), (12, "nobody", "x01"), (13, "x02", "x02"), (14, "x05", "leaf001")]
    got = {}
    for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "pair_id int, source string, target string"), 5, None).collect():
        got.setdefault(r["pair_id"], []).append((r["hops"], list(r["nodes"])))
    assert {p: {h for h, _ in v} for p, v in got.items()} == {**{k: {k + 1} for k in range(5)}, 10: {2}, 13: {0}} and len(got[4]) == 2
    wide = graph.shortest_paths(df, spark.createDataFrame(pairs, "pair_id int, source string, target string"), 9, None).collect()
    assert {(r["pair_id"], r["hops"]) for r in wide} == {(k, k + 1) for k in range(8)} | {(10, 2), (13, 0), (14, 6)}
