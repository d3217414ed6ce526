"""Expansion over hubs: edges of a hub are picked before sets meet them."""

from proofweave.operators import graph


def test_hub_is_cut_before_sets_meet_it(spark, monkeypatch):
    """Ten sets beside one hub of 3,000 edges: what meets the sets is bounded by the budget, and the picks are the first ones."""
    rows = [(f"e{i:05d}", f"n{i:05d}", "hub", "knows", None, None) for i in range(3000)]
    edges = spark.createDataFrame(rows, "edge_id string, subject_id string, object_id string, predicate string, segment_from date, segment_to date")
    seeds = spark.createDataFrame([(i, f"n{i * 7:05d}") for i in range(10)], "set_id int, entity_id string")
    met = []
    kept = graph._first_of_nodes

    def counted(touch, most):
        out = kept(touch, most)
        met.append(out.where("node = 'hub'").count())
        return out

    monkeypatch.setattr(graph, "_first_of_nodes", counted)
    found, sets = graph.expand(edges, seeds, 2, 20)
    got = {(r.set_id, r.hop, r.edge_id) for r in found.collect()}
    assert max(met) <= 41
    for i in range(10):
        own = f"e{i * 7:05d}"
        assert (i, 1, own) in got
        # seed, own edge and hub are 3 elements; then 8 edges with one new node each, in reading order
        firsts = [f"e{k:05d}" for k in range(20) if f"e{k:05d}" != own][:8]
        assert {e for s, h, e in got if s == i and h == 2} == set(firsts)
    assert all(r.elements == 19 and r.truncated for r in sets.collect())


def test_repeated_edges_and_loops_use_up_no_place(spark):
    rows = [("e1", "a", "a", "knows", None, None)] * 9 + [(f"f{i}", "a", f"b{i}", "knows", None, None) for i in range(6)] * 2
    edges = spark.createDataFrame(rows, "edge_id string, subject_id string, object_id string, predicate string, segment_from date, segment_to date")
    touch = graph._both_ends(edges, "edge_id", "subject_id", "object_id", "predicate", "segment_from").withColumnRenamed("near", "node")
    first = {r.edge_id for r in graph._first_of_nodes(touch.where("node = 'a'"), 5).collect()}
    assert first == {"e1", "f0", "f1", "f2", "f3"}
