"""Weighted trails between neighbours of two hubs: the ways through the hubs' other neighbours are counted, not written."""

from proofweave.operators import graph


def test_ways_between_hubs_are_listed_only_as_far_as_they_count(spark, monkeypatch):
    rows = [("s1", "s", "h1", "L", 1.0), ("s2", "s", "h1", "L", 0.7), ("t1", "t", "h2", "M", 1.0)]
    for k in range(400):
        rows += [(f"a{k:03d}", "h1", f"n{k:03d}", "L", 1.0 if k % 4 == 3 else 0.7), (f"b{k:03d}", f"n{k:03d}", "h2", "M", 1.0 if k % 2 else 0.4)]
    edges = spark.createDataFrame(rows, "edge_id string, source string, target string, layer string, weight double")
    pairs = spark.createDataFrame([(1, "s", "t")], "pair_id int, source string, target string")
    written = []
    store = graph.cut

    def counted(df):
        out = store(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = [(list(r["edge_ids"]), r["path_confidence"], list(r["nodes"]), list(r["layers"])) for r in graph.weighted_paths(edges, pairs).orderBy("rank").collect()]
    firsts = [k for k in range(400) if k % 4 == 3][:10]
    assert got == [(["s1", f"a{k:03d}", f"b{k:03d}", "t1"], 1.0, ["s", "h1", f"n{k:03d}", "h2", "t"], ["L", "L", "M", "M"]) for k in firsts]
    assert max(written) <= 20
