"""Edges at a few entities come from the claims of their groups alone."""

from proofweave.operators import graph
from proofweave.operators import projection as pj
from proofweave.plans import reads, registry
from proofweave.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_hop_writes_no_other_edges(spark, monkeypatch):
    monkeypatch.setattr(registry, "_STORED", {})
    written = []
    store = pj.cut

    def counted(df):
        out = store(df)
        if "edge_id" in out.columns:
            written.append(out.count())
        return out

    for module in (registry, reads, graph, pj):
        monkeypatch.setattr(module, "cut", counted)
    got = sorted(tuple(r) for r in QUERIES["g4_expand"](spark, FOLDER).collect())
    assert max(written) <= 2 * len(got)
    t = registry.Inputs(spark, FOLDER)
    found, _ = graph.expand(t.edges(), reads.nation_seeds(t), 1)
    assert t.edges().count() > 3 * len(got)
    assert got == sorted(tuple(r) for r in found.select("set_id", "hop", "edge_id").collect())


def test_edges_at_an_entity_keep_their_segments(spark):
    rows = [("a", "b", "p", "1", "2000-01-01", "2000-03-01"), ("a", "b", "p", "2", "2000-02-01", None), ("c", "a", "p", "3", None, None), ("c", "d", "p", "4", None, None)]
    claims = spark.createDataFrame(rows, "subject_id string, object_id string, predicate string, claim_id string, f string, t string")
    resolved = claims.selectExpr("subject_id", "object_id", "predicate", "claim_id", "date(f) AS valid_from", "date(t) AS valid_to", "false AS collapsed")
    at = spark.createDataFrame([("a",), ("a",), ("nobody",)], "entity_id string")
    whole = {tuple(r) for r in pj.edge_rows(resolved).where("subject_id = 'a' OR object_id = 'a'").collect()}
    assert len(whole) == 4 and {tuple(r) for r in pj.edge_rows(resolved, at).collect()} == whole
