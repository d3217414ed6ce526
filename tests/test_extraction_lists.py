"""Cached extractions: each list is parsed once, and empty or missing lists give no rows."""

from pyspark.sql import functions as F

from proofweave.sources import landing

BODIES = [
    ("a", '{"nodes":[{"name":"_One Two_"},{"name":"##"}],"edges":[{"source":"A b","target":"c","relation":"r","layer":"L","confidence":"EXTRACTED"}]}'),
    ("b", '{"nodes":[],"edges":[]}'), ("c", "{}"), ("d", None), ("e", '{"nodes":[{"name":"x"}'), ("f", '{"nodes":[null,{"name":"É"}]}'),
]


def test_each_list_is_parsed_once(spark):
    cached = spark.createDataFrame(BODIES, "record_id string, body string")
    nodes, edges = landing.load_extractions(cached)
    for df in (nodes.select("record_id", "pos", "node_id"), edges.select("record_id", "pos", "source")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    parsed = cached.select("record_id", F.from_json("body", landing.EXTRACTION_SCHEMA).alias("r"))
    for df, field in ((nodes, "nodes"), (edges, "edges")):
        want = parsed.select("record_id", F.posexplode(f"r.{field}").alias("pos", "x")).select("record_id", "pos")
        assert sorted(map(tuple, df.select("record_id", "pos").collect())) == sorted(map(tuple, want.collect()))
    ids = {(r["record_id"], r["pos"]): r["node_id"] for r in nodes.collect()}
    assert ids[("a", 0)] == "one_two" and ids[("a", 1)] == "unknown" and ids[("f", 0)] is None and ids[("f", 1)] == "e"
