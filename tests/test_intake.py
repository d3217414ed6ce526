import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofweave.functions import canonical
from proofweave.operators import access, claims as cl
from proofweave.session import scratch_path
from proofweave.sources import landing, sinks
from proofweave.streaming import intake

RAW = "source_system string, filename string, text string, arrival bigint"


def arrivals(spark):
    rows = [("s", "a.txt", "one", 1), ("s", "a.txt", "one", 2), ("s", "a.txt", "two", 3), ("s", "a.txt", "three", 4), ("s", "b.txt", "x" * 30, 5), ("t", "a.txt", "one", 6)]
    return spark.createDataFrame(rows, RAW)


def test_landing_reasons(spark):
    got = {(r["source_system"], r["arrival"]): (r["status"], r["quarantine_reason"]) for r in landing.land_records(arrivals(spark), 20).collect()}
    assert got[("s", 1)] == ("landed", None) and got[("t", 6)] == ("landed", None) and ("s", 2) not in got
    assert got[("s", 4)][1] == "version conflict: 2 earlier record(s) of 'a.txt' with different content"
    assert got[("s", 5)][1] == "oversized: 30 bytes exceeds the 20-byte bound"


def test_stream_equals_batch_over_several_files(spark):
    source, table, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    arrivals(spark).where("arrival <= 3").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(RAW).parquet(source)
    intake.stream_landing(stream(), table, mark, 20).awaitTermination()
    arrivals(spark).where("arrival > 2").coalesce(1).write.mode("append").parquet(source)
    intake.stream_landing(stream(), table, mark, 20).awaitTermination()
    got, want = spark.read.parquet(table).drop("batch_id", "bucket"), landing.land_records(arrivals(spark), 20)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_suggestions_queue_once(spark):
    source, table, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    schema = "idempotency_key string, body string"
    for batch in ([("k1", "a"), ("k1", "a"), ("k2", "b")], [("k2", "b"), ("k3", "c")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        intake.stream_suggestions(spark.readStream.schema(schema).parquet(source), table, mark).awaitTermination()
    assert sorted(r["idempotency_key"] for r in spark.read.parquet(table).collect()) == ["k1", "k2", "k3"]


def test_a_new_key_may_arrive_late(spark):
    source, table, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    schema = "idempotency_key string, ts timestamp"
    for batch in ([("k1", "2024-01-02 20:00:00")], [("k2", "2024-01-02 21:00:00")], [("late", "2024-01-02 02:00:00"), ("k1", "2024-01-02 20:00:00")]):
        rows = spark.createDataFrame(batch, "idempotency_key string, t string").select("idempotency_key", F.col("t").cast("timestamp").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(source)
        intake.stream_suggestions(spark.readStream.schema(schema).parquet(source), table, mark).awaitTermination()
    assert sorted(r["idempotency_key"] for r in spark.read.parquet(table).collect()) == ["k1", "k2", "late"]


def test_malformed_extractions_are_reported(spark):
    bodies = [("a", '{"nodes": [{"name": "x"}]}'), ("b", '{"nodes": ['), ("c", None), ("d", "no json"), ("e", "{}")]
    got = landing.extraction_errors(spark.createDataFrame(bodies, "record_id string, body string"))
    assert {(r["record_id"], r["error"]) for r in got.collect()} == {("b", "malformed body"), ("c", "no body"), ("d", "malformed body")}


def test_text_with_bad_bytes(spark):
    df = spark.createDataFrame([("1", "a.txt", None, bytearray(b"ok \xff!")), ("2", "b.bin", None, bytearray(b"x")), ("3", "c.TXT", None, bytearray(b"  "))], "record_id string, filename string, media_type string, content binary")
    got = {r["record_id"]: (r["outcome"], r["text"]) for r in landing.text_records(df).collect()}
    assert got == {"1": ("text", "ok �!"), "2": ("unsupported media type", None), "3": ("empty text", "  ")}


def test_projection_versions(spark):
    root = scratch_path(spark, "projection")
    df = lambda n: spark.range(n).select(F.col("id"), F.lit("p").alias("predicate"))
    sinks.write_projection(df(3), root, 7)
    sinks.write_projection(df(5), root, 8)
    assert sinks.current_projection(spark, root).count() == 5


def test_unsafe_layer_stops(spark):
    edge = spark.createDataFrame([("e", "a", "b", "r", 'X]->() DELETE', "INFERRED", 0.7, None, None)], "edge_id string, source string, target string, relation string, layer string, confidence string, weight double, start_date date, end_date date")
    with pytest.raises(Exception, match="unsafe relationship type"):
        sinks.edge_statements(edge).collect()


def test_custody_lines(spark):
    text = '3. Ann LEE alias “Lee” (NIC 123456789V) — arrested 2023-01-02 – remanded, North Prison (2023-01-03 to ONGOING)\nnoise\n4. Bo — arrested 2023-01-02 - remanded South Gaol (2023-01-03 to 2023-02-01)'
    got = cl.parse_custody_list(spark.createDataFrame([("r", text)], "record_id string, text string")).orderBy("num").collect()
    assert [(r["num"], r["name"], r["alias"], r["nic"], r["facility"], str(r["end_date"])) for r in got] == [
        (3, "Ann LEE", "Lee", "123456789V", "North Prison", "None"), (4, "Bo", None, None, "South Gaol", "2023-02-01")]


def brute_chunks(text, least):
    import re

    if len(text) <= least:
        return [text]
    out, buffer = [], ""
    for block in [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]:
        buffer = f"{buffer}\n\n{block}" if buffer else block
        if len(buffer) >= least:
            out, buffer = out + [buffer], ""
    return out + [buffer] if buffer else out


@pytest.mark.parametrize("least", [5, 12, 40])
def test_paragraph_chunks(spark, least):
    texts = ["short", "aa\n\nbbbb\n \ncccccccc\n\n\ndd", "one block only that is long enough to split never", "\n\nlead\n\ntail\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in cl.paragraph_chunks(df, min_chars=least).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert [got.get(i, []) for i in range(len(texts))] == [brute_chunks(t, least) for t in texts]


def test_whole_documents_are_chunked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: brute_chunks(r["text"], 500) for r in docs.collect()}
    got = {}
    for r in cl.paragraph_chunks(docs, min_chars=500).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {k: v for k, v in want.items() if v}


def test_extraction_edges(spark):
    body = json.dumps({"nodes": [{"name": "José Núñez", "aliases": ["Pepe"]}], "edges": [
        {"source": "José Núñez", "target": "jose nunez", "relation": "x", "layer": "FINANCIAL", "confidence": "EXTRACTED"},
        {"source": "a", "target": "b", "relation": "Met In", "layer": "FINANCIAL", "confidence": "INFERRED", "start_date": "2020-02-01", "end_date": "2020-01-01"},
        {"source": "a", "target": "c", "relation": "Met In", "layer": "FINANCIAL", "confidence": "INFERRED"}]})
    nodes, edges = landing.load_extractions(spark.createDataFrame([("r", body)], "record_id string, body string"))
    assert nodes.first()["node_id"] == "jose_nunez"
    assert [(r["error"], r["weight"], r["relation"]) for r in edges.orderBy("pos").collect()] == [("self-loop", 1.0, "x"), ("end precedes start", 0.7, "met_in"), (None, 0.7, "met_in")]


def chain(n):
    rows, prev = [], "0" * 64
    for i in range(1, n + 1):
        event = {"id": i * 3, "at": f"2024-01-01T00:00:{i:02d}.000000Z", "actor": "ä", "session_id": None, "purpose": None, "case_id": None, "action": "a", "resource_type": "t", "resource_id": None, "decision": "allow", "detail": {"z": 1, "a": ["අ", None]}}
        h = hashlib.sha256(prev.encode() + json.dumps(event, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((i * 3, event["at"][:19].replace("T", " "), "ä", "a", "t", "allow", json.dumps(event["detail"]), prev, h))
        prev = h
    return rows


def verify(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, at string, actor string, action string, resource_type string, decision string, detail string, prev_hash string, entry_hash string").withColumn("at", F.to_timestamp("at"))
    event = canonical.canonical_event(**{c: F.col(c) for c in ("id", "at", "actor", "action", "resource_type", "decision", "detail")})
    return access.audit_verify(df, canonical.entry_hash(F.col("prev_hash"), event)).first()


def test_audit_chain(spark):
    rows = chain(20)
    assert verify(spark, rows)["ok"] and verify(spark, rows)["checked"] == 20
    edited = rows[:7] + [rows[7][:2] + ("mallory",) + rows[7][3:]] + rows[8:]
    bad = verify(spark, edited)
    assert (bad["ok"], bad["checked"], bad["failed_id"]) == (False, 7, 24) and bad["reason"].startswith("entry hash")
    missing = verify(spark, rows[:5] + rows[6:])
    assert (missing["checked"], missing["failed_id"]) == (5, 21) and missing["reason"].startswith("previous hash")


def test_custody_rules(spark):
    rows = [("e", 1, None, "a", 1), ("e", 2, "b", "c", 2), ("e", 3, "c", "c", 3), ("e", 4, None, "d", 2), ("f", 1, "x", "y", 1)]
    df = spark.createDataFrame(rows, "evidence_id string, seq int, from_actor string, to_actor string, occurred_at int")
    got = {(r["evidence_id"], r["seq"]): r["error"].split(":")[0] for r in access.custody_check(df).collect()}
    assert got == {("e", 2): "from_actor", ("e", 3): "to_actor", ("e", 4): "occurred_at", ("f", 1): "from_actor"}


def test_validation_paths(spark):
    drafts = spark.createDataFrame(
        [("1", "p1", "member_of", "o1", None, "r1", "assessed", "low"), ("2", "o1", "member_of", "o1", None, "r1", "observed", "low"), ("3", "p1", "known_as", "o1", None, "r9", "reported", None), ("4", "p1", "nope", None, None, "r1", "reported", None)],
        "draft_id string, subject_id string, predicate string, object_id string, object_value string, record_id string, assertion_type string, analytic_confidence string")
    entities = spark.createDataFrame([("p1", "person"), ("o1", "organization")], "entity_id string, entity_type string")
    got = {r["draft_id"]: r["errors"] for r in cl.validate_claims(drafts, entities, spark.createDataFrame([("r1",)], "record_id string")).collect()}
    assert got["1"] == []
    assert got["2"] == ["predicates.member_of.subject", "claim.object_id", "claim.analytic_confidence"]
    assert got["3"] == ["predicates.known_as.object", "claim.record_id"]
    assert got["4"] == ["predicates.nope", "claim.object"]
