"""Registered queries: landing, extraction, claim shaping, name keys, streaming intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import vocabulary as V
from ..operators import claims as cl
from ..operators import projection as pj
from ..session import scratch_path
from ..sources import landing, sinks
from ..streaming import intake
from .registry import SYMMETRIC, Inputs, oracle, query

MAX_BYTES = 20_000

LANDED_SQL = f"""
SELECT ingest_key, source_system, filename, content_hash, size_bytes, arrival,
 CASE WHEN reason = '' THEN 'landed' ELSE 'quarantined' END AS status, nullif(reason, '') AS quarantine_reason
FROM (SELECT *, concat_ws('; ',
  CASE WHEN c > 0 THEN concat('version conflict: ', c, ' earlier record(s) of ''', filename, ''' with different content') END,
  CASE WHEN size_bytes > {MAX_BYTES} THEN concat('oversized: ', size_bytes, ' bytes exceeds the {MAX_BYTES}-byte bound') END) AS reason
 FROM (SELECT *, row_number() OVER (PARTITION BY source_system, filename ORDER BY arrival, ingest_key) - 1 AS c
  FROM (SELECT source_system, filename, content_hash, size_bytes, ingest_key, min(arrival) AS arrival
   FROM (SELECT source_system, filename, arrival, sha256(text) AS content_hash, strlen(text) AS size_bytes,
     sha256(concat_ws('|', source_system, filename, sha256(text))) AS ingest_key FROM fx_raw) k
   GROUP BY source_system, filename, content_hash, size_bytes, ingest_key)))
"""


@query("s1_land_records", oracle(LANDED_SQL))
def s1(t: Inputs):
    return landing.land_records(t.view("raw"), MAX_BYTES)


FILES = """
SELECT concat('rec_', CAST(doc_id AS STRING)) AS record_id,
 concat('f_', CAST(doc_id AS STRING), CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.pdf' WHEN 3 THEN '.json' ELSE '' END) AS filename,
 CASE WHEN doc_id % 7 = 0 THEN 'text/plain' END AS media_type, text FROM documents
"""


@query("s2_text_records", oracle("""
SELECT record_id, media, CASE WHEN media LIKE 'text/%' THEN CASE WHEN trim(text) = '' THEN 'empty text' ELSE 'text' END ELSE 'unsupported media type' END AS outcome,
 CASE WHEN media LIKE 'text/%' THEN length(text) END AS chars, CASE WHEN media LIKE 'text/%' THEN sha256(text) END AS text_hash
FROM (SELECT record_id, text, coalesce(media_type, CASE lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown'
 WHEN 'pdf' THEN 'application/pdf' WHEN 'json' THEN 'application/json' END) AS media FROM files)
""", files=FILES))
def s2(t: Inputs):
    files = t.sql(FILES).withColumn("content", F.col("text").cast("binary")).drop("text")
    return landing.text_records(files).select(
        "record_id", F.col("media_type").alias("media"), "outcome", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")
    )


DERIVED = """
SELECT concat('drv_', record_id) AS derivative_id, record_id AS parent_record, 'text' AS kind, CASE o_orderkey % 4 WHEN 3 THEN 'ocr' ELSE 'reader' END AS tool,
 CASE o_orderkey % 3 WHEN 0 THEN '1.0' ELSE '2.0' END AS tool_version, CASE o_orderkey % 5 WHEN 0 THEN '{"pages":"odd"}' ELSE '{"pages":"all"}' END AS params FROM {r}
"""


@query("s3_derivative_reuse", oracle("""
SELECT r.record_id, CASE WHEN d.derivative_id IS NULL THEN 'needed' ELSE 'reused' END AS state, d.derivative_id FROM fx_record r LEFT JOIN derived d
ON d.parent_record = r.record_id AND d.tool = 'reader' AND d.tool_version = '2.0' AND d.params = '{"pages":"all"}'
""", derived=DERIVED.replace("{r}", "fx_record")))
def s3(t: Inputs):
    records = t.record
    records.createOrReplaceTempView("records_of_derivatives")
    derived = t.spark.sql(DERIVED.replace("{r}", "records_of_derivatives"))
    reused, needed = landing.derivative_reuse(records.select("record_id"), derived, "reader", "2.0", '{"pages":"all"}')
    return reused.select("record_id", F.lit("reused").alias("state"), "derivative_id").unionByName(
        needed.select("record_id", F.lit("needed").alias("state"), F.lit(None).cast("string").alias("derivative_id"))
    )


EXTRACTED = """
SELECT concat('rec_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS record_id, c_name AS person,
 CASE WHEN l_partkey % 13 = 0 THEN upper(c_name) ELSE concat('Organization ', CAST(l_suppkey % 7 AS STRING)) END AS other,
 CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
 CASE l_partkey % 3 WHEN 0 THEN 'FINANCIAL' WHEN 1 THEN 'IDEOLOGICAL' ELSE 'TRANSNATIONAL' END AS layer,
 CASE l_partkey % 2 WHEN 0 THEN 'member of' ELSE 'Met-With' END AS relation,
 CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity - 5 AS INT) AS end_date,
 (CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq, l_suppkey, l_partkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')".format


def extraction_json(t: Inputs):
    """One cached extraction per line item, as the JSON text a model would have returned."""
    e = t.sql(EXTRACTED)
    node = lambda c, kind: F.struct(F.col(c).alias("name"), F.lit(kind).alias("node_type"))
    edge = F.struct(F.col("person").alias("source"), F.col("other").alias("target"), "relation", "layer", "confidence", "start_date", "end_date")
    return e.select("record_id", F.to_json(F.struct(F.array(node("person", "PERSON"), node("other", "ORGANIZATION")).alias("nodes"), F.array(edge).alias("edges"))).alias("body"))


@query("s4_load_extractions", oracle(f"""
SELECT record_id, source, target, relation, layer, confidence, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.4 END AS weight, start_date, end_date,
 CASE WHEN source = target THEN 'self-loop' WHEN end_date < start_date THEN 'end precedes start' END AS error
FROM (SELECT record_id, {SLUG('person')} AS source, {SLUG('other')} AS target, {SLUG('relation')} AS relation, layer, confidence, start_date, CAST(end_date AS DATE) AS end_date FROM extracted)
""", extracted=EXTRACTED))
def s4(t: Inputs):
    _, edges = landing.load_extractions(extraction_json(t))
    return edges.select("record_id", "source", "target", "relation", "layer", "confidence", "weight", "start_date", "end_date", "error")


@query("s4_malformed", oracle("""
SELECT doc_id AS record_id, CASE WHEN doc_id % 7 = 0 THEN 'no body' ELSE 'malformed body' END AS error FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0
"""))
def s4_malformed(t: Inputs):
    """Bodies that are cut off or missing give error rows instead of vanishing."""
    bodies = t.sql("SELECT doc_id AS record_id, to_json(named_struct('nodes', array(named_struct('name', text)))) AS body FROM documents")
    broken = F.when(F.col("record_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("record_id") % 5 == 0, F.expr("substr(body, 1, length(body) - 2)")).otherwise(F.col("body"))
    return landing.extraction_errors(bodies.withColumn("body", broken))


@query("s4_load_extraction_nodes", oracle(f"""
SELECT record_id, pos, {SLUG('name')} AS node_id, name, node_type FROM
 (SELECT record_id, 0 AS pos, person AS name, 'PERSON' AS node_type FROM extracted UNION ALL SELECT record_id, 1, other, 'ORGANIZATION' FROM extracted)
""", extracted=EXTRACTED))
def s4_nodes(t: Inputs):
    nodes, _ = landing.load_extractions(extraction_json(t))
    return nodes.select("record_id", "pos", "node_id", "name", "node_type")


@query("s5_content_integrity", oracle("""
SELECT doc_id, content_hash, sha256(text) AS actual_hash FROM
 (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN sha256(concat(text, 'x')) ELSE sha256(text) END AS content_hash FROM documents) WHERE sha256(text) <> content_hash
"""))
def s5(t: Inputs):
    stored = t.sql("SELECT doc_id, text AS content, CASE WHEN doc_id % 50 = 0 THEN sha2(concat(text, 'x'), 256) ELSE sha2(text, 256) END AS content_hash FROM documents")
    return landing.content_integrity(stored).select("doc_id", "content_hash", "actual_hash")


PROJECTION_OUT = "SELECT edge_id, subject_id, object_id, predicate, segment_from, segment_to, claim_count, record_count, handling_rank, corroboration_count, contradiction_count FROM projection"
PROJECTION_COLUMNS = ["edge_id", "subject_id", "object_id", "predicate", "segment_from", "segment_to", "claim_count", "record_count", "handling_rank", "corroboration_count", "contradiction_count"]


@query("s6_write_projection", oracle(PROJECTION_OUT))
def s6(t: Inputs):
    """Write a version, then read back what readers see."""
    root = scratch_path(t.spark, "projection")
    built = pj.edge_projection(t.resolved(), t.relation, 1)
    sinks.write_projection(built, root, 1)
    return sinks.current_projection(t.spark, root).select(*PROJECTION_COLUMNS)


NODE_OUT = """SELECT slug AS node_id, s.entity_id, label AS name, upper(entity_type) AS node_type, coalesce(rs.source_file, '') AS source_file FROM slugs s LEFT JOIN record_source rs ON rs.record_id = s.record_id"""


@query("s7_graph_export", oracle("""
SELECT 'node' AS part, to_json(struct_pack(node_id := node_id, entity_id := entity_id, name := name, node_type := node_type, source_file := source_file)) AS document FROM nodes
UNION ALL SELECT 'edge', to_json(struct_pack(edge_id := edge_id, source := source, target := target, relation := relation, layer := layer, confidence := confidence,
 start_date := start_date, end_date := end_date, source_file := source_file)) FROM display
""", nodes=NODE_OUT))
def s7(t: Inputs):
    nodes = pj.graph_nodes(t.slugs(), t.record, t.source)
    edges = t.display_edges().select("edge_id", "source", "target", "relation", "layer", "confidence", "start_date", "end_date", "source_file")
    return sinks.graph_export(nodes, edges)


@query("s8_cypher_rows", oracle("""
SELECT node_id || '/' || entity_id AS key, concat('MERGE (c:Criminal {node_id: "', node_id, '"})', chr(10), 'SET c.name = "', name, '",', chr(10), '    c.aliases = [],', chr(10), '    c.nic = null,', chr(10),
 '    c.affiliations = [],', chr(10), '    c.node_type = "', node_type, '",', chr(10), '    c.cluster_id = null,', chr(10), '    c.source_file = "', source_file, '",', chr(10), '    c.source_excerpt = null;') AS statement FROM nodes
UNION ALL SELECT edge_id, concat('MATCH (a:Criminal {node_id: "', source, '"})', chr(10), 'MATCH (b:Criminal {node_id: "', target, '"})', chr(10), 'MERGE (a)-[r:', layer, ' {relation: "', relation,
 '", source_file: "', source_file, '"}]->(b)', chr(10), 'SET r.confidence = "', confidence, '",', chr(10), '    r.weight = ', CAST(weight AS DOUBLE), ',', chr(10),
 '    r.start_date = ', CASE WHEN start_date IS NULL THEN 'null' ELSE concat('date("', CAST(start_date AS VARCHAR), '")') END, ',', chr(10), '    r.end_date = ', CASE WHEN end_date IS NULL THEN 'null' ELSE concat('date("', CAST(end_date AS VARCHAR), '")') END, ',', chr(10),
 '    r.location = null,', chr(10), '    r.extraction_method = null,', chr(10), '    r.source_excerpt = null;') FROM display
""", nodes=NODE_OUT))
def s8(t: Inputs):
    nodes = pj.graph_nodes(t.slugs(), t.record, t.source)
    rows = sinks.node_statements(nodes, key=F.concat("node_id", F.lit("/"), "entity_id"))
    return rows.unionByName(sinks.edge_statements(t.display_edges()))


@query("s9_ingest_status", oracle("SELECT status, count(*) AS records FROM fx_record GROUP BY status"))
def s9(t: Inputs):
    return landing.ingest_status(t.record)


CUSTODY_TEXT = """
SELECT stay_id, concat('ANNEX C: PERSONS REMANDED', chr(10), CASE WHEN person % 11 = 0 THEN 'withdrawn ' ELSE '' END, CAST(person % 90 + 1 AS STRING), '. Person ', CAST(person AS STRING),
 CASE WHEN person % 2 = 0 THEN concat(' alias "Nick ', CAST(person AS STRING), '"') ELSE '' END, CASE WHEN person % 3 = 0 THEN concat(' (NIC ', lpad(CAST(person AS STRING), 12, '1'), ')') ELSE '' END,
 ' — arrested ', CAST(start_date AS STRING), ' - remanded, ', facility, ' (', CAST(start_date AS STRING), ' to ', coalesce(CAST(end_date AS STRING), 'ongoing'), ')', chr(10), 'end of list') AS text,
 person, facility, start_date, end_date FROM {stays}
"""


@query("x1_parse_custody_list", oracle("""
SELECT stay_id AS record_id, 1 AS line_no, CAST(person % 90 + 1 AS INT) AS num, concat('Person ', CAST(person AS STRING)) AS name,
 CASE WHEN person % 2 = 0 THEN concat('Nick ', CAST(person AS STRING)) END AS alias, CASE WHEN person % 3 = 0 THEN lpad(CAST(person AS STRING), 12, '1') END AS nic,
 start_date AS arrested, facility, start_date, CAST(end_date AS DATE) AS end_date FROM fx_stay WHERE person % 11 <> 0
"""))
def x1(t: Inputs):
    t.view("stay").createOrReplaceTempView("stays_listed")
    docs = t.spark.sql(CUSTODY_TEXT.replace("{stays}", "stays_listed"))
    return cl.parse_custody_list(docs, doc="stay_id").drop("line")


@query("x2_co_location", oracle("""
SELECT a.stay_id AS stay_a, b.stay_id AS stay_b, a.facility, greatest(a.start_date, b.start_date) AS start_date, CAST(least(a.end_date, b.end_date) AS DATE) AS end_date
FROM fx_stay a JOIN fx_stay b ON lower(a.facility) = lower(b.facility) AND a.stay_id < b.stay_id
WHERE greatest(a.start_date, b.start_date) <= coalesce(least(a.end_date, b.end_date), DATE '9999-12-31')
"""))
def x2(t: Inputs):
    return cl.co_location(t.view("stay"))


NAMED = """
SELECT CAST(doc_id AS STRING) AS record_id, 'own' AS ref, lower(regexp_extract(substring(text, CAST(floor(length(text) / 2) AS INT) + 1), '[^ ]+ [^ ]+ [^ ]+', 0)) AS name FROM documents
UNION ALL SELECT CAST(d.doc_id AS STRING), 'item', regexp_extract(b.text, '[^ ]+ [^ ]+ [^ ]+', 0) FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS pick FROM documents) d JOIN benchmark b ON b.item_id = d.pick
"""


@query("x3_locate_mentions", oracle("""
SELECT record_id, ref, name, CASE WHEN spot >= 0 THEN substring(text, spot + 1, length(name)) ELSE name END AS raw_text, CASE WHEN spot >= 0 THEN spot END AS char_start, CASE WHEN spot >= 0 THEN spot + length(name) END AS char_end,
 CASE WHEN spot >= 0 THEN substring(text, greatest(spot - 120, 0) + 1, least(length(text), spot + length(name) + 120) - greatest(spot - 120, 0)) END AS context, spot >= 0 AS verified
FROM (SELECT n.record_id, n.ref, n.name, d.text, strpos(lower(d.text), lower(n.name)) - 1 AS spot FROM named n JOIN documents d ON CAST(d.doc_id AS STRING) = n.record_id WHERE trim(n.name) <> '')
""", named=NAMED))
def x3(t: Inputs):
    docs = t.sql("SELECT CAST(doc_id AS STRING) AS record_id, text FROM documents")
    return cl.locate_mentions(docs, t.sql(NAMED))


@query("x4_paragraph_chunks", oracle(r"""
SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS chunk_index, unnest(chunks) AS chunk FROM (
 SELECT doc_id, CASE WHEN length(text) <= 400 THEN [text] WHEN len(blocks) = 0 THEN CAST([] AS VARCHAR[])
  ELSE string_split(list_reduce(blocks, lambda a, b: CASE WHEN length(string_split(a, chr(1))[-1]) >= 400 THEN concat(a, chr(1), b) ELSE concat(a, chr(10), chr(10), b) END), chr(1)) END AS chunks FROM (
  SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS blocks FROM (
   SELECT doc_id, replace(text, '. ', concat('.', chr(10), ' ', chr(10))) AS text FROM documents)))
"""))
def x4(t: Inputs):
    """Sentences as paragraphs, so that chunks are really merged."""
    spaced = t.raw("documents").withColumn("text", F.regexp_replace("text", r"\. ", ".\n \n"))
    return cl.paragraph_chunks(spaced, min_chars=400)


@query("x5_merge_nodes", oracle(f"""
SELECT node_id, min(seq) AS first_seq, arg_min(name, seq) AS name, arg_min(nic, seq) FILTER (WHERE nic IS NOT NULL) AS nic, arg_min(source_excerpt, seq) FILTER (WHERE source_excerpt IS NOT NULL) AS source_excerpt
FROM (SELECT seq, {SLUG('person')} AS node_id, person AS name, CASE WHEN l_suppkey % 5 = 0 THEN concat('nic-', CAST(seq AS STRING)) END AS nic, CASE WHEN l_partkey % 3 = 0 THEN concat('line ', CAST(seq AS STRING)) END AS source_excerpt FROM extracted) GROUP BY node_id
""", extracted=EXTRACTED))
def x5_nodes(t: Inputs):
    e = t.sql(EXTRACTED)
    return cl.merge_nodes(
        e.select(
            "seq", cl.ascii_slug(F.col("person")).alias("node_id"), F.col("person").alias("name"),
            F.expr("CASE WHEN l_suppkey % 5 = 0 THEN concat('nic-', CAST(seq AS STRING)) END").alias("nic"),
            F.expr("CASE WHEN l_partkey % 3 = 0 THEN concat('line ', CAST(seq AS STRING)) END").alias("source_excerpt"),
        )
    )


@query("x5_merge_node_values", oracle(f"""
SELECT node_id, kind, value, min(seq) AS first_seq FROM (SELECT {SLUG('person')} AS node_id, 'affiliation' AS kind, other AS value, seq FROM extracted
 UNION ALL SELECT {SLUG('person')}, 'alias', concat('A', CAST(l_partkey % 10 AS STRING)), seq FROM extracted) GROUP BY node_id, kind, value
""", extracted=EXTRACTED))
def x5_values(t: Inputs):
    e = t.sql(EXTRACTED).withColumn("node_id", cl.ascii_slug(F.col("person"))).withColumn("pos", F.lit(0))
    stated = e.select("seq", "pos", "node_id", F.lit("affiliation").alias("kind"), F.col("other").alias("value")).unionByName(
        e.select("seq", "pos", "node_id", F.lit("alias").alias("kind"), F.expr("concat('A', CAST(l_partkey % 10 AS STRING))").alias("value"))
    )
    return cl.merge_node_values(stated).drop("first_pos")


@query("x5_merge_edges", oracle("""
SELECT source, target, relation, layer, start_date, end_date, min(seq) AS seq, arg_min(confidence, seq) AS confidence FROM
 (SELECT person AS source, other AS target, relation, layer, date_trunc('year', start_date)::DATE AS start_date, CAST(NULL AS DATE) AS end_date, seq, confidence FROM extracted) GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY source, target, relation, layer, start_date, end_date"), extracted=EXTRACTED))
def x5_edges(t: Inputs):
    e = t.sql(EXTRACTED)
    return cl.merge_edges(
        e.select(
            F.col("person").alias("source"), F.col("other").alias("target"), "relation", "layer", F.trunc("start_date", "year").alias("start_date"),
            F.lit(None).cast("date").alias("end_date"), "seq", "confidence",
        )
    )


def _claim_edges(t: Inputs):
    c = t.claim
    return c.select("claim_id", F.col("subject_id").alias("source"), F.col("object_id").alias("target")), c.select(F.col("subject_id").alias("node_id")).distinct()


@query("x6_dangling_edges", oracle("""
SELECT claim_id, subject_id AS source, object_id AS target FROM fx_claim WHERE object_id NOT IN (SELECT DISTINCT subject_id FROM fx_claim)
"""))
def x6(t: Inputs):
    return cl.dangling_edges(*_claim_edges(t)).select("claim_id", "source", "target")


@query("x6_prune_dangling", oracle("""
SELECT claim_id, subject_id AS source, object_id AS target FROM fx_claim WHERE object_id IN (SELECT DISTINCT subject_id FROM fx_claim)
"""))
def x6_prune(t: Inputs):
    return cl.prune_dangling(*_claim_edges(t)).select("claim_id", "source", "target")


VERBS = list(V.VERB_REMAP) + ["allied_with", "sibling_of", "member_of", "unheard_of"]
VERB_EDGES = f"""
SELECT concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS edge_no,
 CASE l_partkey % {len(VERBS)} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERBS))} END AS relation,
 CASE l_suppkey % 4 WHEN 0 THEN 'IDEOLOGICAL' WHEN 1 THEN 'FINANCIAL' WHEN 2 THEN 'TRANSNATIONAL' ELSE 'KINSHIP' END AS layer,
 CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' WHEN 'R' THEN 'AMBIGUOUS' END AS confidence,
 CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS end_date,
 CASE WHEN l_linenumber = 1 THEN 'Pier 9' WHEN l_linenumber = 2 THEN '' END AS location FROM lineitem
"""
VERB_ROWS = [(v, *target, len(ts) > 1) for v, ts in V.VERB_REMAP.items() for target in ts] + [
    (n, n, None, None, "full", False) for n in V.PREDICATES if n not in V.VERB_REMAP
]
CORRECTIONS = " OR ".join(f"(v.predicate = '{p}' AND e.layer IN ({', '.join(repr(x) for x in ls)}))" for p, ls in V.CATEGORY_CORRECTIONS.items())
CRED_ORDER = V.sql_case("{0}", {c: i for i, c in enumerate(V.CREDIBILITY)}).format


@query("x7_remap_edges", oracle(f"""
SELECT edge_no, relation, layer, predicate, category, "symmetric", CASE WHEN cap IS NOT NULL AND {CRED_ORDER('cap')} > {CRED_ORDER('credibility')} THEN cap ELSE credibility END AS credibility_normalized,
 verification_status, CASE WHEN part IN ('full', 'from_start') THEN start_date END AS valid_from, CAST(CASE WHEN part = 'full' THEN end_date WHEN part = 'until_start' THEN start_date END AS DATE) AS valid_to,
 coalesce(nullif(location, ''), place) AS location_text, coalesce(split, FALSE) AS split, cap IS NOT NULL AS credibility_capped, coalesce(corrected, FALSE) AS category_corrected,
 CASE WHEN predicate IS NULL THEN concat('predicates.', relation) WHEN corrected AND NOT allowed THEN concat('predicates.', predicate, '.category') END AS error
FROM (SELECT e.*, v.predicate, v.cap, v.place, v.part, v.split, {V.sql_case('v.predicate', {n: s[2] for n, s in V.PREDICATES.items() if s[2]})} AS category, v.predicate IN ({SYMMETRIC}) AS "symmetric",
  CASE e.confidence WHEN 'EXTRACTED' THEN 'confirmed' WHEN 'INFERRED' THEN 'probably_true' ELSE 'doubtful' END AS credibility,
  CASE e.confidence WHEN 'EXTRACTED' THEN 'record_confirmed' WHEN 'INFERRED' THEN 'partially_corroborated' ELSE 'unverified' END AS verification_status,
  {V.sql_case('v.predicate', {n: s[2] for n, s in V.PREDICATES.items() if s[2]})} <> lower(e.layer) AS corrected, coalesce({CORRECTIONS}, FALSE) AS allowed
 FROM verb_edges e LEFT JOIN {V.sql_values(VERB_ROWS, 'v(verb, predicate, cap, place, part, split)')} ON v.verb = e.relation)
""", verb_edges=VERB_EDGES))
def x7(t: Inputs):
    return cl.remap_edges(t.sql(VERB_EDGES))


@query("x8_grade_confidence", oracle("""
SELECT edge_no, confidence, CASE confidence WHEN 'EXTRACTED' THEN 'confirmed' WHEN 'INFERRED' THEN 'probably_true' ELSE 'doubtful' END AS credibility,
 CASE confidence WHEN 'EXTRACTED' THEN 'record_confirmed' WHEN 'INFERRED' THEN 'partially_corroborated' ELSE 'unverified' END AS verification,
 CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.4 END AS weight FROM verb_edges
""", verb_edges=VERB_EDGES))
def x8(t: Inputs):
    return cl.grade_confidence(t.sql(VERB_EDGES).select("edge_no", "confidence"))


@query("x9_normalize_grade", oracle("""
SELECT s_suppkey, grade, CASE WHEN grade IN ('A', 'B', 'C', 'F') THEN 'reliability' END AS dimension,
 CASE grade WHEN 'A' THEN 'reliable' WHEN 'B' THEN 'generally_reliable' WHEN 'C' THEN 'generally_reliable' WHEN 'F' THEN 'unknown' END AS normalized,
 CASE WHEN grade NOT IN ('A', 'B', 'C', 'F') THEN concat('grading.schemes.admiralty.', grade) END AS error FROM (SELECT s_suppkey, chr(CAST(65 + s_suppkey % 7 AS INT)) AS grade FROM supplier)
"""))
def x9(t: Inputs):
    return cl.normalize_grade(t.sql("SELECT s_suppkey, chr(CAST(65 + s_suppkey % 7 AS INT)) AS grade FROM supplier"), "admiralty")


@query("x10_node_property_claims", oracle(f"""
SELECT e.entity_id AS subject_id, 'known_as' AS predicate, CAST(NULL AS VARCHAR) AS object_id, c_mktsegment AS object_value, concat('rec_', CAST(c_nationkey AS STRING)) AS record_id,
 'confirmed' AS credibility_normalized, 'record_confirmed' AS verification_status FROM customer JOIN fx_entity e ON e.label = c_name
UNION ALL SELECT e.entity_id, 'affiliated_with', o.entity_id, CASE WHEN o.entity_id IS NULL THEN concat('Organization ', CAST(c_custkey % 9 AS STRING)) END, concat('rec_', CAST(c_nationkey AS STRING)),
 'probably_true', 'partially_corroborated' FROM customer JOIN fx_entity e ON e.label = c_name LEFT JOIN fx_entity o ON {SLUG('o.label')} = concat('organization_', CAST(c_custkey % 9 AS STRING))
"""))
def x10(t: Inputs):
    c = t.sql("SELECT c_name, c_mktsegment, concat('rec_', CAST(c_nationkey AS STRING)) AS record_id, concat('Organization ', CAST(c_custkey % 9 AS STRING)) AS org FROM customer").withColumn(
        "node_id", cl.ascii_slug(F.col("c_name"))
    )
    entities = t.entity.select(cl.ascii_slug(F.col("label")).alias("slug"), "entity_id")
    return cl.node_property_claims(
        c.select("node_id", "record_id"), c.select("node_id", F.col("c_mktsegment").alias("value")), c.select("node_id", F.col("org").alias("value")), entities
    )


SUGGESTED = """
SELECT concat('rec_', lpad(CAST(orders.o_orderkey AS STRING), 9, '0')) AS record_id, m.norm_key AS source, concat('organization_', CAST(l_suppkey % 7 AS STRING)) AS target,
 CASE l_partkey % 3 WHEN 0 THEN 'co_located_with' WHEN 1 THEN 'member_of' ELSE 'shared_a_boat_with' END AS relation,
 CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, 'SEMANTIC' AS extraction_method,
 CAST(l_shipdate AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, CAST(NULL AS STRING) AS location, CAST(NULL AS STRING) AS source_excerpt
FROM lineitem JOIN orders ON l_orderkey = orders.o_orderkey JOIN {m} m ON m.o_orderkey = orders.o_orderkey
"""


@query("x11_draft_suggestions", oracle("""
SELECT record_id, subject_ref, object_ref, raw_relation, predicate, subject_id, object_id, subject_mention_id, needs_entity, count(*) AS drafts FROM (
 SELECT DISTINCT s.record_id, s.source AS subject_ref, s.target AS object_ref, s.relation AS raw_relation, s.confidence, s.start_date,
  CASE s.relation WHEN 'co_located_with' THEN 'co_located_in_prison_with' WHEN 'member_of' THEN 'member_of' END AS predicate,
  r.entity_id AS subject_id, CAST(NULL AS VARCHAR) AS object_id, m.mention_id AS subject_mention_id, CASE WHEN r.entity_id IS NULL THEN 2 ELSE 1 END AS needs_entity
 FROM suggested s LEFT JOIN (SELECT norm_key, arg_min(entity_id, membership_id) AS entity_id FROM fx_membership b JOIN fx_mention n ON n.mention_id = b.mention_id WHERE closed_revision_id IS NULL GROUP BY norm_key) r ON r.norm_key = s.source
 LEFT JOIN (SELECT record_id, norm_key, min(mention_id) AS mention_id FROM fx_mention GROUP BY record_id, norm_key) m ON m.record_id = s.record_id AND m.norm_key = s.source)
GROUP BY record_id, subject_ref, object_ref, raw_relation, predicate, subject_id, object_id, subject_mention_id, needs_entity
""", suggested=SUGGESTED.replace("{m}", "fx_mention")))
def x11(t: Inputs):
    t.mention.createOrReplaceTempView("mentions_suggested")
    edges = t.sql(SUGGESTED.replace("{m}", "mentions_suggested"))
    mentions = t.mention.groupBy("record_id", F.col("norm_key").alias("ref")).agg(F.min("mention_id").alias("mention_id"))
    orgs = edges.select("record_id", F.col("target").alias("ref")).distinct()
    mentions = mentions.unionByName(orgs.withColumn("mention_id", F.concat_ws("_", F.lit("men"), "ref", "record_id")))
    drafts = cl.draft_suggestions(edges, mentions, cl.resolve_norm_key(t.mention, t.membership), "semantic_pass", "model-1")
    return drafts.groupBy(
        "record_id", "subject_ref", "object_ref", "raw_relation", "predicate", "subject_id", "object_id", "subject_mention_id", F.size("needs_entity").alias("needs_entity")
    ).agg(F.count(F.lit(1)).alias("drafts"))


DRAFTS = """
SELECT claim_id, subject_id, CASE WHEN claim_id LIKE '%7_1' THEN 'unheard_of' ELSE predicate END AS predicate,
 CASE WHEN claim_id LIKE '%3_2' THEN subject_id WHEN claim_id LIKE '%4_3' THEN CAST(NULL AS STRING) ELSE object_id END AS object_id, CAST(NULL AS STRING) AS object_value,
 CASE WHEN claim_id LIKE '%5_2' THEN 'rec_missing' ELSE record_id END AS record_id, CASE WHEN claim_id LIKE '%6_1' THEN 'rumoured' ELSE 'reported' END AS assertion_type,
 CASE WHEN claim_id LIKE '%1' THEN 'curated' ELSE 'semantic_llm' END AS collection_method, credibility_normalized, handling_code, valid_from,
 CASE WHEN claim_id LIKE '%2_1' THEN DATE '1900-01-01' ELSE CAST(valid_to AS DATE) END AS valid_to, subject_mention_id, CAST(NULL AS STRING) AS object_mention_id FROM {c}
"""
SUBJECT_TYPES = V.sql_values([(n, t) for n, s in V.PREDICATES.items() for t in s[0]], "st(predicate, entity_type)")
OBJECT_TYPES = V.sql_values([(n, t) for n, s in V.PREDICATES.items() for t in s[1]], "ot(predicate, entity_type)")


@query("x12_validate_claims", oracle(f"""
SELECT claim_id, array_to_string(list_filter([
 CASE WHEN NOT known THEN concat('predicates.', predicate) END, CASE WHEN s_type IS NULL THEN 'claim.subject_id' END,
 CASE WHEN known AND s_type IS NOT NULL AND NOT s_ok THEN concat('predicates.', predicate, '.subject') END, CASE WHEN object_id IS NULL THEN 'claim.object' END,
 CASE WHEN known AND object_id IS NULL THEN concat('predicates.', predicate, '.object') END, CASE WHEN known AND object_id IS NOT NULL AND o_type IS NOT NULL AND NOT o_ok THEN concat('predicates.', predicate, '.object') END,
 CASE WHEN object_id = subject_id OR (object_id IS NOT NULL AND o_type IS NULL) THEN 'claim.object_id' END, CASE WHEN assertion_type = 'rumoured' THEN 'claim.assertion_type.rumoured' END,
 CASE WHEN valid_to < valid_from THEN 'claim.valid_to' END, CASE WHEN rec IS NULL THEN 'claim.record_id' END,
 CASE WHEN assertion_type = 'reported' AND collection_method = 'semantic_llm' AND subject_mention_id IS NULL THEN 'claim.subject_mention_id' END,
 CASE WHEN assertion_type = 'reported' AND collection_method = 'semantic_llm' AND object_id IS NOT NULL THEN 'claim.object_mention_id' END], lambda x: x IS NOT NULL), ' | ') AS errors
FROM (SELECT d.*, se.entity_type AS s_type, oe.entity_type AS o_type, r.record_id AS rec, EXISTS (SELECT 1 FROM {SUBJECT_TYPES} WHERE st.predicate = d.predicate) AS known,
  EXISTS (SELECT 1 FROM {SUBJECT_TYPES} WHERE st.predicate = d.predicate AND st.entity_type = se.entity_type) AS s_ok,
  EXISTS (SELECT 1 FROM {OBJECT_TYPES} WHERE ot.predicate = d.predicate AND ot.entity_type = oe.entity_type) AS o_ok
 FROM drafts d LEFT JOIN fx_entity se ON se.entity_id = d.subject_id LEFT JOIN fx_entity oe ON oe.entity_id = d.object_id LEFT JOIN fx_record r ON r.record_id = d.record_id)
""", drafts=DRAFTS.replace("{c}", "fx_claim")))
def x12(t: Inputs):
    t.claim.createOrReplaceTempView("claims_drafted")
    drafts = t.spark.sql(DRAFTS.replace("{c}", "claims_drafted"))
    return cl.validate_claims(drafts, t.entity, t.record).select("claim_id", F.array_join("errors", " | ").alias("errors"))


@query("x13_orient_symmetric", oracle(f"""
SELECT claim_id, predicate, CASE WHEN f THEN object_id ELSE subject_id END AS subject_id, CASE WHEN f THEN subject_id ELSE object_id END AS object_id,
 CASE WHEN f THEN NULL ELSE subject_mention_id END AS subject_mention_id, CASE WHEN f THEN subject_mention_id END AS object_mention_id
FROM (SELECT *, predicate IN ({SYMMETRIC}) AND object_id < subject_id AS f FROM fx_claim)
"""))
def x13(t: Inputs):
    c = t.claim.withColumn("object_mention_id", F.lit(None).cast("string"))
    return pj.orient_symmetric(c).select("claim_id", "predicate", "subject_id", "object_id", "subject_mention_id", "object_mention_id")


REDRAFTED = """
SELECT claim_id AS draft_id, object_id AS subject_id, subject_id AS object_id, predicate, record_id, valid_from, CAST(valid_to AS DATE) AS valid_to FROM {c}
"""


@query("x14_claim_dedupe", oracle(f"""
SELECT draft_id, least(d.subject_id, d.object_id) AS low, greatest(d.subject_id, d.object_id) AS high, d.predicate FROM drafts d WHERE NOT EXISTS (SELECT 1 FROM fx_claim c WHERE c.retracted_on IS NULL AND c.predicate = d.predicate AND c.record_id = d.record_id
 AND c.valid_from IS NOT DISTINCT FROM d.valid_from AND c.valid_to IS NOT DISTINCT FROM d.valid_to
 AND ((c.subject_id = d.subject_id AND c.object_id = d.object_id) OR (c.predicate IN ({SYMMETRIC}) AND c.subject_id = d.object_id AND c.object_id = d.subject_id)))
""", drafts=REDRAFTED.replace("{c}", "fx_claim")))
def x14(t: Inputs):
    """Drafts with both ends exchanged: only the symmetric ones repeat a claim."""
    claims = t.claim
    claims.createOrReplaceTempView("claims_redrafted")
    drafts = t.spark.sql(REDRAFTED.replace("{c}", "claims_redrafted"))
    new = cl.claim_dedupe(drafts, claims)
    return new.select("draft_id", F.least("subject_id", "object_id").alias("low"), F.greatest("subject_id", "object_id").alias("high"), "predicate")


@query("x14_literal_dedupe", oracle("""
SELECT c_custkey AS draft_id, CASE WHEN c_custkey % 3 = 0 THEN 'alias' ELSE c_name END AS object_value FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0
"""))
def x14_literals(t: Inputs):
    """Literal drafts: another value of the same predicate is not a repeat, an equal one is."""
    base = "SELECT c_custkey AS draft_id, concat('ent_', CAST(c_custkey AS STRING)) AS subject_id, CAST(NULL AS STRING) AS object_id, 'known_as' AS predicate, 'rec' AS record_id, CAST(NULL AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to, "
    drafts = t.sql(base + "CASE WHEN c_custkey % 3 = 0 THEN 'alias' ELSE c_name END AS object_value FROM customer")
    claims = t.sql(base + "c_name AS object_value, CASE WHEN c_custkey % 4 = 0 THEN DATE '2020-01-01' END AS retracted_on FROM customer")
    return cl.claim_dedupe(drafts, claims.drop("draft_id")).select("draft_id", "object_value")


@query("x15_entities_for_new_mentions", oracle("""
SELECT m.mention_id, concat('ent_', substr(sha256(m.mention_id), 1, 24)) AS entity_id, 'person' AS entity_type, m.raw_text AS label, CAST(NULL AS VARCHAR) AS error
FROM (SELECT DISTINCT subject_mention_id AS mention_id FROM fx_claim WHERE subject_mention_id IS NOT NULL) d JOIN fx_mention m ON m.mention_id = d.mention_id
WHERE d.mention_id NOT IN (SELECT mention_id FROM fx_membership WHERE closed_revision_id IS NULL AND opened_revision_id > 0)
"""))
def x15(t: Inputs):
    """Mentions whose only membership is the baseline count as not adjudicated here."""
    drafts = t.claim.where("subject_mention_id IS NOT NULL").select(
        F.col("subject_mention_id").alias("mention_id"), "predicate", F.lit("subject").alias("role"), F.lit(None).cast("string").alias("requested_type")
    )
    return cl.entities_for_new_mentions(drafts, t.mention, t.active().where("opened_revision_id > 0"))


@query("x16_resolve_norm_key", oracle("""
SELECT n.norm_key, arg_min(b.entity_id, b.membership_id) AS entity_id FROM fx_membership b JOIN fx_mention n ON n.mention_id = b.mention_id WHERE b.closed_revision_id IS NULL GROUP BY n.norm_key
"""))
def x16(t: Inputs):
    return cl.resolve_norm_key(t.mention, t.membership)


@query("x17_backfill_anchors", oracle("""
SELECT c.claim_id, coalesce(c.subject_mention_id, CASE WHEN s.n = 1 THEN s.only END) AS subject_mention_id, CASE WHEN o.n = 1 THEN o.only END AS object_mention_id,
 CASE WHEN (c.subject_mention_id IS NULL AND s.n = 1) OR o.n = 1 THEN 'anchored' WHEN (c.subject_mention_id IS NULL AND s.n > 1) OR o.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome
FROM fx_claim c LEFT JOIN options s ON s.entity_id = c.subject_id AND s.record_id = c.record_id LEFT JOIN options o ON o.entity_id = c.object_id AND o.record_id = c.record_id
""", options="SELECT a.entity_id, m.record_id, count(*) AS n, min(m.mention_id) AS only FROM fx_mention m JOIN active a ON a.mention_id = m.mention_id GROUP BY a.entity_id, m.record_id"))
def x17(t: Inputs):
    return cl.backfill_anchors(t.claim, t.mention, t.active())


@query("n1_mention_keys", oracle(f"""
SELECT mention_id, {SLUG('raw_text')} AS norm_key, {SLUG('raw_text')} AS latin_key, {SLUG('raw_text')} AS script_key, 'Latn' AS script FROM fx_mention
"""))
def n1(t: Inputs):
    return names.mention_keys(t.mention.select("mention_id", "raw_text")).select("mention_id", "norm_key", "latin_key", "script_key", "script")


@query("n1_text_keys")
def n1_text(t: Inputs):
    """Keys of every distinct word of all documents: four languages, accents, marks."""
    words = t.raw("documents").select(F.explode(F.split("text", r"\s+")).alias("raw_text")).distinct()
    return names.mention_keys(words.withColumn("word", F.col("raw_text")))


@query("t1_stream_landing", oracle(LANDED_SQL))
def t1(t: Inputs):
    """The landing query over the same arrivals read as a stream."""
    table, checkpoint = scratch_path(t.spark, "landed"), scratch_path(t.spark, "landing-checkpoint")
    schema = t.raw("documents").schema
    arrivals = t.spark.readStream.schema(schema).parquet(f"{t.folder}/documents*.parquet").selectExpr(
        "source AS source_system", "concat('file_', CAST(doc_id % 5 AS STRING), '.txt') AS filename", "text", "doc_id AS arrival"
    )
    intake.stream_landing(arrivals, table, checkpoint, MAX_BYTES).awaitTermination()
    return t.spark.read.parquet(table).drop("batch_id", "bucket")


@query("t2_stream_suggestions", oracle("""
SELECT DISTINCT sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR))) AS idempotency_key, event_type, user_id FROM events
"""))
def t2(t: Inputs):
    """Each (type, user) proposal once, however often it arrives."""
    table, checkpoint = scratch_path(t.spark, "suggestions"), scratch_path(t.spark, "suggestions-checkpoint")
    arrivals = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.folder}/events*.parquet").select(
        F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("idempotency_key"), "event_type", "user_id"
    )
    intake.stream_suggestions(arrivals, table, checkpoint).awaitTermination()
    return t.spark.read.parquet(table).select("idempotency_key", "event_type", "user_id")


@query("t2_late_suggestions", oracle("""
SELECT idempotency_key, min(day) AS first_batch FROM (SELECT concat(event_type, '|', CAST(user_id AS VARCHAR)) AS idempotency_key, user_id % 7 AS day FROM events) GROUP BY idempotency_key
"""))
def t2_late(t: Inputs):
    """Seven batches over one table, the newest events first: a key that arrives late for the first time is still queued."""
    table, schema = scratch_path(t.spark, "late-suggestions"), "`idempotency_key` string, `day` bigint"
    rows = t.sql("SELECT concat(event_type, '|', CAST(user_id AS STRING)) AS idempotency_key, CAST(user_id % 7 AS BIGINT) AS day FROM events")
    for batch in range(7):
        repeats = rows.where(F.col("day") == (batch + 6) % 7)  # the previous day's rows come once more
        intake.suggestion_batch(t.spark, rows.where(F.col("day") == batch).unionByName(repeats.limit(0) if batch == 0 else repeats), batch, table, schema)
    return t.spark.read.parquet(table).select("idempotency_key", F.col("batch_id").cast("bigint").alias("first_batch"))
