"""Claim-model views over the driver tables; one SQL text each, read the same by Spark and the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")

VIEWS = {
    "fx_entity": """
SELECT concat('ent_c', lpad(CAST(c_custkey AS STRING), 9, '0')) AS entity_id, 'person' AS entity_type, c_name AS label, c_custkey AS num FROM customer
UNION ALL SELECT DISTINCT concat('ent_o', CAST(s_suppkey % 7 AS STRING)), 'organization', concat('Organization ', CAST(s_suppkey % 7 AS STRING)), CAST(NULL AS BIGINT) FROM supplier
""",
    "fx_source": """
SELECT concat('src_', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS source_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'reliable' WHEN 1 THEN 'generally_reliable' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unreliable' END AS reliability_normalized, n_nationkey FROM nation
""",
    "fx_record": """
SELECT concat('rec_', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS record_id, concat('src_', lpad(CAST(c_nationkey AS STRING), 2, '0')) AS source_id, CASE o_orderkey % 10 WHEN 9 THEN 'sensitive' WHEN 8 THEN 'restricted' ELSE 'open' END AS handling_code, CASE WHEN o_orderkey % 40 = 0 THEN 'quarantined' ELSE 'landed' END AS status, o_orderdate AS received_at, o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_mention": """
SELECT concat('men_', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS mention_id, concat('rec_', lpad(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE min(o_orderkey) OVER (PARTITION BY o_custkey) END AS STRING), 9, '0')) AS record_id, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE replace(c_name, '#', ' no. ') END AS raw_text, CASE o_orderkey % 3 WHEN 2 THEN replace(lower(c_name), '#', '_no_') ELSE replace(lower(c_name), '#', '_') END AS norm_key, o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_decision": """
SELECT concat('dec_', CAST(r AS STRING)) AS decision_id, kind, r AS result_revision_id, subject_num FROM (
 SELECT 'confirm' AS kind, CAST(c_custkey AS BIGINT) AS r, c_custkey AS subject_num FROM customer WHERE c_custkey % 10 = 7
 UNION ALL SELECT 'split', CAST(c_custkey + 100000000 AS BIGINT), c_custkey FROM customer WHERE c_custkey % 30 = 7
 UNION ALL SELECT 'merge', CAST(c_custkey + 200000000 AS BIGINT), c_custkey FROM customer WHERE c_custkey % 20 = 6) d
""",
    "fx_membership": """
WITH b AS (SELECT concat('men_', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS mention_id, o_custkey AS k FROM orders),
 ev AS (
  SELECT mention_id, k, k AS ent, CAST(0 AS BIGINT) AS rev FROM b
  UNION ALL SELECT mention_id, k, k - 1, CAST(k AS BIGINT) FROM b WHERE k % 10 = 7
  UNION ALL SELECT mention_id, k, k, CAST(k + 100000000 AS BIGINT) FROM b WHERE k % 30 = 7
  UNION ALL SELECT mention_id, k, k - 1, CAST(k + 200000000 AS BIGINT) FROM b WHERE k % 20 = 6
  UNION ALL SELECT mention_id, k, k - 2, CAST(k - 1 + 200000000 AS BIGINT) FROM b WHERE k % 20 = 7 AND k % 30 <> 7)
SELECT concat('mem_', substr(mention_id, 5, 9), '_', CAST(rev AS STRING)) AS membership_id, mention_id, concat('ent_c', lpad(CAST(ent AS STRING), 9, '0')) AS entity_id, rev AS opened_revision_id, lead(rev) OVER (PARTITION BY mention_id ORDER BY rev) AS closed_revision_id FROM ev
""",
    "fx_claim": """
SELECT concat('clm_', lpad(CAST(l_orderkey AS STRING), 9, '0'), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS claim_id, concat('ent_c', lpad(CAST(o_custkey AS STRING), 9, '0')) AS subject_id,
 CASE l_partkey % 4 WHEN 0 THEN 'member_of' WHEN 1 THEN 'founded' WHEN 2 THEN 'foreign_contact_of' ELSE 'allied_with' END AS predicate,
 CASE WHEN l_partkey % 4 = 3 THEN concat('ent_c', lpad(CAST(abs(o_custkey - 1 - l_suppkey % 3) AS STRING), 9, '0')) ELSE concat('ent_o', CAST(l_suppkey % 7 AS STRING)) END AS object_id,
 CASE WHEN l_linenumber < 4 THEN concat('men_', lpad(CAST(l_orderkey AS STRING), 9, '0')) END AS subject_mention_id,
 concat('rec_', lpad(CAST(l_orderkey AS STRING), 9, '0')) AS record_id,
 CASE l_linenumber % 6 WHEN 0 THEN 'cannot_judge' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'probably_true' WHEN 3 THEN 'possibly_true' WHEN 4 THEN 'doubtful' ELSE 'improbable' END AS credibility_normalized,
 CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'N' THEN 'restricted' ELSE 'sensitive' END AS handling_code,
 CASE WHEN l_orderkey % 50 = 0 THEN concat('cas_', CAST(l_orderkey % 3 AS STRING)) END AS case_id,
 CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS valid_from,
 CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 30 AS INT) END AS valid_to,
 CAST(o_orderdate AS DATE) AS recorded_on, CASE WHEN l_partkey % 20 = 0 THEN CAST(l_shipdate AS DATE) + 90 END AS retracted_on
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey % 4 <> 3 OR abs(o_custkey - 1 - l_suppkey % 3) <> o_custkey
""",
    "fx_relation": """
SELECT a.l_orderkey, concat('clm_', lpad(CAST(a.l_orderkey AS STRING), 9, '0'), '_', CAST(a.l_linenumber AS STRING), '_', CAST(a.l_partkey AS STRING), '_', CAST(CAST(round(a.l_extendedprice * 100) AS BIGINT) AS STRING)) AS from_claim, concat('clm_', lpad(CAST(b.l_orderkey AS STRING), 9, '0'), '_', CAST(b.l_linenumber AS STRING), '_', CAST(b.l_partkey AS STRING), '_', CAST(CAST(round(b.l_extendedprice * 100) AS BIGINT) AS STRING)) AS to_claim, CASE WHEN a.l_returnflag = b.l_returnflag THEN 'corroborates' ELSE 'contradicts' END AS relation FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
""",
    "fx_stay": """
SELECT concat('stay_', lpad(CAST(l_orderkey AS STRING), 9, '0'), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING), '_', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS stay_id, o_custkey AS person, concat('Facility ', CAST(l_suppkey AS STRING)) AS facility, CAST(l_shipdate AS DATE) AS start_date, CASE WHEN l_partkey % 100 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS end_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "fx_raw": """
SELECT source AS source_system, concat('file_', CAST(doc_id % 5 AS STRING), '.txt') AS filename, text, doc_id AS arrival FROM documents
""",
    "fx_custody": """
SELECT concat('evd_', CAST(o_custkey AS STRING)) AS evidence_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CASE WHEN o_orderkey % 97 = 0 THEN 'user:tampered' ELSE lag(concat('user:', CAST(o_orderkey % 5 AS STRING))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS from_actor, concat('user:', CAST(o_orderkey % 5 AS STRING)) AS to_actor, o_orderdate AS occurred_at FROM orders
""",
    "fx_er_scalars": """
SELECT c_custkey AS unique_id, concat(substr(md5(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)), 1, 5), '_', substr(md5(CAST(c_custkey % 3 AS STRING)), 1, 4)) AS latin_key, substr(md5(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)), 1, 5) AS phonetic_key, CASE WHEN c_custkey % 3 <> 0 THEN concat('alias_', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING)) END AS alias_key, CASE WHEN c_custkey % 5 <> 0 THEN concat('org_', CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS STRING)) END AS affiliation_key, CASE WHEN c_custkey % 7 <> 0 THEN DATE '1970-01-01' + CAST(floor(c_custkey / 2) % 9000 AS INT) END AS date_of_birth FROM customer
""",
    "fx_identifier": """
SELECT concat('men_', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS mention_id, concat('clm_id_', CAST(o_orderkey AS STRING)) AS claim_id, 'has_nic' AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN concat('id-', CAST(o_custkey AS STRING)) ELSE concat('ID - ', CAST(o_custkey AS STRING)) END AS value, CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS jurisdiction, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS valid_to FROM orders WHERE o_orderkey % 4 < 2
""",
}


class Tables:
    """Lazy access to the driver tables of one folder and to the views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[f"fx_{name}"])

    def sql(self, text: str) -> DataFrame:
        """Run ``text`` with the driver tables it names bound as views."""
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self.raw(table).createOrReplaceTempView(table)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.view(name)
        raise AttributeError(name)


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """SQL text for the checking engine: the named views as CTEs in front of ``body``."""
    body = body.strip()
    if body[:5].upper() == "WITH ":
        rest = ", " + body[5:]
    else:
        rest = " " + body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"fx_{n} AS ({VIEWS['fx_' + n].strip()})" for n in names) + rest
