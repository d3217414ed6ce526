"""Drafts are grouped by what they say; neither texts nor keys of drafts are shuffled."""

from proofweave.operators import claims as cl


def test_equal_proposals_are_one_draft_and_payloads_are_not_shuffled(spark):
    rows = [
        ("r1", "a", "x", "member_of", "EXTRACTED"), ("r1", "a", "x", "member_of", "EXTRACTED"), ("r1", "a", "y", "member_of", "EXTRACTED"),
        ("r1", "a", "x", "unheard_of", "EXTRACTED"), ("r1", "a", "x", "heard_of", "EXTRACTED"), ("r2", "a", "x", "member_of", "INFERRED"),
    ]
    edges = spark.createDataFrame(rows, "record_id string, source string, target string, relation string, confidence string").selectExpr(
        "*", "'SEMANTIC' AS extraction_method", "DATE '2000-01-01' AS start_date", "CAST(NULL AS DATE) AS end_date", "CAST(NULL AS STRING) AS location", "CAST(NULL AS STRING) AS source_excerpt"
    )
    mentions = spark.createDataFrame([("r1", "a", "m1")], "record_id string, ref string, mention_id string")
    resolved = spark.createDataFrame([("a", "e1")], "norm_key string, entity_id string")
    drafts = cl.draft_suggestions(edges, mentions, resolved, "p", "1")
    plan = drafts._jdf.queryExecution().optimizedPlan().toString()
    # the key's hash stands above the grouping, which shuffles
    assert plan.rindex("sha2(") < plan.index("Aggregate")
    got = sorted((r["record_id"], r["object_ref"], r["raw_relation"], r["subject_mention_id"], tuple(r["needs_entity"])) for r in drafts.collect())
    # an unresolved object leaves no trace in the proposal: x and y are one draft, and so are both unknown relations
    assert got == [("r1", "x", "heard_of", "m1", ("x",)), ("r1", "x", "member_of", "m1", ("x",)), ("r2", "x", "member_of", None, ("x",))]
    assert drafts.select("idempotency_key").distinct().count() == 3
