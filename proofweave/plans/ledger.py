"""Registered queries: identity ledger and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import ascii_key
from ..operators import identity as idn
from ..operators import resolution as er
from ..sources.views import with_views
from .registry import Inputs, oracle, query

AS_OF = 100_000_000


@query("i1_membership_as_of", oracle(f"""
SELECT membership_id, mention_id, entity_id FROM fx_membership WHERE opened_revision_id <= {AS_OF} AND (closed_revision_id IS NULL OR closed_revision_id > {AS_OF})
"""))
def i1(t: Inputs):
    return idn.membership_as_of(t.membership, AS_OF).select("membership_id", "mention_id", "entity_id")


@query("i1_membership_now", oracle("SELECT membership_id, mention_id, entity_id FROM fx_membership WHERE closed_revision_id IS NULL"))
def i1_now(t: Inputs):
    return t.active().select("membership_id", "mention_id", "entity_id")


@query("i2_lineage_replay", oracle("SELECT entity_id, parent_id FROM lineage"))
def i2(t: Inputs):
    return t.lineage()


@query("i3_canonical_map", oracle("""
SELECT entity_id, canonical_entity_id, (SELECT max(opened_revision_id) FROM fx_membership) AS at_revision_id FROM canon
"""))
def i3(t: Inputs):
    return t.build_canonical()


@query("i4_tombstones", oracle("""
SELECT entity_id, entity_id = canonical_entity_id AND entity_id NOT IN (SELECT entity_id FROM active) AS tombstoned FROM canon
"""))
def i4(t: Inputs):
    return idn.tombstones(t.canonical(), t.membership)


PENDING = "SELECT concat('pend_', decision_id) AS decision_id, result_revision_id AS parent_revision_id, concat('ent_c', lpad(CAST(subject_num AS STRING), 9, '0')) AS entity_id FROM {d}"


@query("i5_stale_scope", oracle("""
SELECT DISTINCT p.decision_id, d.decision_id AS intervening_decision_id, d.kind, d.result_revision_id FROM pending p
JOIN (SELECT * FROM gained UNION SELECT * FROM closed) m ON m.entity_id = p.entity_id AND m.rev > p.parent_revision_id JOIN fx_decision d ON d.result_revision_id = m.rev
""", pending=PENDING.replace("{d}", "fx_decision")))
def i5(t: Inputs):
    t.decision.createOrReplaceTempView("decisions_pending")
    pending = t.spark.sql(PENDING.replace("{d}", "decisions_pending"))
    return idn.stale_scope(pending, t.membership, t.decision)


def _batch(t: Inputs):
    """Candidates from mentions sharing a normalized key across neighbouring records of one customer."""
    m = t.sql(
        "SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS other FROM orders"
    ).where("other IS NOT NULL")
    men = lambda c: F.concat(F.lit("men_"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return m.select(
        F.concat(F.lit("cnd_"), F.col("o_orderkey").cast("string")).alias("candidate_id"), F.col("o_orderkey").alias("position"), men("o_orderkey").alias("mention_a"), men("other").alias("mention_b"),
        (F.col("o_orderkey") % 9 != 0).alias("pre_verified"), F.when(F.col("o_orderkey") % 10 == 0, "confirmed").otherwise("open").alias("disposition"),
    )


@query("i6_batch_confirm")
def i6(t: Inputs):
    return idn.batch_confirm(_batch(t), t.membership, 400_000_000).select("candidate_id", "position", "entity_a", "entity_b", "confirmed", "reason")


SPLITS = (
    "SELECT decision_id, concat('ent_c', lpad(CAST(subject_num - 1 AS STRING), 9, '0')) AS entity_id, concat('ent_c', lpad(CAST(subject_num AS STRING), 9, '0')) AS new_entity_id "
    "FROM {d} WHERE kind = 'split'"
)
FOUND = """SELECT DISTINCT s.decision_id, s.entity_id, s.new_entity_id, c.claim_id FROM splits s JOIN
 (SELECT decision_id, entity_id AS named FROM splits UNION SELECT s.decision_id, c.entity_id FROM splits s JOIN canon c ON c.canonical_entity_id = s.entity_id) n ON n.decision_id = s.decision_id
 JOIN fx_claim c ON c.retracted_on IS NULL AND ((c.subject_id = n.named AND c.subject_mention_id IS NULL) OR c.object_id = n.named)"""


def _splits(t: Inputs):
    t.decision.createOrReplaceTempView("decisions_split")
    return t.spark.sql(SPLITS.replace("{d}", "decisions_split"))


@query("i7_unattributable_claims", oracle("SELECT decision_id, claim_id FROM found", found=FOUND, splits=SPLITS.replace("{d}", "fx_decision")))
def i7(t: Inputs):
    return idn.unattributable_claims(_splits(t), t.claim, t.canonical()).select("decision_id", "claim_id")


@query("i8_reattribution_drafts", oracle("""
SELECT f.decision_id, f.claim_id AS supersedes, CASE WHEN on_subject THEN f.new_entity_id ELSE f.subject_id END AS subject_id, f.predicate,
 CASE WHEN NOT on_subject AND o_root = f.entity_id THEN f.new_entity_id ELSE f.object_id END AS object_id, f.record_id
FROM (SELECT f.*, c.subject_id, c.object_id, c.predicate, c.record_id, coalesce(ko.canonical_entity_id, c.object_id) AS o_root,
  coalesce(ks.canonical_entity_id, c.subject_id) = f.entity_id AND c.subject_mention_id IS NULL AS on_subject
 FROM found f JOIN fx_claim c ON c.claim_id = f.claim_id LEFT JOIN canon ks ON ks.entity_id = c.subject_id LEFT JOIN canon ko ON ko.entity_id = c.object_id) f
""", found=FOUND, splits=SPLITS.replace("{d}", "fx_decision")))
def i8(t: Inputs):
    found = idn.unattributable_claims(_splits(t), t.claim, t.canonical())
    return idn.reattribution_drafts(found, t.claim, t.canonical())


REJECTED = """
SELECT concat('neg_', CAST(o_orderkey AS STRING)) AS constraint_id, concat('m', CAST(o_custkey AS STRING)) AS mention_1, concat('m', CAST(o_custkey - o_orderkey % 2 AS STRING)) AS mention_2, o_orderkey AS decided_revision_id FROM orders
"""
CHAIN = """
SELECT constraint_id, mention_a, mention_b, row_number() OVER (PARTITION BY mention_a, mention_b ORDER BY decided_revision_id) AS version,
 lead(constraint_id) OVER (PARTITION BY mention_a, mention_b ORDER BY decided_revision_id) AS superseded_by
FROM (SELECT *, least(mention_1, mention_2) AS mention_a, greatest(mention_1, mention_2) AS mention_b FROM rejected)
"""


@query("i9_supersede_constraints", oracle(CHAIN, rejected=REJECTED))
def i9(t: Inputs):
    return idn.supersede_constraints(t.sql(REJECTED))


@query("i9_active_constraints", oracle("SELECT constraint_id, mention_a, mention_b, version FROM chain WHERE superseded_by IS NULL", chain=CHAIN, rejected=REJECTED))
def i9_active(t: Inputs):
    return idn.active_constraints(idn.supersede_constraints(t.sql(REJECTED))).drop("superseded_by")


@query("i10_identity_history", oracle("""
SELECT t.asked_id, d.decision_id, d.kind, d.result_revision_id, coalesce(o.entity_id, '') AS entity_id FROM
 (SELECT DISTINCT s.asked_id, m.rev FROM scope s JOIN (SELECT * FROM gained UNION SELECT * FROM closed) m ON m.entity_id = s.entity_id) t
 JOIN fx_decision d ON d.result_revision_id = t.rev LEFT JOIN (SELECT s.asked_id, g.rev, min(g.entity_id) AS entity_id FROM scope s JOIN gained g ON g.entity_id = s.entity_id GROUP BY s.asked_id, g.rev) o
 ON o.asked_id = t.asked_id AND o.rev = t.rev
""", scope="SELECT e.entity_id AS asked_id, k.entity_id FROM fx_entity e JOIN canon c ON c.entity_id = e.entity_id JOIN canon k ON k.canonical_entity_id = c.canonical_entity_id UNION SELECT entity_id, canonical_entity_id FROM canon"))
def i10(t: Inputs):
    return idn.identity_history(t.entity, t.canonical(), t.membership, t.decision)


@query("e1_identifier_pairs", oracle("""
SELECT a.mention_id AS mention_a, b.mention_id AS mention_b, a.predicate, least(a.claim_id, b.claim_id) AS claim_low, greatest(a.claim_id, b.claim_id) AS claim_high, coalesce(a.jurisdiction, b.jurisdiction) AS jurisdiction
FROM fx_identifier a JOIN fx_identifier b ON upper(regexp_replace(a.value, '\\s+', '', 'g')) = upper(regexp_replace(b.value, '\\s+', '', 'g')) AND a.predicate = b.predicate AND a.mention_id < b.mention_id
WHERE coalesce(a.jurisdiction = b.jurisdiction, TRUE) AND NOT coalesce(a.valid_to < b.valid_from, FALSE) AND NOT coalesce(b.valid_to < a.valid_from, FALSE)
"""))
def e1(t: Inputs):
    return er.identifier_pairs(t.identifier)


@query("e1_suppressed_conflicts", oracle("""
SELECT a.predicate, count(*) FILTER (WHERE NOT coalesce(a.jurisdiction = b.jurisdiction, TRUE) OR coalesce(a.valid_to < b.valid_from, FALSE) OR coalesce(b.valid_to < a.valid_from, FALSE)) AS suppressed_conflict
FROM fx_identifier a JOIN fx_identifier b ON upper(regexp_replace(a.value, '\\s+', '', 'g')) = upper(regexp_replace(b.value, '\\s+', '', 'g')) AND a.predicate = b.predicate AND a.mention_id < b.mention_id GROUP BY a.predicate
"""))
def e1_suppressed(t: Inputs):
    observed = t.identifier
    return er.suppressed_conflicts(observed, er.identifier_pairs(observed))


@query("e2_same_key_pairs", oracle("""
SELECT a.record_id, a.norm_key, a.mention_id AS mention_a, b.mention_id AS mention_b FROM fx_mention a JOIN fx_mention b ON a.record_id = b.record_id AND a.norm_key = b.norm_key AND a.mention_id < b.mention_id
"""))
def e2(t: Inputs):
    return er.same_key_pairs(t.mention)


@query("e3_feature_frame", oracle("""
SELECT m.mention_id AS unique_id, a.entity_id, trim(regexp_replace(lower(m.raw_text), '[^a-z0-9]+', '_', 'g'), '_') AS latin_key, m.norm_key FROM fx_mention m JOIN active a ON a.mention_id = m.mention_id
"""))
def e3(t: Inputs):
    keyed = t.mention.select("mention_id", "norm_key", ascii_key(F.col("raw_text")).alias("latin_key"))
    return er.feature_frame(keyed, t.active()).select("unique_id", "entity_id", "latin_key", "norm_key")


@query("e3_entity_features", oracle("""
SELECT DISTINCT subject_id AS entity_id, 'associate' AS kind, object_id AS value FROM fx_claim WHERE retracted_on IS NULL
UNION SELECT DISTINCT object_id, 'associate', subject_id FROM fx_claim WHERE retracted_on IS NULL
"""))
def e3_features(t: Inputs):
    return er.entity_features(t.claim, F.col("value"), F.col("value"))


LANES = ", '|', ".join(f"CAST(sum(CAST(CAST(concat('0x', substr(h, {1 + 15 * i}, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query("e4_snapshot_digest", oracle(f"""
SELECT count(*) AS edges, concat('sha256:', substr(sha256(concat({LANES})), 1, 32)) AS graph_snapshot_id FROM
 (SELECT sha256(concat_ws('|', subject_id, object_id, predicate)) AS h FROM fx_claim WHERE object_id IS NOT NULL AND retracted_on IS NULL)
"""))
def e4(t: Inputs):
    return er.snapshot_digest(t.claim)


# script keys and associates are absent from this view; both comparisons then take their lowest or missing level
def frame(t: Inputs):
    s = t.er_scalars
    f = s.select(
        F.lpad(F.col("unique_id").cast("string"), 9, "0").alias("unique_id"), F.concat(F.lit("e"), F.col("unique_id").cast("string")).alias("entity_id"), "latin_key",
        F.lit(None).cast("string").alias("script_key"), "phonetic_key", "date_of_birth",
    )
    one = lambda kind, c: s.where(f"{c} IS NOT NULL").select(F.concat(F.lit("e"), F.col("unique_id").cast("string")).alias("entity_id"), F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return f, one("alias", "alias_key").unionByName(one("affiliation", "affiliation_key"))


BLOCKED = """SELECT a.id AS id_a, b.id AS id_b FROM er a JOIN er b ON a.id < b.id AND a.phonetic_key = b.phonetic_key
UNION SELECT a.id, b.id FROM er a JOIN er b ON a.id < b.id AND substr(a.latin_key, 1, 4) = substr(b.latin_key, 1, 4)
UNION SELECT a.id, b.id FROM er a JOIN er b ON a.id < b.id AND a.affiliation_key = b.affiliation_key"""
ER = "SELECT *, lpad(CAST(unique_id AS STRING), 9, '0') AS id FROM fx_er_scalars"
COMPARED = """SELECT p.id_a, p.id_b, CASE WHEN a.latin_key = b.latin_key THEN 3 WHEN jaro_winkler_similarity(a.latin_key, b.latin_key) >= 0.92 THEN 2 WHEN jaro_winkler_similarity(a.latin_key, b.latin_key) >= 0.85 THEN 1 ELSE 0 END AS gamma_name,
 CASE WHEN a.alias_key = b.alias_key THEN 1 ELSE 0 END AS gamma_alias, CASE WHEN a.affiliation_key = b.affiliation_key THEN 1 ELSE 0 END AS gamma_affiliation, 0 AS gamma_associate,
 CASE WHEN a.date_of_birth IS NULL OR b.date_of_birth IS NULL THEN -1 WHEN a.date_of_birth = b.date_of_birth THEN 1 ELSE 0 END AS gamma_birth
FROM blocked p JOIN er a ON a.id = p.id_a JOIN er b ON b.id = p.id_b"""
_bf = lambda column, levels: f"CASE {column} " + " ".join(f"WHEN {g} THEN {m}::DOUBLE / {u}::DOUBLE" for g, (m, u) in levels.items()) + " ELSE 1.0 END"
SCORED = (
    "SELECT *, odds / (1 + odds) AS p FROM (SELECT *, (0.0001::DOUBLE / 0.9999::DOUBLE) * "
    + " * ".join(_bf(f"gamma_{n}", levels) for n, levels in er.COMPARISONS.items())
    + " AS odds FROM compared)"
)
FRAGMENTS = dict(er=ER, blocked=BLOCKED, compared=COMPARED, scored=SCORED)


@query("e5_block_pairs", oracle("SELECT id_a, id_b FROM blocked", **FRAGMENTS))
def e5(t: Inputs):
    return er.block_pairs(*frame(t))


@query("e6_compare_pairs", oracle("SELECT * FROM compared", **FRAGMENTS))
def e6(t: Inputs):
    f, features = frame(t)
    return er.compare_pairs(er.block_pairs(f, features), f, features).drop("entity_a", "entity_b")


@query("e7_score_pairs", oracle("SELECT id_a, id_b, round(p, 6) AS probability FROM scored", **FRAGMENTS))
def e7(t: Inputs):
    f, features = frame(t)
    scored = er.score_pairs(er.compare_pairs(er.block_pairs(f, features), f, features))
    return scored.select("id_a", "id_b", F.round("probability", 6).alias("probability"))


def scored_above(t: Inputs):
    f, features = frame(t)
    return er.score_pairs(er.compare_pairs(er.pairs_above(f, features), f, features)).withColumnsRenamed({"id_a": "mention_a", "id_b": "mention_b"})


# --- a run over entities of one or two mentions, with features stated as claims ---------------------------------------

ER_OWNER = "CASE WHEN unique_id % 10 < 2 THEN CAST(CAST(floor(unique_id / 10) AS BIGINT) AS STRING) ELSE lpad(CAST(unique_id AS STRING), 9, '0') END"
ER_STATED = f"""SELECT concat('k', CAST(unique_id AS STRING)) AS claim_id, {ER_OWNER} AS subject_id, 'known_as' AS predicate, CAST(NULL AS STRING) AS object_id, alias_key AS object_value FROM fx_er_scalars
UNION ALL SELECT concat('a', CAST(unique_id AS STRING)), {ER_OWNER}, 'affiliated_with', CAST(NULL AS STRING), affiliation_key FROM fx_er_scalars
UNION ALL SELECT concat('b', CAST(unique_id AS STRING)), {ER_OWNER}, 'born_on', CAST(NULL AS STRING), CAST(date_of_birth AS STRING) FROM fx_er_scalars
UNION ALL SELECT concat('l', CAST(unique_id AS STRING)), {ER_OWNER}, 'allied_with', {ER_OWNER.replace("unique_id", "(unique_id + 3)")}, CAST(NULL AS STRING) FROM fx_er_scalars WHERE unique_id % 4 = 0"""
FEATURE_ROWS = """SELECT DISTINCT subject_id AS entity_id, 'alias' AS kind, object_value AS value FROM stated WHERE predicate = 'known_as' AND object_value IS NOT NULL
UNION SELECT DISTINCT subject_id, 'affiliation', object_value FROM stated WHERE predicate = 'affiliated_with' AND object_value IS NOT NULL
UNION SELECT DISTINCT subject_id, 'associate', object_id FROM stated WHERE object_id IS NOT NULL UNION SELECT DISTINCT object_id, 'associate', subject_id FROM stated WHERE object_id IS NOT NULL"""
BIRTH_ROWS = "SELECT subject_id AS entity_id, min(object_value) AS date_of_birth FROM stated WHERE predicate = 'born_on' AND object_value IS NOT NULL GROUP BY subject_id HAVING min(object_value) = max(object_value)"
RUN_FRAGMENTS = {
    "stated": ER_STATED,
    "features": FEATURE_ROWS,
    "births": BIRTH_ROWS,
    "lists": "SELECT entity_id, string_agg(value, '|' ORDER BY value) AS list FROM features WHERE kind = 'affiliation' GROUP BY entity_id",
    "owned": f"SELECT s.*, b.date_of_birth AS born, coalesce(l.list, '') AS list FROM (SELECT unique_id, lpad(CAST(unique_id AS STRING), 9, '0') AS id, latin_key, phonetic_key, {ER_OWNER} AS entity_id FROM fx_er_scalars) s"
             " LEFT JOIN births b ON b.entity_id = s.entity_id LEFT JOIN lists l ON l.entity_id = s.entity_id",
    "blocked": """SELECT a.id AS id_a, b.id AS id_b FROM owned a JOIN owned b ON a.id < b.id AND a.phonetic_key = b.phonetic_key
UNION SELECT a.id, b.id FROM owned a JOIN owned b ON a.id < b.id AND substr(a.latin_key, 1, 4) = substr(b.latin_key, 1, 4)
UNION SELECT a.id, b.id FROM owned a JOIN owned b ON a.id < b.id AND a.list = b.list""",
    "shared": "SELECT a.entity_id AS ea, b.entity_id AS eb, count(*) FILTER (WHERE kind = 'alias') AS s_alias, count(*) FILTER (WHERE kind = 'affiliation') AS s_affiliation, count(*) FILTER (WHERE kind = 'associate') AS s_associate"
              " FROM features a JOIN features b USING (kind, value) GROUP BY a.entity_id, b.entity_id",
    "compared": """SELECT p.id_a, p.id_b, a.entity_id AS ea, b.entity_id AS eb, a.unique_id AS ua, b.unique_id AS ub,
 CASE WHEN a.latin_key = b.latin_key THEN 3 WHEN jaro_winkler_similarity(a.latin_key, b.latin_key) >= 0.92 THEN 2 WHEN jaro_winkler_similarity(a.latin_key, b.latin_key) >= 0.85 THEN 1 ELSE 0 END AS gamma_name,
 least(coalesce(s_alias, 0), 1) AS gamma_alias, least(coalesce(s_affiliation, 0), 1) AS gamma_affiliation, least(coalesce(s_associate, 0), 2) AS gamma_associate,
 CASE WHEN a.born IS NULL OR b.born IS NULL THEN -1 WHEN a.born = b.born THEN 1 ELSE 0 END AS gamma_birth
FROM blocked p JOIN owned a ON a.id = p.id_a JOIN owned b ON b.id = p.id_b LEFT JOIN shared s ON s.ea = a.entity_id AND s.eb = b.entity_id""",
    "scored": SCORED,
    "outcomes": """SELECT *, CASE WHEN p < 0.8 THEN 'below_threshold' WHEN ea = eb THEN 'same_entity' WHEN ua % 7 = 0 AND ub = ua + 1 THEN 'suppressed_constraint' WHEN ua % 11 = 0 AND ub = ua + 1 THEN 'already_open' ELSE 'emitted' END AS outcome FROM scored""",
}


def stated(t: Inputs):
    return t.sql(with_views(ER_STATED, "er_scalars")).withColumn("retracted_on", F.lit(None).cast("date"))


def run_frame(t: Inputs):
    """Frame and features of the run: two mentions of every tenth entity, everything else from claims."""
    claims = stated(t)
    mentions = t.er_scalars.select(F.lpad(F.col("unique_id").cast("string"), 9, "0").alias("mention_id"), "latin_key", "phonetic_key")
    active = t.er_scalars.select(F.lpad(F.col("unique_id").cast("string"), 9, "0").alias("mention_id"), F.expr(ER_OWNER).alias("entity_id"))
    frame = er.feature_frame(mentions, active, er.birth_dates(claims)).withColumn("script_key", F.lit(None).cast("string"))
    return frame, er.entity_features(claims, F.col("value"), F.col("value"))


def run_judged(t: Inputs):
    frame, features = run_frame(t)
    pairs = er.pairs_above(frame, features, whole_lists=True)
    scored = er.score_pairs(er.compare_pairs(pairs, frame, features)).withColumnsRenamed({"id_a": "mention_a", "id_b": "mention_b"})
    ids = t.er_scalars.select("unique_id", F.lpad(F.col("unique_id").cast("string"), 9, "0").alias("mention_a"), F.lpad((F.col("unique_id") + 1).cast("string"), 9, "0").alias("mention_b"))
    active = frame.select(F.col("unique_id").alias("mention_id"), "entity_id")
    judged = er.judge_candidates(scored, active, ids.where("unique_id % 7 = 0").drop("unique_id"), ids.where("unique_id % 11 = 0").drop("unique_id"))
    return frame, features, judged


@query("e3_stated_features", oracle("SELECT entity_id, kind, value FROM features", **RUN_FRAGMENTS))
def e3_stated(t: Inputs):
    """Aliases, affiliations and associates of entities, from claims."""
    return run_frame(t)[1]


@query("e3_birth_frame", oracle("SELECT id AS unique_id, entity_id, latin_key, born AS date_of_birth FROM owned", **RUN_FRAGMENTS))
def e3_births(t: Inputs):
    """The frame with the one stated date of birth of each entity; entities with several dates have none."""
    return run_frame(t)[0].select("unique_id", "entity_id", "latin_key", "date_of_birth")


@query("e8_emit_candidates", oracle("SELECT id_a AS mention_a, id_b AS mention_b, round(p, 6) AS probability, outcome FROM outcomes WHERE outcome NOT IN ('below_threshold', 'same_entity')", **RUN_FRAGMENTS))
def e8(t: Inputs):
    """Only pairs of different entities that can reach the threshold are generated; the ones that do are judged."""
    judged = run_judged(t)[2]
    return judged.where("outcome <> 'below_threshold'").select("mention_a", "mention_b", F.round("probability", 6).alias("probability"), "outcome")


@query("e8_outcome_counters", oracle("""
SELECT count(*) AS compared, count(*) FILTER (WHERE outcome = 'below_threshold') AS below_threshold, count(*) FILTER (WHERE outcome = 'same_entity') AS same_entity,
 count(*) FILTER (WHERE outcome = 'suppressed_constraint') AS suppressed_constraint, count(*) FILTER (WHERE outcome = 'already_open') AS already_open, count(*) FILTER (WHERE outcome = 'emitted') AS emitted FROM outcomes
""", **RUN_FRAGMENTS))
def e8_counters(t: Inputs):
    """All counters of the run; pairs below the threshold and inside an entity are counted, not listed."""
    return er.run_report(*run_judged(t))


@query("e9_evaluate_er", oracle("""
SELECT *, rule_pairwise_precision >= 0.95 AND transliteration_pairwise_recall >= 0.70 AND review_load_per_1000_mentions <= 50 AS passed FROM (
SELECT (SELECT count(*) FROM er) AS mention_count, (SELECT count(*) FROM rule WHERE ta = tb) AS rule_true_positives, (SELECT count(*) FROM rule WHERE ta <> tb) AS rule_false_positives,
 (SELECT count(*) FROM near n JOIN scored s ON s.id_a = n.id_a AND s.id_b = n.id_b WHERE s.p >= 0.8) AS transliteration_true_positives, (SELECT count(*) FROM near) AS transliteration_pairs,
 (SELECT count(*) FROM queued) AS emitted_candidate_pairs, (SELECT count(*) FROM queued q WHERE CAST(id_b AS BIGINT) = CAST(id_a AS BIGINT) + 1 AND CAST(id_a AS BIGINT) % 2 = 1) AS distinct_pairs_emitted,
 round((SELECT count(*) FROM rule WHERE ta = tb) / (SELECT count(*) FROM rule), 6) AS rule_pairwise_precision,
 round((SELECT count(*) FROM near n JOIN scored s ON s.id_a = n.id_a AND s.id_b = n.id_b WHERE s.p >= 0.8) / (SELECT count(*) FROM near), 6) AS transliteration_pairwise_recall,
 round((SELECT count(*) FROM queued) * 1000.0 / (SELECT count(*) FROM er), 6) AS review_load_per_1000_mentions)
""", rule="SELECT a.id AS id_a, b.id AS id_b, floor(a.unique_id / 2) AS ta, floor(b.unique_id / 2) AS tb FROM er a JOIN er b ON a.id < b.id AND upper(a.phonetic_key) = upper(b.phonetic_key)",
   near="SELECT a.id AS id_a, b.id AS id_b FROM er a JOIN er b ON b.unique_id = a.unique_id + 1 AND a.unique_id % 2 = 0",
   queued="SELECT id_a, id_b FROM rule UNION SELECT id_a, id_b FROM scored WHERE p >= 0.8 UNION SELECT a.id, b.id FROM er a JOIN er b ON a.id < b.id AND a.affiliation_key = b.affiliation_key AND a.alias_key = b.alias_key",
   **FRAGMENTS))
def e9(t: Inputs):
    s = t.er_scalars.withColumn("mention_id", F.lpad(F.col("unique_id").cast("string"), 9, "0"))
    observed = s.select("mention_id", F.concat(F.lit("c"), "mention_id").alias("claim_id"), F.lit("has_nic").alias("predicate"), F.col("phonetic_key").alias("value"), F.lit(None).cast("string").alias("jurisdiction"),
                        F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    same_doc = er.same_key_pairs(s.where("affiliation_key IS NOT NULL AND alias_key IS NOT NULL").select(F.col("affiliation_key").alias("record_id"), F.col("alias_key").alias("norm_key"), "mention_id"))
    truth = s.select("mention_id", F.floor(F.col("unique_id") / 2).alias("truth_entity"))
    follow = s.select((F.col("unique_id") - 1).alias("unique_id"), F.col("mention_id").alias("mention_b"))
    adjacent = s.select("unique_id", F.col("mention_id").alias("mention_a")).join(follow, "unique_id")
    return er.evaluate(er.identifier_pairs(observed), scored_above(t).where(F.col("probability") >= er.THRESHOLD), same_doc, truth, adjacent.where("unique_id % 2 = 0"), adjacent.where("unique_id % 2 = 1"))


@query("e10_waterfall", oracle("""
SELECT concat(id_a, '-', id_b) AS candidate_id, comparison, gamma, round(bf, 6) AS bayes_factor, round(abs(log10(bf)), 6) AS strength FROM (
""" + " UNION ALL ".join(f"SELECT id_a, id_b, '{n}' AS comparison, gamma_{n} AS gamma, {_bf(f'gamma_{n}', levels)} AS bf FROM scored WHERE p >= 0.8" for n, levels in er.COMPARISONS.items()) + ")", **FRAGMENTS))
def e10(t: Inputs):
    kept = scored_above(t).where(F.col("probability") >= er.THRESHOLD)
    candidates = kept.select(F.concat_ws("-", "mention_a", "mention_b").alias("candidate_id"), er.feature_map(kept).alias("features"))
    return er.waterfall(candidates).select("candidate_id", "comparison", "gamma", F.round("bayes_factor", 6).alias("bayes_factor"), F.round("strength", 6).alias("strength"))
