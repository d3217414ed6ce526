"""The identity ledger: memberships by revision, merge lineage, canonical ids, batch confirmation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .windows import ordered_steps

MERGING_KINDS = ("confirm", "merge")


class LineageCycle(ValueError):
    """Merge lineage that never reaches a surviving entity."""


def membership_as_of(memberships: DataFrame, revision: int | None = None) -> DataFrame:
    if revision is None:
        return memberships.where("closed_revision_id IS NULL")
    return memberships.where(
        (F.col("opened_revision_id") <= revision)
        & (F.col("closed_revision_id").isNull() | (F.col("closed_revision_id") > revision))
    )


def _moves(memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    gained = memberships.select(F.col("opened_revision_id").alias("rev"), "entity_id").distinct()
    closed = memberships.where("closed_revision_id IS NOT NULL").select(F.col("closed_revision_id").alias("rev"), "entity_id").distinct()
    return gained, closed


def lineage_replay(memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """(entity_id, parent_id): who each absorbed entity resolves to, latest decision last.

    Instead of replaying in order, every decision states its effect on each entity as a row and the newest row wins.
    """
    gained, closed = _moves(memberships)
    lost = closed.join(gained, ["rev", "entity_id"], "left_anti")
    winners = gained.groupBy("rev").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("winner")).where("n = 1")
    d = decisions.select(F.col("result_revision_id").alias("rev"), "kind")
    absorbed = (
        d.where(F.col("kind").isin(*MERGING_KINDS)).join(winners, "rev").join(lost, "rev")
        .select("entity_id", "rev", F.col("winner").alias("parent_id"))
    )
    restored = d.where("kind = 'split'").join(gained, "rev").select("entity_id", "rev", F.lit(None).cast("string").alias("parent_id"))
    return (
        absorbed.unionByName(restored)
        .groupBy("entity_id")
        .agg(F.max_by(F.struct("parent_id"), "rev").alias("last"))
        .select("entity_id", F.col("last.parent_id").alias("parent_id"))
        .where("parent_id IS NOT NULL")
    )


def chain_ends(lineage: DataFrame) -> DataFrame:
    """(entity_id, end_id) by pointer doubling: each round every pointer jumps as far as it has already come."""
    state = cut(lineage.select("entity_id", F.col("parent_id").alias("end_id")))
    total = state.count()
    for _ in range(math.ceil(math.log2(total + 1)) + 2):
        hop = state.select(F.col("entity_id").alias("end_id"), F.col("end_id").alias("_next"))
        state = cut(
            state.join(hop, "end_id", "left").select(
                "entity_id", F.coalesce("_next", "end_id").alias("end_id"), F.col("_next").isNotNull().alias("moved")
            )
        )
        facts = state.agg(
            F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved"),
            F.min(F.when(F.col("entity_id") == F.col("end_id"), F.col("entity_id"))).alias("looped"),
        ).first()
        if facts["looped"] is not None:
            raise LineageCycle(_name_cycle(lineage, facts["looped"]))
        if not facts["moved"]:
            return state.select("entity_id", "end_id")
    stuck = state.where("moved").agg(F.min("entity_id")).first()[0]
    raise LineageCycle(_name_cycle(lineage, stuck))


def _name_cycle(lineage: DataFrame, start: str, longest: int = 50) -> str:
    seen, current = [start], start
    for _ in range(longest):
        row = lineage.where(F.col("entity_id") == current).select("parent_id").first()
        if row is None:
            break
        current = row["parent_id"]
        seen.append(current)
        if current in seen[:-1]:
            break
    return "merge lineage contains a cycle: " + " -> ".join(seen)


def canonical_map(entities: DataFrame, lineage: DataFrame, memberships: DataFrame) -> DataFrame:
    head = memberships.agg(F.max("opened_revision_id")).first()[0] or 0
    return entities.select("entity_id").join(chain_ends(lineage), "entity_id", "left").select(
        "entity_id", F.coalesce("end_id", "entity_id").alias("canonical_entity_id"), F.lit(head).cast("long").alias("at_revision_id")
    )


def tombstones(canonical: DataFrame, memberships: DataFrame) -> DataFrame:
    """Every entity with whether it is retired: nothing active and nobody it resolves to."""
    live = membership_as_of(memberships).select("entity_id", F.lit(True).alias("live")).distinct()
    return canonical.join(live, "entity_id", "left").select(
        "entity_id", (F.col("live").isNull() & (F.col("entity_id") == F.col("canonical_entity_id"))).alias("tombstoned")
    )


def stale_scope(pending: DataFrame, memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that moved an entity of a pending decision's scope after its parent revision.

    ``pending(decision_id, parent_revision_id, entity_id)``; no row means the pending decision is current.
    """
    gained, closed = _moves(memberships)
    touched = gained.unionByName(closed).distinct()
    later = decisions.select(F.col("decision_id").alias("intervening_decision_id"), "kind", F.col("result_revision_id").alias("rev"))
    return (
        pending.join(touched, "entity_id").where("rev > parent_revision_id").join(later, "rev")
        .select("decision_id", "intervening_decision_id", "kind", F.col("rev").alias("result_revision_id")).distinct()
    )


def unattributable_claims(splits: DataFrame, claims: DataFrame, canonical: DataFrame) -> DataFrame:
    """Live claims naming a split entity, or an id it absorbed, on a side without an anchor: (decision_id, claim_id, ...)."""
    scope = _scope(splits, canonical)
    live = claims.where("retracted_on IS NULL")
    if "object_mention_id" not in live.columns:
        live = live.withColumn("object_mention_id", F.lit(None).cast("string"))
    sides = [
        live.where(f"{side}_mention_id IS NULL AND {side}_id IS NOT NULL")
        .select("claim_id", F.col(f"{side}_id").alias("named_id"))
        .join(scope, "named_id")
        .select("decision_id", "entity_id", "new_entity_id", "claim_id")
        for side in ("subject", "object")
    ]
    return sides[0].unionByName(sides[1]).distinct()


def _scope(splits: DataFrame, canonical: DataFrame) -> DataFrame:
    own = splits.select("decision_id", "entity_id", "new_entity_id", F.col("entity_id").alias("named_id"))
    taken = splits.join(
        canonical.select(F.col("entity_id").alias("named_id"), F.col("canonical_entity_id").alias("entity_id")), "entity_id"
    ).select("decision_id", "entity_id", "new_entity_id", "named_id")
    return own.unionByName(taken).distinct()


def reattribution_drafts(found: DataFrame, claims: DataFrame, canonical: DataFrame) -> DataFrame:
    """One superseding draft per unattributable claim, repointing the side that resolves to the survivor."""
    names = canonical.select("entity_id", "canonical_entity_id")
    c = claims if "object_mention_id" in claims.columns else claims.withColumn("object_mention_id", F.lit(None).cast("string"))
    rows = (
        found.join(c.select("claim_id", "subject_id", "predicate", "object_id", "record_id", "subject_mention_id", "object_mention_id"), "claim_id")
        .join(names.toDF("subject_id", "_s"), "subject_id", "left")
        .join(names.toDF("object_id", "_o"), "object_id", "left")
    )
    subject = (F.coalesce("_s", "subject_id") == F.col("entity_id")) & F.col("subject_mention_id").isNull()
    obj = ~subject & (F.coalesce("_o", "object_id") == F.col("entity_id")) & F.col("object_mention_id").isNull()
    return rows.select(
        "decision_id",
        F.col("claim_id").alias("supersedes"),
        F.when(subject, F.col("new_entity_id")).otherwise(F.col("subject_id")).alias("subject_id"),
        "predicate",
        F.when(F.coalesce(obj, F.lit(False)), F.col("new_entity_id")).otherwise(F.col("object_id")).alias("object_id"),
        "record_id",
    )


def supersede_constraints(rejections: DataFrame) -> DataFrame:
    """Version chain per rejected pair: ``rejections(constraint_id, mention_1, mention_2, decided_revision_id)``."""
    pairs = rejections.select(
        "constraint_id", F.least("mention_1", "mention_2").alias("mention_a"), F.greatest("mention_1", "mention_2").alias("mention_b"), "decided_revision_id"
    )
    steps = ordered_steps(pairs, ["mention_a", "mention_b"], "decided_revision_id", {"constraint": "constraint_id"}, tie="constraint_id")
    return steps.select(
        "constraint_id", "mention_a", "mention_b", F.col("step").alias("version"), F.col("next_constraint").alias("superseded_by")
    )


def active_constraints(constraints: DataFrame) -> DataFrame:
    return constraints.where("superseded_by IS NULL")


def identity_history(entities: DataFrame, canonical: DataFrame, memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that opened or closed a membership of each asked entity's canonical class."""
    asked = entities.select(F.col("entity_id").alias("asked_id")).join(
        canonical.select(F.col("entity_id").alias("asked_id"), "canonical_entity_id"), "asked_id", "left"
    ).select("asked_id", F.coalesce("canonical_entity_id", "asked_id").alias("root"))
    classes = canonical.select(F.col("canonical_entity_id").alias("root"), "entity_id")
    scope = asked.join(classes, "root").select("asked_id", "entity_id").unionByName(
        asked.select("asked_id", F.col("root").alias("entity_id"))
    ).distinct()
    gained, closed = _moves(memberships)
    owners = gained.join(scope, "entity_id").groupBy("asked_id", "rev").agg(F.min("entity_id").alias("entity_id"))
    touched = gained.unionByName(closed).distinct().join(scope, "entity_id").select("asked_id", "rev").distinct()
    d = decisions.select("decision_id", "kind", F.col("result_revision_id").alias("rev"))
    return (
        touched.join(d, "rev").join(owners, ["asked_id", "rev"], "left")
        .select("asked_id", "decision_id", "kind", F.col("rev").alias("result_revision_id"), F.coalesce("entity_id", F.lit("")).alias("entity_id"))
    )


def batch_confirm(candidates: DataFrame, memberships: DataFrame, parent_revision: int) -> DataFrame:
    """Which pre-verified candidates are confirmed, taken in ``position`` order, and why the others are skipped.

    ``candidates(candidate_id, position, mention_a, mention_b, pre_verified, disposition)``. A confirmed pair makes
    both its entities stale for every later candidate. Each round settles all candidates that are the earliest at
    both of their entities, then removes their neighbours; the result equals taking them one by one.
    """
    active = membership_as_of(memberships).select("mention_id", "entity_id")
    moved = (
        memberships.select("entity_id", F.greatest("opened_revision_id", "closed_revision_id").alias("rev"))
        .groupBy("entity_id").agg(F.max("rev").alias("rev")).where(F.col("rev") > parent_revision).select("entity_id", F.lit(True).alias("moved"))
    )
    rows = (
        candidates.join(active.toDF("mention_a", "entity_a"), "mention_a", "left")
        .join(active.toDF("mention_b", "entity_b"), "mention_b", "left")
        .join(moved.toDF("entity_a", "moved_a"), "entity_a", "left")
        .join(moved.toDF("entity_b", "moved_b"), "entity_b", "left")
    )
    first_reason = (
        F.when(~F.col("pre_verified"), "not pre-verified")
        .when(F.col("disposition") != "open", F.concat(F.lit("already "), F.col("disposition")))
        .when(F.col("entity_a").isNull() | F.col("entity_b").isNull() | (F.col("entity_a") == F.col("entity_b")), "nothing to confirm")
        .when(F.coalesce("moved_a", "moved_b"), "stale")
    )
    keep = ["candidate_id", "position", "mention_a", "mention_b", "entity_a", "entity_b"]
    judged = cut(rows.select(*keep, first_reason.alias("reason")))
    settled = [judged.where("reason IS NOT NULL").withColumn("confirmed", F.lit(False))]
    alive = judged.where("reason IS NULL").drop("reason")
    while not alive.isEmpty():  # the earliest candidate left always wins, so every round settles some
        ends = alive.select("position", F.explode(F.array("entity_a", "entity_b")).alias("entity"))
        firsts = ends.groupBy("entity").agg(F.min("position").alias("first"))
        looked = alive.join(firsts.toDF("entity_a", "first_a"), "entity_a").join(firsts.toDF("entity_b", "first_b"), "entity_b")
        won = cut(looked.where("position = first_a AND position = first_b").select(*keep))
        partner = won.select(F.col("entity_a").alias("entity"), F.col("candidate_id").alias("by")).unionByName(
            won.select(F.col("entity_b").alias("entity"), F.col("candidate_id").alias("by"))
        )
        rest = (
            alive.join(won.select("candidate_id"), "candidate_id", "left_anti")
            .join(partner.toDF("entity_a", "by_a"), "entity_a", "left")
            .join(partner.toDF("entity_b", "by_b"), "entity_b", "left")
        )
        marked = cut(
            rest.select(
                *keep,
                F.when(F.col("by_a") == F.col("by_b"), "nothing to confirm")
                .when(F.coalesce("by_a", "by_b").isNotNull(), "stale").alias("reason"),
            )
        )
        settled.append(won.withColumns({"reason": F.lit(None).cast("string"), "confirmed": F.lit(True)}))
        settled.append(marked.where("reason IS NOT NULL").withColumn("confirmed", F.lit(False)))
        alive = marked.where("reason IS NULL").drop("reason")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def confirm_moves(confirmed: DataFrame, memberships: DataFrame, first_revision: int) -> DataFrame:
    """Membership rows a batch closes and opens; the survivor is the entity of ``mention_a``."""
    won = confirmed.where("confirmed")
    ranked = ordered_steps(won.select("candidate_id", "position", "entity_a", "entity_b"), [], "position", {}, tie="candidate_id")
    moved = membership_as_of(memberships).select("membership_id", "mention_id", F.col("entity_id").alias("entity_b")).join(ranked, "entity_b")
    rev = (F.lit(first_revision) + F.col("step") - 1).alias("revision_id")
    closed = moved.select(F.lit("close").alias("op"), "membership_id", "mention_id", F.col("entity_b").alias("entity_id"), rev)
    opened = moved.select(F.lit("open").alias("op"), F.lit(None).cast("string").alias("membership_id"), "mention_id", F.col("entity_a").alias("entity_id"), rev)
    return closed.unionByName(opened)
