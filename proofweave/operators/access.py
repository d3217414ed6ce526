"""Who may read which claim, which grants should exist, and whether audit and custody chains hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..session import small
from .windows import ordered_steps

# fixed value: what precedes the first audit row
GENESIS_HASH = "0" * 64


def predicate_sensitivity(predicates: DataFrame, properties: DataFrame) -> DataFrame:
    """(predicate, required_rank): the strictest sensitivity a predicate stands for.

    A predicate stands for the property of the same name and, when it is an identifier, for every identifier
    property of its subject types.
    """
    rated = properties.where("sensitivity IS NOT NULL").select(
        "object_type", "property", "type", V.handling_rank(F.col("sensitivity")).alias("required_rank")
    )
    same_name = predicates.select("predicate").join(
        rated.select(F.col("property").alias("predicate"), "required_rank"), "predicate"
    )
    inherited = (
        predicates.where("identifier")
        .select("predicate", F.explode("subject_types").alias("object_type"))
        .join(rated.where("type = 'identifier'"), "object_type")
        .select("predicate", "required_rank")
    )
    return same_name.unionByName(inherited).groupBy("predicate").agg(F.max("required_rank").alias("required_rank"))


def type_sensitivity(properties: DataFrame) -> DataFrame:
    """(entity_type, required_rank) of types whose display title is itself sensitive."""
    return properties.where("is_title AND sensitivity IS NOT NULL").select(
        F.col("object_type").alias("entity_type"), V.handling_rank(F.col("sensitivity")).alias("required_rank")
    )


def forbidden_predicates(levels: DataFrame, predicates: DataFrame, properties: DataFrame) -> DataFrame:
    """(clearance, predicate) above each clearance of ``levels(clearance)``."""
    need = predicate_sensitivity(predicates, properties)
    above = need.select("predicate", F.explode(F.expr("sequence(0, required_rank - 1)")).alias("clearance"))
    return levels.select("clearance").distinct().join(above, "clearance")


def hidden_types(levels: DataFrame, properties: DataFrame) -> DataFrame:
    need = type_sensitivity(properties)
    above = need.select("entity_type", F.explode(F.expr("sequence(0, required_rank - 1)")).alias("clearance"))
    return levels.select("clearance").distinct().join(above, "clearance")


def readable_claims(
    claims: DataFrame,
    users: DataFrame,
    case_members: DataFrame,
    entities: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """(user_id, claim columns) for every user at once.

    ``users(user_id, clearance, auditor)``, ``case_members(user_id, case_id)``. Users meet claims only through an
    equality (handling code, then case), so a claim is never compared with users who cannot read its code.
    """
    codes = F.explode(F.slice(F.array(*[F.lit(c) for c in V.HANDLING_CODES]), 1, F.least(F.col("clearance") + 1, F.lit(len(V.HANDLING_CODES)))))
    allowed = users.where("clearance >= 0").select("user_id", "clearance", "auditor", codes.alias("handling_code"))
    spark = claims.sparkSession
    predicates, properties = V.predicate_table(spark), V.property_table(spark)
    need = F.broadcast(predicate_sensitivity(predicates, properties).withColumnRenamed("required_rank", "_p"))
    rows = claims.join(need, "predicate", "left")
    if entities is not None:
        hidden = entities.join(F.broadcast(type_sensitivity(properties)), "entity_type").select("entity_id", "required_rank")
        rows = rows.join(hidden.toDF("subject_id", "_s"), "subject_id", "left").join(hidden.toDF("object_id", "_o"), "object_id", "left")
    else:
        rows = rows.withColumns({"_s": F.lit(None).cast("int"), "_o": F.lit(None).cast("int")})
    floor = F.greatest(F.coalesce("_p", F.lit(0)), F.coalesce("_s", F.lit(0)), F.coalesce("_o", F.lit(0)))
    pool = rows.where("case_id IS NULL").join(small(allowed), "handling_code")
    in_case = rows.where("case_id IS NOT NULL").join(small(allowed.join(case_members.distinct(), "user_id")), ["handling_code", "case_id"])
    met = pool.unionByName(in_case).where(F.col("clearance") >= floor)
    if as_of is None:
        live = F.col("retracted_on").isNull() | F.col("auditor")
    else:
        live = (F.col("recorded_on") <= as_of) & (F.col("auditor") | F.col("retracted_on").isNull() | (F.col("retracted_on") > as_of))
    return met.where(live).select("user_id", *claims.columns)


def readable_by(claims: DataFrame, clearance: int, cases: list[str] = (), auditor: bool = False) -> DataFrame:
    """The same rule for one reader, as plain filters that reach the scan."""
    codes = list(V.HANDLING_CODES[: clearance + 1])
    keep = F.col("handling_code").isin(codes) & ~F.col("predicate").isin(V.predicates_above(clearance))
    scope = F.col("case_id").isNull()
    if cases:
        scope = scope | F.col("case_id").isin(list(cases))
    rows = claims.where(keep & scope)
    return rows if auditor else rows.where("retracted_on IS NULL")


def desired_grants(case_members: DataFrame, evidence: DataFrame, custody: DataFrame) -> DataFrame:
    """(user, relation, object) implied by the tables; roles without a relation give none."""
    relation = V.lookup(F.col("role"), V.CASE_ROLE_RELATIONS)
    cases = case_members.select(
        F.concat(F.lit("user:"), "user_id").alias("user"), relation.alias("relation"), F.concat(F.lit("case:"), "case_id").alias("object")
    ).where("relation IS NOT NULL")
    items = evidence.where("case_id IS NOT NULL").select(
        F.concat(F.lit("case:"), "case_id").alias("user"), F.lit("case").alias("relation"), F.concat(F.lit("evidence_item:"), "evidence_id").alias("object")
    )
    holders = custody.groupBy("evidence_id").agg(F.max_by("to_actor", "seq").alias("actor")).select(
        F.concat(F.lit("user:"), "actor").alias("user"), F.lit("custodian").alias("relation"), F.concat(F.lit("evidence_item:"), "evidence_id").alias("object")
    )
    return cases.unionByName(items).unionByName(holders).distinct()


def grant_diff(desired: DataFrame, existing: DataFrame) -> DataFrame:
    columns = ["user", "relation", "object"]
    want, have = desired.select(*columns).distinct(), existing.select(*columns).distinct()
    return want.join(have, columns, "left_anti").withColumn("op", F.lit("write")).unionByName(
        have.join(want, columns, "left_anti").withColumn("op", F.lit("delete"))
    )


def outbox_backlog(outbox: DataFrame) -> DataFrame:
    """Pending rows and the longest time a delete took to take effect."""
    seconds = F.unix_timestamp("processed_at") - F.unix_timestamp("created_at")
    return outbox.agg(
        F.count_if(F.col("processed_at").isNull()).alias("pending"),
        F.count_if(F.col("processed_at").isNotNull()).alias("processed"),
        F.coalesce(F.max(F.when(F.col("op") == "delete", seconds)), F.lit(0)).alias("max_delete_staleness_seconds"),
    )


def audit_failures(log: DataFrame, expected_hash: Column, genesis: str = GENESIS_HASH) -> DataFrame:
    """Rows that break the chain, with the reason; the link to the row before is checked before the row itself.

    Every row is checked on its own and against its neighbour, so the check runs in parallel over the whole log;
    up to the first failure this is what a walk from the first row finds.
    """
    checked = log.select("id", "prev_hash", "entry_hash", expected_hash.alias("expected"))
    linked = ordered_steps(checked, [], "id", {"entry": "entry_hash"})
    reason = F.when(
        F.col("prev_hash") != F.coalesce("prev_entry", F.lit(genesis)), "previous hash does not match the verified chain head"
    ).when(F.col("entry_hash") != F.col("expected"), "entry hash does not match canonical event data")
    return linked.withColumn("reason", reason).where("reason IS NOT NULL").select("id", "step", "reason")


def audit_verify(log: DataFrame, expected_hash: Column, genesis: str = GENESIS_HASH) -> DataFrame:
    """One row: whether the chain holds, how many rows were good before the first failure, and that failure."""
    failures = audit_failures(log, expected_hash, genesis).select(F.struct("id", "step", "reason").alias("f"), F.lit(0).cast("long").alias("n"))
    rows = log.select(F.lit(None).cast(failures.schema["f"].dataType).alias("f"), F.lit(1).cast("long").alias("n"))
    return failures.unionByName(rows).agg(F.min("f").alias("f"), F.sum("n").alias("n")).select(
        F.col("f").isNull().alias("ok"),
        F.coalesce(F.col("f.step") - 1, F.col("n")).alias("checked"),
        F.col("f.id").alias("failed_id"),
        F.col("f.reason").alias("reason"),
    )


def audit_query(
    log: DataFrame, actor: str | None = None, case: str | None = None, action: str | None = None, since=None, until=None
) -> DataFrame:
    """Filters of the audit list; order and page with ``lists.keyset_page(..., [("id", "desc")])``."""
    for column, value in (("actor", actor), ("case_id", case), ("action", action)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if since is not None:
        log = log.where(F.col("at") >= since)
    if until is not None:
        log = log.where(F.col("at") <= until)
    return log


def custody_check(events: DataFrame) -> DataFrame:
    """Custody events that break a rule: (evidence_id, seq, error), first broken rule per event.

    ``seq`` has no gaps, so an event meets the one before it by equality on (evidence, seq).
    """
    before = events.select(
        "evidence_id", (F.col("seq") + 1).alias("seq"), F.col("to_actor").alias("holder"), F.col("occurred_at").alias("held_since"), F.lit(True).alias("known")
    )
    error = (
        F.when((F.col("seq") == 1) & F.col("from_actor").isNotNull(), "from_actor: must be null for the first event")
        .when((F.col("seq") > 1) & F.col("known").isNull(), "seq: previous event is missing")
        .when((F.col("seq") > 1) & (F.col("from_actor") != F.col("holder")), "from_actor: must match the current custodian")
        .when(F.col("occurred_at") < F.col("held_since"), "occurred_at: precedes the previous event")
        .when(F.col("to_actor") == F.col("holder"), "to_actor: already the current custodian")
    )
    return events.join(before, ["evidence_id", "seq"], "left").withColumn("error", error).where("error IS NOT NULL").select("evidence_id", "seq", "error")
