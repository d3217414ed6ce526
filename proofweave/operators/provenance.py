"""Why two entities are connected, what is claimed about one, and where a claim comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import projection as pj

MAX_CLAIMS = 200  # fixed value: claims shown per answer


def _classes(ids: DataFrame, canonical: DataFrame) -> DataFrame:
    """asked_id -> every id of its canonical class (itself included when the map does not know it)."""
    asked = ids.select("asked_id").distinct()
    root = asked.join(canonical.select(F.col("entity_id").alias("asked_id"), F.col("canonical_entity_id").alias("root")), "asked_id", "left").select(
        "asked_id", F.coalesce("root", "asked_id").alias("root")
    )
    members = root.join(canonical.select(F.col("canonical_entity_id").alias("root"), F.col("entity_id").alias("member_id")), "root")
    return members.select("asked_id", "root", "member_id").unionByName(root.select("asked_id", "root", F.col("root").alias("member_id"))).distinct()


def why_connected(pairs: DataFrame, claims: DataFrame, canonical: DataFrame, relations: DataFrame, limit: int = MAX_CLAIMS) -> DataFrame:
    """Readable claims between two canonical classes, either way round, with relation counts.

    ``pairs(pair_id, left_id, right_id)``, ``claims`` already filtered for the reader. ``shown`` marks the first
    ``limit`` claims by (recorded_on, claim_id); later ones only tell that the answer is truncated.
    """
    sides = {}
    for s in ("left", "right"):
        c = _classes(pairs.select(F.col(f"{s}_id").alias("asked_id")), canonical)
        sides[s] = pairs.select("pair_id", F.col(f"{s}_id").alias("asked_id")).join(c, "asked_id").select("pair_id", F.col("member_id").alias(f"{s}_member"))
    met = sides["left"].join(sides["right"], "pair_id")
    ends = met.select("pair_id", F.col("left_member").alias("subject_id"), F.col("right_member").alias("object_id")).unionByName(
        met.select("pair_id", F.col("right_member").alias("subject_id"), F.col("left_member").alias("object_id"))
    ).distinct()
    found = claims.join(ends, ["subject_id", "object_id"])
    order = Window.partitionBy("pair_id").orderBy("recorded_on", "claim_id")
    ranked = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit + 1)
    return _with_relations(ranked.withColumn("shown", F.col("position") <= limit), claims, relations)


def why_connected_summary(answers: DataFrame) -> DataFrame:
    shown = answers.where("shown")
    counts = shown.groupBy("pair_id").agg(F.count(F.lit(1)).alias("claim_count"), F.count_distinct("record_id").alias("record_count"))
    more = answers.groupBy("pair_id").agg(F.bool_or(~F.col("shown")).alias("truncated"))
    return counts.join(more, "pair_id")


def _with_relations(rows: DataFrame, readable: DataFrame, relations: DataFrame) -> DataFrame:
    """Relation counts per claim; both ends of a relation must be readable."""
    index = pj.relation_index(relations, readable).groupBy("claim_id").agg(
        F.count_if(F.col("relation") == "corroborates").alias("corroborated_by"), F.count_if(F.col("relation") == "contradicts").alias("contradicted_by")
    )
    return rows.join(index, "claim_id", "left").na.fill(0, ["corroborated_by", "contradicted_by"])


def relation_totals(answers: DataFrame, relations: DataFrame, readable: DataFrame, group: str = "pair_id") -> DataFrame:
    """Distinct unordered corroborations and contradictions around the shown claims of each answer."""
    index = pj.relation_index(relations, readable)
    touching = answers.where("shown").select(group, "claim_id").join(index, "claim_id").select(
        group, F.least("claim_id", "other_claim").alias("low"), F.greatest("claim_id", "other_claim").alias("high"), "relation"
    ).distinct()
    return touching.groupBy(group).agg(
        F.count_if(F.col("relation") == "corroborates").alias("corroboration_count"), F.count_if(F.col("relation") == "contradicts").alias("contradiction_count")
    )


def entity_claims(entities: DataFrame, claims: DataFrame, canonical: DataFrame, relations: DataFrame, limit: int = MAX_CLAIMS) -> DataFrame:
    """Readable claims whose subject is in each asked entity's class, by predicate, first ``limit`` shown."""
    c = _classes(entities.select(F.col("entity_id").alias("asked_id")), canonical).select("asked_id", F.col("root").alias("resolved_id"), F.col("member_id").alias("subject_id"))
    order = Window.partitionBy("asked_id").orderBy("predicate", "recorded_on", "claim_id")
    found = claims.join(c, "subject_id").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit + 1)
    return _with_relations(found.withColumn("shown", F.col("position") <= limit), claims, relations)


def _with_anchor(claims: DataFrame, mentions: DataFrame, side: str) -> DataFrame:
    """``claims`` with the text of the ``side`` mention; claims without one are not shuffled together."""
    column, text = f"{side}_mention_id", f"{side}_text"
    if column not in claims.columns:
        return claims.withColumn(text, F.lit(None).cast("string"))
    anchored = claims.where(F.col(column).isNotNull()).join(mentions.select(F.col("mention_id").alias(column), F.col("raw_text").alias(text)), column, "left")
    bare = claims.where(F.col(column).isNull()).withColumn(text, F.lit(None).cast("string"))
    return anchored.select(*claims.columns, text).unionByName(bare)


def claim_provenance(claims: DataFrame, records: DataFrame, sources: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Each readable claim with its record, source (which carries the reliability), both anchor texts and relation counts.

    ``claim_relations`` lists the related claims themselves.
    """
    r = records.select("record_id", "source_id", "status")
    s = sources.select("source_id", F.col("name").alias("source_name"), F.col("reliability_normalized").alias("reliability"))
    rows = _with_anchor(_with_anchor(claims, mentions, "subject"), mentions, "object")
    return _with_relations(rows.join(r, "record_id", "left").join(s, "source_id", "left"), claims, relations)


def claim_relations(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """(claim_id, relation, other_claim) among readable claims, from both ends."""
    return pj.relation_index(relations, claims).select("claim_id", "relation", "other_claim")
