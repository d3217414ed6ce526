"""Keyset pages and the inbox lists built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

MAX_LIMIT = 200  # fixed value: largest page


def keyset_page(df: DataFrame, order: list[tuple[str, str]], after: list | None = None, limit: int = 50, max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """One page after the cursor row plus ``has_more``; a bounded sort, never a sort of the whole table.

    ``order`` lists (column, "asc" | "desc"); ``after`` holds the cursor row's values in the same order. Pages have between
    one and ``max_limit`` rows whatever is asked for; ``max_limit`` None: no upper limit.
    """
    limit = max(1, limit if max_limit is None else min(limit, max_limit))
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (column, direction), value in zip(order, after):
            c = F.col(column)
            beyond = beyond | (equal & ((c > F.lit(value)) if direction == "asc" else (c < F.lit(value))))
            equal = equal & (c == F.lit(value))
        df = df.where(beyond)
    by = [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]
    page = df.orderBy(*by).limit(limit + 1)
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*by)))  # at most limit + 1 rows
    more = F.max("position").over(Window.partitionBy()) > limit
    return numbered.withColumn("has_more", more).where(F.col("position") <= limit)


def _codes(clearance: int) -> list[str]:
    return list(V.HANDLING_CODES[: clearance + 1])


def candidate_inbox(
    candidates: DataFrame, mentions: DataFrame, records: DataFrame, memberships: DataFrame, entities: DataFrame, clearance: int
) -> DataFrame:
    """Candidates whose both sides the reader may see; page with ``CANDIDATE_ORDER``."""
    readable = records.where(F.col("handling_code").isin(_codes(clearance))).select("record_id")
    seen = mentions.select("mention_id", "record_id", "raw_text").join(readable, "record_id", "left_semi").select("mention_id", "record_id", "raw_text")
    members = memberships.where("closed_revision_id IS NULL").select("mention_id", "entity_id")
    kinds = entities.select("entity_id", "entity_type", "label")
    rows = candidates
    for s in "ab":
        rows = (
            rows.join(seen.toDF(f"mention_{s}", f"record_{s}", f"text_{s}"), f"mention_{s}")
            .join(members.toDF(f"mention_{s}", f"entity_{s}"), f"mention_{s}", "left")
            .join(kinds.toDF(f"entity_{s}", f"type_{s}", f"label_{s}"), f"entity_{s}", "left")
        )
    hidden, barred = V.types_above(clearance), V.predicates_above(clearance)
    for s in "ab":
        if hidden:
            rows = rows.where(F.col(f"type_{s}").isNull() | ~F.col(f"type_{s}").isin(hidden))
    if barred:
        rows = rows.where(~F.col("producer").isin([f"rule:{p}" for p in barred]))
        if "predicate" in rows.columns:
            rows = rows.where(F.col("predicate").isNull() | ~F.col("predicate").isin(barred))
    return rows.withColumns({"pre_key": F.col("pre_verified").cast("int"), "score_key": F.coalesce("score", F.lit(-1.0))})


CANDIDATE_ORDER = [("pre_key", "desc"), ("score_key", "desc"), ("candidate_id", "asc")]


def review_inbox(
    queue: DataFrame, records: DataFrame, clearance: int, cases: list[str] = (), kind: str | None = None,
    status: str | None = None, producer: str | None = None, record: str | None = None,
) -> DataFrame:
    """Suggestions in the reader's case scope whose record and predicate they may see; page with ``REVIEW_ORDER``."""
    scope = F.col("case_id").isNull()
    if cases:
        scope = scope | F.col("case_id").isin(list(cases))
    barred = V.predicates_above(clearance)
    rows = queue.where(scope)
    predicate = F.get_json_object("payload", "$.predicate")
    if barred:
        rows = rows.where(predicate.isNull() | ~predicate.isin(barred))
    for column, value in (("suggestion_kind", kind), ("status", status), ("producer", producer), ("record_id", record)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    codes = records.select("record_id", F.col("handling_code").alias("_code"))
    unfiled = rows.where("record_id IS NULL")
    filed = rows.where("record_id IS NOT NULL").join(codes.where(F.col("_code").isin(_codes(clearance))).select("record_id"), "record_id", "left_semi")
    return filed.select(*queue.columns).unionByName(unfiled)


REVIEW_ORDER = [("created_at", "desc"), ("suggestion_id", "desc")]


def record_inbox(records: DataFrame, clearance: int, status: str | None = None, source: str | None = None) -> DataFrame:
    rows = records.where(F.col("handling_code").isin(_codes(clearance)))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if source is not None:
        rows = rows.where(F.col("source_id") == source)
    return rows


RECORD_ORDER = [("received_at", "desc"), ("record_id", "desc")]
SOURCE_ORDER = [("created_at", "asc"), ("source_id", "asc")]
