"""Extraction results to claim drafts: parsing, locating, merging, grading, checking, anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from .projection import orient_symmetric

# fixed value: the custody-list line format (dashes may be em, en or hyphen; alias and id number are optional)
CUSTODY_LINE = (
    r'(?i)^\s*(\d+)\.\s+(.+?)(?:\s+alias\s+["“]([^"”]+)["”])?(?:\s+\(NIC\s+(\d{9}[VvXx]|\d{12})\))?'
    r"\s*[—–-]+\s*arrested\s+(\d{4}-\d{2}-\d{2})\s*[—–-]+\s*remanded,?\s+(.+?)"
    r"\s*\(\s*(\d{4}-\d{2}-\d{2})\s+to\s+(\d{4}-\d{2}-\d{2}|ongoing)\s*\)\s*$"
)
CONTEXT_WINDOW = 120  # fixed value: characters kept on each side of a mention
GRADING_SCHEME = "legacy-confidence-tag"  # fixed value: scheme name drafts carry
CHUNK_CHARS = 12_000  # fixed value: documents up to this length are one chunk
DEDUPE_KEY = ["source", "target", "relation", "layer", "start_date", "end_date"]


def ascii_slug(text: Column) -> Column:
    """Lower-case ASCII slug; accents are folded by the caller where text is not ASCII."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), "^$", "unknown")


def parse_custody_list(docs: DataFrame, doc: str = "record_id", text: str = "text") -> DataFrame:
    """Numbered list lines as rows; lines of another form are left out."""
    lines = docs.select(F.col(doc).alias("record_id"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "line"))
    part = lambda i: F.nullif(F.regexp_extract("line", CUSTODY_LINE, i), F.lit(""))
    rows = lines.where(F.col("line").rlike(CUSTODY_LINE))
    return rows.select(
        "record_id", "line_no",
        part(1).cast("int").alias("num"), F.trim(part(2)).alias("name"), part(3).alias("alias"), part(4).alias("nic"),
        F.to_date(part(5)).alias("arrested"), F.trim(part(6)).alias("facility"), F.to_date(part(7)).alias("start_date"),
        F.when(F.lower(part(8)) != "ongoing", F.to_date(part(8))).alias("end_date"), F.trim("line").alias("line"),
    )


def co_location(stays: DataFrame, item: str = "stay_id") -> DataFrame:
    """Pairs of stays in one facility with overlapping windows; touching ends count, a null end is open.

    Each stay is filed under every month it covers and each pair is found in the month the later stay begins, so
    stays that never meet are not compared and a busy facility is spread over its months.
    """
    span = stays.agg(F.max("start_date").alias("last")).first()["last"]
    if span is None:
        span = "1970-01-01"
    last = F.lit(span).cast("date")
    rows = stays.select(item, F.lower("facility").alias("_place"), "facility", "start_date", "end_date")
    month = lambda d: F.year(d) * 12 + F.month(d)
    until = F.greatest(F.least(F.coalesce("end_date", last), last), F.col("start_date"))
    reaching = rows.where("end_date IS NULL OR end_date >= start_date").select(
        "_place",
        F.explode(F.sequence(month(F.col("start_date")), month(until))).alias("_month"),
        F.struct(item, "facility", "start_date", "end_date").alias("x"),
    )
    begins = rows.select("_place", month(F.col("start_date")).alias("_month"), F.struct(item, "facility", "start_date", "end_date").alias("y"))
    met = reaching.join(begins, ["_place", "_month"]).where(
        (F.col("x.start_date") < F.col("y.start_date"))
        | ((F.col("x.start_date") == F.col("y.start_date")) & (F.col(f"x.{item}") < F.col(f"y.{item}")))
    ).where("(x.end_date IS NULL OR x.end_date >= y.start_date) AND (y.end_date IS NULL OR y.end_date >= y.start_date)")
    met = met.where(F.col(f"x.{item}") != F.col(f"y.{item}"))
    swap = F.col(f"x.{item}") > F.col(f"y.{item}")
    first = F.when(swap, F.col("y")).otherwise(F.col("x"))
    second = F.when(swap, F.col("x")).otherwise(F.col("y"))
    return met.select(
        first[item].alias("stay_a"), second[item].alias("stay_b"), first["facility"].alias("facility"),
        F.col("y.start_date").alias("start_date"), F.least("x.end_date", "y.end_date").alias("end_date"),
    )


def locate_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """First case-insensitive place of each name in its record's whole text, with offsets and context.

    ``docs(record_id, text)``, ``names(record_id, ref, name)``. Names that are not found stay, unverified.
    """
    spans = (
        names.where(F.trim("name") != "").join(docs.select("record_id", "text"), "record_id")
        .withColumn("_at", F.expr("instr(lower(text), lower(name)) - 1"))
        .withColumn("_len", F.length("name"))
    )
    found = F.col("_at") >= 0
    left = F.greatest(F.col("_at") - CONTEXT_WINDOW, F.lit(0))
    right = F.least(F.length("text"), F.col("_at") + F.col("_len") + CONTEXT_WINDOW)
    return spans.select(
        "record_id", "ref", "name",
        F.when(found, F.substring("text", F.col("_at") + 1, F.col("_len"))).otherwise(F.col("name")).alias("raw_text"),
        F.when(found, F.col("_at")).alias("char_start"),
        F.when(found, F.col("_at") + F.col("_len")).alias("char_end"),
        F.when(found, F.substring("text", left + 1, right - left)).alias("context"),
        found.alias("verified"),
    )


def new_mentions(located: DataFrame, existing: DataFrame, key: str = "norm_key") -> DataFrame:
    """Located names not yet stored under the same (record, key, offset); several refs of one place make one row."""
    one = located.groupBy("record_id", key, "char_start").agg(
        F.min_by(F.struct(*[c for c in located.columns if c not in ("record_id", key, "char_start")]), "ref").alias("m")
    ).select("record_id", key, "char_start", "m.*")
    e = existing.select(F.col("record_id").alias("_r"), F.col(key).alias("_k"), F.col("char_start").alias("_s"))
    same = (F.col("record_id") == F.col("_r")) & (F.col(key) == F.col("_k")) & F.col("char_start").eqNullSafe(F.col("_s"))
    return one.join(e, same, "left_anti")


def paragraph_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = CHUNK_CHARS) -> DataFrame:
    """Paragraph groups of at least ``min_chars``; the last one may be shorter; short documents stay whole."""
    blocks = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    empty = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def add(state, block):
        grown = F.when(state["open"] == "", block).otherwise(F.concat(state["open"], F.lit("\n\n"), block))
        full = F.length(grown) >= min_chars
        return F.struct(
            F.when(full, F.lit("")).otherwise(grown).alias("open"),
            F.when(full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"),
        )

    grouped = F.aggregate(blocks, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    chunks = F.when(F.length(text) <= min_chars, F.array(F.col(text))).otherwise(grouped)
    return docs.select(doc, F.posexplode(chunks).alias("chunk_index", "chunk"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id: the first stated value in ``seq`` order for each field.

    ``nodes(seq, node_id, name, nic, source_excerpt)``.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return nodes.groupBy("node_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("name", "seq").alias("name"), first("nic"), first("source_excerpt")
    )


def merge_node_values(values: DataFrame) -> DataFrame:
    """Union of a node's aliases, affiliations and source files, ordered by ``first_seq``.

    ``values(seq, pos, node_id, kind, value)``; each distinct value once, where it was first seen.
    """
    return values.groupBy("node_id", "kind", "value").agg(F.min(F.struct("seq", "pos")).alias("f")).select(
        "node_id", "kind", "value", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos")
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges with equal (source, target, relation, layer, start, end): the first one stays."""
    rest = [c for c in edges.columns if c not in DEDUPE_KEY]
    return edges.groupBy(*DEDUPE_KEY).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*DEDUPE_KEY, *[F.col(f"r.{c}").alias(c) for c in rest])


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("node_id").distinct()
    return (
        edges.join(known.select(F.col("node_id").alias("source"), F.lit(True).alias("_s")), "source", "left")
        .join(known.select(F.col("node_id").alias("target"), F.lit(True).alias("_t")), "target", "left")
        .where("_s IS NULL OR _t IS NULL").select(*edges.columns)
    )


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select("node_id").distinct()
    return edges.join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi")


def grade_confidence(edges: DataFrame) -> DataFrame:
    tag = F.col("confidence")
    return edges.withColumns({
        "credibility": V.lookup(tag, {t: g[0] for t, g in V.TAG_GRADES.items()}),
        "verification": V.lookup(tag, {t: g[1] for t, g in V.TAG_GRADES.items()}),
        "weight": V.lookup(tag, {t: g[2] for t, g in V.TAG_GRADES.items()}),
    })


def normalize_grade(rows: DataFrame, scheme: str, original: str = "grade") -> DataFrame:
    table = {g: d for (s, g), d in V.GRADING_SCHEMES.items() if s == scheme}
    dimension = V.lookup(F.col(original), {g: d[0] for g, d in table.items()})
    value = V.lookup(F.col(original), {g: d[1] for g, d in table.items()})
    return rows.withColumns({
        "dimension": dimension, "normalized": value, "error": F.when(value.isNull(), F.concat(F.lit(f"grading.schemes.{scheme}."), F.col(original)))
    })


def remap_edges(edges: DataFrame) -> DataFrame:
    """Extraction verbs to vocabulary predicates, one row per target; what cannot be mapped carries an ``error``.

    ``edges(edge_no, relation, layer, confidence, start_date, end_date, location)``.
    """
    verbs = V.verb_table(edges.sparkSession)
    rows = grade_confidence(edges).drop("weight").join(F.broadcast(verbs), "relation", "left")
    category = F.col("category")
    corrected = category.isNotNull() & (category != F.lower("layer"))
    allowed = F.lit(False)
    for predicate, layers in V.CATEGORY_CORRECTIONS.items():
        allowed = allowed | ((F.col("predicate") == predicate) & F.col("layer").isin(*layers))
    cap = V.credibility_order(F.col("credibility_cap"))
    weaker = F.when(cap > V.credibility_order(F.col("credibility")), F.col("credibility_cap")).otherwise(F.col("credibility"))
    return rows.select(
        "edge_no", "relation", "layer", "predicate",
        "category",
        "symmetric",
        F.when(F.col("credibility_cap").isNotNull(), weaker).otherwise(F.col("credibility")).alias("credibility_normalized"),
        F.col("verification").alias("verification_status"),
        F.when(F.col("window_part") == "full", F.col("start_date")).when(F.col("window_part") == "from_start", F.col("start_date")).alias("valid_from"),
        F.when(F.col("window_part") == "full", F.col("end_date")).when(F.col("window_part") == "until_start", F.col("start_date")).alias("valid_to"),
        F.coalesce(F.nullif(F.col("location"), F.lit("")), F.col("default_location")).alias("location_text"),
        F.coalesce("split", F.lit(False)).alias("split"),
        F.col("credibility_cap").isNotNull().alias("credibility_capped"),
        F.coalesce(corrected, F.lit(False)).alias("category_corrected"),
        F.when(F.col("predicate").isNull(), F.concat(F.lit("predicates."), F.col("relation")))
        .when(F.col("credibility").isNull(), F.concat(F.lit("confidence."), F.col("confidence")))
        .when(corrected & ~allowed, F.concat(F.lit("predicates."), F.col("predicate"), F.lit(".category"))).alias("error"),
    )


def node_property_claims(nodes: DataFrame, aliases: DataFrame, affiliations: DataFrame, entities: DataFrame) -> DataFrame:
    """Alias and affiliation claims of nodes: ``nodes(node_id, record_id)``, ``aliases/affiliations(node_id, value)``,
    ``entities(slug, entity_id)``. An affiliation names an entity when its slug does, and stays text otherwise."""
    owner = nodes.join(entities.select(F.col("slug").alias("node_id"), F.col("entity_id").alias("subject_id")), "node_id")
    graded = lambda tag: (F.lit(V.TAG_GRADES[tag][0]).alias("credibility_normalized"), F.lit(V.TAG_GRADES[tag][1]).alias("verification_status"))
    known = owner.join(aliases, "node_id").select(
        "subject_id", F.lit("known_as").alias("predicate"), F.lit(None).cast("string").alias("object_id"), F.col("value").alias("object_value"), "record_id", *graded("EXTRACTED")
    )
    member = owner.join(affiliations, "node_id").withColumn("slug", ascii_slug(F.col("value"))).join(
        entities.select("slug", F.col("entity_id").alias("object_id")), "slug", "left"
    ).select(
        "subject_id", F.lit("affiliated_with").alias("predicate"), "object_id",
        F.when(F.col("object_id").isNull(), F.col("value")).alias("object_value"), "record_id", *graded("INFERRED"),
    )
    return known.unionByName(member).distinct()


def draft_suggestions(edges: DataFrame, mentions: DataFrame, resolved: DataFrame, producer: str, version: str, existing: DataFrame | None = None) -> DataFrame:
    """Claim drafts of extracted edges with their idempotency key; drafts already queued are left out.

    ``edges(record_id, source, target, relation, confidence, extraction_method, start_date, end_date, location,
    source_excerpt)``, ``mentions(record_id, ref, mention_id)``, ``resolved(norm_key, entity_id)``.
    """
    rows = edges
    for side, end in (("subject", "source"), ("object", "target")):
        rows = rows.join(resolved.toDF(end, f"{side}_id"), end, "left").join(
            mentions.select("record_id", F.col("ref").alias(end), F.col("mention_id").alias(f"{side}_mention_id")), ["record_id", end], "left"
        )
    named = F.coalesce(V.lookup(F.col("relation"), V.PREDICATE_RENAMES), F.col("relation"))
    # what a proposal says; equal proposals are one draft, whichever way they were worded
    said = {
        "record_id": F.col("record_id"), "subject_id": F.col("subject_id"), "object_id": F.col("object_id"), "subject_mention_id": F.col("subject_mention_id"),
        "object_mention_id": F.col("object_mention_id"), "predicate": F.when(named.isin(*V.PREDICATES), named), "confidence": F.col("confidence"),
        "method": V.lookup(F.col("extraction_method"), V.COLLECTION_METHOD_OF_TAG), "valid_from": F.col("start_date").cast("string"),
        "valid_to": F.col("end_date").cast("string"), "location": F.col("location"), "source_excerpt": F.col("source_excerpt"),
    }
    worded = {"subject_ref": F.col("source"), "object_ref": F.col("target"), "raw_relation": F.col("relation")}
    # dealt by record, a document each, for this grouping and any by record after it; texts and keys are made of what is left
    dealt = rows.select(*[c.alias(n) for n, c in (said | worded).items()]).repartition("record_id")
    drafts = dealt.groupBy(*said).agg(F.min(F.struct(*worded)).alias("w")).select(*said, "w.*")
    drafts = grade_confidence(drafts)
    # fields in sorted key order, nulls kept, so that equal proposals give equal text
    payload = F.to_json(
        F.struct(
            F.lit("reported").alias("assertion_type"), F.col("method").alias("collection_method"),
            F.col("credibility").alias("credibility_normalized"), F.col("confidence").alias("credibility_original"),
            F.lit(GRADING_SCHEME).alias("credibility_scheme"), F.col("source_excerpt").alias("excerpt"),
            F.col("location").alias("location_text"), "object_id", "object_mention_id", "predicate", "record_id",
            "subject_id", "subject_mention_id", "valid_from", "valid_to", F.col("verification").alias("verification_status"),
        ),
        {"ignoreNullFields": "false"},
    )
    key = F.sha2(F.concat_ws("|", F.lit("claim_draft"), F.lit(producer), F.lit(version), payload), 256)
    needs = F.array_compact(F.array(F.when(F.col("subject_id").isNull(), F.col("subject_ref")), F.when(F.col("object_id").isNull(), F.col("object_ref"))))
    drafts = drafts.select(
        "record_id", "subject_ref", "object_ref", "raw_relation", "predicate",
        "subject_id", "object_id", "subject_mention_id", "object_mention_id", needs.alias("needs_entity"), payload.alias("payload"), key.alias("idempotency_key"),
    )
    return drafts if existing is None else drafts.join(existing.select("idempotency_key"), "idempotency_key", "left_anti")


DRAFT_DEFAULTS = {
    "object_value": "string", "assertion_type": "string", "collection_method": "string", "credibility_normalized": "string",
    "verification_status": "string", "analytic_confidence": "string", "event_time_earliest": "timestamp", "event_time_latest": "timestamp",
    "valid_from": "date", "valid_to": "date", "handling_code": "string", "case_id": "string", "supersedes": "string",
    "subject_mention_id": "string", "object_mention_id": "string",
}


def validate_claims(drafts: DataFrame, entities: DataFrame, records: DataFrame, cases: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Drafts with every broken rule as a stable path in ``errors`` (empty when valid), first rule first."""
    d = drafts
    for name, kind in DRAFT_DEFAULTS.items():
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    table = F.broadcast(V.predicate_table(d.sparkSession))
    types = entities.select("entity_id", "entity_type")
    d = (
        d.join(table, "predicate", "left")
        .join(types.toDF("subject_id", "_st"), "subject_id", "left")
        .join(types.toDF("object_id", "_ot"), "object_id", "left")
        .join(records.select("record_id", F.lit(True).alias("_rec")).distinct(), "record_id", "left")
    )
    d = d.join(cases.select("case_id", F.lit(True).alias("_case")).distinct(), "case_id", "left") if cases is not None else d.withColumn("_case", F.lit(True))
    d = d.join(claims.select(F.col("claim_id").alias("supersedes"), F.lit(True).alias("_sup")).distinct(), "supersedes", "left") if claims is not None else d.withColumn("_sup", F.lit(True))
    c = F.col
    path = lambda *p: F.concat(*[F.lit(x) if not isinstance(x, Column) else x for x in p])
    on_predicate = lambda tail: path("predicates.", c("predicate"), tail)
    declared = lambda v, scale: c(v).isNull() | c(v).isin(*scale)
    both = c("object_id").isNull() == c("object_value").isNull()
    anchored = c("assertion_type").isin(*V.ANCHORED_ASSERTIONS) & c("collection_method").isNotNull() & ~c("collection_method").isin(*V.ANCHOR_EXEMPT_METHODS)
    known = c("category").isNotNull() | c("symmetric").isNotNull()
    checks = [
        (~known, on_predicate("")),
        (c("_st").isNull(), F.lit("claim.subject_id")),
        (known & ~F.array_contains("subject_types", c("_st")), on_predicate(".subject")),
        (both, F.lit("claim.object")),
        (known & c("object_id").isNull() & ~c("allows_literal"), on_predicate(".object")),
        (known & c("object_id").isNotNull() & ~c("allows_entity"), on_predicate(".object")),
        (c("object_id").isNotNull() & c("_ot").isNull(), F.lit("claim.object_id")),
        (known & c("allows_entity") & c("_ot").isNotNull() & ~F.array_contains("object_types", c("_ot")), on_predicate(".object")),
        (c("subject_id") == c("object_id"), F.lit("claim.object_id")),
        (c("assertion_type").isNotNull() & ~c("assertion_type").isin(*V.ASSERTION_TYPES), path("claim.assertion_type.", c("assertion_type"))),
        (~declared("credibility_normalized", V.CREDIBILITY), path("grading.credibility.", c("credibility_normalized"))),
        (~declared("verification_status", V.VERIFICATION), path("grading.verification.", c("verification_status"))),
        (~declared("analytic_confidence", V.ANALYTIC_CONFIDENCE), path("grading.analytic_confidence.", c("analytic_confidence"))),
        (c("analytic_confidence").isNotNull() & (F.coalesce("assertion_type", F.lit("")) != "assessed"), F.lit("claim.analytic_confidence")),
        (~declared("handling_code", V.HANDLING_CODES), path("handling_codes.", c("handling_code"))),
        (c("event_time_latest") < c("event_time_earliest"), F.lit("claim.event_time_latest")),
        (c("valid_to") < c("valid_from"), F.lit("claim.valid_to")),
        (c("_rec").isNull(), F.lit("claim.record_id")),
        (c("case_id").isNotNull() & c("_case").isNull(), F.lit("claim.case_id")),
        (c("supersedes").isNotNull() & c("_sup").isNull(), F.lit("claim.supersedes")),
        (anchored & c("subject_mention_id").isNull(), F.lit("claim.subject_mention_id")),
        (anchored & c("object_id").isNotNull() & c("object_mention_id").isNull(), F.lit("claim.object_mention_id")),
    ]
    errors = F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), message) for test, message in checks])))
    return d.select(*drafts.columns, errors.alias("errors"))


def claim_dedupe(drafts: DataFrame, claims: DataFrame) -> DataFrame:
    """Drafts without a live claim of the same predicate, record, endpoints (either way round when symmetric), literal value
    and window."""
    key = ["subject_id", "object_id", "object_value", "predicate", "record_id", "valid_from", "valid_to"]
    literal = lambda df: df if "object_value" in df.columns else df.withColumn("object_value", F.lit(None).cast("string"))
    drafts, claims = literal(drafts), literal(claims)
    have = orient_symmetric(claims.where("retracted_on IS NULL")).select(*[F.col(k).alias(f"_{k}") for k in key])
    want = orient_symmetric(drafts)
    same = None
    for k in key:
        test = F.col(k).eqNullSafe(F.col(f"_{k}")) if k in ("object_id", "object_value", "valid_from", "valid_to") else F.col(k) == F.col(f"_{k}")
        same = test if same is None else same & test
    return want.join(have, same, "left_anti")


def entities_for_new_mentions(drafts: DataFrame, mentions: DataFrame, active: DataFrame) -> DataFrame:
    """One new entity per unadjudicated mention a draft names: (mention_id, entity_id, entity_type, label, error).

    ``drafts(mention_id, predicate, role, requested_type)`` with role ``subject`` or ``object``.
    """
    table = F.broadcast(V.predicate_table(drafts.sparkSession))
    new = drafts.join(active.select("mention_id"), "mention_id", "left_anti").join(table, "predicate")
    allowed = F.when(F.col("role") == "subject", F.col("subject_types")).otherwise(F.col("object_types"))
    chosen = F.when(F.col("requested_type").isNotNull(), F.when(F.array_contains(allowed, F.col("requested_type")), F.col("requested_type"))).when(
        F.size(allowed) == 1, F.element_at(allowed, 1)
    )
    error = F.when(F.size(allowed) == 0, "takes no entity").when(chosen.isNull() & F.col("requested_type").isNotNull(), "type not allowed").when(chosen.isNull(), "type must be proposed")
    one = new.select("mention_id", chosen.alias("entity_type"), error.alias("error")).groupBy("mention_id").agg(
        F.min("entity_type").alias("entity_type"), F.min("error").alias("error")
    )
    return one.join(mentions.select("mention_id", F.col("raw_text").alias("label")), "mention_id").select(
        "mention_id", F.concat(F.lit("ent_"), F.substring(F.sha2("mention_id", 256), 1, 24)).alias("entity_id"), "entity_type", "label",
        F.when(F.col("entity_type").isNull(), F.col("error")).alias("error"),
    )


def resolve_norm_key(mentions: DataFrame, memberships: DataFrame) -> DataFrame:
    """norm_key -> entity of the smallest open membership."""
    return (
        memberships.where("closed_revision_id IS NULL").select("membership_id", "mention_id", "entity_id")
        .join(mentions.select("mention_id", "norm_key"), "mention_id")
        .groupBy("norm_key").agg(F.min_by("entity_id", "membership_id").alias("entity_id"))
    )


def backfill_anchors(claims: DataFrame, mentions: DataFrame, active: DataFrame) -> DataFrame:
    """Missing anchors that one active mention settles: (claim_id, subject_mention_id, object_mention_id, outcome)."""
    c = claims if "object_mention_id" in claims.columns else claims.withColumn("object_mention_id", F.lit(None).cast("string"))
    c = c.where("subject_mention_id IS NULL OR object_mention_id IS NULL").select("claim_id", "record_id", "subject_id", "object_id", "subject_mention_id", "object_mention_id")
    options = mentions.select("mention_id", "record_id").join(active.select("mention_id", "entity_id"), "mention_id").groupBy("entity_id", "record_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mention_id").alias("only")
    )
    rows = c
    for side in ("subject", "object"):
        rows = rows.join(options.toDF(f"{side}_id", "record_id", f"_n_{side}", f"_m_{side}"), [f"{side}_id", "record_id"], "left")
    open_ = {s: F.col(f"{s}_mention_id").isNull() & F.col(f"{s}_id").isNotNull() for s in ("subject", "object")}
    n = {s: F.coalesce(f"_n_{s}", F.lit(0)) for s in open_}
    decided = (open_["subject"] & (n["subject"] == 1)) | (open_["object"] & (n["object"] == 1))
    unclear = (open_["subject"] & (n["subject"] > 1)) | (open_["object"] & (n["object"] > 1))
    filled = lambda s: F.coalesce(f"{s}_mention_id", F.when(open_[s] & (n[s] == 1), F.col(f"_m_{s}"))).alias(f"{s}_mention_id")
    return rows.select(
        "claim_id", filled("subject"), filled("object"),
        F.when(decided, "anchored").when(unclear, "ambiguous").otherwise("unmatched").alias("outcome"),
    )
