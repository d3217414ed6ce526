"""Landing of raw records, text derivatives, cached extractions, and the integrity of stored content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators.claims import ascii_slug
from ..operators.windows import ordered_steps

# fixed values: media types by file extension, and the JSON layout of a cached extraction
MEDIA_TYPES = {
    "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html",
    "xml": "text/xml", "json": "application/json", "pdf": "application/pdf",
}
NODES_SCHEMA = "nodes array<struct<node_id:string,name:string,node_type:string,nic:string,aliases:array<string>,affiliations:array<string>,source_excerpt:string>>"
EDGES_SCHEMA = "edges array<struct<source:string,target:string,relation:string,layer:string,confidence:string,start_date:date,end_date:date,location:string,source_excerpt:string>>"
EXTRACTION_SCHEMA = f"{NODES_SCHEMA}, {EDGES_SCHEMA}"


def ingest_key(system: Column, filename: Column, content_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", system, filename, content_hash), 256)


def keyed(raw: DataFrame) -> DataFrame:
    """Hash and size of each arrival; the content itself goes no further than this projection."""
    content_hash = F.sha2(F.col("text").cast("binary"), 256)
    return raw.select(
        "source_system", "filename", "arrival", content_hash.alias("content_hash"), F.octet_length("text").alias("size_bytes")
    ).withColumn("ingest_key", ingest_key(F.col("source_system"), F.col("filename"), F.col("content_hash")))


def first_arrivals(rows: DataFrame) -> DataFrame:
    rest = ["source_system", "filename", "content_hash", "size_bytes"]
    return rows.groupBy("ingest_key").agg(F.min("arrival").alias("arrival"), *[F.first(c).alias(c) for c in rest])


def judged(records: DataFrame, conflicts: Column, max_bytes: int) -> DataFrame:
    """Status and every reason for it, all failed checks named."""
    conflict = F.when(
        conflicts > 0, F.concat(F.lit("version conflict: "), conflicts, F.lit(" earlier record(s) of '"), F.col("filename"), F.lit("' with different content"))
    )
    oversize = F.when(
        F.col("size_bytes") > max_bytes, F.concat(F.lit("oversized: "), F.col("size_bytes"), F.lit(f" bytes exceeds the {max_bytes}-byte bound"))
    )
    reasons = F.nullif(F.concat_ws("; ", conflict, oversize), F.lit(""))
    return records.select(
        "ingest_key", "source_system", "filename", "content_hash", "size_bytes", "arrival",
        F.when(reasons.isNull(), "landed").otherwise("quarantined").alias("status"), reasons.alias("quarantine_reason"),
    )


def land_records(raw: DataFrame, max_bytes: int = 50_000_000) -> DataFrame:
    """One record per (system, filename, content); later different content of a name is a version conflict.

    ``raw(source_system, filename, text, arrival)``. Versions of one name are counted with ordered steps, so a name
    that holds most of the arrivals is still numbered in parallel.
    """
    first = first_arrivals(keyed(raw))
    numbered = ordered_steps(first, ["source_system", "filename"], "arrival", {}, tie="ingest_key")
    return judged(numbered, F.col("step") - 1, max_bytes)


def text_records(files: DataFrame) -> DataFrame:
    """``files(record_id, filename, media_type, content)`` to text: invalid UTF-8 is replaced, other types reported."""
    extension = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    media = F.coalesce(F.nullif(F.col("media_type"), F.lit("")), V.lookup(extension, MEDIA_TYPES))
    is_text = F.coalesce(media.startswith("text/"), F.lit(False))
    text = F.when(is_text, F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.select("record_id", media.alias("media_type"), text.alias("text"), is_text.alias("_t"))
    return rows.withColumn(
        "outcome", F.when(~F.col("_t"), "unsupported media type").when(F.trim("text") == "", "empty text").otherwise("text")
    ).drop("_t")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` as records for ``text_records``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.sha2("path", 256).alias("record_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("media_type"), "content"
    )


def derivative_reuse(records: DataFrame, derivatives: DataFrame, tool: str, version: str, params: str, kind: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reused, needed): records with a derivative of exactly this tool, version and params, and those without."""
    same = derivatives.where(
        (F.col("kind") == kind) & (F.col("tool") == tool) & (F.col("tool_version") == version) & (F.col("params") == params)
    ).groupBy(F.col("parent_record").alias("record_id")).agg(F.min("derivative_id").alias("derivative_id"))
    return records.join(same, "record_id"), records.join(same, "record_id", "left_anti")


def _accents_folded(text: Column) -> Column:
    """ASCII as it is; other letters through the name keys, which only rows with such letters pay for."""
    from ..functions.names import name_keys

    plain = text.rlike(r"^[\x00-\x7F]*$")
    folded = name_keys(F.when(~plain, text)).getField("norm_key")
    return F.when(plain, text).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def _listed(cached: DataFrame, schema: str, field: str, item: str) -> DataFrame:
    """(record_id, pos, item): one list of the bodies. Only that list is parsed, and once: the inner explode would bring a
    filter on the list's size, which parses every body again."""
    parsed = cached.select("record_id", F.from_json("body", schema, {"mode": "PERMISSIVE"}).getField(field).alias("_l"))
    return parsed.select("record_id", F.posexplode_outer("_l").alias("pos", item)).where("pos IS NOT NULL")


def load_extractions(cached: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of cached extraction JSON: ``cached(record_id, body)``.

    Ids become slugs, the weight follows the tag whatever the payload says, provenance is the record's own. Edges carry
    ``error`` when they are self-loops, end before they start, or use an unknown tag.
    """
    fold = (lambda c: c) if ascii_only else _accents_folded
    n = _listed(cached, NODES_SCHEMA, "nodes", "n")
    nodes = n.select(
        "record_id", "pos", ascii_slug(fold(F.coalesce(F.nullif(F.col("n.node_id"), F.lit("")), F.col("n.name")))).alias("node_id"), "n.name",
        F.coalesce("n.node_type", F.lit("PERSON")).alias("node_type"), "n.nic", "n.aliases", "n.affiliations", "n.source_excerpt",
    )
    e = _listed(cached, EDGES_SCHEMA, "edges", "e").select("record_id", "pos", "e.*")
    for c in ("source", "target", "relation"):
        e = e.withColumn(c, ascii_slug(fold(F.col(c))))
    weight = V.lookup(F.col("confidence"), {t: g[2] for t, g in V.TAG_GRADES.items()})
    error = (
        F.when(F.col("source") == F.col("target"), "self-loop")
        .when(F.col("end_date") < F.col("start_date"), "end precedes start")
        .when(weight.isNull(), "unknown confidence tag")
    )
    edges = e.withColumns({"weight": weight, "extraction_method": F.lit("SEMANTIC"), "error": error})
    return nodes, edges


def extraction_errors(cached: DataFrame) -> DataFrame:
    """(record_id, error) of cached bodies that give neither nodes nor edges because they are no JSON object."""
    parsed = F.from_json("body", EXTRACTION_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = F.col("body").isNull() | F.col("r").isNull() | F.col("r._bad").isNotNull()
    return cached.withColumn("r", parsed).where(broken).select("record_id", F.when(F.col("body").isNull(), "no body").otherwise("malformed body").alias("error"))


def content_integrity(objects: DataFrame) -> DataFrame:
    """Stored objects whose bytes no longer hash to their key: ``objects(content_hash, content)``."""
    actual = F.sha2(F.col("content").cast("binary"), 256)
    return objects.withColumn("actual_hash", actual).where("actual_hash <> content_hash").drop("content")


def ingest_status(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


def open_quarantine(records: DataFrame) -> DataFrame:
    return records.where("status = 'quarantined'").select("ingest_key", "quarantine_reason")
