"""Sinks: versioned projection folders, graph JSON documents, graph-database statements."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER_PATTERN = "^[A-Z][A-Z0-9_]*$"  # fixed value: what a relationship type may look like


def write_projection(df: DataFrame, root: str, revision: int) -> str:
    """Full replacement as a new version folder; readers switch once its success marker is there."""
    path = f"{root.rstrip('/')}/version={revision:020d}-{uuid.uuid4().hex}"
    df.write.partitionBy("predicate").parquet(path)
    return path


def current_projection(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version under ``root``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    complete = []
    for status in fs.listStatus(folder):
        marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if status.getPath().getName().startswith("version=") and fs.exists(marker):
            name = status.getPath().getName()
            complete.append((name.split("-")[0], fs.getFileStatus(marker).getModificationTime(), status.getPath().toString()))
    if not complete:
        raise FileNotFoundError(f"no complete projection under {root}")
    return spark.read.parquet(max(complete)[2])


def node_documents(nodes: DataFrame) -> DataFrame:
    columns = [c for c in nodes.columns]
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(*edges.columns), {"ignoreNullFields": "false"}).alias("document"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per node and per edge."""
    return node_documents(nodes).unionByName(edge_documents(edges))


def write_graph(documents: DataFrame, path: str) -> None:
    documents.select("document", "part").write.partitionBy("part").text(path)


def _literal(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _date(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit('date("'), value.cast("string"), F.lit('")')), F.lit("null"))


def node_statements(nodes: DataFrame, key: Column | None = None) -> DataFrame:
    """One idempotent MERGE per node; nodes may bring ``aliases``/``affiliations`` arrays."""
    have = lambda c: _literal(F.col(c)) if c in nodes.columns else F.lit("null")
    listed = lambda c: F.to_json(F.col(c)) if c in nodes.columns else F.lit("[]")
    text = F.concat(
        F.lit("MERGE (c:Criminal {node_id: "), _literal(F.col("node_id")), F.lit("})\nSET c.name = "), _literal(F.col("name")),
        F.lit(",\n    c.aliases = "), listed("aliases"), F.lit(",\n    c.nic = "), have("nic"), F.lit(",\n    c.affiliations = "), listed("affiliations"),
        F.lit(",\n    c.node_type = "), _literal(F.col("node_type")), F.lit(",\n    c.cluster_id = "), have("cluster_id"),
        F.lit(",\n    c.source_file = "), have("source_file"), F.lit(",\n    c.source_excerpt = "), have("source_excerpt"), F.lit(";"),
    )
    return nodes.select((F.col("node_id") if key is None else key).alias("key"), text.alias("statement"))


def edge_statements(edges: DataFrame) -> DataFrame:
    """One idempotent MERGE per edge; a layer that is not a bare identifier stops the job."""
    layer = F.when(F.col("layer").rlike(LAYER_PATTERN), F.col("layer")).otherwise(F.raise_error(F.concat(F.lit("unsafe relationship type: "), F.col("layer"))))
    have = lambda c: _literal(F.col(c)) if c in edges.columns else F.lit("null")
    text = F.concat(
        F.lit("MATCH (a:Criminal {node_id: "), _literal(F.col("source")), F.lit("})\nMATCH (b:Criminal {node_id: "), _literal(F.col("target")),
        F.lit("})\nMERGE (a)-[r:"), layer, F.lit(" {relation: "), _literal(F.col("relation")), F.lit(", source_file: "), have("source_file"),
        F.lit("}]->(b)\nSET r.confidence = "), _literal(F.col("confidence")), F.lit(",\n    r.weight = "), F.col("weight").cast("string"),
        F.lit(",\n    r.start_date = "), _date(F.col("start_date")), F.lit(",\n    r.end_date = "), _date(F.col("end_date")),
        F.lit(",\n    r.location = "), have("location"), F.lit(",\n    r.extraction_method = "), have("extraction_method"),
        F.lit(",\n    r.source_excerpt = "), have("source_excerpt"), F.lit(";"),
    )
    return edges.select(F.col("edge_id").alias("key"), text.alias("statement"))


def cypher_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return node_statements(nodes).unionByName(edge_statements(edges))
