"""Landing and suggestion intake over unbounded input.

Each micro-batch is judged against the durable table and written to its own ``batch_id`` folder with overwrite, so a
batch replayed after a lost executor or driver writes the same folder again. The table, not operator state, is what
makes late and repeated rows harmless, and no key's history is held in one task. Tables are filed by a hash bucket of the
key, and a batch reads only the buckets that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import ordered_steps
from ..sources import landing

LANDED = (
    "ingest_key string, source_system string, filename string, content_hash string, size_bytes int, arrival bigint, "
    "status string, quarantine_reason string"
)


BUCKETS = 256


def _bucketed(rows: DataFrame, *key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _table(spark: SparkSession, path: str, schema: str, before: int, touching: DataFrame) -> DataFrame:
    """Rows of earlier batches in the buckets that ``touching`` has rows in."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema + ", batch_id bigint, bucket int")
    buckets = [r.bucket for r in touching.select("bucket").distinct().collect()]  # at most BUCKETS
    earlier = spark.read.schema(schema + ", batch_id bigint, bucket int").parquet(path)
    return earlier.where((F.col("batch_id") < before) & F.col("bucket").isin(buckets))


def land_batch(spark: SparkSession, rows: DataFrame, batch_id: int, table: str, max_bytes: int) -> None:
    """New content of the batch, with version conflicts counted against the table and within the batch."""
    name = ["source_system", "filename"]
    earlier = _table(spark, table, LANDED, batch_id, _bucketed(rows.select(*name), *name))
    fresh = landing.first_arrivals(landing.keyed(rows)).join(earlier.select("ingest_key"), "ingest_key", "left_anti")
    numbered = ordered_steps(fresh, name, "arrival", {}, tie="ingest_key")
    known = earlier.groupBy(*name).agg(F.count(F.lit(1)).alias("known"))
    counted = numbered.join(known, name, "left").withColumn("conflicts", F.col("step") - 1 + F.coalesce("known", F.lit(0)))
    _write(_bucketed(landing.judged(counted, F.col("conflicts"), max_bytes), *name), f"{table}/batch_id={batch_id}")


def stream_landing(raw: DataFrame, table: str, checkpoint: str, max_bytes: int = 50_000_000) -> StreamingQuery:
    """Land a stream of (source_system, filename, text, arrival) into ``table``; processes what is there, then stops."""
    return (
        raw.writeStream.foreachBatch(lambda rows, batch: land_batch(rows.sparkSession, rows, batch, table, max_bytes))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def suggestion_batch(spark: SparkSession, rows: DataFrame, batch_id: int, table: str, schema: str) -> None:
    rows = _bucketed(rows.dropDuplicates(["idempotency_key"]), "idempotency_key")
    earlier = _table(spark, table, schema, batch_id, rows)
    _write(rows.join(earlier.select("idempotency_key"), "idempotency_key", "left_anti"), f"{table}/batch_id={batch_id}")


def stream_suggestions(drafts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Queue each idempotency key once, however late it first arrives: only the table decides what is a repeat."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drafts.schema.fields)
    return (
        drafts.writeStream.foreachBatch(lambda rows, batch: suggestion_batch(rows.sparkSession, rows, batch, table, schema))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
