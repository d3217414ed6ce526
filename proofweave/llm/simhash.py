"""Near-duplicates by SimHash: fingerprints, tiled exact comparison, components.

A fingerprint is 64 bits over the XXH64 (seed 42) of all word shingles of a whole text; a bit is set when more than half of
the shingle hashes, repeats included, have it. Fingerprints within ``radius`` bits are linked.

Distinct fingerprints are dealt into tiles by the population counts of their two halves. Two tiles whose counts differ by
more than the radius in sum cannot hold a link and never meet; the others are compared exactly with exclusive-or and bit
counts, again split into sub-tiles by the counts of quarters and eighths while they are large. Tiles above ``tile_rows``
are cut into chunks, and chunk meets chunk. A pair of tiles answers with a spanning forest of its links instead of the
links, and the forests of all pairs are joined to components in Spark.

Null, empty and blank texts have the fingerprint zero and are linked like any other. Rows with equal fingerprints meet once.
A null id is never the smallest; a component of null ids only has a null component id. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, settle, texts_of

RADIUS = 3
SHINGLE = 3
TILE_ROWS = 20_000


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    ends -= 1
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, shingle) for t in texts_of(batch.column(1))], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fp long")


def _parts(x: np.ndarray, bits: int) -> np.ndarray:
    """Population counts of the parts of ``bits`` bits, one row per fingerprint."""
    return np.bitwise_count(x.view({32: np.uint32, 16: np.uint16, 8: np.uint8}[bits]).reshape(len(x), -1)).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, bits: int = 16, direct: int = 1 << 22):
    """Yields index arrays (i, j) with bit_count(a[i] ^ b[j]) <= radius; every such pair once."""
    if len(a) * len(b) <= direct or bits < 8:
        step = max(1, (1 << 18) // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
            if len(i):
                yield i + at, j
        return
    ta, ia = np.unique(_parts(a, bits), axis=0, return_inverse=True)
    tb, ib = np.unique(_parts(b, bits), axis=0, return_inverse=True)
    rows_a, rows_b = (np.split(np.argsort(i, kind="stable"), np.cumsum(np.bincount(i.ravel()))[:-1]) for i in (ia.ravel(), ib.ravel()))
    for k, own in enumerate(ta):
        near = np.flatnonzero(np.abs(tb - own).sum(1) <= radius)
        if not len(near):
            continue
        for m in near:
            for i, j in close_pairs(a[rows_a[k]], b[rows_b[m]], radius, bits // 2, direct):
                yield rows_a[k][i], rows_b[m][j]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of the pairs (i, j); label[x] points to a smaller or equal member."""
    while True:
        while not np.array_equal(label, up := label[label]):
            label[:] = up
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def _forest(group: pa.Table, radius: int) -> pa.Table:
    fp, side = group["fp"].to_numpy(), group["side"].to_numpy()
    # of one tile, or of two; sorted, so that the smallest member of a component is its root
    same = not side.any()
    order = np.argsort(fp, kind="stable")
    fp, side = np.ascontiguousarray(fp[order]), side[order]
    bits = fp.view(np.uint64)
    left = np.arange(len(fp)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    label = np.arange(len(fp))
    for i, j in close_pairs(bits[left], bits[right], radius):
        _merge(label, left[i], right[j])
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": pa.array(fp[child], pa.int64()), "v": pa.array(fp[label[child]], pa.int64())})


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning forest (u > v) of all links between the distinct fingerprints in ``prints`` (column fp)."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    tiled = prints.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("p"), F.bit_count(low).alias("q"))
    # at most 33 * 33 tiles, whatever the input
    sizes = tiled.groupBy("p", "q").count().select("p", "q", F.ceil(F.col("count") / tile_rows).cast("int").alias("chunks"))
    own = tiled.join(F.broadcast(sizes), ["p", "q"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long"))
    steps = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    other = sizes.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("chunks").alias("chunks2"))
    near = F.explode(F.array(*[F.struct((F.col("p") + a).alias("p2"), (F.col("q") + b).alias("q2")) for a, b in steps]))
    met = (
        own.withColumn("n", near).select("fp", "p", "q", "c", F.col("n.p2").alias("p2"), F.col("n.q2").alias("q2"))
        .join(F.broadcast(other), ["p2", "q2"])
        .withColumn("c2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks2").cast("long") - 1)))
    )
    mine, theirs = F.struct("p", "q", "c"), F.struct(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("c2").alias("c"))
    pairs = met.select("fp", F.when(mine <= theirs, 0).otherwise(1).alias("side"), F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"))
    return pairs.groupBy("a", "b").applyInArrow(lambda g: _forest(g, radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each is one aggregation and one join, written out before the next.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = cut(small.where("u <> v").distinct())
        # settled: every node has one edge, and no end of an edge is itself a child
        if small.groupBy("u").count().where("count > 1").isEmpty() and small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id, the smallest doc_id linked over any number of steps."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, radius, tile_rows))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest doc_id of their near-duplicate group, one row of each group."""
    bounded_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), list(docs.columns)
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t, shingle) for t in texts_of(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*names, "simhash_fp"])
        settle()

    marked = cut(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("simhash_fp", LongType())])))
    prints = marked.select("doc_id", F.col("simhash_fp").alias("fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct, radius, tile_rows))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    # one (id, fingerprint) of each group; ids that are null come last
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")).alias("b"))
    keep = best.select(F.col("b.least_id").alias("keep_id"), F.col("b.fp").alias("keep_fp"))
    kept = marked.join(keep, (marked.simhash_fp == keep.keep_fp) & marked.doc_id.eqNullSafe(keep.keep_id), "left_semi")
    return kept.dropDuplicates(["doc_id", "simhash_fp"]).drop("simhash_fp")
