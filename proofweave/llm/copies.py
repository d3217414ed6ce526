"""Near copies by tiled SimHash comparison and exact Jaccard similarity of five-word shingles; one row of each group is kept.

Two texts are linked when their sets of distinct shingles (XXH64 of lower-cased words, as in ``simhash``) have a Jaccard
similarity of at least ``SHARE``; a group is what links reach over any number of steps. A text of fewer words is one shingle.

1. Texts with equal sets are one member. Members meet in tiles: all members that share one of ``BANDS`` hashes over ``ROWS``
   least values each. A pair of similarity 0.8 shares none with probability 7e-6, more similar pairs with less.
2. In a tile the fingerprints of all pairs are compared by exclusive-or and bit counts within ``RADIUS`` bits, tile pairs of
   too different population counts being skipped. At similarity 0.8 bits differ with probability arccos(8/9)/pi, 9.7 of 64
   on average, and more than RADIUS (22) with probability 2e-5. A tile answers with a spanning forest; a tile above ``TILE``
   members with a star. What the forests join is a neighbourhood: every link lies inside one.
3. Whole sets travel once, to their neighbourhood, where fingerprints within the radius are decided by exact similarity. Pairs
   that are already joined need no decision, and the member nearest to the majority of the fingerprints goes first, so a group
   of near copies costs about one decision a member. The answer is again a spanning forest.
4. A neighbourhood above ``GROUP`` members or ``ELEMENTS`` shingles is cut into chunks that all get the nearest member.
   Members that it does not reach then meet every chunk; all others are joined already.

So every task sees a bounded number of members, and no step lists the pairs of a group.

Null, empty and blank texts have the empty set and form one group. A null id is never the smallest. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import bounded_batches, cut, settle, small_slices, texts_of
from .simhash import _merge, components, shingle_hashes

SHINGLE = 5
#: 4 / 5 as whole numbers, so that a similarity of exactly 0.8 counts
SHARE = (4, 5)
RADIUS = 22
BANDS, ROWS = 30, 5
TILE = 4096
GROUP = 2000
ELEMENTS = 4 << 20
_PART_ROWS = 500_000
_TIMES = np.random.default_rng(11).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` hashes for each set; sets are not empty."""
    joined, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    held, out = np.empty_like(joined), np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        mixed = np.full(len(sets), b + 1, np.uint64)
        for times in _TIMES[b]:
            np.multiply(joined, times, out=held)
            mixed = (mixed ^ np.minimum.reduceat(held, starts)) * _MIX
            mixed ^= mixed >> np.uint64(29)
        out[:, b] = mixed
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending sets is ``SHARE`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def _fits(a, b):
    """Whether sets of these sizes can have a similarity of ``SHARE``."""
    return SHARE[1] * np.minimum(a, b) >= SHARE[0] * np.maximum(a, b)


def _near_pairs(fp: np.ndarray, radius: int, tile: int = 512):
    """Yields index arrays (i, j), i and j in tiles of like population counts, of all pairs within the radius."""
    ones = np.bitwise_count(fp).astype(np.int64)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order]
    for a in range(0, len(fp), tile):
        top = ones[min(a + tile, len(fp)) - 1]
        for b in range(a, len(fp), tile):
            if ones[b] - top > radius:
                break
            i, j = np.nonzero(np.bitwise_count(fp[a : a + tile, None] ^ fp[None, b : b + tile]) <= radius)
            yield order[a + i], order[b + j]


def tile_forest(band: np.ndarray, key: np.ndarray, fp: np.ndarray, size: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (u, v) of spanning forests, one a band, over the pairs of a band within the radius and of fitting sizes."""
    order = np.lexsort((key, band))
    band, key, fp, size = band[order], key[order], fp[order].view(np.uint64), size[order]
    start = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    count = np.diff(np.append(start, len(band)))
    label = np.arange(len(band))

    def take(i, j):
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & _fits(size[i], size[j])
        _merge(label, i[near], j[near])

    # small tiles side by side: each member with the one ``step`` behind it
    low = np.repeat(count <= 64, count)
    for step in range(1, min(64, int(count.max(initial=0)))):
        i = np.flatnonzero(low[: len(band) - step] & (band[: len(band) - step] == band[step:]))
        take(i, i + step)
    for a, n in zip(start[count > 64].tolist(), count[count > 64].tolist(), strict=True):
        for i, j in _near_pairs(fp[a : a + n], radius):
            take(a + i, a + j)
    child = np.flatnonzero(label != np.arange(len(label)))
    return key[child], key[label[child]]


def similar_forest(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels after joining all similar pairs of members with different labels, one of which asks; ``first`` go first."""
    fp, size = fp.view(np.uint64), np.array([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(fp), bitorder="little").view(np.uint64)[0]
    order = np.lexsort((np.arange(len(fp)), np.bitwise_count(fp ^ middle), ~first, ~asks))
    open_, marked, label = np.ones(len(fp), bool), np.zeros(int(codes.max(initial=0)) + 1, bool), label.copy()
    for i in order[: int(asks.sum())].tolist():
        open_[i] = False
        near = np.flatnonzero(open_ & (label != label[i]) & (np.bitwise_count(fp ^ fp[i]) <= radius) & _fits(size, size[i]))
        if not len(near):
            continue
        own = codes[ends[i] - size[i] : ends[i]]
        marked[own] = True
        n = size[near]
        place = np.repeat(ends[near] - np.cumsum(n), n) + np.arange(int(n.sum()))
        both = np.add.reduceat(marked[codes[place]], np.cumsum(n) - n, dtype=np.int64)
        marked[own] = False
        joined = np.unique(label[near[SHARE[1] * both >= SHARE[0] * (n + size[i] - both)]])
        if len(joined):
            label[np.isin(label, joined)] = label[i]
    return label


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, and of the set: key (hash), size, fp, bands."""
    import xxhash

    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = StructType([source.schema["doc_id"], StructField("text_hash", LongType()), *(StructField(n, LongType()) for n in ("key", "size", "fp")), StructField("bands", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, 2):
                sets = [shingle_set(t, shingle) for t in texts_of(part.column(2))]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                full = [k for k, s in enumerate(sets) if len(s)]
                found = [[] for _ in sets]
                if full:
                    for k, row in zip(full, bands([sets[k] for k in full]).view(np.int64).tolist(), strict=True):
                        found[k] = row
                columns = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=schema.names)
        settle()

    return cut(source.mapInArrow(run, schema))


def _tiles(distinct: DataFrame, tile: int) -> DataFrame:
    """Edges (u, v) that join each neighbourhood."""
    members = distinct.select("key", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("least")).where("n > 1")
    met = cut(members.join(shared, "band").join(distinct.select("key", "size", "fp"), "key"))
    parts = met.count() // _PART_ROWS + 12

    def run(group: pa.Table) -> pa.Table:
        u, v = tile_forest(*(group[n].to_numpy() for n in ("band", "key", "fp", "size")))
        settle()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    inside = met.where(F.col("n") <= tile).withColumn("part", F.pmod(F.xxhash64("band"), F.lit(parts))).select("part", "band", "key", "fp", "size")
    forest = inside.groupBy("part").applyInArrow(run, "u long, v long")
    return forest.union(met.where(F.col("n") > tile).select(F.col("key").alias("u"), F.col("least").alias("v")))


def _forest(group: pa.Table, joined: bool = False) -> pa.Table:
    """Spanning forests (u, v) of the similar pairs of each neighbourhood in a group.

    ``joined``: members have roots that say what is joined already, and only pairs with a member that asks count; else
    ``first`` marks the members that go first, and all ask.
    """
    u, v = [], []
    # a member may stand twice; the row that asks or goes first counts
    lead = group["asks" if joined else "first"].to_numpy(zero_copy_only=False)
    blob, key = group["blob"].to_numpy(), group["key"].to_numpy()
    order = np.lexsort((~lead, key, blob))
    order = order[np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(blob[order]) != 0)))]
    for rows in np.split(order, np.flatnonzero(np.diff(blob[order])) + 1):
        own, every = group.take(pa.array(rows)), np.ones(len(rows), bool)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in own["hashes"].combine_chunks()]
        node, begin = np.unique(own["root" if joined else "key"].to_numpy(), return_inverse=True)
        label = similar_forest(own["fp"].to_numpy(), sets, begin, lead[rows] if joined else every, ~every if joined else lead[rows])
        now = np.empty(len(node), np.int64)
        now[begin] = label
        least = node[np.unique(now, return_index=True)[1]]
        root = least[np.unique(now, return_inverse=True)[1]]
        u.append(node[node != root]), v.append(root[node != root])
    settle()
    column = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.table({"u": column(u), "v": column(v)})


def _nearest(members: DataFrame) -> DataFrame:
    """(blob, key) of the member nearest to the majority of the fingerprints of each neighbourhood."""
    bit = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    sums = members.groupBy("blob").agg(F.count("*").alias("n"), *bit)
    middle = F.lit(0).cast("long")
    for k in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    near = members.join(sums.select("blob", middle.alias("middle")), "blob")
    return near.groupBy("blob").agg(F.min(F.struct(far.alias("far"), "key")).alias("m")).select("blob", F.col("m.key").alias("key"))


def _large(sets: DataFrame, group: int) -> DataFrame:
    """Edges inside neighbourhoods of several chunks; sets: blob, key, fp, size, hashes, chunks."""
    chunked = cut(sets.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks"))))
    nearest = cut(_nearest(chunked.select("blob", "key", "fp")))
    centre = nearest.join(chunked, ["blob", "key"]).select("blob", "key", "fp", "hashes", "chunks")
    centre = centre.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    columns = ["blob", "chunk", "key", "fp", "hashes"]
    both = chunked.select(*columns, F.lit(False).alias("first")).union(centre.select(*columns, F.lit(True).alias("first")))
    edges = cut(both.groupBy("blob", "chunk").applyInArrow(lambda g: _forest(g), "u long, v long"))
    roots = components(edges).withColumnRenamed("node", "key")
    known = cut(chunked.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    top = nearest.join(known.select("key", F.col("root").alias("top")), "key").select("blob", "top")
    asking = known.join(top, "blob").where("root <> top").drop("top")
    counts = asking.groupBy("blob").count().select("blob", F.ceil(F.col("count") / group).alias("turns"))
    columns = ["blob", "chunk", "turn", "key", "fp", "root", "hashes"]
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    turn = F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns"))
    asks = asking.join(counts, "blob").withColumn("turn", turn).withColumn("chunk", to("chunks")).select(*columns, F.lit(True).alias("asks"))
    rest = known.join(counts, "blob").withColumn("turn", to("turns")).select(*columns, F.lit(False).alias("asks"))
    return edges.union(asks.union(rest).groupBy("blob", "chunk", "turn").applyInArrow(lambda g: _forest(g, True), "u long, v long"))


def _same_row() -> Column:
    """Rows of documents and of a table with copies_id and copies_text that have the same id and text."""
    return F.col("doc_id").eqNullSafe(F.col("copies_id")) & (F.xxhash64("text") == F.col("copies_text"))


def links(distinct: DataFrame, docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(node, root) of the keys with a link; distinct: key, size, fp, bands, doc_id and text_hash of one of its rows."""
    below = components(_tiles(distinct, tile)).select(F.col("node").alias("key"), F.col("root").alias("blob"))
    blobs = below.union(below.select(F.col("blob").alias("key"), "blob").distinct())
    wanted = cut(distinct.select("key", "size", "fp", F.col("doc_id").alias("copies_id"), F.col("text_hash").alias("copies_text")).join(blobs, "key"))
    per_blob = wanted.groupBy("blob").agg(F.ceil(F.greatest(F.count("*") / group, F.sum("size") / ELEMENTS)).alias("chunks"))
    texts = docs.select("doc_id", "text").join(wanted.select("key", "copies_id", "copies_text").hint("merge"), _same_row())

    def run(batches):
        for batch in batches:
            for part in small_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in texts_of(part.column(1))], pa.binary())], names=["key", "hashes"])
        settle()

    sets = texts.select("key", "text").dropDuplicates(["key"]).mapInArrow(run, "key long, hashes binary")
    sets = cut(sets.join(wanted.select("key", "blob", "fp", "size"), "key").join(per_blob, "blob"))
    parts = (sets.agg(F.sum("size")).first()[0] or 0) // (ELEMENTS // 2) + 12
    few = sets.where("chunks = 1").withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(parts))).select("part", "blob", "key", "fp", "hashes", F.lit(False).alias("first"))
    edges, many = few.groupBy("part").applyInArrow(lambda g: _forest(g), "u long, v long"), sets.where("chunks > 1")
    return components(edges if many.isEmpty() else edges.union(_large(many, group)))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest doc_id of their group of near copies, one row of each group."""
    marked = _marked(docs, shingle)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = marked.groupBy("key").agg(F.min(row).alias("least"), *(F.first(n).alias(n) for n in ("size", "fp", "bands")))
    distinct = cut(distinct.select("key", "size", "fp", "bands", "least.doc_id", "least.text_hash"))
    roots = links(distinct, docs, shingle, tile, group).select(F.col("node").alias("key"), "root")
    ends = distinct.select("key", row.alias("least")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # one (id, text) of each group; ids that are null come last
    kept = ends.groupBy("root").agg(F.min("least").alias("kept"))
    named = ends.select("key", "root").join(kept, "root").select("key", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("text_hash").eqNullSafe(F.col("kept_hash"))
    rows = marked.select("doc_id", "text_hash", "key").join(named, "key").groupBy("doc_id", "text_hash").agg(F.max(same).alias("stays"), F.count("*").alias("n"))
    # rows that go, and rows that stand several times; the texts are shuffled once, at every size of the input
    special = cut(rows.where("NOT stays OR n > 1").select(F.col("doc_id").alias("copies_id"), F.col("text_hash").alias("copies_text"), "stays"))
    passed = docs.join(special.select("copies_id", "copies_text").hint("merge"), _same_row(), "left_anti")
    repeated = special.where("stays").select("copies_id", "copies_text")
    if repeated.isEmpty():
        return passed
    again = docs.join(repeated.hint("merge"), _same_row()).dropDuplicates(["copies_id", "copies_text"])
    return passed.union(again.select(*(docs[c] for c in docs.columns)))
