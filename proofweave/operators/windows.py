"""Ordered steps and pair generation that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SPLITS = 64
BUCKET_ROWS = 1 << 17  # rows of one order bucket
CHUNK = 4096


def order_bucket(df: DataFrame, order: list[str], splits: int = SPLITS) -> Column:
    """Bucket number that grows with the ``order`` columns, compared by their own types.

    Cut points are rows of the frame: those with the smallest hashes, a bounded number, sorted, every n-th of them. Rows
    that tie in the first column are told apart by the others, so a column of one value still spreads.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    sample = keyed.orderBy(F.xxhash64(*names)).limit(splits * 16)
    rows = sample.distinct().orderBy(*names).collect()
    points = rows[16::16] or rows[1:][:: max(1, len(rows) // splits)]
    if not points:
        return F.lit(0)
    own = F.struct(*[F.col(c).alias(n) for c, n in zip(order, names, strict=True)])
    cuts = [F.struct(*[F.lit(p[n]).cast(keyed.schema[n].dataType).alias(n) for n in names]) for p in points]
    return F.size(F.filter(F.array(*cuts), lambda p: p <= own))


def order_ranges(df: DataFrame, order: list[str], splits: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_b``, the number of its range of the ``order`` columns: as many ranges as the rows fill, of like size.

    The rows are dealt by range and written out with the range they came to, so later steps agree on it whatever is
    computed again. Nothing but Spark's own sample of the keys reaches the driver.
    """
    n = splits or df.count() // bucket_rows + 1
    return cut(df.repartitionByRange(int(n), *order).withColumn("_b", F.spark_partition_id()))


def ordered_steps(
    df: DataFrame, keys: list[str], order: str, carry: dict[str, str], tie: str | None = None, splits: int | None = None
) -> DataFrame:
    """Adds ``step`` (1-based position within ``keys``) and ``prev_x`` / ``next_x`` for each carried column.

    A key's rows are cut into order buckets, numbered inside the bucket and stitched through one row per
    (key, bucket): no task ever sorts a whole hot key, and the stitching window sees one row for each bucket of a key.
    Buckets hold about ``BUCKET_ROWS`` rows however many there are; ``splits`` fixes their number instead.
    """
    columns = df.columns
    ordering = [order] + ([tie] if tie else [])
    b = order_ranges(df, ordering, splits)
    inner = Window.partitionBy(*keys, "_b").orderBy(*ordering)
    sort_key = F.struct(*ordering)
    carried = F.struct(*[F.col(c).alias(f"c_{a}") for a, c in carry.items()]) if carry else F.struct(F.lit(1).alias("c_"))
    edges = b.groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(carried, sort_key).alias("_first"), F.max_by(carried, sort_key).alias("_last")
    )
    outer = Window.partitionBy(*keys).orderBy("_b") if keys else Window.orderBy("_b")
    edges = edges.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag("_last").over(outer).alias("_before"),
        F.lead("_first").over(outer).alias("_after"),
    )
    inside = b.withColumn("_rn", F.row_number().over(inner))
    for a, c in carry.items():
        inside = inside.withColumn(f"_p_{a}", F.lag(c).over(inner)).withColumn(f"_n_{a}", F.lead(c).over(inner))
    inside = inside.withColumn("_tail", F.lead(F.lit(1)).over(inner).isNull())
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._b") == F.col("r._b")]
    joined = inside.alias("l").join(edges.alias("r"), on)
    out = [F.col(f"l.{c}") for c in columns] + [(F.col("_rn") + F.col("_off")).alias("step")]
    for a in carry:
        out.append(F.when(F.col("_rn") == 1, F.col(f"_before.c_{a}")).otherwise(F.col(f"_p_{a}")).alias(f"prev_{a}"))
        out.append(F.when(F.col("_tail"), F.col(f"_after.c_{a}")).otherwise(F.col(f"_n_{a}")).alias(f"next_{a}"))
    return joined.select(*out)


def pairs_within(df: DataFrame, keys: list[str], item: str, chunk: int = CHUNK) -> DataFrame:
    """Unordered pairs ``(a, b)`` of rows sharing ``keys``, smaller ``item`` first.

    A group larger than ``chunk`` is cut into slots and joined slot against slot, so each task meets at most
    ``chunk`` x ``chunk`` rows of one group; smaller groups take a plain equi-join. Every pair appears once.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk)
    hot = sizes.select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_slots"))
    slotted = (
        df.join(hot, keys, "left")
        .withColumn("_slots", F.coalesce("_slots", F.lit(1)))
        .withColumn("_slot", F.expr(f"CAST(pmod(xxhash64({item}), _slots) AS INT)"))
    )
    a = slotted.withColumn("_j", F.explode(F.expr("sequence(_slot, _slots - 1)"))).withColumn("_i", F.col("_slot"))
    b = slotted.withColumn("_i", F.explode(F.expr("sequence(0, _slot)"))).withColumn("_j", F.col("_slot"))
    fields = [c for c in df.columns if c not in keys]
    pack = lambda d, name: d.select(*keys, "_i", "_j", F.struct(*fields).alias(name))
    met = pack(a, "x").join(pack(b, "y"), [*keys, "_i", "_j"]).where(
        (F.col("_i") < F.col("_j")) | (F.col(f"x.{item}") < F.col(f"y.{item}"))
    )
    swap = F.col(f"x.{item}") > F.col(f"y.{item}")
    return met.select(
        *keys,
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"),
    )


def join_within(left: DataFrame, right: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Inner equi-join on ``keys`` in which no task meets more than ``chunk`` x ``chunk`` rows of one key.

    Each side of a key above ``chunk`` rows is cut into slots by the hash of its rows, and slot meets slot: rows of one side
    are repeated once for each slot of the other. Keys at or below it have one slot. Every pair of rows appears once.
    """
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > chunk).select(*keys, F.ceil(F.col(n) / chunk).cast("int").alias(n))
    hot = count(left, "_sl").join(count(right, "_sr"), keys, "full").na.fill(1, ["_sl", "_sr"])
    sides = []
    for d, own, other, mine, theirs in ((left, "_sl", "_sr", "_i", "_j"), (right, "_sr", "_sl", "_j", "_i")):
        rest = [F.col(c).cast("string") for c in d.columns if c not in keys]
        slots = d.join(hot, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_sl", "_sr")})
        slots = slots.withColumn(mine, F.pmod(F.xxhash64(*rest), F.col(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        sides.append(slots.drop("_sl", "_sr"))
    return sides[0].join(sides[1], [*keys, "_i", "_j"]).drop("_i", "_j")
