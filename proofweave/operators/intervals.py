"""Half-open validity intervals, swept as day-keyed deltas.

A (subject, object, predicate) group can hold any number of claims, but only as many distinct cut days as the calendar
has. Everything a segment needs is therefore summed per (group, day) first, and the running window that follows sees
days, not claims. No claim list is ever collected: which claim supports which segment is a long table, read off with
two equi-joins on the cut days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the unbounded ends used inside the sweep only
FIRST_DAY = "0001-01-01"
LAST_DAY = "9999-12-31"


def half_open(df: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Adds ``lo``/``hi`` with ``[lo, hi)``. The last day of the calendar as an end means no end. Rows that cover no day
    are left to ``unrepresentable``."""
    last = F.to_date(F.lit(LAST_DAY))
    rows = df.withColumn("lo", F.coalesce(F.col(start), F.to_date(F.lit(FIRST_DAY)))).withColumn(
        "hi", F.when(F.col(end).isNull() | (F.col(end) >= last), last).otherwise(F.date_add(F.col(end), 1))
    )
    return rows.where(F.col("lo") < F.col("hi"))


def unrepresentable(df: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows ``half_open`` leaves out, with the reason."""
    return df.withColumn(
        "error",
        F.when(F.col(end) < F.col(start), "valid_to before valid_from").when(
            F.col(start) >= F.to_date(F.lit(LAST_DAY)), "valid_from beyond the date range"
        ),
    ).where(F.col("error").isNotNull())


def deltas(rows: DataFrame, keys: list[str], measures: dict) -> DataFrame:
    """``+m`` at ``lo`` and ``-m`` at ``hi`` for each measure, summed per (keys, day)."""
    names = list(measures)
    flat = rows.select(*keys, "lo", "hi", *[measures[n].alias(n) for n in names])
    ends = F.explode(F.array(F.struct(F.col("lo").alias("cut"), F.lit(1).alias("sign")),
                             F.struct(F.col("hi").alias("cut"), F.lit(-1).alias("sign")))).alias("e")
    return (
        flat.select(*keys, *names, ends)
        .groupBy(*keys, F.col("e.cut").alias("cut"))
        .agg(*[F.sum(F.col(n) * F.col("e.sign")).alias(n) for n in names])
    )


def presence(rows: DataFrame, keys: list[str], item: list[str], measures: dict) -> DataFrame:
    """Deltas that count each distinct ``item`` once, however many of its intervals cover a day."""
    kept = [c for c in item]
    per_item = deltas(rows, keys + kept, {"_d": F.lit(1)})
    step = steps(per_item, keys + kept).where(F.col("_s") != 0)
    return step.groupBy(*keys, "cut").agg(*[F.sum(F.col("_s") * m).alias(n) for n, m in measures.items()])


def steps(per_item: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_s`` to deltas ``_d`` of items: 1 on the day an item begins to be covered, -1 on the day that ends, else 0."""
    w = Window.partitionBy(*keys).orderBy("cut")
    running = per_item.withColumn("_r", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    began = F.signum("_r").cast("int") - F.signum(F.coalesce(F.lag("_r").over(w), F.lit(0))).cast("int")
    return running.withColumn("_s", began).drop("_r")


def sweep(parts: list[DataFrame], keys: list[str], cover: str) -> DataFrame:
    """Running totals between consecutive cuts: one row per cut with ``idx``, ``lo``, ``hi`` and every measure."""
    names = sorted({c for p in parts for c in p.columns if c not in keys and c != "cut"})
    wide = [
        p.select(*keys, "cut", *[(F.col(n) if n in p.columns else F.lit(0)).cast("long").alias(n) for n in names])
        for p in parts
    ]
    total = reduce(DataFrame.unionByName, wide).groupBy(*keys, "cut").agg(*[F.sum(n).alias(n) for n in names])
    return running(total, keys, cover)


def running(total: DataFrame, keys: list[str], cover: str) -> DataFrame:
    """Running totals of one row per (keys, cut)."""
    names = sorted(c for c in total.columns if c not in keys and c != "cut")
    w = Window.partitionBy(*keys).orderBy("cut")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return total.select(
        *keys,
        F.row_number().over(w).alias("idx"),
        F.col("cut").alias("lo"),
        F.lead("cut").over(w).alias("hi"),
        *[F.sum(n).over(run).alias(n) for n in names],
    ).withColumn("covered", F.col(cover) > 0)


def bounds(df: DataFrame) -> DataFrame:
    """``[lo, hi)`` back to inclusive dates with null for unbounded."""
    return df.withColumn(
        "segment_from", F.when(F.col("lo") != F.to_date(F.lit(FIRST_DAY)), F.col("lo"))
    ).withColumn("segment_to", F.when(F.col("hi") != F.to_date(F.lit(LAST_DAY)), F.date_sub("hi", 1)))


def segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal ranges over which the covering set is constant, with how many rows cover them.

    Every cut is some non-empty interval's end, so the covering set differs on its two sides and neighbouring ranges
    never merge.
    """
    swept = sweep([deltas(rows, keys, {"cover": F.lit(1)})], keys, "cover")
    return bounds(swept.where("covered"))


def memberships(rows: DataFrame, swept: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Long table (keys, idx, item): the segments each row covers, found by position instead of a range join."""
    at = swept.select(*keys, F.col("lo").alias("cut"), F.col("idx").alias("at"))
    found = (
        rows.select(*keys, item, "lo", "hi")
        .join(at.withColumnRenamed("cut", "lo").withColumnRenamed("at", "i"), [*keys, "lo"])
        .join(at.withColumnRenamed("cut", "hi").withColumnRenamed("at", "j"), [*keys, "hi"])
    )
    return found.select(*keys, item, F.explode(F.expr("sequence(i, j - 1)")).alias("idx"))
