"""Ranking helpers that stay distributed when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The planner limits every input task to ``k`` rows per group
    before the shuffle (WindowGroupLimit), so a hot group never reaches one task whole."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the smallest ``order`` tuple. A min over a struct, so partial aggregates
    are combined before the shuffle."""
    packed = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_best")
    picked = df.groupBy(*keys).agg(packed)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def last_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the largest ``order`` tuple (later definition wins)."""
    packed = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_best")
    picked = df.groupBy(*keys).agg(packed)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def _ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` as a written table, with ``_slice``: which of the ranges of ``columns`` a row falls into. A key with very
    many rows spreads over many ranges."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(slices, *columns).withColumn("_slice", F.spark_partition_id()), "ranges")


def next_value(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Adds the next larger-or-equal ``order`` value of the same key, null for the last row. Rows look
    inside their (key, slice) first; the last one of a slice takes the start of the key's next slice."""
    sliced = _ranged(df, [*keys, order])
    starts = sliced.groupBy(*keys, "_slice").agg(F.min(order).alias("_start"))
    later = F.lead("_start").over(Window.partitionBy(*keys).orderBy("_slice"))
    follow = starts.select(*keys, "_slice", later.alias("_later"))
    local = F.lead(order).over(Window.partitionBy(*keys, "_slice").orderBy(order))
    joined = sliced.withColumn("_local", local).join(follow, [*keys, "_slice"])
    return joined.withColumn(out, F.coalesce("_local", "_later")).drop("_slice", "_local", "_later")


def full_row_number(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Exact 1-based row number per key for *every* row, without sorting a whole group in one task.

    ``order`` are columns of any type whose values together are unique within a key. Ranges of keys and order cut
    a key into slices; each (key, slice) is numbered on its own and shifted by the number of rows of the key in the
    earlier slices, of which there are at most as many as shuffle partitions.
    """
    sliced = _ranged(df, [*keys, *order])
    totals = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(offsets.select(*[F.col(k).alias(f"_o_{k}") for k in [*keys, "_slice"]], "_offset"),
              on=[F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in [*keys, "_slice"]])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_slice", "_local", "_offset", *[f"_o_{k}" for k in [*keys, "_slice"]])
    )
