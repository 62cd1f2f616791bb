"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is cut into cells of about equal numbers of rows (exact running counts of its values, at most ``2^bits - 1``
boundaries), a row's cells give its place on the curve, rows are range-partitioned and sorted by place, and runs of the order
become shards. Near places are near in every dimension, so each shard covers a small range of most of them:
``shard_ranges`` keeps these ranges, ``matching_shards`` reads which shards a filter can touch.

Cases: null lies in a cell of its own before all values; NaN counts as the largest number; ties at a place are ordered by ``ties``
(rows equal in these too may swap slots). Tables without rows give none; with fewer rows than shards some shards stay empty.
Existing columns named ``curve``, ``shard`` or ``slot`` are replaced. A place with a third of all rows is cut like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import materialise


def _sliced(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in ranges of ``order``, numbered by ``_slice``."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "curve")


def _running(sliced: DataFrame, order: list[str], amount: Column) -> DataFrame:
    """Adds ``_upto``, the sum of ``amount`` up to a row, itself included: within its slice, plus all earlier slices."""
    per_slice = sliced.groupBy("_slice").agg(F.sum(amount).alias("_sum"))
    # one row per slice: as many as shuffle partitions
    before = F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    earlier = per_slice.select("_slice", F.coalesce(before, F.lit(0)).alias("_earlier"))
    within = F.sum(amount).over(Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sliced.withColumn("_within", within).join(F.broadcast(earlier), "_slice").withColumn("_upto", F.col("_within") + F.col("_earlier")).drop("_within", "_earlier")


def boundaries(df: DataFrame, dimension: str, bits: int) -> list:
    """Sorted smallest values of at most ``2^bits - 1`` cells that hold about equal numbers of rows."""
    counts = df.select(F.col(dimension).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    sliced = _sliced(counts, ["value"])
    total = sliced.agg(F.sum("n")).first()[0]
    if not total:
        return []
    cell = F.expr(f"(2 * _upto - n) * {2**bits - 1} div (2 * {total})")
    firsts = _running(sliced, ["value"], F.col("n")).groupBy(cell.alias("cell")).agg(F.min("value").alias("value"))
    return [r.value for r in firsts.orderBy("cell").collect()]


def cell(value: Column, bounds: list) -> Column:
    """0 for null, else the number of boundaries up to the value."""
    if not bounds:
        return F.when(value.isNull(), 0).otherwise(1)
    inside = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))
    return F.when(value.isNull(), 0).otherwise(inside)


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points given as dimensions x points, ``bits`` bits each.

    From the highest bit down, a set bit mirrors the lower bits of the first axis and a clear one swaps them with the axis's
    own; the Gray code of what is left, read across the axes, is the place."""
    axes = cells.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(len(axes)):
            mirrored = axes[k] >> bit & 1 == 1
            swapped = np.where(mirrored, 0, (axes[0] ^ axes[k]) & low)
            axes[k] ^= swapped
            axes[0] ^= np.where(mirrored, low, swapped)
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turn = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    axes ^= turn
    places = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            places = places << 1 | axis >> bit & 1
    return places


def place(docs: DataFrame, dimensions: list[str], bits: int) -> Column:
    """A row's place on the curve through ``dimensions``; ``bits`` times their number is at most 62."""
    if len(dimensions) * bits > 62:
        raise ValueError("at most 62 bits in all")

    @F.pandas_udf("long")
    def on_curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_places(np.stack([c.to_numpy(np.int64) for c in cells]), bits))

    return on_curve(*[cell(F.col(d), boundaries(docs, d, bits)) for d in dimensions])


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int, law: str = "rows", ties: list[str] = (), bits: int = 6, size: str = "size") -> DataFrame:
    """``docs`` with ``curve``, ``shard`` (from 0) and ``slot`` (from 0 in each shard, along the curve).

    ``law`` "rows": the shards' numbers of rows differ by at most one. "bytes": sums of the column ``size`` are near equal, to
    one row's size at each cut."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no law {law}")
    placed = docs.withColumn("curve", place(docs, dimensions, bits)).drop("shard", "slot")
    order = ["curve", *ties]
    numbered = _running(_sliced(placed, order), order, F.lit(1)).withColumnRenamed("_upto", "_rank")
    if law == "rows":
        total = numbered.count()
        if not total:
            return docs.withColumn("curve", F.lit(0).cast("long")).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
        shard = F.expr(f"cast((_rank - 1) * {shards} div {total} as int)")
        slot = F.expr(f"_rank - 1 - (cast(shard as long) * {total} + {shards - 1}) div {shards}")
        return numbered.withColumn("shard", shard).withColumn("slot", slot).drop("_rank", "_slice")
    numbered = materialise(numbered, "ranked")
    weighed = _running(numbered, ["_rank"], F.col(size).cast("decimal(20,0)"))
    total = numbered.agg(F.sum(F.col(size).cast("decimal(20,0)"))).first()[0] or 0
    middle = F.col("_upto") * 2 - F.col(size)
    shard = F.least(F.floor(middle * shards / F.lit(max(2 * total, 1))).cast("int"), F.lit(shards - 1))
    dealt = materialise(weighed.withColumn("shard", shard).drop("_upto", "_slice"), "dealt")
    firsts = dealt.groupBy(F.col("shard").alias("_shard")).agg(F.min("_rank").alias("_first"))
    return dealt.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_shard")


def shard_ranges(dealt: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per shard: its rows, and ``low_``, ``high_`` and ``nulls_`` of each dimension."""
    ranges = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("low", F.min), ("high", F.max), ("nulls", lambda c: F.count(F.when(F.col(c).isNull(), 1))))]
    return dealt.groupBy("shard").agg(F.count("*").alias("rows"), *ranges)


def matching_shards(ranges: DataFrame, wanted: dict[str, tuple]) -> DataFrame:
    """Shards that can hold rows with every dimension of ``wanted`` between its two ends (an end of None is open)."""
    for d, (low, high) in wanted.items():
        if low is not None:
            ranges = ranges.filter(F.col(f"high_{d}") >= low)
        if high is not None:
            ranges = ranges.filter(F.col(f"low_{d}") <= high)
    return ranges.select("shard")


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order: readers that filter by dimensions skip most row groups."""
    dealt.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
