"""Bit filters as tables: one row per 64 cells, of bounded number, so that they may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of 64 bits that a filter has at most: 16 MB of numbers and bits.
FILTER_WORDS = 1 << 20


def cell(key: Column, cells: int) -> Column:
    """One of ``cells`` (a power of two) for a key of any type."""
    return F.xxhash64(key).bitwiseAND(F.lit(cells - 1))


def cells_for(rows: int, per_row: int) -> int:
    return 1 << max(12, (per_row * rows - 1).bit_length())


def filter_words(cells: int, most: int = FILTER_WORDS) -> int:
    return min(most, cells >> 6)


def _place(cell_column: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a cell; beyond the bound of the filter, cells share words."""
    return F.shiftright(cell_column, 6).bitwiseAND(F.lit(words - 1)), cell_column.bitwiseAND(F.lit(63)).cast("int")


def bit_filter(cells_found: DataFrame, words: int) -> DataFrame:
    """``word, bits`` of a column ``cell``; at most ``words`` rows."""
    word, bit = _place(F.col("cell"), words)
    return cells_found.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def tested(rows: DataFrame, key: Column, cells: int, bits: DataFrame, words: int, name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean that is true wherever the key's bit is set. The filter is broadcast: its size is bounded."""
    word, bit = _place(cell(key, cells), words)
    found = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word", "left")
    return found.withColumn(name, F.coalesce(F.getbit("bits", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_bit", "bits")
