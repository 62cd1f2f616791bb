"""Batch texts for a scoring service and the parsing of its replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, cache_key
from .ranking import full_row_number


def numbered_batches(rows: DataFrame, keys: list[str], seq: str, name: str, size: int) -> DataFrame:
    """(keys, batch, body): rows of a key in ``seq`` order, ``size`` per batch, one numbered line per
    row. A batch is bounded by ``size``; the row numbers come from the sliced exact numbering."""
    numbered = full_row_number(rows, keys, [seq], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size))
    line = F.concat(
        ((F.col("_n") - 1) % size + 1).cast("string"), F.lit(". ["), F.col(seq).cast("string"), F.lit("] "), F.col(name)
    )
    packed = numbered.groupBy(*keys, "batch").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("_l"))
    return packed.select(*keys, "batch", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"))


def _lines(replies: DataFrame, body: str) -> DataFrame:
    kept = [c for c in replies.columns if c != body]
    lines = replies.select(*kept, F.explode(F.split(F.trim(F.col(body)), "\n")).alias("_line"))
    parts = lines.select(*kept, F.split(F.trim("_line"), r"\.").alias("_p")).filter(F.size("_p") >= 2)
    return parts.withColumn("idx", F.expr("try_cast(trim(_p[0]) as int)")).filter("idx is not null")


def parse_labels(replies: DataFrame, body: str, allowed: list[str]) -> DataFrame:
    """"<n>. <label>" lines -> (.., idx, label); lines without a number or an allowed label are dropped."""
    word = F.split(F.trim(F.lower(F.col("_p")[1])), SPACE + "+")[0]
    return _lines(replies, body).withColumn("label", word).filter(F.col("label").isin(allowed)).drop("_p")


def parse_scores(replies: DataFrame, body: str) -> DataFrame:
    """"<n>. <0..10>" lines -> (.., idx, score in 0..1)."""
    raw = F.split(F.trim(F.col("_p")[1]), SPACE + "+")[0].try_cast("int")
    return (
        _lines(replies, body)
        .withColumn("score", raw / F.lit(10.0))
        .filter((F.col("score") >= 0) & (F.col("score") <= 1))
        .drop("_p")
    )


def with_cache(rows: DataFrame, cache: DataFrame, scored: DataFrame | None, text: str, default: str) -> DataFrame:
    """Adds ``value``: cached by content key, else freshly scored by ``id``, else the default, and
    ``origin``. ``cache(key, value)``, ``scored(id, value)``."""
    keyed = rows.withColumn("key", cache_key(F.col(text)))
    out = keyed.join(cache.select("key", F.col("value").alias("_c")).dropDuplicates(["key"]), "key", "left")
    if scored is None:
        out = out.withColumn("_s", F.lit(None).cast("string"))
    else:
        out = out.join(scored.select("id", F.col("value").alias("_s")), "id", "left")
    origin = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_s").isNotNull(), "scored").otherwise("default")
    return out.withColumn("origin", origin).withColumn("value", F.coalesce("_c", "_s", F.lit(default))).drop("_c", "_s")


def uncached(rows: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("key", cache_key(F.col(text))).join(cache.select("key").distinct(), "key", "left_anti")
