"""Line deduplication: lines are judged by their hashes, documents get bitmaps of the lines that stay.

The hashes of all lines are range-partitioned together with a split number, so that a line which a third of all
documents hold still spreads over the cluster, and sorted within partitions by document and position. One pass over
that order marks first occurrences and counts documents; the few sums per hash and split then meet. What returns to
the documents is one bit per line, and only for documents that lose a line; texts are not part of any of this.

A null or empty text is one empty line. Lines whose key is shorter than ``min_chars`` always stay. Documents are told
apart by id and text: repeated rows count once and lose the same lines. Further columns stay as they are.
Keys are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import materialise

BLANK_CHARS = " \t\n\x0b\f\r"
SPREAD = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """What makes lines equal: blanks at both ends go, A-Z become lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK_CHARS)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_occurrences(docs: DataFrame, id_column: str, text_column: str, min_chars: int, long_words: int | None = None) -> DataFrame:
    """``id, tag, pos, hash`` of every line with a key of at least ``min_chars`` code points, and whether it is ``long``."""
    words = F.size(F.array_remove(F.split(F.translate("key", BLANK_CHARS, " " * len(BLANK_CHARS)), " ", -1), ""))
    long = F.lit(False) if long_words is None else words >= long_words
    # Null ids would never meet their bitmap in a join; the tag keeps such rows apart.
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return (
        base.select("id", _tag(F.col("text")).alias("tag"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "tag", "pos", F.xxhash64("key").alias("hash"), long.alias("long"))
    )


def dropped_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, long_words: int | None = None) -> DataFrame:
    """``id, tag, dropped``: for each document that loses a line, its 64-line words with the bits of lines to drop.

    Lines found in at least ``min_docs`` documents go: all their occurrences, or with ``keep_first`` all but the first
    one by document and position. Lines of ``long_words`` words or more go from two documents on."""
    spark = docs.sparkSession
    occurrences = materialise(line_occurrences(docs, id_column, text_column, min_chars, long_words), "lines")
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = F.pmod(F.xxhash64("id", "tag"), F.lit(splits)).cast("int")
    order = ["hash", "split", "id", "tag", "pos"]
    ranged = occurrences.withColumn("split", split).repartitionByRange("hash", "split").sortWithinPartitions(*order)
    window = Window.partitionBy("hash", "split").orderBy("id", "tag", "pos")
    here = F.struct("id", "tag")
    streamed = ranged.withColumn("new_document", F.when(here.eqNullSafe(F.lag(here).over(window)), 0).otherwise(1))
    sums = streamed.groupBy("hash", "split").agg(F.sum("new_document").alias("n"), F.min(F.struct("id", "tag", "pos")).alias("first"), F.max("long").alias("long"))
    least = F.when(F.col("long"), min(2, min_docs)).otherwise(min_docs)
    common = sums.groupBy("hash").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"), F.max("long").alias("long")).filter(F.col("n_docs") >= least)
    # A line of very many documents meets its verdict in several tasks.
    spread = F.pmod(F.xxhash64("tag", "id"), F.lit(SPREAD)).cast("int")
    verdicts = common.select("hash", "first", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    gone = occurrences.withColumn("spread", spread).join(verdicts, ["hash", "spread"])
    if keep_first:
        gone = gone.filter(~F.struct("id", "tag", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy("id", "tag", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", counts: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the lines that their bitmap drops gone.

    With ``counts``, ``n_lines`` and ``n_dropped`` take the place of columns of these names."""
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = left.withColumns({"id": F.col(f"row.`{id_column}`"), "tag": _tag(F.col(f"row.`{text_column}`"))}).alias("l")
    right = bitmaps.alias("r")
    joined = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.tag") == F.col("r.tag")), "left").select("row", "dropped")
    lines = text_lines(F.col(f"row.`{text_column}`"))
    # One word per 64 lines, found by position afterwards.
    dense = F.transform(F.sequence(F.lit(0), F.expr("int((size(lines) - 1) div 64)")), lambda w: F.coalesce(F.try_element_at("dropped", w), F.lit(0).cast("long")))
    stays = F.expr("filter(lines, (line, i) -> getbit(gone[i div 64], i % 64) = 0)")
    kept = (
        joined.withColumn("lines", lines)
        .withColumn("gone", F.when(F.col("dropped").isNotNull(), dense))
        .withColumn("stays", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(stays))
    )
    text = F.when(F.col("dropped").isNull(), F.col(f"row.`{text_column}`")).otherwise(F.array_join("stays", "\n"))
    columns = {c: text if c == text_column else F.col(f"row.`{c}`") for c in docs.columns}
    if counts:
        columns |= {"n_lines": F.size("lines").cast("long"), "n_dropped": (F.size("lines") - F.size("stays")).cast("long")}
    return kept.select(*[column.alias(name) for name, column in columns.items()])
