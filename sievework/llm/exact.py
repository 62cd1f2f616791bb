"""Exact deduplication: a two-pass Bloom filter finds possibly repeated digests, only their rows shuffle.

First pass: every text is reduced to a digest, and its digest to one of at least 64 cells per row; counting rows per
cell (partial counts before the shuffle) finds the cells that more than one row falls into. They become a bit filter
of bounded size. Second pass: each row tests its cell's bit in the broadcast filter. Rows whose bit is clear are unique
and pass straight through; the others meet their like by full digest. A crowded filter only lets more rows through to
the exact comparison, so the result doesn't depend on its size.

Null texts count as empty, and empty texts equal each other. Rows that repeat both id and text come out as one
document; group sizes count rows. A null id is never the smallest. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import bits
from sievework.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"
CELLS_PER_ROW = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_words: int = bits.FILTER_WORDS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    Texts are equal if they are identical once every run of white space is one blank; the smallest id stays."""
    rows = materialise(
        docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_column)), 256)).alias("digest")), "digests"
    )
    cells = bits.cells_for(rows.count(), CELLS_PER_ROW)
    words = bits.filter_words(cells, filter_words)
    repeated = rows.select(bits.cell(F.col("digest"), cells).alias("cell")).groupBy("cell").count().filter("count > 1")
    tested = bits.tested(rows, F.col("digest"), cells, bits.bit_filter(repeated, words), words)
    unique = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    again = tested.filter("maybe").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = again.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    met = again.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return unique.unionByName(met)
