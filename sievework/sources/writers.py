"""Writers: report sections, page records, record envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section of an audit."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_partitioned_json(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines with one folder per value, so later region filters prune folders."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def write_lines(envelopes: DataFrame, path: str) -> None:
    envelopes.select("json").write.mode("overwrite").text(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON file per row, for readers of files that hold a single object."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_arrays(rows: DataFrame, path: str, block: Column, column: str) -> None:
    """JSON texts of ``column`` as files of one array each; ``block`` says which rows share a file and bounds its size."""
    arrays = rows.groupBy(block.alias("block")).agg(F.array_join(F.collect_list(column), ",").alias("_a"))
    whole = arrays.select(F.concat(F.lit("["), "_a", F.lit("]")).alias("value"))
    whole.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_vectors(vectors: DataFrame, path: str, rows: int = 1 << 16) -> None:
    """``vectors(id, vector)`` as packed half-precision matrices of at most ``rows`` rows, one or more a task."""
    packed.register(vectors.sparkSession)
    ready = vectors.selectExpr("string(id) AS id", "cast(vector AS array<float>) AS vector")
    ready.write.format(packed.FORMAT).mode("overwrite").option("rows", rows).save(path)
