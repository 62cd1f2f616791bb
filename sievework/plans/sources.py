"""Round trips through the file formats, on tables derived from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalogue as ca
from ..operators import consensus
from ..session import shared_folder, table
from ..sources import readers, writers
from .consensus import IT, rated_items
from .registry import query
from .search import DICT, page_dictionary
from .vectors import vectors


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/sievework-{name}-{uuid.uuid4().hex}"


@query("partitioned_corpus_scan", sql="SELECT doc_id AS id, md5(text) AS digest, source FROM documents WHERE source IN ('src3', 'src7')")
def partitioned_corpus_scan(spark, sf):
    """Documents as JSON lines per source, read back with a pruned region filter."""
    path = _folder(spark, "corpus")
    writers.write_partitioned_json(table(spark, sf, "documents").select("doc_id", "text", "source"), path, "source")
    back = spark.read.schema("doc_id long, text string, source string").json(path)
    return back.filter(F.col("source").isin("src3", "src7")).select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "source")


@query("envelope_round_trip", sql="SELECT p_name AS name, p_brand AS body_region, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS seconds FROM part GROUP BY ALL")
def envelope_round_trip(spark, sf):
    path = _folder(spark, "envelopes")
    p = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("body_region"), F.col("p_size").cast("long").alias("total_time_seconds")
    )
    writers.write_lines(ca.export_envelope(p, "1.0.0", "builder", F.lit("2024-01-01T00:00:00Z"), p.columns), path)
    back = ca.import_envelopes(spark.read.text(path).withColumnRenamed("value", "json"), "json")
    return back.groupBy("name", "body_region").agg(F.count("*").alias("n"), F.sum("total_time_seconds").alias("seconds"))


# a float as the nearest half-precision number, ties to even
HALF = (
    "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END"
)


@query(
    "packed_vector_scan",
    sql=f"SELECT CAST(vec_id AS VARCHAR) AS id, len(v) AS dim, round(v[1], 9) AS first, round(list_sum(v), 6) AS total FROM (SELECT vec_id, list_transform("
    f"list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: {HALF}) AS v FROM embeddings)",
)
def packed_vector_scan(spark, sf):
    """Embeddings as half-precision matrices of at most 300 rows, read back in byte ranges that cut across rows."""
    path = _folder(spark, "packed")
    writers.write_vectors(vectors(spark, sf), path, 300)
    back = spark.read.format("packed_vectors").option("rangeBytes", 5000).load(path)
    doubles = F.transform("vector", lambda x: x.cast("double"))
    return back.select(
        "id", F.size("vector").cast("long").alias("dim"), F.round(doubles[0], 9).alias("first"),
        F.round(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query(
    "catalogue_scan",
    sql="SELECT 'Order ' || o_orderkey AS name, o_orderstatus = 'F' AS uses_contrast, 'step ' || l_partkey AS sequence_name, l_returnflag = 'R' AS "
    "is_post_contrast, l_linenumber AS sort_order FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def catalogue_scan(spark, sf):
    """Orders as nested catalogue entries in files of arrays, flags in both spellings, read back as entries and steps."""
    path = _folder(spark, "catalogue")
    li = table(spark, sf, "lineitem")
    step = F.struct(
        F.concat_ws(" ", F.lit("step"), "l_partkey").alias("sequence_name"), F.when(F.col("l_returnflag") == "R", "1").otherwise("false").alias("is_post_contrast"),
        F.col("l_linenumber").cast("int").alias("sort_order"),
    )
    steps = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(step).alias("sequences"))
    entry = F.struct(
        F.concat_ws(" ", F.lit("Order"), "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "true").otherwise("0").alias("uses_contrast"), "sequences"
    )
    entries = table(spark, sf, "orders").join(steps, "o_orderkey").select("o_orderkey", F.to_json(entry).alias("entry"))
    writers.write_arrays(entries, path, F.floor(F.col("o_orderkey") / 1000), "entry")
    found, lines, _ = readers.load_catalogue(spark, path)
    return lines.join(found.select("name", "uses_contrast"), "name").select("name", "uses_contrast", "sequence_name", "is_post_contrast", "sort_order")


@query(
    "dictionary_scan",
    sql=f"WITH {DICT} SELECT term, CAST(row_number() OVER (PARTITION BY term ORDER BY synonym) - 1 AS INTEGER) AS pos, synonym FROM dict",
)
def dictionary_scan(spark, sf):
    """Page words as objects whose keys are data, one object a file, read back in order."""
    path = _folder(spark, "dictionary")
    lists = page_dictionary(spark, sf).groupBy("term").agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))
    entry = F.map_from_entries(F.collect_list(F.struct("term", "synonyms")))
    objects = lists.groupBy(F.substring(F.sha1("term"), 1, 2).alias("block")).agg(entry.alias("m")).select(F.to_json("m").alias("value"))
    objects.write.option("maxRecordsPerFile", 1).text(path)
    return readers.load_dictionary(spark, path)


@query(
    "step_library_scan",
    sql="SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS INTEGER) AS seq, p_name AS "
    "name, p_size AS time_seconds, [p_brand, p_type] AS planes, 'for ' || p_type AS purpose FROM part",
)
def step_library_scan(spark, sf):
    """Parts as step libraries of 500 types a file."""
    path = _folder(spark, "library")
    kind = F.struct(
        "p_partkey", F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("time_seconds"),
        F.array("p_brand", "p_type").alias("planes"), F.struct(F.concat_ws(" ", F.lit("for"), "p_type").alias("purpose")).alias("rationale"),
    )
    libraries = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("block")).agg(F.array_sort(F.collect_list(kind)).alias("sequence_types"))
    writers.write_documents(libraries.select("sequence_types"), path)
    return readers.load_step_library(spark, path).select("id", "seq", "name", "time_seconds", "planes", "purpose")


@query(
    "report_sections",
    sql=IT + " SELECT 'summary' AS section, CASE WHEN rating >= 7 THEN 'high' WHEN rating >= 4 THEN 'mid' ELSE 'low' END AS key, count(*) AS n FROM it GROUP BY ALL "
    "UNION ALL SELECT 'detail', CAST(scenario_id AS VARCHAR), count(*) FROM it WHERE rating >= 7 GROUP BY scenario_id",
)
def report_sections(spark, sf):
    """A report of two sections, written and read back."""
    path = _folder(spark, "report")
    items = rated_items(spark, sf, item="p_name")
    high = items.filter(F.col("rating") >= consensus.HIGH).groupBy(F.col("scenario_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    summary = items.groupBy(consensus.rating_band(F.col("rating"))["class"].alias("key")).agg(F.count("*").alias("n"))
    writers.write_report({"summary": summary, "detail": high}, path)
    read = spark.read.schema("key string, n long")
    return read.json(f"{path}/summary").select(F.lit("summary").alias("section"), "*").unionByName(
        read.json(f"{path}/detail").select(F.lit("detail").alias("section"), "*")
    )
