"""Concept lookup: conversation turns and page hosts against the words of the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup
from ..session import materialise, table
from .registry import norm_sql, query
from .search import HOST

SYN = (
    f"words AS (SELECT item_id, unnest(w) AS synonym, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT item_id, "
    f"string_split({norm_sql('text')}, ' ') AS w FROM benchmark)), "
    "raw AS (SELECT item_id * 100000 + pos AS seq, synonym, item_id AS concept_id FROM words), "
    "syn AS (SELECT synonym, min(seq) AS seq, arg_max(concept_id, seq) AS concept_id FROM raw WHERE synonym <> '' GROUP BY 1)"
)
Q = (
    f"q AS (SELECT * FROM (SELECT 'turn ' || conv_id || ' ' || turn AS qid, {norm_sql('text')} AS q FROM conversations UNION ALL "
    f"SELECT 'page ' || page_id, {norm_sql(HOST)} FROM pages) WHERE q <> '')"
)
FUZZY = (
    "fz AS (SELECT q.qid, s.synonym AS matched, s.concept_id, 1 AS distance, length(s.synonym) AS ln, s.seq FROM {src} q JOIN "
    "syn s ON length(q.q) >= 6 AND abs(length(q.q) - length(s.synonym)) <= 1 AND levenshtein(q.q, s.synonym) = 1), "
    "fc AS (SELECT * FROM fz QUALIFY row_number() OVER (PARTITION BY qid, concept_id ORDER BY ln, seq) = 1), "
    "fr AS (SELECT qid, matched, concept_id, distance, row_number() OVER (PARTITION BY qid ORDER BY ln, seq) AS rank FROM fc)"
)
FIRST = (
    "(SELECT q.qid, arg_min(s.concept_id, s.seq) AS concept_id, arg_min(s.synonym, s.seq) AS matched FROM {src} q JOIN syn s "
    "ON contains(q.q, s.synonym) OR contains(s.synonym, q.q) GROUP BY 1)"
)
LONGEST = (
    "(SELECT qid, concept_id, synonym AS matched FROM (SELECT q.qid, s.*, q.q, instr(q.q, s.synonym) AS i, "
    "instr(s.synonym, q.q) AS j FROM {src} q JOIN syn s ON length(q.q) > 3 AND (contains(q.q, s.synonym) OR "
    "contains(s.synonym, q.q))) WHERE CASE WHEN length(synonym) <= 3 THEN list_contains(string_split(q, ' '), synonym) "
    "WHEN i > 0 THEN (i = 1 OR substr(q, i - 1, 1) = ' ') AND (i + length(synonym) = length(q) + 1 OR "
    "substr(q, i + length(synonym), 1) = ' ') ELSE (j = 1 OR substr(synonym, j - 1, 1) = ' ') AND (j + length(q) = "
    "length(synonym) + 1 OR substr(synonym, j + length(q), 1) = ' ') END "
    "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(synonym) DESC, seq) = 1)"
)


def synonyms(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(lookup.norm(F.col("text")), " ")))
    return b.select(
        (F.col("item_id") * 100000 + F.col("pos") + 1).alias("seq"),
        F.col("col").alias("synonym"),
        F.col("item_id").alias("concept_id"),
    )


def queries(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws(" ", F.lit("turn"), "conv_id", "turn").alias("qid"), "text")
    hosts = table(spark, sf, "pages").select(
        F.concat_ws(" ", F.lit("page"), "page_id").alias("qid"),
        F.regexp_extract("url", r"//(m\.|www\.)?([^./]+)\.", 2).alias("text"),
    )
    return turns.unionByName(hosts)


def prepared(spark, sf):
    syn = materialise(lookup.normalise_synonyms(synonyms(spark, sf)), "synonyms")
    return materialise(lookup.normalise_queries(queries(spark, sf)), "queries"), syn


@query("synonym_index", sql=f"WITH {SYN} SELECT synonym, seq, concept_id FROM syn")
def synonym_index(spark, sf):
    return lookup.normalise_synonyms(synonyms(spark, sf))


@query("lookup_exact", sql=f"WITH {SYN}, {Q} SELECT qid, concept_id, synonym AS matched FROM q JOIN syn ON q = synonym")
def lookup_exact(spark, sf):
    return lookup.resolve_exact(
        lookup.normalise_queries(queries(spark, sf)), lookup.normalise_synonyms(synonyms(spark, sf))
    )


@query("lookup_first_substring", sql=f"WITH {SYN}, {Q} SELECT * FROM {FIRST.format(src='q')}")
def lookup_first_substring(spark, sf):
    return lookup.resolve_first_substring(*prepared(spark, sf))


@query("lookup_longest", sql=f"WITH {SYN}, {Q} SELECT * FROM {LONGEST.format(src='q')}")
def lookup_longest(spark, sf):
    return lookup.resolve_longest(*prepared(spark, sf))


@query(
    "lookup_similar",
    sql=f"WITH {SYN}, {Q}, {FUZZY.format(src='q')} SELECT qid, matched, concept_id, distance, CAST(rank AS INTEGER) AS rank "
    "FROM fr WHERE rank <= 3",
)
def lookup_similar(spark, sf):
    return lookup.suggest_similar(*prepared(spark, sf), 3)


def cascade_sql(pick: str) -> str:
    return (
        f"WITH {SYN}, {Q}, ex AS (SELECT qid, concept_id, synonym AS matched FROM q JOIN syn ON q = synonym), "
        f"l1 AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM ex)), sb AS {pick.format(src='l1')}, "
        f"l2 AS (SELECT * FROM l1 WHERE qid NOT IN (SELECT qid FROM sb)), {FUZZY.format(src='l2')} "
        "SELECT *, 'exact' AS stage FROM ex UNION ALL SELECT *, 'substring' FROM sb UNION ALL "
        "SELECT qid, concept_id, matched, 'fuzzy' FROM fr WHERE rank = 1"
    )


@query("concept_resolution_region", sql=cascade_sql(FIRST))
def concept_resolution_region(spark, sf):
    return lookup.resolve(queries(spark, sf), synonyms(spark, sf), "first")


@query("concept_resolution_global", sql=cascade_sql(LONGEST))
def concept_resolution_global(spark, sf):
    return lookup.resolve(queries(spark, sf), synonyms(spark, sf), "longest")
