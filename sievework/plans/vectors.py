"""Vector search over embeddings, fusion with the text of the documents of the same id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ..session import table
from .registry import literal, norm_sql, query, values_sql

# abbreviation pairs over syllables of the test prose
PAIRS = [("onti", "ontion"), ("ble", "bless"), ("queau", "que le"), ("schb", "der sch")]

UNIT = (
    "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings), "
    "u AS (SELECT id, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS v FROM e)"
)


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("l2_normalised", sql=f"WITH {UNIT} SELECT id, round(v[1], 9) AS first, round(list_sum(v), 6) AS total, "
       "round(list_dot_product(v, v), 6) AS norm FROM u")
def l2_normalised(spark, sf):
    v = vectors(spark, sf).select("id", vector.l2_normalise(F.col("vector")).alias("v"))
    return v.select(
        "id",
        F.round(F.col("v")[0], 9).alias("first"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(vector.dot(F.col("v"), F.col("v")), 6).alias("norm"),
    )


@query(
    "vector_topk",
    sql=f"WITH {UNIT}, s AS (SELECT a.id AS qid, b.id, list_dot_product(a.v, b.v) AS s FROM u a, u b WHERE a.id <> b.id) "
    "SELECT qid, id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 10",
)
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    hits = vector.vector_topk(v.withColumnRenamed("id", "qid"), v, 10, skip_self=True)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_cells")
def vector_topk_cells(spark, sf):
    """The approximate form on the queries of ``vector_topk``, for the recall against it."""
    v = vectors(spark, sf)
    hits = vector.vector_topk(v.withColumnRenamed("id", "qid"), v, 10, skip_self=True, method="cells")
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def pairs_sql() -> str:
    def has(c, p):
        return f"(contains({c}, {literal(p[0])}) OR contains({c}, {literal(p[1])}))"

    return " + ".join(f"CASE WHEN {has('q', p)} AND ({has('name', p)} OR {has('kw', p)}) THEN 3 ELSE 0 END" for p in PAIRS)


LEX = (
    f"WITH {UNIT}, qq AS (SELECT item_id AS qid, {norm_sql('text')} AS q, v FROM benchmark JOIN u ON u.id = item_id), "
    f"cc AS (SELECT doc_id AS id, {norm_sql('text')} AS name, {norm_sql("source || ' ' || lang")} AS kw, v FROM documents JOIN "
    "u ON u.id = doc_id), s AS (SELECT qid, cc.id, q, name, kw, list_dot_product(qq.v, cc.v) AS sim FROM qq, cc), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS vr FROM s QUALIFY vr <= 32), "
    "l AS (SELECT qid, id, sim, vr, tanh((list_sum(list_prepend(0, list_transform(list_filter(string_split(q, ' '), lambda t: "
    "length(t) >= 3), lambda t: CASE WHEN contains(name, t) THEN 2 WHEN kw <> '' AND contains(kw, t) THEN 1 ELSE 0 END))) + "
    f"{pairs_sql()}) / 4.0) AS lex FROM p), "
    "f AS (SELECT *, sim + 0.05 * lex AS fused, row_number() OVER (PARTITION BY qid ORDER BY sim + 0.05 * lex DESC, vr) AS rank "
    "FROM l) "
)


def _hybrid(spark, sf, k):
    v = vectors(spark, sf)
    q = table(spark, sf, "benchmark").join(v, F.col("item_id") == F.col("id")).select(
        F.col("item_id").alias("qid"), "text", "vector"
    )
    c = table(spark, sf, "documents").join(v, F.col("doc_id") == F.col("id")).select(
        "id", F.col("text").alias("name"), F.array("source", "lang").alias("keywords"), "vector"
    )
    return vector.hybrid_topk(q, c, k=k, pool=32, pairs=PAIRS)


@query(
    "hybrid_search",
    sql=LEX + "SELECT qid, id, round(sim, 6) AS similarity, round(lex, 6) AS lexical, round(fused, 6) AS score, "
    "CAST(vr AS INTEGER) AS vector_rank, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 8",
)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, 8).select(
        "qid", "id", F.round("similarity", 6).alias("similarity"), F.round("lexical", 6).alias("lexical"),
        F.round("score", 6).alias("score"), "vector_rank", "rank",
    )


@query(
    "rank_changes",
    sql=LEX + "SELECT qid, id, CASE WHEN vr <= 10 THEN CAST(vr AS INTEGER) END AS vector_rank, CASE WHEN rank <= 10 THEN "
    "CAST(rank AS INTEGER) END AS fused_rank, CASE WHEN vr > 10 OR rank > 10 THEN NULL WHEN vr > rank THEN 'up' WHEN vr < rank "
    "THEN 'down' ELSE 'same' END AS moved FROM f WHERE vr <= 10 OR rank <= 10",
)
def rank_changes(spark, sf):
    return vector.rank_changes(_hybrid(spark, sf, 32), 10)
