"""Lexical search over documents; benchmark items are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import lexical
from ..session import spread, table
from .registry import norm_sql, query

DOC_WORDS = (
    f"dn AS (SELECT doc_id AS id, {norm_sql('text')} AS t FROM documents), "
    "post AS (SELECT DISTINCT id, word FROM (SELECT id, unnest(string_split(t, ' ')) AS word FROM dn) "
    "WHERE length(word) >= 2), vocab AS (SELECT DISTINCT word FROM post)"
)
QUERY_WORDS = (
    f"qn AS (SELECT item_id AS qid, {norm_sql('text')} AS q FROM benchmark), "
    "qw AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest(string_split(q, ' ')) AS word FROM qn) "
    "WHERE length(word) >= 2)"
)
HOST = "regexp_extract(url, '//(m\\.|www\\.)?([^./]+)\\.', 2)"
DICT = (
    "dict AS (SELECT DISTINCT term, synonym FROM (SELECT regexp_extract(url, '//(m\\.|www\\.)?([^./]+)\\.', 2) AS term, "
    "regexp_extract(html, '<a href=\"/([^\"]+)\">', 1) AS synonym FROM pages) WHERE term <> '' AND synonym <> '')"
)
EXPANDED = (
    "ex AS (SELECT qid, word FROM qw UNION SELECT qid, word FROM (SELECT qid, unnest(string_split("
    f"{norm_sql('synonym')}, ' ')) AS word FROM qn JOIN dict ON contains(q, {norm_sql('term')})) WHERE word <> '')"
)
WEIGHTS = (
    "tw AS (SELECT t.word AS term, v.word, CASE WHEN t.word = v.word THEN 3 ELSE 1 END AS w "
    "FROM (SELECT DISTINCT word FROM {terms}) t JOIN vocab v ON contains(v.word, t.word) OR contains(t.word, v.word))"
)


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text")))


def named_documents(spark, sf):
    return documents(spark, sf).withColumn("name", F.col("text"))


def benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text"))


def page_dictionary(spark, sf):
    """Host word of a page -> first link word of the page."""
    return (
        table(spark, sf, "pages")
        .select(
            F.regexp_extract("url", r"//(m\.|www\.)?([^./]+)\.", 2).alias("term"),
            F.regexp_extract("html", '<a href="/([^"]+)">', 1).alias("synonym"),
        )
        .filter("term <> '' and synonym <> ''")
        .distinct()
    )


@query("inverted_index", sql=f"WITH {DOC_WORDS} SELECT id, word FROM post")
def inverted_index(spark, sf):
    return lexical.build_postings(documents(spark, sf))


@query(
    "bigram_index",
    sql=f"WITH {DOC_WORDS}, w AS (SELECT id, list_filter(string_split(t, ' '), lambda x: length(x) >= 2) AS w FROM dn), "
    "s AS (SELECT id, w, unnest(range(1, len(w))) AS i FROM w) "
    "SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS bigram FROM s",
)
def bigram_index(spark, sf):
    return lexical.build_bigrams(documents(spark, sf))


@query(
    "expanded_queries",
    sql=f"WITH {QUERY_WORDS}, {DICT}, {EXPANDED} SELECT qid, word FROM ex",
)
def expanded_queries(spark, sf):
    return lexical.expand_queries(benchmark(spark, sf), page_dictionary(spark, sf))


@query(
    "term_scores",
    sql=f"WITH {DOC_WORDS}, {QUERY_WORDS}, {WEIGHTS.format(terms='qw')} "
    "SELECT term, id, CAST(sum(w) AS BIGINT) AS points FROM tw JOIN post USING (word) GROUP BY ALL",
)
def term_scores(spark, sf):
    terms = lexical.build_postings(benchmark(spark, sf).withColumnRenamed("qid", "id")).select("word")
    texts = documents(spark, sf).select("id", norm(F.col("text")).alias("text"))
    return lexical.term_scores(terms, texts)


@query(
    "keyword_search",
    sql=f"WITH {DOC_WORDS}, {QUERY_WORDS}, {DICT}, {EXPANDED}, {WEIGHTS.format(terms='ex')}, "
    "ts AS (SELECT term, id, sum(w) AS p FROM tw JOIN post USING (word) GROUP BY ALL), "
    "sc AS (SELECT qid, id, sum(p) AS s FROM (SELECT qid, id, p FROM ex JOIN ts ON ex.word = ts.term "
    "UNION ALL SELECT qid, id, 15 FROM qn JOIN dn ON contains(t, q)) GROUP BY ALL), "
    "fin AS (SELECT qid, sc.id, CAST(s + CASE WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS BIGINT) AS score FROM sc "
    "LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = sc.id) "
    "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid "
    "ORDER BY score DESC, id) AS rank FROM fin) WHERE rank <= 10",
)
def keyword_search(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return lexical.keyword_search(
        benchmark(spark, sf), named_documents(spark, sf), page_dictionary(spark, sf), boosted=good, k=10
    )


TF = (
    f"{DOC_WORDS}, tok AS (SELECT id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM dn), "
    "tf AS (SELECT id, dl, word, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS word FROM tok) GROUP BY ALL), "
    "df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL), "
    "tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok)"
)
BM25 = (
    "SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s "
    "FROM {terms} JOIN tf USING (word) JOIN df USING (word), tot GROUP BY qid, id"
)


@query("bm25_statistics", sql=f"WITH {TF} SELECT id, word, CAST(dl AS INTEGER) AS dl, tf, df, round(avgdl, 6) AS avgdl, n "
       "FROM tf JOIN df USING (word), tot")
def bm25_statistics(spark, sf):
    tf, df, totals = lexical.bm25_statistics(documents(spark, sf))
    return (
        tf.join(df.hint("shuffle_hash"), "word")  # every word has one row there: the long side needs no sort
        .withColumn("n", totals.select("n").scalar())
        .withColumn("avgdl", F.round(totals.select("avgdl").scalar(), 6))
        .select("id", "word", "dl", "tf", "df", "avgdl", "n")
    )


@query(
    "bm25_search",
    sql=f"WITH {TF}, qn AS (SELECT item_id AS qid, text FROM benchmark WHERE length(trim(text)) >= 2), "
    f"q1 AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest(string_split({norm_sql('text')}, ' ')) AS word FROM qn) "
    f"WHERE word <> ''), h AS ({BM25.format(terms='q1')}) "
    "SELECT qid, id, 'plain' AS stage, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() "
    "OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM h) WHERE rank <= 10",
)
def bm25_search(spark, sf):
    hits = lexical.bm25_search(benchmark(spark, sf), documents(spark, sf), k=10)
    return hits.select("qid", "id", "stage", F.round("score", 6).alias("score"), "rank")


NAMES = (
    "qq AS (SELECT * FROM (SELECT qid, q, list_filter(string_split(q, ' '), lambda x: length(x) >= 2) AS toks FROM q0 "
    "WHERE length(q) >= 3) WHERE len(toks) > 0), "
    f"c AS (SELECT doc_id AS id, {norm_sql('text')} AS name, {norm_sql("source || ' ' || lang")} AS kw FROM documents), "
    "p AS (SELECT qid, id, q, name, kw, len(toks) AS nt, len(list_filter(toks, lambda x: contains(name, x))) AS inn, "
    "len(list_filter(toks, lambda x: contains(kw, x))) AS ink FROM qq JOIN c ON "
    "len(list_filter(toks, lambda x: contains(name, x))) >= len(toks) - 1 OR contains(kw, q)), "
    "s AS (SELECT qid, id, name, CASE WHEN name = q THEN 100 WHEN starts_with(name, q || ' ') OR starts_with(name, q || ',') "
    "THEN 80 WHEN contains(name, q) THEN 60 WHEN inn = nt THEN 30 + inn * 5 WHEN nt >= 2 AND inn >= greatest(1, nt - 1) "
    "THEN 15 + inn * 4 ELSE 0 END AS ns, CASE WHEN contains(kw, q) THEN CASE WHEN contains(' ' || kw || ' ', ' ' || q || ' ') "
    "THEN 45 ELSE 0 END WHEN nt >= 2 AND ink = nt THEN 25 + ink * 3 ELSE 0 END AS ks, kw FROM p), "
    "f AS (SELECT qid, id, length(name) AS nl, CASE WHEN ns < 30 AND kw <> '' THEN greatest(ns, ks) ELSE ns END AS sc FROM s), "
    "g AS (SELECT qid, id, nl, sc - least(15, nl // 20) AS score FROM f WHERE sc > 0)"
)


@query(
    "name_search",
    sql=f"WITH q0 AS (SELECT 'item ' || item_id AS qid, {norm_sql('text')} AS q FROM benchmark UNION ALL SELECT 'page ' || page_id, "
    f"{norm_sql(HOST)} FROM pages), "
    f"{NAMES} "
    "SELECT qid, id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY qid ORDER BY score DESC, nl, id) AS rank FROM g) WHERE rank <= 8",
)
def name_search(spark, sf):
    hosts = table(spark, sf, "pages").select(
        F.concat_ws(" ", F.lit("page"), "page_id").alias("qid"), F.regexp_extract("url", r"//(m\.|www\.)?([^./]+)\.", 2).alias("text")
    )
    corpus = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("name"), F.array("source", "lang").alias("keywords")
    )
    items = benchmark(spark, sf).withColumn("qid", F.concat_ws(" ", F.lit("item"), "qid"))
    return lexical.name_search(items.unionByName(hosts), corpus, k=8)
