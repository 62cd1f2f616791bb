"""Concept index over documents: every benchmark item is a concept, its long words the keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as co
from ..operators import lexical, lookup
from ..operators.containment import phrase_pairs
from ..session import materialise, spread, table
from .lookup import FIRST, cascade_sql, queries, synonyms
from .registry import ORACLES, query
from .search import benchmark, documents
from .texts import CONTEXTS, PHASES, context_value_sql, phase_sql

PHASE_NAMES = [("screening", "Screening"), ("initial", "Initial Workup")]

BASE = (
    "co AS (SELECT item_id AS concept_id, CASE WHEN contains(text, ' the ') OR contains(text, ' of ') THEN 'en' WHEN contains(text, "
    "' der ') OR contains(text, ' die ') THEN 'de' WHEN contains(text, ' les ') OR contains(text, ' le ') THEN 'fr' ELSE 'es' END AS "
    "region FROM benchmark), "
    "kw AS (SELECT DISTINCT concept_id, keyword, CASE WHEN length(keyword) >= 13 THEN 'neg' ELSE 'pos' END AS kind FROM (SELECT item_id "
    "AS concept_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS keyword FROM benchmark) WHERE length(keyword) >= 1), "
    "seeds AS (SELECT item_id AS concept_id, doc_id AS id, CASE WHEN l.quality = 1 THEN 0.9 END AS rel FROM benchmark b JOIN documents d "
    "ON contains(d.text, b.text) LEFT JOIN labels l USING (doc_id)), "
    "corpus AS (SELECT doc_id AS id, text AS name, lang AS region FROM documents)"
)
INDEX = (
    f"{BASE}, tot AS (SELECT concept_id, count(*) AS total FROM kw WHERE kind = 'pos' GROUP BY 1), "
    "h AS (SELECT kw.concept_id, c.id, c.region, CAST(sum(CASE WHEN kind = 'pos' THEN 1 ELSE 0 END) AS INTEGER) AS hits, max(CASE WHEN "
    "kind = 'neg' THEN 1 ELSE 0 END) AS neg FROM kw JOIN corpus c ON contains(lower(c.name), keyword) GROUP BY ALL), "
    "r AS (SELECT concept_id, id, region, CASE WHEN neg = 1 THEN 0.05 ELSE least(1.0, hits / greatest(total, 3)) END AS r FROM h JOIN tot "
    "USING (concept_id)), "
    "found AS (SELECT r.concept_id, id, region, round_even(least(1.0, r + 0.2) * 100, 0) / 100 AS relevance, 1 AS tier FROM r JOIN co USING (concept_id, "
    "region) WHERE r > 0.1), "
    "sd AS (SELECT concept_id, id, region, round_even(coalesce(rel, 0.8) * 100, 0) / 100 AS relevance, 0 AS tier FROM seeds JOIN corpus USING (id)), "
    "al AS (SELECT * FROM sd UNION ALL SELECT * FROM found WHERE (concept_id, id) NOT IN (SELECT concept_id, id FROM sd)), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY relevance DESC, tier, id) AS rank FROM al QUALIFY rank <= 50), "
    f"idx AS (SELECT concept_id, id, name, top.region, CAST(relevance AS DOUBLE) AS relevance, {phase_sql('lower(name)')} AS phase, "
    f"{context_value_sql('lower(name)', CONTEXTS[0][1])} AS article, {context_value_sql('lower(name)', CONTEXTS[1][1])} AS verb, tier, "
    "CAST(rank AS INTEGER) AS rank FROM top JOIN corpus USING (id))"
)


def concept_tables(spark, sf):
    text = F.col("text")

    def has(*xs):
        return F.contains(text, F.lit(xs[0])) | F.contains(text, F.lit(xs[1]))

    b = table(spark, sf, "benchmark").withColumnRenamed("item_id", "concept_id")
    region = F.when(has(" the ", " of "), "en").when(has(" der ", " die "), "de").when(has(" les ", " le "), "fr").otherwise("es")
    concepts = b.select("concept_id", region.alias("region"))
    words = b.select("concept_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("keyword")).filter(F.length("keyword") >= 1)
    kind = F.when(F.length("keyword") >= 13, "neg").otherwise("pos")
    keywords = words.withColumn("kind", kind).distinct()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("tid"), "text")
    inside = phrase_pairs(b.select(F.col("concept_id").alias("nid"), F.col("text").alias("needle")), docs)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("tid"), F.when(F.col("quality") == 1, 0.9).alias("relevance"))
    seeds = inside.join(labels, "tid", "left").select(F.col("nid").alias("concept_id"), F.col("tid").alias("id"), "relevance")
    corpus = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("lang").alias("region")))
    return corpus, concepts, keywords, seeds


def index(spark, sf):
    corpus, concepts, keywords, seeds = concept_tables(spark, sf)
    return co.build_concept_index(corpus, concepts, keywords, concepts, seeds, 50, PHASES, CONTEXTS, PHASE_NAMES)


@query(
    "concept_index",
    sql=f"WITH {INDEX} SELECT concept_id, id, md5(name) AS name, region, relevance, phase, CASE phase WHEN 'screening' THEN 'Screening' "
    "WHEN 'initial' THEN 'Initial Workup' ELSE upper(phase[1]) || phase[2:] END AS phase_display, article, verb, tier, rank FROM idx",
)
def concept_index(spark, sf):
    i = index(spark, sf)
    return i.select(
        "concept_id", "id", F.md5("name").alias("name"), "region", "relevance", "phase", "phase_display",
        F.try_element_at("context", F.lit("article")).alias("article"), F.try_element_at("context", F.lit("verb")).alias("verb"),
        "tier", "rank",
    )


@query(
    "filtered_mappings",
    sql=f"WITH {INDEX} SELECT concept_id, id, relevance FROM idx WHERE region = 'en' AND phase = 'screening' AND article = 'definite' "
    "AND verb = 'being'",
)
def filtered_mappings(spark, sf):
    kept = co.filter_mappings(index(spark, sf), "en", "screening", {"article": "definite", "verb": "being"})
    return kept.select("concept_id", "id", "relevance")


POSITION = "coalesce(list_position(['screening','initial','pretreatment','surveillance','complication'], phase), 999)"


@query(
    "phase_counts",
    sql=f"WITH {INDEX} SELECT concept_id, phase, count(*) AS n, CAST({POSITION} AS INTEGER) AS position FROM idx GROUP BY ALL",
)
def phase_counts(spark, sf):
    return co.phase_counts(index(spark, sf))


@query(
    "phase_groups",
    sql=f"WITH {INDEX} SELECT concept_id, phase, CASE WHEN phase = 'surveillance' THEN 0 ELSE CAST({POSITION} AS INTEGER) END AS "
    "position, list(id ORDER BY rank) AS ids FROM idx GROUP BY ALL",
)
def phase_groups(spark, sf):
    return co.phase_groups(index(spark, sf), preferred=F.lit("surveillance"))


@query(
    "concept_previews",
    sql=f"WITH {INDEX}, fs AS (SELECT concept_id, region, min(rank) AS first FROM idx GROUP BY ALL), rg AS (SELECT concept_id, list(region ORDER BY first) AS "
    "regions FROM fs GROUP BY 1) SELECT concept_id, count(*) AS total, any_value(regions) AS regions, list(id ORDER BY rank)[1:5] AS ids FROM idx JOIN rg USING "
    "(concept_id) GROUP BY 1",
)
def concept_previews(spark, sf):
    return co.mapping_preview(materialise(index(spark, sf), "concept-index"))


@query(
    "check_expectations",
    sql=f"WITH rs AS ({cascade_sql(FIRST)}), {BASE}, ep AS (SELECT 'page ' || page_id AS qid, page_id % 10 AS expected_concept, nullif(regexp_extract(url, "
    "'//[^/]+/([a-z]+)/', 1), '') AS expected_region FROM pages) SELECT ep.qid, rs.concept_id, expected_concept, coalesce(rs.concept_id = "
    "expected_concept AND co.region = expected_region, FALSE) AS passed FROM ep LEFT JOIN rs ON rs.qid = ep.qid LEFT JOIN co ON co.concept_id = rs.concept_id",
)
def check_expectations(spark, sf):
    """Page hosts resolved to concepts, held against a concept and the region in their address."""
    _, concepts, _, _ = concept_tables(spark, sf)
    resolved = lookup.resolve(queries(spark, sf), synonyms(spark, sf), "first")
    expected = table(spark, sf, "pages").select(
        F.concat_ws(" ", F.lit("page"), "page_id").alias("qid"), (F.col("page_id") % 10).alias("expected_concept"),
        F.nullif(F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1), F.lit("")).alias("expected_region"),
    )
    return co.expectation_check(resolved, expected, concepts)


@query(
    "check_contamination",
    sql=f"WITH {INDEX} SELECT concept_id, id, idx.region, co.region AS expected FROM idx JOIN co USING (concept_id) WHERE idx.region <> "
    "co.region",
)
def check_contamination(spark, sf):
    _, concepts, _, _ = concept_tables(spark, sf)
    return co.region_contamination(index(spark, sf), concepts)


@query(
    "check_synonyms",
    sql=f"WITH {BASE}, ix AS (SELECT keyword AS synonym, max(concept_id) AS to_id FROM kw WHERE kind = 'pos' GROUP BY 1) SELECT "
    "concept_id, keyword AS synonym, CASE WHEN to_id IS NULL THEN 'missing' ELSE 'other' END AS problem FROM kw LEFT JOIN ix ON keyword = "
    "synonym WHERE to_id IS NULL OR to_id <> concept_id",
)
def check_synonyms(spark, sf):
    _, _, keywords, _ = concept_tables(spark, sf)
    lookup = keywords.filter("kind = 'pos'").groupBy(F.col("keyword").alias("synonym")).agg(F.max("concept_id").alias("concept_id"))
    return co.synonym_gaps(keywords.withColumnRenamed("keyword", "synonym"), lookup)


VALID = [("screening", ["the", "that"]), ("initial", ["que", "der"]), ("pretreatment", ["und"]), ("surveillance", ["with", "les"])]


@query(
    "check_phase_consistency",
    sql=f"WITH {INDEX}, v AS (SELECT phase, lower(name) AS n FROM idx), j AS (SELECT "
    + " OR ".join(f"(phase = '{p}' AND (" + " OR ".join(f"contains(n, '{w}')" for w in ws) + "))" for p, ws in VALID)
    + " OR (phase = 'pretreatment' AND regexp_matches(n, 'von.*und')) OR NOT ("
    + " OR ".join(f"(phase <> '{p}' AND (" + " OR ".join(f"contains(n, '{w}')" for w in ws) + "))" for p, ws in VALID)
    + ") AS ok FROM v) SELECT count(*) AS total, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS correct, round(sum(CAST(ok AS INTEGER)) / "
    "count(*) * 100, 4) AS accuracy FROM j",
)
def check_phase_consistency(spark, sf):
    return co.phase_consistency(index(spark, sf), VALID, ["von.*und"], "pretreatment")


@query(
    "check_coverage",
    sql=f"WITH {INDEX} SELECT co.concept_id, count(idx.id) AS n, CASE WHEN count(idx.id) < 2 THEN 'low' WHEN count(idx.id) > 40 THEN "
    "'high' ELSE 'ok' END AS flag FROM co LEFT JOIN idx USING (concept_id) GROUP BY 1",
)
def check_coverage(spark, sf):
    _, concepts, _, _ = concept_tables(spark, sf)
    return co.coverage_bounds(index(spark, sf), concepts, 2, 40)


@query(
    "check_false_positives",
    sql=f"WITH {INDEX}, t AS (SELECT max(concept_id) AS concept_id, keyword FROM kw GROUP BY keyword HAVING count(DISTINCT concept_id) = 1) SELECT concept_id, id, relevance FROM idx "
    "WHERE rank <= 5 AND relevance > 0.3 AND NOT EXISTS (SELECT 1 FROM t WHERE t.concept_id = idx.concept_id AND contains(lower(idx.name), "
    "keyword))",
)
def check_false_positives(spark, sf):
    """Best mappings that hold none of the keywords which only their concept has."""
    _, _, keywords, _ = concept_tables(spark, sf)
    owners = keywords.groupBy(F.col("keyword").alias("term")).agg(F.min("concept_id").alias("concept_id"), F.max("concept_id").alias("last"))
    terms = owners.filter("concept_id = last").select("concept_id", "term")
    return co.false_positives(index(spark, sf), terms)


@query(
    "check_dangling_ids",
    sql=f"WITH {INDEX} SELECT concept_id, id, region FROM idx WHERE region IN (SELECT DISTINCT lang FROM documents JOIN labels USING "
    "(doc_id)) AND (region, id) NOT IN (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id))",
)
def check_dangling_ids(spark, sf):
    """The index against the labelled part of the corpus."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    return co.dangling(index(spark, sf), d.select(F.col("lang").alias("region"), F.col("doc_id").alias("id")))


@query(
    "labelled_accuracy",
    sql="WITH p AS (SELECT quality, toxic, CAST(contains(text, ' the ') OR contains(text, ' der ') AS INTEGER) AS pq, "
    "CAST(contains(text, 'hate') AS INTEGER) AS pt FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'good' AS field, count(*) AS "
    "labelled, round(avg(CASE WHEN quality IS NULL OR pq = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p UNION ALL SELECT 'bad', "
    "count(*), round(avg(CASE WHEN toxic IS NULL OR pt = toxic THEN 1.0 ELSE 0.0 END), 6) FROM p",
)
def labelled_accuracy(spark, sf):
    t = F.col("text")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        (F.contains(t, F.lit(" the ")) | F.contains(t, F.lit(" der "))).cast("int").alias("good"),
        F.contains(t, F.lit("hate")).cast("int").alias("bad"), "quality", "toxic",
    )
    return co.labelled_accuracy(rows, [("good", "quality"), ("bad", "toxic")])


@query(
    "retrieval_metrics",
    sql=f"WITH h AS ({ORACLES['bm25_search']}), tr AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), "
    "f AS (SELECT tr.qid, min(h.rank) AS r FROM tr LEFT JOIN h ON h.qid = tr.qid AND h.id = tr.id GROUP BY 1) SELECT count(*) AS queries, "
    "round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM f",
)
def retrieval_metrics(spark, sf):
    """BM25 hits against the documents that hold an item verbatim."""
    hits = lexical.bm25_search(benchmark(spark, sf), documents(spark, sf), k=10)
    truth = phrase_pairs(
        benchmark(spark, sf).select(F.col("qid").alias("nid"), F.col("text").alias("needle")),
        documents(spark, sf).select(F.col("id").alias("tid"), "text"),
    ).select(F.col("nid").alias("qid"), F.col("tid").alias("id"))
    return co.retrieval_metrics(hits, truth, 10)
