"""Cards, autocomplete, glossary, topics and the search cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import cards as cd
from ..operators import intent
from ..operators import queries as qs
from ..session import materialise, spread, table
from .concepts import INDEX, index
from .intents import name_sql, phase_of
from .lookup import FIRST, FUZZY, LONGEST, SYN, queries, synonyms
from .registry import norm_sql, query, values_sql
from .search import BM25, DOC_WORDS, HOST, NAMES, TF, WEIGHTS, benchmark, named_documents
from .vectors import PAIRS, UNIT, pairs_sql, vectors

CARDS = (
    "cw AS (SELECT item_id * 100000 + pos AS seq, w FROM (SELECT item_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT item_id, "
    f"string_split({norm_sql('text')}, ' ') AS w FROM benchmark)) WHERE w <> ''), "
    "cards AS (SELECT min(seq) AS seq, w AS topic, 'the ' || w AS display, count(*) AS scenario_count FROM cw GROUP BY w)"
)
ASKED = (
    "qq AS (SELECT * FROM (SELECT 'turn ' || conv_id || ' ' || turn AS qid, trim(lower(text), ' ') AS q FROM conversations UNION ALL SELECT 'page ' || page_id, "
    f"trim(lower({HOST}), ' ') FROM pages) WHERE length(q) >= 2)"
)


def cards(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(norm(F.col("text")), " ")).alias("pos", "w")).filter("w <> ''")
    return words.groupBy(F.col("w").alias("topic")).agg(
        F.min(F.col("item_id") * 100000 + F.col("pos") + 1).alias("seq"), F.count("*").alias("scenario_count")
    ).withColumn("display", F.concat(F.lit("the "), "topic"))


@query(
    "matched_cards",
    sql=f"WITH {CARDS}, {ASKED}, ex AS (SELECT qid, seq, topic, TRUE AS exact FROM qq JOIN cards ON q = topic OR q = display), "
    "s AS (SELECT qid, seq, topic, greatest(CASE WHEN contains(q, topic) THEN 2 * length(topic) + scenario_count ELSE 0 END, CASE WHEN contains(q, display) "
    "THEN 2 * length(display) + scenario_count ELSE 0 END, CASE WHEN list_contains(regexp_split_to_array(q, '\\s+'), topic) THEN 1.5 * length(topic) + "
    "scenario_count ELSE 0 END) AS sc FROM qq JOIN cards ON contains(q, topic)) "
    "SELECT * FROM ex UNION ALL SELECT qid, seq, topic, FALSE FROM (SELECT * FROM s WHERE qid NOT IN (SELECT qid FROM ex) QUALIFY row_number() OVER "
    "(PARTITION BY qid ORDER BY sc DESC, seq) = 1)",
)
def matched_cards(spark, sf):
    return cd.match_cards(queries(spark, sf), cards(spark, sf))


@query(
    "autocomplete",
    sql=f"WITH {CARDS}, al AS (SELECT DISTINCT substr(topic, 1, 4) AS alias, display AS topic FROM cards WHERE length(topic) % 2 = 1 UNION SELECT DISTINCT "
    "substr(topic, 1, 4), topic FROM cards WHERE length(topic) % 2 = 0), "
    f"{ASKED}, "
    "atx AS (SELECT DISTINCT qid, al.topic FROM qq JOIN al ON contains(alias, q) OR contains(q, alias)), "
    "b AS (SELECT qid, seq, topic, scenario_count, CASE WHEN topic = q OR display = q THEN 100 WHEN starts_with(topic, q) OR starts_with(display, q) THEN 80 "
    "WHEN contains(topic, q) OR contains(display, q) THEN 60 WHEN contains(q, topic) THEN 50 WHEN (qid, topic) IN (SELECT qid, topic FROM atx) THEN 70 ELSE "
    "(SELECT CASE WHEN n > 0 THEN 30 + 10 * n ELSE 0 END FROM (SELECT len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: contains(topic, x) OR "
    "contains(x, topic))) AS n)) END AS base FROM qq, cards) "
    "SELECT qid, topic, round(base + least(scenario_count / 100, 5), 4) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY base + "
    "least(scenario_count / 100, 5) DESC, seq) AS INTEGER) AS rank FROM b WHERE base > 0 QUALIFY rank <= 8",
)
def autocomplete(spark, sf):
    c = cards(spark, sf)
    start = F.substring("topic", 1, 4).alias("alias")
    aliases = c.filter(F.length("topic") % 2 == 1).select(start, F.col("display").alias("topic")).unionByName(
        c.filter(F.length("topic") % 2 == 0).select(start, "topic")
    ).distinct()
    out = cd.autocomplete(queries(spark, sf), c, aliases)
    return out.withColumn("score", F.round("score", 4))


GLOSS = (
    "gd AS (SELECT min(page_id) AS seq, key, min(title) AS term FROM (SELECT page_id, lower(regexp_extract(html, '<a href=\"/([^\"]+)\">', 1)) AS key, "
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) WHERE length(key) >= 1 GROUP BY key), "
    f"gs AS (SELECT min(page_id) AS seq, lower({HOST}) AS key, min(url) AS term FROM pages WHERE length({HOST}) >= 1 GROUP BY 2)"
)


@query(
    "glossary_lookup",
    sql=f"WITH {GLOSS}, h AS (SELECT doc_id AS qid, 1 AS tier, seq, key, term FROM documents JOIN gd ON contains(lower(text), key) UNION ALL SELECT doc_id, 2, "
    "seq, key, term FROM documents JOIN gs ON contains(lower(text), key)) SELECT qid, term, tier FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY "
    "tier, CASE WHEN tier = 1 THEN -length(key) ELSE 0 END, seq) = 1",
)
def glossary_lookup(spark, sf):
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), F.lower(F.regexp_extract("html", '<a href="/([^"]+)">', 1)).alias("key"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("term"), "url",
        F.lower(F.regexp_extract("url", r"//(m\.|www\.)?([^./]+)\.", 2)).alias("host"),
    )
    definitions = p.filter(F.length("key") >= 1).groupBy("key").agg(F.min("seq").alias("seq"), F.min("term").alias("term"))
    symptoms = p.filter(F.length("host") >= 1).groupBy(F.col("host").alias("key")).agg(F.min("seq").alias("seq"), F.min("url").alias("term"))
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "text"))
    return qs.glossary_lookup(docs, definitions, symptoms)


TOPICS = [
    (0, "tables", "|"), (1, "urban", "theand"), (1, "urban", "hand "), (2, "long", "tionon"), (2, "long", "ich"), (3, "german", "der"), (3, "german", "und die"),
    (4, "french", "que"), (4, "french", "les"), (5, "general", "ing"), (6, "plain", "of the"),
]
EXTRA = [("theand", "andthe"), ("tionon", "onthe"), ("tionon", "pain"), ("que", "queau")]


def topic_patterns(spark):
    patterns = spark.createDataFrame(TOPICS, "seq int, topic string, pattern string")
    dictionary = spark.createDataFrame(EXTRA, "term string, synonym string")
    return qs.expand_patterns(patterns, dictionary, ["pain", "mass"])


@query(
    "assigned_topics",
    sql="WITH " + values_sql("tp", "seq, topic, pattern", TOPICS) + ", " + values_sql("dx", "term, synonym", EXTRA)
    + ", al AS (SELECT * FROM tp UNION SELECT seq, topic, synonym FROM tp JOIN dx ON pattern = term WHERE synonym NOT IN ('pain', 'mass')), "
    "h AS (SELECT doc_id AS id, seq, topic FROM documents JOIN al ON CASE WHEN length(pattern) > 3 THEN contains(lower(text), pattern) WHEN pattern = '|' THEN "
    "regexp_matches(lower(text), '\\b\\|\\b') ELSE regexp_matches(lower(text), '\\b' || pattern || '\\b') END) SELECT id, arg_min(topic, seq) AS topic FROM h "
    "GROUP BY 1",
)
def assigned_topics(spark, sf):
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return qs.assign_topic(docs, "text", topic_patterns(spark))


@query(
    "topic_match_rate",
    sql="WITH d AS (SELECT doc_id, contains(lower(text), 'theand') OR contains(lower(text), 'tionon') AS m FROM documents) SELECT count(*) AS total, "
    "CAST(sum(CAST(m AS INTEGER)) AS BIGINT) AS matched, CAST(round_even(100 * sum(CAST(m AS INTEGER)) / count(*), 0) AS INTEGER) AS pct FROM d",
)
def topic_match_rate(spark, sf):
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    patterns = spark.createDataFrame([(0, "a", "theand"), (1, "b", "tionon")], "seq int, topic string, pattern string")
    found = qs.assign_topic(docs, "text", patterns)
    r = docs.select("id").join(found, "id", "left").agg(F.count("*").alias("total"), F.count("topic").alias("matched"))
    return r.select("total", "matched", F.bround(F.lit(100) * F.col("matched") / F.col("total")).cast("int").alias("pct"))


# Each stage of a cascade in SQL reads what the stages before it left open.
HOST_REGION = "nullif(regexp_extract(url, '//[^/]+/([a-z]+)/', 1), '')"
PROSE_RULES = {
    "acute": r"\b(now|that)\b",
    "followed": r"\b(with|is)\b",
    "phases": [("screening", [r"\bthe\b", r"\bof\b"]), ("initial", [r"\bis\b", r"\bder\b", r"\bque\b"]), ("surveillance", [r"\bwith\b", r"\bles\b"])],
    "urgencies": [("acute", [r"\bthat\b", r"\bwas\b"]), ("chronic", [r"\band\b"]), ("routine", [r"\bon\b"])],
}
PROSE_PHASES = [("surveillance", [" with ", " les "]), ("initial", [" is ", " der "])]
PROSE_URGENCIES = [("acute", [" was ", " est "]), ("routine", [" on ", " die "])]
REGION_SEARCH = (
    f"WITH {SYN}, rq AS (SELECT 'turn ' || conv_id || ' ' || turn AS qid, text, CAST(NULL AS VARCHAR) AS region FROM conversations UNION ALL SELECT "
    f"'page ' || page_id, {HOST}, {HOST_REGION} FROM pages), q AS (SELECT qid, {norm_sql('text')} AS q FROM rq WHERE {norm_sql('text')} <> ''), "
    "ex AS (SELECT qid, concept_id FROM q JOIN syn ON q = synonym), l1 AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM ex)), "
    f"sb AS (SELECT qid, concept_id FROM {FIRST.format(src='l1')}), l2 AS (SELECT * FROM l1 WHERE qid NOT IN (SELECT qid FROM sb)), "
    f"{FUZZY.format(src='l2')}, rs AS (SELECT * FROM ex UNION ALL SELECT * FROM sb UNION ALL SELECT qid, concept_id FROM fr WHERE rank = 1), "
    # the concept index, then the mappings of a query's region
    f"{INDEX}, ch AS (SELECT qid, concept_id, id, relevance AS score, rank, phase FROM rs JOIN idx USING (concept_id) JOIN rq USING (qid) WHERE rq.region "
    "IS NULL OR rq.region = idx.region), "
    # keyword search for the rest
    f"lk AS (SELECT qid, {norm_sql('text')} AS q FROM rq WHERE qid NOT IN (SELECT qid FROM ch)), {DOC_WORDS}, kx AS (SELECT DISTINCT qid, word FROM "
    "(SELECT qid, unnest(string_split(q, ' ')) AS word FROM lk) WHERE length(word) >= 2), "
    f"{WEIGHTS.format(terms='kx')}, ts AS (SELECT term, id, sum(w) AS p FROM tw JOIN post USING (word) GROUP BY ALL), sc AS (SELECT qid, id, sum(p) AS s "
    "FROM (SELECT qid, id, p FROM kx JOIN ts ON kx.word = ts.term UNION ALL SELECT qid, id, 15 FROM lk JOIN dn ON q <> '' AND contains(t, q)) GROUP BY ALL), "
    "kh AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM sc QUALIFY rank <= 20), "
    "hits AS (SELECT qid, id, score, rank, concept_id, phase FROM ch UNION ALL SELECT qid, id, 1.0, rank, NULL, NULL FROM kh), "
    # intents and re-ranking
    f"it AS (SELECT qid, {phase_of(PROSE_RULES, 'phase')} AS ph, {phase_of(PROSE_RULES, 'phase_confidence')} AS pc, {phase_of(PROSE_RULES, 'urgency')} AS "
    f"ur, {phase_of(PROSE_RULES, 'urgency_confidence')} AS uc FROM (SELECT qid, lower(text) AS q FROM rq)), "
    f"ip AS (SELECT doc_id AS id, coalesce(any_value(idx.phase), any_value({name_sql('text', PROSE_PHASES)})) AS ip, any_value({name_sql('text', PROSE_URGENCIES)}) AS iu FROM "
    "documents LEFT JOIN idx ON id = doc_id GROUP BY 1), "
    "bo AS (SELECT hits.*, ph, CASE WHEN ph = 'unknown' THEN 1.0 ELSE CASE WHEN pc <= 0.6 THEN 1.0 WHEN ip = ph THEN 1.5 WHEN ph = 'initial' AND ip = "
    "'surveillance' THEN 0.5 WHEN ph = 'surveillance' AND ip = 'initial' THEN 0.7 ELSE 1.0 END * CASE WHEN ur = 'unknown' OR uc <= 0.6 THEN 1.0 WHEN iu = "
    "ur THEN 1.3 WHEN ur = 'acute' AND iu = 'routine' THEN 0.6 ELSE 1.0 END END AS boost FROM hits JOIN it USING (qid) JOIN ip USING (id)) "
    "SELECT qid, CASE WHEN concept_id IS NULL THEN 'keyword' ELSE 'concept' END AS source, concept_id, id, CAST(score AS DOUBLE) AS score, round(CAST(boost AS DOUBLE), 6) AS boost, "
    "CAST(r AS INTEGER) AS rank, phase, CAST(CASE WHEN phase IS NULL THEN NULL WHEN phase = ph THEN 0 ELSE "
    "coalesce(list_position(['screening','initial','pretreatment','surveillance','complication'], phase), 999) END AS INTEGER) AS group_position FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN ph = 'unknown' THEN 0 ELSE round(score * boost, 9) END DESC, rank) AS r FROM bo) WHERE r <= 20"
)


@query("region_search", sql=REGION_SEARCH)
def region_search(spark, sf):
    """Turns ask any region, page hosts the one in their address; what has no concept there is searched by keywords."""
    turns = queries(spark, sf).join(
        table(spark, sf, "pages").select(
            F.concat_ws(" ", F.lit("page"), "page_id").alias("qid"), F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("_r")
        ), "qid", "left",
    )
    asked = turns.select("qid", "text", F.nullif("_r", F.lit("")).alias("region"))
    intents = intent.classify_intent(asked, None, PROSE_RULES, [("no such word", "acute")], PROSE_RULES["followed"])
    mapped = materialise(index(spark, sf), "concept-index")
    found = cd.region_search(
        asked, synonyms(spark, sf), mapped, named_documents(spark, sf), intents, 20, phases=PROSE_PHASES, urgencies=PROSE_URGENCIES
    )
    return found.withColumn("boost", F.round("boost", 6))


PHRASES = (
    "cw AS (SELECT item_id * 100000 + i AS seq, w[i] || ' ' || w[i + 1] AS w FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, "
    f"string_split({norm_sql('text')}, ' ') AS w FROM benchmark))), "
    "cards AS (SELECT min(seq) AS seq, w AS topic, 'the ' || w AS display, count(*) AS scenario_count FROM cw GROUP BY w)"
)
NAMED_SYN = SYN.replace(
    "FROM raw WHERE", f"FROM (SELECT * FROM raw UNION ALL SELECT item_id * 100000, {norm_sql('text')}, item_id FROM benchmark) WHERE"
)
BM25_HITS = "{name} AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS r FROM ({hits}) QUALIFY r <= 8)"
GLOBAL_SEARCH = (
    "WITH qa AS (SELECT * FROM (SELECT 'item ' || item_id AS qid, text, CAST(NULL AS BIGINT) AS vid FROM benchmark UNION ALL SELECT 'turn ' || conv_id || "
    f"' ' || turn, text, NULL FROM conversations UNION ALL SELECT 'page ' || page_id, {HOST}, page_id * 3 FROM pages) WHERE length(trim(text, ' ')) > 0), "
    f"{PHRASES}, {NAMED_SYN}, q AS (SELECT qid, {norm_sql('text')} AS q FROM qa WHERE {norm_sql('text')} <> ''), "
    "qq AS (SELECT * FROM (SELECT qid, trim(lower(text), ' ') AS q FROM qa) WHERE length(q) >= 2), "
    # cards, and concepts of equal synonyms before them
    "ce AS (SELECT qid, topic FROM qq JOIN cards ON q = topic OR q = display), cs AS (SELECT qid, seq, topic, greatest(CASE WHEN contains(q, topic) THEN 2 * "
    "length(topic) + scenario_count ELSE 0 END, CASE WHEN contains(q, display) THEN 2 * length(display) + scenario_count ELSE 0 END, CASE WHEN "
    "list_has_all(qws, tws) THEN 1.5 * length(topic) + scenario_count ELSE 0 END) AS sc FROM (SELECT *, regexp_split_to_array(q, '\\s+') AS qws FROM qq) JOIN "
    "(SELECT *, string_split(topic, ' ') AS tws FROM cards) ON contains(q, topic) OR list_has_all(qws, tws)), "
    "mc AS (SELECT * FROM ce UNION ALL SELECT qid, topic FROM (SELECT * FROM cs WHERE qid NOT IN (SELECT qid FROM ce) QUALIFY row_number() OVER (PARTITION BY "
    "qid ORDER BY sc DESC, seq) = 1)), "
    "own AS (SELECT qid FROM mc JOIN qq USING (qid) WHERE topic = q), "
    "eq AS (SELECT qid, concept_id FROM q JOIN syn ON q = synonym WHERE qid NOT IN (SELECT qid FROM own)), "
    "cd AS (SELECT * FROM mc WHERE qid NOT IN (SELECT qid FROM eq)), "
    # concepts
    "l0 AS (SELECT * FROM q WHERE qid NOT IN (SELECT qid FROM eq UNION ALL SELECT qid FROM cd)), "
    f"lo AS {LONGEST.format(src='l0')}, l1 AS (SELECT * FROM l0 WHERE qid NOT IN (SELECT qid FROM lo)), {FUZZY.format(src='l1')}, "
    "rs AS (SELECT qid, concept_id FROM eq UNION ALL SELECT qid, concept_id FROM lo UNION ALL SELECT qid, concept_id FROM fr WHERE rank = 1), "
    # vectors with a lexical bonus
    f"{UNIT}, h0 AS (SELECT * FROM qa WHERE qid NOT IN (SELECT qid FROM rs UNION ALL SELECT qid FROM cd)), "
    f"hq AS (SELECT qid, {norm_sql('text')} AS q, v FROM h0 JOIN u ON u.id = vid), "
    f"hc AS (SELECT doc_id AS id, {norm_sql('text')} AS name, {norm_sql("source || ' ' || lang")} AS kw, v FROM documents JOIN u ON u.id = doc_id), "
    "hs AS (SELECT qid, hc.id, q, name, kw, list_dot_product(hq.v, hc.v) AS sim FROM hq, hc), hp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY "
    "sim DESC, id) AS vr FROM hs QUALIFY vr <= 32), hf AS (SELECT qid, id, vr, sim + 0.05 * tanh((list_sum(list_prepend(0, list_transform(list_filter("
    "string_split(q, ' '), lambda t: length(t) >= 3), lambda t: CASE WHEN contains(name, t) THEN 2 WHEN kw <> '' AND contains(kw, t) THEN 1 ELSE 0 END))) + "
    f"{pairs_sql()}) / 4.0) AS s FROM hp), hy AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vr) AS r FROM hf QUALIFY r <= 8), "
    # BM25: the words, the words without special characters, the words at edit distance one
    f"{TF}, t0 AS (SELECT * FROM h0 WHERE qid NOT IN (SELECT qid FROM hy) AND length(trim(text, ' ')) >= 2), "
    f"q1 AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest(string_split({norm_sql('text')}, ' ')) AS word FROM t0) WHERE word <> ''), "
    f"{BM25_HITS.format(name='b1', hits=BM25.format(terms='q1'))}, t1 AS (SELECT * FROM t0 WHERE qid NOT IN (SELECT qid FROM b1)), "
    f"q2 AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest(string_split({norm_sql("regexp_replace(text, '[^a-zA-Z0-9\\s]', ' ', 'g')")}, ' ')) AS word FROM t1) "
    f"WHERE word <> ''), {BM25_HITS.format(name='b2', hits=BM25.format(terms='q2'))}, t2 AS (SELECT * FROM t1 WHERE qid NOT IN (SELECT qid FROM b2)), "
    f"q3 AS (SELECT DISTINCT qid, df.word FROM (SELECT qid, unnest(string_split({norm_sql('text')}, ' ')) AS w FROM t2) JOIN df ON length(w) >= 3 AND "
    f"abs(length(w) - length(df.word)) <= 1 AND levenshtein(w, df.word) <= 1), {BM25_HITS.format(name='b3', hits=BM25.format(terms='q3'))}, "
    "bm AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3), "
    # names and keywords
    f"n0 AS (SELECT qid, {norm_sql('text')} AS q FROM h0 WHERE qid NOT IN (SELECT qid FROM hy UNION ALL SELECT qid FROM bm)), {NAMES.replace('q0', 'n0').replace('qq', 'nq')}, "
    "nm AS (SELECT qid, id, score AS s, row_number() OVER (PARTITION BY qid ORDER BY score DESC, nl, id) AS r FROM g QUALIFY r <= 8) "
    # a similar synonym would have answered as a concept, so nothing is left to suggest
    "SELECT qid, 'concept' AS stage, CAST(concept_id AS VARCHAR) AS target, 1.0::DOUBLE AS score, 1::INTEGER AS rank FROM rs UNION ALL SELECT qid, 'card', topic, 1.0, 1 FROM "
    "cd UNION ALL SELECT qid, 'hybrid', CAST(id AS VARCHAR), round(s, 6), CAST(r AS INTEGER) FROM hy UNION ALL SELECT qid, 'text', CAST(id AS VARCHAR), round(s, 6), CAST(r AS INTEGER) FROM bm "
    "UNION ALL SELECT qid, 'name', CAST(id AS VARCHAR), CAST(s AS DOUBLE), CAST(r AS INTEGER) FROM nm"
)


def phrase_cards(spark, sf):
    """Neighbouring words of the benchmark items as topics."""
    w = F.split(norm(F.col("text")), " ")
    rest = F.size(w) - 1
    pairs = F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat_ws(" ", a, b))
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(pairs).alias("pos", "w"))
    return words.groupBy(F.col("w").alias("topic")).agg(
        F.min(F.col("item_id") * 100000 + F.col("pos") + 1).alias("seq"), F.count("*").alias("scenario_count")
    ).withColumn("display", F.concat(F.lit("the "), "topic"))


@query("global_search", sql=GLOBAL_SEARCH)
def global_search(spark, sf):
    """Items, turns and page hosts against phrases as cards, words and whole items as synonyms, and the documents; every third vector is
    that of a page's query."""
    b = benchmark(spark, sf)
    v = vectors(spark, sf)
    named = synonyms(spark, sf).unionByName(b.select((F.col("qid") * 100000).alias("seq"), F.col("text").alias("synonym"), F.col("qid").alias("concept_id")))
    asked = b.withColumn("qid", F.concat_ws(" ", F.lit("item"), "qid")).unionByName(queries(spark, sf))
    corpus = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"), F.col("text").alias("name"), F.array("source", "lang").alias("keywords")
    )
    given = v.join(corpus.select("id"), "id", "left_semi")
    pages = table(spark, sf, "pages").select(F.concat_ws(" ", F.lit("page"), "page_id").alias("qid"), (F.col("page_id") * 3).alias("id"))
    encoded = pages.join(v, "id").select("qid", "vector")
    out = cd.global_search(asked, phrase_cards(spark, sf), named, encoded, corpus, pairs=PAIRS, encoded=given)
    return out.withColumn("score", F.round("score", 6))
