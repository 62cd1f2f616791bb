"""Inverted index, query expansion, keyword search, BM25 search and name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, word_bounded_at_first, words
from ..session import materialise, release
from .automaton import contained
from .containment import WordIndex, phrase_pairs, postings, words_containing
from .lookup import near_words
from .ranking import top_k
from .termscan import bm25_top_k, query_blocks, scan_top_k, string_blocks, term_points, word_counts


def build_postings(corpus: DataFrame, min_len: int = 2) -> DataFrame:
    """(id, word) of ``corpus(id, text)``: distinct normalised words of at least ``min_len``."""
    return postings(corpus.select("id", norm(F.col("text")).alias("text")), "id", "text", min_len)


def build_bigrams(corpus: DataFrame) -> DataFrame:
    """(id, bigram): distinct pairs of neighbouring words of at least two characters."""
    kept = corpus.select("id", words(norm(F.col("text")), 2).alias("w"))
    pairs = F.expr(
        "case when size(w) > 1 then array_distinct(transform(sequence(0, size(w) - 2), "
        "i -> concat(w[i], ' ', w[i + 1]))) end"
    )
    return kept.select("id", F.explode(pairs).alias("bigram"))


def expand_queries(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qid, word): the query's words plus the words of the synonyms of every dictionary term that
    occurs in the query. ``dictionary(term, synonym)``; synonym words may have one character."""
    q = queries.select("qid", norm(F.col("text")).alias("text"))
    own = postings(q, "qid", "text", 2)
    d = dictionary.select(norm(F.col("term")).alias("term"), norm(F.col("synonym")).alias("synonym")).filter(
        "term <> ''"
    )
    terms = d.select("term").distinct().select(F.col("term").alias("nid"), F.col("term").alias("needle"))
    found = phrase_pairs(terms, q.select(F.col("qid").alias("tid"), "text"))
    added = (
        found.select(F.col("nid").alias("term"), F.col("tid").alias("qid"))
        .join(d, "term")
        .select("qid", F.explode(F.split("synonym", " ")).alias("word"))
        .filter("word <> ''")
    )
    return own.unionByName(added).distinct()


def term_scores(terms: DataFrame, texts: DataFrame, min_len: int = 1, exact: int = 3, partial: int = 1) -> DataFrame:
    """(term, id, points) of distinct ``terms(word)`` in ``texts(id, text)``, normalised: ``exact`` for the word itself, ``partial``
    for every other word of two or more characters that contains the term or lies in it. ``min_len`` leaves one-sided matches of
    shorter strings out; 1 keeps all of them.

    Terms are taken in blocks of bounded size, each with one scan of the texts; nearly every term meets nearly every text, so
    these rows leave the scan as they are, without a shuffle. Rows that repeat an id count as one text."""
    listed = texts.select("id", F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 2)).alias("w"))
    repeated = materialise(
        texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id")), "repeated"
    )
    if not repeated.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        merged = listed.join(repeated, same, "left_semi").select("id", F.explode("w").alias("word"))
        merged = merged.groupBy("id").agg(F.collect_set("word").alias("w"))
        listed = listed.join(repeated, same, "left_anti").unionByName(merged)
    found = None
    for block in string_blocks(terms, "word"):
        part = term_points(listed, block, exact, partial, min_len)
        found = part if found is None else found.unionByName(part)
    return term_points(listed, [], exact, partial, min_len) if found is None else found


def keyword_search(
    queries: DataFrame,
    corpus: DataFrame,
    dictionary: DataFrame | None = None,
    boosted: DataFrame | None = None,
    k: int = 10,
    min_len: int = 1,
    phrase_boost: int = 15,
    item_boost: int = 2,
) -> DataFrame:
    """(qid, id, score, rank). ``corpus(id, name, text)``; ``boosted(id)`` lists rows that get
    ``item_boost`` when they already score. A name containing the whole query scores
    ``phrase_boost`` even without any word hit.

    Queries are taken in blocks of bounded size, each with one scan of the corpus (see ``termscan``): nothing but the best
    of each task is shuffled, and no pair of a query and a document is ever listed."""
    texts = queries.select("qid", norm(F.col("text")).alias("text"))
    expanded = postings(texts, "qid", "text", 2) if dictionary is None else expand_queries(queries, dictionary)
    listed = expanded.groupBy("qid").agg(F.collect_set("word").alias("words"))
    docs = corpus.select("id", norm(F.col("name")).alias("name"), norm(F.col("text")).alias("text"))
    if boosted is None:
        docs = docs.withColumn("bonus", F.lit(0))
    else:
        docs = docs.join(boosted.select("id").distinct().withColumn("bonus", F.lit(item_boost)), "id", "left")
    hits = None
    for rows, named in query_blocks(texts.join(listed, "qid", "left")):
        terms: dict[str, list[int]] = {}
        for number, r in enumerate(rows):
            for word in r.words or []:
                terms.setdefault(word, []).append(number)
        part = named(scan_top_k(docs, terms, [r.text for r in rows], k, 3, 1, min_len, phrase_boost))
        hits = part if hits is None else hits.unionByName(part)
    return top_k(hits, ["qid"], [F.desc("score"), F.asc("id")], k)


def bm25_statistics(corpus: DataFrame, tokens: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tf(id, word, tf, dl), df(word, df) and a one-row totals(n, avgdl) of ``corpus(id, text)``.

    ``tokens`` is the pluggable token function: a column of arrays; default is the words of the
    normalised text. A row's words are counted where the row is read; only rows that repeat an id meet in a shuffle."""
    listed = corpus.select("id", (norm(F.col("text")) if tokens is None else F.filter(tokens, lambda w: w != "")).alias("w"))
    counted = word_counts(listed)
    repeated = materialise(corpus.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id")), "repeated")
    if not repeated.isEmpty():  # rows of one id and length count together
        same = F.col("id").eqNullSafe(F.col("_id"))
        summed = counted.join(repeated, same, "left_semi").groupBy("id", "dl", "word").agg(F.sum("tf").alias("tf"))
        counted = counted.join(repeated, same, "left_anti").unionByName(summed)
    tf = materialise(counted, "tf")
    df = materialise(tf.groupBy("word").agg(F.count("*").alias("df")), "df")
    rows = corpus.agg(F.count("*").alias("n"), F.count(F.lit(1) if tokens is None else tokens).alias("_rows"))
    total = F.coalesce(F.sum("tf"), F.lit(0)).alias("_total")
    totals = rows.crossJoin(tf.agg(total)).select("n", F.when(F.col("_rows") > 0, F.col("_total") / F.col("_rows")).alias("avgdl"))
    return tf, df, totals


def bm25_search(
    queries: DataFrame, corpus: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(qid, id, stage, score, rank). A query without any hit is retried with its special characters
    stripped, then with every token of three or more characters replaced by the vocabulary words
    at edit distance one or less. Scores are equal if they are to nine decimals.

    Each stage counts the documents of its queries' words and then scans the corpus once per block of queries: the
    postings of common words are not listed, and only the best of each task are shuffled. Queries of the same words are
    searched once: a block holds different ones only."""
    listed = materialise(corpus.select("id", F.filter(words(norm(F.col("text"))), lambda w: w != "").alias("w")), "tokens")
    n, avgdl = listed.agg(F.count("*"), F.avg(F.size("w"))).first()
    held = listed.select(F.explode(F.array_distinct("w")).alias("word"))
    asked = queries.filter(F.length(F.trim("text")) >= 2)

    def terms_of(rows: DataFrame, text: Column) -> DataFrame:
        return rows.select("qid", F.explode(F.array_distinct(F.split(norm(text), " "))).alias("word")).filter(
            "word <> ''"
        )

    def scored(terms: DataFrame, stage: str) -> DataFrame:
        wanted = materialise(terms.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("held")), "terms")
        terms = materialise(wanted.select("held").distinct().select("held", F.explode(F.split("held", " ")).alias("word")), "words")
        df = held.join(terms.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = terms.join(df, "word").select(F.col("held").alias("qid"), F.struct("word", idf.alias("idf")).alias("pair"))
        hits = None
        for rows, named in query_blocks(weighed.groupBy("qid").agg(F.collect_list("pair").alias("pairs")).withColumn("words", F.col("pairs.word"))):
            weights: dict[str, list[tuple[int, float]]] = {}
            for number, r in enumerate(rows):
                for word, weight in r.pairs:
                    weights.setdefault(word, []).append((number, weight))
            part = named(bm25_top_k(listed, weights, len(rows), k, k1, b, avgdl or 1.0))
            hits = part if hits is None else hits.unionByName(part)
        best = top_k(hits.withColumnRenamed("qid", "held"), ["held"], [F.desc("score"), F.asc("id")], k)
        return materialise(wanted.join(best, "held").select("qid", "id", F.lit(stage).alias("stage"), "score", "rank"), "bm25")

    def unanswered(rows: DataFrame, hits: DataFrame) -> DataFrame:
        return rows.join(hits.select("qid").distinct(), "qid", "left_anti")

    found = scored(terms_of(asked, F.col("text")), "plain")
    left = materialise(unanswered(asked, found), "left")
    if left.isEmpty():
        release(listed)
        return found
    stripped_text = F.regexp_replace("text", r"[^a-zA-Z0-9\s]", " ")
    stripped = scored(terms_of(left, stripped_text), "stripped")
    missed = materialise(terms_of(unanswered(left, stripped), F.col("text")).filter(F.length("word") >= 3), "missed")
    near = near_words(materialise(missed.select("word").distinct(), "missed-words"), held.distinct())
    fuzzy = scored(missed.join(near, "word").select("qid", F.col("near").alias("word")).distinct(), "fuzzy")
    release(listed)
    return found.unionByName(stripped).unionByName(fuzzy)


def name_search(queries: DataFrame, corpus: DataFrame, k: int = 8) -> DataFrame:
    """(qid, id, score, rank) over ``corpus(id, name, keywords)`` with tiers for the whole query in
    the name, all tokens, all tokens but one, the query in the keywords, all tokens in the keywords.

    A name that misses at most one token holds at least one of any two, so candidates come from the two
    rarest of the query's longest tokens; for keywords the rarest one is enough. Whether the other
    tokens occur is then read from the whole name.
    """
    q = (
        queries.select("qid", norm(F.col("text")).alias("q"))
        .filter(F.length("q") >= 3)
        .withColumn("toks", words(F.col("q"), 2))
        .filter(F.size("toks") > 0)
    )
    # the same text is often asked again: every distinct text is searched once
    asked = materialise(q.select("qid", "q"), "asked")
    q = materialise(q.select("q", "toks").distinct().withColumn("qid", F.col("q")), "queries")
    c = materialise(
        corpus.select("id", norm(F.col("name")).alias("name"), norm(F.array_join("keywords", " ")).alias("kw")), "names"
    )
    # long tokens are rare ones: only the four longest of a query are looked up as keys
    tokens = materialise(
        top_k(
            q.select("qid", F.explode(F.array_distinct("toks")).alias("token")).withColumn("_l", F.length("token")),
            ["qid"], [F.desc("_l"), F.asc("token")], 4,
        ).select("qid", "token"),
        "tokens",
    )
    needles = materialise(tokens.select(F.col("token").alias("needle")).distinct(), "needles")

    def candidates(column: str, keys: int) -> DataFrame:
        # a bounded number of tokens is looked for in the texts themselves, more of them in an index of all words
        scanned = contained(needles.select(F.col("needle").alias("nid"), "needle"), c.select(F.col("id").alias("tid"), F.col(column).alias("text")))
        if scanned is None:
            index = WordIndex.build(c.select("id", column), "id", column)
            hits = materialise(words_containing(needles, index.vocabulary.select("word")), "hits")
            per_token = hits.join(index.vocabulary, "word").groupBy("needle").agg(F.sum("n").alias("n"))
        else:
            holding = materialise(scanned.select(F.col("nid").alias("needle"), F.col("tid").alias("id")), "holding")
            per_token = holding.groupBy("needle").agg(F.count("*").alias("n"))
        rated = tokens.join(per_token.withColumnRenamed("needle", "token"), "token", "left").withColumn(
            "n", F.coalesce("n", F.lit(0))
        )
        chosen = top_k(rated, ["qid"], [F.asc("n"), F.asc("token")], keys).select("qid", F.col("token").alias("needle"))
        if scanned is not None:
            return chosen.join(holding, "needle").select("qid", "id").distinct()
        return index.lookup(chosen.join(hits, "needle").select("qid", "word").distinct(), "id").select("qid", "id").distinct()

    # tokens repeat in the count below exactly as often as in the query; two distinct keys suffice
    pairs = candidates("name", 2).unionByName(candidates("kw", 1)).distinct()
    joined = pairs.join(q, "qid").join(c, "id")
    n_tok = F.size("toks")
    in_name = F.size(F.filter("toks", lambda t: F.contains(F.col("name"), t)))
    in_kw = F.size(F.filter("toks", lambda t: F.contains(F.col("kw"), t)))
    name, query, kw = F.col("name"), F.col("q"), F.col("kw")
    name_tier = (
        F.when(name == query, 100)
        .when(F.startswith(name, F.concat(query, F.lit(" "))) | F.startswith(name, F.concat(query, F.lit(","))), 80)
        .when(F.contains(name, query), 60)
        .when(in_name == n_tok, 30 + in_name * 5)
        .when((n_tok >= 2) & (in_name >= F.greatest(F.lit(1), n_tok - 1)), 15 + in_name * 4)
        .otherwise(0)
    )
    kw_tier = (
        F.when(F.contains(kw, query), F.when(word_bounded_at_first(kw, query), 45).otherwise(0))
        .when((n_tok >= 2) & (in_kw == n_tok), 25 + in_kw * 3)
        .otherwise(0)
    )
    scored = (
        joined.withColumn("_name", name_tier)
        .withColumn("_s", F.when((F.col("_name") < 30) & (kw != ""), F.greatest("_name", kw_tier)).otherwise(F.col("_name")))
        .filter("_s > 0")
        .withColumn("name_length", F.length("name"))
        .withColumn(
            "score", F.col("_s") - F.least(F.lit(15), F.floor(F.col("name_length") / 20).cast("int"))
        )
    )
    best = top_k(
        scored.select("q", "id", "score", "name_length"), ["q"], [F.desc("score"), F.asc("name_length"), F.asc("id")], k
    )
    return asked.join(best, "q").select("qid", "id", "score", "rank")
