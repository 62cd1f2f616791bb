"""Resolving query texts to concepts through a synonym table: exact, substring, longest, fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, word_bounded_at_first
from ..session import materialise
from .containment import phrase_pairs
from .ranking import first_by, top_k

DELETION_LIMIT = 32


def normalise_synonyms(synonyms: DataFrame) -> DataFrame:
    """``synonyms(seq, synonym, concept_id)`` -> one row per normalised synonym. The last definition
    gives the concept, the first one the position; blank synonyms are dropped."""
    keyed = synonyms.select("seq", norm(F.col("synonym")).alias("synonym"), "concept_id").filter("synonym <> ''")
    return keyed.groupBy("synonym").agg(
        F.min("seq").alias("seq"), F.max(F.struct("seq", "concept_id")).getField("concept_id").alias("concept_id")
    )


def normalise_queries(queries: DataFrame) -> DataFrame:
    return queries.select("qid", norm(F.col("text")).alias("q")).filter("q <> ''")


def resolve_exact(q: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(qid, concept_id, matched) for queries equal to a synonym."""
    return q.join(synonyms, q.q == synonyms.synonym).select("qid", "concept_id", F.col("synonym").alias("matched"))


def _pairs(q: DataFrame, synonyms: DataFrame, whole_words: bool) -> DataFrame:
    """(qid, synonym) where either contains the other."""
    inside = phrase_pairs(
        synonyms.select(F.col("synonym").alias("nid"), F.col("synonym").alias("needle")),
        q.select(F.col("qid").alias("tid"), F.col("q").alias("text")),
        whole_words,
    ).select(F.col("tid").alias("qid"), F.col("nid").alias("synonym"))
    around = phrase_pairs(
        q.select(F.col("qid").alias("nid"), F.col("q").alias("needle")),
        synonyms.select(F.col("synonym").alias("tid"), F.col("synonym").alias("text")),
        whole_words,
    ).select(F.col("nid").alias("qid"), F.col("tid").alias("synonym"))
    return inside.unionByName(around).distinct()


def resolve_first_substring(q: DataFrame, synonyms: DataFrame) -> DataFrame:
    """First synonym in table order that contains the query or is contained in it."""
    hits = _pairs(q, synonyms, whole_words=False).join(synonyms, "synonym")
    return first_by(hits, ["qid"], ["seq"], ["synonym", "concept_id"]).select(
        "qid", "concept_id", F.col("synonym").alias("matched")
    )


def resolve_longest(q: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Longest word-bounded synonym for queries of more than three characters, earliest on ties.

    Synonyms of up to three characters must equal a word of the query. Longer ones must stand
    between word borders at their *first* occurrence, in the query or around it.
    """
    eligible = q.filter(F.length("q") > 3)
    hits = _pairs(eligible, synonyms, whole_words=True).join(eligible, "qid").join(synonyms, "synonym")
    s, text = F.col("synonym"), F.col("q")
    matches = (
        F.when(F.length(s) <= 3, F.array_contains(F.split(text, " "), s))
        .when(F.contains(text, s), word_bounded_at_first(text, s))
        .when(F.contains(s, text), word_bounded_at_first(s, text))
        .otherwise(False)
    )
    kept = hits.filter(matches).withColumn("_len", -F.length("synonym"))
    return first_by(kept, ["qid"], ["_len", "seq"], ["synonym", "concept_id"]).select(
        "qid", "concept_id", F.col("synonym").alias("matched")
    )


def _deletion_keys(col: Column) -> Column:
    return F.array_distinct(
        F.concat(
            F.array(col),
            F.transform(
                F.sequence(F.lit(1), F.length(col)),
                lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))),
            ),
        )
    )


def _half_keys(col: Column, base: Column) -> list[Column]:
    """Left and right part of a string as cut for a partner of length ``base``."""
    mid = F.floor(base / 2).cast("int")
    return [
        F.concat(F.lit("<"), base.cast("string"), F.lit(":"), F.substring(col, F.lit(1), mid)),
        F.concat(F.lit(">"), base.cast("string"), F.lit(":"), F.substring(col, F.length(col) - (base - mid) + 1, base)),
    ]


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, near, distance) with edit distance 0 or 1 between ``left(word)`` and ``right(word)``.

    Short strings that near share the string itself or a one-character deletion. For long ones one
    half is untouched by the single edit, so they meet on a half; key volume stays linear.
    """
    word, near = F.col("word"), F.col("near")
    b = right.select(F.col("word").alias("near"))
    short = left.filter(F.length("word") <= DELETION_LIMIT).select("word", F.explode(_deletion_keys(word)).alias("key"))
    b_short = b.filter(F.length("near") <= DELETION_LIMIT + 1).select("near", F.explode(_deletion_keys(near)).alias("key"))
    pairs = b_short.join(short, "key").select("word", "near")
    long = left.filter(F.length("word") > DELETION_LIMIT).select(
        "word", F.explode(F.array(*_half_keys(word, F.length("word")))).alias("key")
    )
    b_keys = [k for d in (-1, 0, 1) for k in _half_keys(near, F.length("near") + d)]
    b_long = b.filter(F.length("near") >= DELETION_LIMIT).select("near", F.explode(F.array(*b_keys)).alias("key"))
    pairs = pairs.unionByName(b_long.join(long, "key").select("word", "near")).distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "near", 1)).filter("distance >= 0")


def suggest_similar(q: DataFrame, synonyms: DataFrame, n: int = 3) -> DataFrame:
    """(qid, matched, concept_id, distance, rank): synonyms at edit distance one from queries of six
    or more characters, one per concept, shortest first."""
    asked = q.filter(F.length("q") >= 6)
    near = near_words(asked.select(F.col("q").alias("word")).distinct(), synonyms.select(F.col("synonym").alias("word")))
    hits = (
        near.filter("distance = 1")
        .join(asked.withColumnRenamed("q", "word"), "word")
        .join(synonyms.withColumnRenamed("synonym", "near"), "near")
        .withColumn("_len", F.length("near"))
    )
    per_concept = first_by(hits, ["qid", "concept_id"], ["distance", "_len", "seq"], ["near"])
    return top_k(per_concept, ["qid"], [F.asc("distance"), F.asc("_len"), F.asc("seq")], n).select(
        "qid", F.col("near").alias("matched"), "concept_id", "distance", "rank"
    )


def first_hit(stages: list[tuple[str, DataFrame]], key: str = "qid") -> DataFrame:
    """Rows of the first stage that answers a key; ``stages`` share their columns."""
    done = None
    for name, rows in stages:
        rows = rows.withColumn("stage", F.lit(name))
        if done is not None:
            rows = rows.join(done.select(key).distinct(), key, "left_anti")
            rows = done.unionByName(rows)
        done = rows
    return done


def resolve(queries: DataFrame, synonyms: DataFrame, substring: str = "first") -> DataFrame:
    """(qid, concept_id, matched, stage): exact, then substring (``first`` in table order or
    ``longest`` word-bounded), then edit distance one. Each stage only sees unresolved queries."""
    syn = materialise(normalise_synonyms(synonyms), "synonyms")
    q = materialise(normalise_queries(queries), "queries")
    exact = materialise(resolve_exact(q, syn).withColumn("stage", F.lit("exact")), "exact")
    left = materialise(q.join(exact.select("qid").distinct(), "qid", "left_anti"), "left")
    pick = resolve_first_substring if substring == "first" else resolve_longest
    part = materialise(pick(left, syn).withColumn("stage", F.lit("substring")), "part")
    rest = left.join(part.select("qid"), "qid", "left_anti")
    fuzzy = suggest_similar(rest, syn, 1).select("qid", "concept_id", "matched").withColumn("stage", F.lit("fuzzy"))
    return exact.unionByName(part).unionByName(fuzzy)
