"""Query-side helpers: ambiguity, refinement, glossary, topic assignment, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import has_word
from ..functions.text import contains_any
from .containment import phrase_pairs
from .ranking import first_by


def detect_ambiguity(queries: DataFrame, triggers: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """One row per clarifying option of the first trigger whose options' words are all absent from
    the query. ``triggers`` is a literal list of (pattern, [(label, value)])."""
    low = F.lower("text")
    option_type = "array<struct<label:string,value:string>>"
    ladder = F.when(F.lit(False), F.lit(None).cast(option_type))
    for pattern, options in triggers:
        known = contains_any(low, [w for _, value in options for w in value.split(" ")])
        packed = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in options])
        ladder = ladder.when(low.rlike(pattern) & ~known, packed)
    found = queries.withColumn("_o", ladder).filter("_o is not null")
    exploded = found.select(*queries.columns, F.posexplode("_o").alias("pos", "o"))
    return exploded.select(*queries.columns, (F.col("pos") + 1).alias("pos"), "o.label", "o.value")


def refine_query(rows: DataFrame, text: Column, extra: Column) -> DataFrame:
    """Adds ``refined``: the query with the chosen clarifier appended."""
    return rows.withColumn("refined", F.concat_ws(" ", text, extra))


def glossary_lookup(queries: DataFrame, definitions: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(qid, term, tier): the longest definition key inside the query, else the first symptom key.
    Both glossaries hold (seq, key, term), keys in lower case."""
    q = queries.select(F.col("qid").alias("tid"), F.lower("text").alias("text"))

    def hits(glossary: DataFrame, tier: int) -> DataFrame:
        needles = glossary.select(F.col("key").alias("nid"), F.col("key").alias("needle")).distinct()
        return phrase_pairs(needles, q).join(glossary, F.col("nid") == F.col("key")).select(
            F.col("tid").alias("qid"), "seq", "key", "term", F.lit(tier).alias("tier")
        )

    both = hits(definitions, 1).unionByName(hits(symptoms, 2))
    length = F.when(F.col("tier") == 1, -F.length("key")).otherwise(0)
    return first_by(both.withColumn("_l", length), ["qid"], ["tier", "_l", "seq"], ["term"]).select("qid", "term", "tier")


def assign_topic(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(id, topic): first topic in ``seq`` order with a pattern in the lower-cased text.
    ``patterns(seq, topic, pattern)``; patterns of up to three characters need word borders."""
    texts = rows.select(F.col("id").alias("tid"), F.lower(text).alias("text"))
    needles = patterns.select(F.col("pattern").alias("nid"), F.col("pattern").alias("needle")).distinct()
    long = phrase_pairs(needles.filter(F.length("needle") > 3), texts)
    hits = long.join(patterns, F.col("nid") == F.col("pattern")).select(F.col("tid").alias("id"), "seq", "topic")
    short = [r.pattern for r in patterns.filter(F.length("pattern") <= 3).select("pattern").distinct().collect()]
    if short:  # strings of up to three characters over the pattern alphabet: a bounded set
        found = F.filter(F.array(*[F.when(has_word(F.col("text"), p), F.lit(p)) for p in short]), lambda p: p.isNotNull())
        words = texts.select(F.col("tid").alias("id"), F.explode(found).alias("pattern"))
        hits = hits.unionByName(words.join(patterns, "pattern").select("id", "seq", "topic"))
    return first_by(hits, ["id"], ["seq"], ["topic"]).select("id", "topic")


def expand_patterns(patterns: DataFrame, dictionary: DataFrame, blocked: list[str]) -> DataFrame:
    """(seq, topic, pattern) plus the synonyms of every pattern, minus broad terms."""
    added = (
        patterns.join(dictionary, patterns.pattern == dictionary.term)
        .filter(~F.lower("synonym").isin(blocked))
        .select("seq", "topic", F.col("synonym").alias("pattern"))
    )
    return patterns.select("seq", "topic", "pattern").unionByName(added).distinct()


def alias_topics(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, topic): topics of every alias that contains the query or lies in it.
    ``queries(qid, q)`` trimmed lower case, ``aliases(alias, topic)``."""
    names = aliases.select("alias").distinct()
    inside = phrase_pairs(
        names.select(F.col("alias").alias("nid"), F.col("alias").alias("needle")),
        queries.select(F.col("qid").alias("tid"), F.col("q").alias("text")),
    ).select(F.col("tid").alias("qid"), F.col("nid").alias("alias"))
    around = phrase_pairs(
        queries.select(F.col("qid").alias("nid"), F.col("q").alias("needle")),
        names.select(F.col("alias").alias("tid"), F.col("alias").alias("text")),
    ).select(F.col("nid").alias("qid"), F.col("tid").alias("alias"))
    return inside.unionByName(around).join(aliases, "alias").select("qid", "topic").distinct()
