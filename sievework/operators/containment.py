"""Word indexes and substring joins without a nested loop.

A pair (needle, text) is only looked at when both share a key that every true pair must share: a
whole word, or a character gram. Each needle is keyed by its *rarest* such key, and the candidates
are verified with ``contains`` afterwards, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .automaton import contained
from .ranking import first_by

SALTS = 32
GRAM = 3
HOT_ROWS = 2_000_000
HOT_SHARE = 1000
SHORT_TERM = 64


def hot_keys(counts: DataFrame, key: str, n: str = "n", floor: int = HOT_ROWS, share: int = HOT_SHARE) -> list:
    """Keys with at least ``floor`` rows and at least 1/``share`` of all rows. Row counts add up to
    the total, so there are at most ``share`` such keys however large the table is."""
    most, total = counts.agg(F.max(n), F.sum(n)).first()
    if most is None or most < floor:
        return []
    return [r[0] for r in counts.filter(F.col(n) >= max(floor, total // share)).select(key).collect()]


def skew_join(
    large: DataFrame, small: DataFrame, key: str, spread: Column, hot: list, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose hot keys are split over ``salts`` parts of the large side; the rows of the
    small side are repeated for the hot keys only."""
    if not hot:
        return large.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    left = large.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = small.withColumn(
        "_salt",
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def postings(texts: DataFrame, tid: str, text: str, min_len: int = 1) -> DataFrame:
    """Distinct (id, word) pairs of a normalised text column, made distinct inside the row."""
    kept = F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= min_len))
    return texts.select(tid, F.explode(kept).alias("word"))


@dataclass
class WordIndex:
    """Stored postings (id, word), vocabulary (word, n) and the words too frequent for one task."""

    postings: DataFrame
    vocabulary: DataFrame
    hot: list = field(default_factory=list)

    @staticmethod
    def build(texts: DataFrame, tid: str, text: str, min_len: int = 1) -> WordIndex:
        stored = materialise(postings(texts, tid, text, min_len), "postings")
        vocabulary = materialise(stored.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
        return WordIndex(stored, vocabulary, hot_keys(vocabulary, "word"))

    def lookup(self, small: DataFrame, tid: str) -> DataFrame:
        """Join (word, ...) rows with the postings."""
        return skew_join(self.postings, small, "word", F.col(tid), self.hot)


def _grams(col: Column, size: int) -> Column:
    """Distinct grams of one length; words shorter than ``size`` have none."""
    starts = F.when(F.length(col) >= size, F.sequence(F.lit(1), F.length(col) - (size - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.substring(col, i, F.lit(size))))


def words_containing(needles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All (needle, word) with ``word`` containing ``needle``; both inputs hold distinct strings.

    A bounded number of needles is found by one scan. Beyond that, needles of 1 and 2 characters meet words on the needle itself, longer ones on their rarest
    three-character gram.
    """
    scanned = contained(
        needles.select(F.col("needle").alias("nid"), "needle"), vocabulary.select(F.col("word").alias("tid"), F.col("word").alias("text"))
    )
    if scanned is not None:
        return scanned.select(F.col("nid").alias("needle"), F.col("tid").alias("word"))
    word = F.col("word")
    few = vocabulary.select("word", F.explode(F.concat(_grams(word, 1), _grams(word, 2))).alias("needle"))
    short = few.join(needles.filter(F.length("needle").between(1, GRAM - 1)), "needle").select("needle", "word")
    hay = vocabulary.select("word", F.explode(_grams(word, GRAM)).alias("gram"))
    counts = materialise(hay.groupBy("gram").agg(F.count("*").alias("n")), "grams")
    grams = needles.filter(F.length("needle") >= GRAM).select(
        "needle", F.explode(_grams(F.col("needle"), GRAM)).alias("gram")
    )
    # a gram the vocabulary lacks rules the needle out: it must not be dropped in favour of others
    rated = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keyed = first_by(rated, ["needle"], ["n", "gram"], []).filter("n > 0").select("needle", "gram")
    long = skew_join(hay, keyed, "gram", word, hot_keys(counts, "gram"))
    return short.unionByName(long.filter(F.contains("word", F.col("needle"))).select("needle", "word"))


def words_within(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """All (term, word) with ``word`` contained in ``term``. Terms of up to 64 characters list their
    own substrings and meet the vocabulary by equality; longer ones go through the gram join."""
    short = terms.filter(F.length("term") <= SHORT_TERM)
    starts = F.sequence(F.lit(1), F.length("term"))
    pieces = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.length("term") - i + 1), lambda n: F.substring(F.col("term"), i, n)
            ),
        )
    )
    listed = short.filter("term <> ''").select("term", F.explode(F.array_distinct(pieces)).alias("word"))
    result = listed.join(vocabulary.select("word"), "word").select("term", "word")
    long = terms.filter(F.length("term") > SHORT_TERM)
    if long.isEmpty():
        return result
    hits = words_containing(
        vocabulary.select(F.col("word").alias("needle")), long.select(F.col("term").alias("word"))
    )
    return result.unionByName(hits.select(F.col("word").alias("term"), F.col("needle").alias("word")))


def phrase_pairs(
    needles: DataFrame, texts: DataFrame, whole_words: bool = False, index: WordIndex | None = None
) -> DataFrame:
    """All (nid, tid) whose text contains the needle.

    ``needles(nid, needle)`` and ``texts(tid, text)`` hold normalised strings; ``index`` is the word
    index of ``texts`` when the caller has one. A bounded number of needles is found by one scan of the texts.
    Beyond that, candidates come from words: inside a needle of three or more words the inner
    words must be whole words of the text; shorter needles meet the text through the words that
    contain their longest word. With ``whole_words`` the needle must be made of whole words, so
    any of its words can serve as key. Verification reads whole texts.
    """
    scanned = contained(needles, texts, whole_words)
    if scanned is not None:
        return scanned
    if index is None:
        index = WordIndex.build(texts, "tid", "text")
    needles = materialise(needles.filter(F.length("needle") > 0).select("nid", "needle"), "needles")
    split = needles.withColumn("_w", F.split("needle", " "))
    if whole_words:
        exact = split.select("nid", F.explode(F.array_distinct("_w")).alias("word"))
    else:
        exact = split.filter(F.size("_w") >= 3).select(
            "nid", F.explode(F.expr("array_distinct(slice(_w, 2, size(_w) - 2))")).alias("word")
        )
    rated = exact.join(index.vocabulary, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    anchors = first_by(rated, ["nid"], ["n", "word"], []).filter("n > 0").select("nid", "word")
    if not whole_words:
        loose = split.filter(F.size("_w") < 3).select(
            "nid", F.expr("array_sort(_w, (a, b) -> length(b) - length(a))")[0].alias("needle")
        )
        if not loose.isEmpty():
            hits = words_containing(loose.select("needle").distinct(), index.vocabulary.select("word"))
            anchors = anchors.unionByName(loose.join(hits, "needle").select("nid", "word"))
    candidates = index.lookup(anchors, "tid").select("nid", "tid").distinct()
    hay, term = F.col("text"), F.col("needle")
    if whole_words:
        hay = F.concat(F.lit(" "), hay, F.lit(" "))
        term = F.concat(F.lit(" "), term, F.lit(" "))
    return (
        candidates.join(needles, "nid")
        .join(texts.select("tid", "text"), "tid")
        .filter(F.contains(hay, term))
        .select("nid", "tid")
    )
