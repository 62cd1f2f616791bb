"""A corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts become ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the next one's
``docs``; all but the last return the columns of ``documents`` and any further ones, whatever their names. Null and empty
texts pass every stage; tables without rows give tables without rows. Rows that repeat an id count as one document for near
dedup, which keeps or drops them together, and are drawn the same number of times by the mix; rows without an id are never
dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import lines, minhash, mixing, pieces, toxicity
from sievework.llm.queries import MOST, SEED, SHARE, TOXIC_FROM, WEIGHTS, piece_model
from sievework.plans.registry import query
from sievework.session import materialise, release, table


#: Words from which a line counts as a passage, which nobody repeats by chance.
LONG_WORDS = 50


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; all others go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct("*").alias("_doc"), toxicity.score(F.col("text"), model).alias("_score"))
    return scored.filter(F.col("_score") < TOXIC_FROM).select("_doc.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents, passages of 50 words or more in at least two, stay in the first one only;
    ``n_chars`` follows the text."""
    kept = lines.without_lines(docs, lines.dropped_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True, long_words=LONG_WORDS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = found.filter(~F.col("kept")).select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, dealt to its shards and shuffled within each."""
    keys = ["doc_id", "source", "mark"]
    draws, _ = mixing.mix(mixing.sized(docs), WEIGHTS, SHARE, MOST, SEED)
    draws = draws.select(*[F.col(k).alias(f"_{k}") for k in keys], "copy", "shard", "slot").distinct()  # rows with one place are drawn together
    mark = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit(""))))
    own = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", mark.alias("mark"))
    drawn = own.join(draws, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return drawn.repartition("shard").sortWithinPartitions("shard", "slot").select("_doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it (a text's own U+2581 comes back as a blank)."""
    coded = docs.select("doc_id", "lang", "source", pieces.encode_checked(F.col("text"), piece_model()).alias("coded"))
    return coded.select(
        "doc_id", "lang", "source", F.size("coded.ids").cast("long").alias("n_tokens"), F.col("coded.ids").alias("ids"), F.col("coded.round_trip").alias("round_trip")
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL can't express the label model or the encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
