"""Query intent: rule classification, condition defaults, merge with model scores, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.rules import matches, pattern_count, word_pattern
from ..functions.text import contains_any
from ..session import materialise
from .ranking import top_k


def _class_with_confidence(text: Column, classes: list[tuple[str, list[str]]]) -> tuple[Column, Column]:
    """A later class must be strictly more confident; confidence is 0.6 + 0.1 per pattern, at most 0.95."""
    label, best = F.lit("unknown"), F.lit(0.5)
    for name, patterns in classes:
        n = pattern_count(text, patterns)
        confidence = F.lit(0.6) + n * F.lit(0.1)
        wins = (n > 0) & (confidence > best)
        label = F.when(wins, F.lit(name)).otherwise(label)
        best = F.when(wins, F.least(confidence, F.lit(0.95))).otherwise(best)
    return label, best


def rule_intent(
    text: Column,
    acute: str = packs.INTENT_ACUTE,
    followed: str = packs.INTENT_FOLLOWED,
    phases: list = packs.INTENT_PHASES,
    urgencies: list = packs.INTENT_URGENCIES,
) -> Column:
    """struct(phase, urgency, phase_confidence, urgency_confidence, source) from patterns alone."""
    q = F.lower(text)
    phase, phase_conf = _class_with_confidence(q, phases)
    urgency, urgency_conf = _class_with_confidence(q, urgencies)
    short = matches(q, acute) & ~matches(q, followed)
    return F.struct(
        F.when(short, "initial").otherwise(phase).alias("phase"),
        F.when(short, "acute").otherwise(urgency).alias("urgency"),
        F.when(short, 0.85).otherwise(phase_conf).alias("phase_confidence"),
        F.when(short, 0.9).otherwise(urgency_conf).alias("urgency_confidence"),
        F.when(short, "rules-acute-condition").otherwise("rules").alias("source"),
    )


def condition_urgency(
    text: Column, conditions: list[tuple[str, str]] = packs.CONDITIONS, followed: str = packs.CONDITION_FOLLOWED
) -> Column:
    """struct(condition, urgency, confidence) of the first word-bounded condition; null without one.
    A follow-up wording turns it into routine."""
    q = F.lower(text)
    table = F.array(
        *[
            F.struct(F.lit(n).alias("condition"), F.lit(u).alias("urgency"), F.lit(word_pattern(n)).alias("p"))
            for n, u in conditions
        ]
    )
    # the plain substring test runs first, so a pattern is only tried on texts that hold the words
    hits = F.filter(table, lambda c: F.contains(q, c["condition"]) & F.regexp_like(q, c["p"]))
    found = F.try_element_at(hits, F.lit(1))
    late = matches(q, followed)
    return F.when(
        found.isNotNull(),
        F.struct(
            found["condition"].alias("condition"),
            F.when(late, "routine").otherwise(found["urgency"]).alias("urgency"),
            F.when(late, 0.75).otherwise(0.85).alias("confidence"),
        ),
    )


def softmax_pick(logits: Column, labels: list[str]) -> Column:
    """struct(label, confidence) of the largest logit, with max-subtracted softmax."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in labels])
    at = F.array_position(logits, top).cast("int")
    return F.struct(F.element_at(names, at).alias("label"), (F.element_at(weights, at) / total).alias("confidence"))


def per_text(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows(..., text)`` with ``out``, a ``value`` read from ``text`` alone: evaluated once per distinct text, since patterns
    cost far more than the look-up and the same text is asked again and again."""
    known = materialise(rows.select("text").distinct().select(F.col("text").alias("_text"), value.alias(out)), "texts")
    return rows.join(known, F.col("text").eqNullSafe(F.col("_text"))).drop("_text")


def classify_intent(
    queries: DataFrame,
    model: DataFrame | None = None,
    rules: dict | None = None,
    conditions: list[tuple[str, str]] = packs.CONDITIONS,
    followed: str = packs.CONDITION_FOLLOWED,
) -> DataFrame:
    """(qid, phase, urgency, phase_confidence, urgency_confidence, source, condition).

    ``model(qid, phase, urgency, phase_confidence, urgency_confidence)`` holds scores of an external
    classifier; queries without a row there are classified by rules. Unsure model answers are
    refined by rules, then by defaults; conditions settle an unsure urgency.
    """
    read = F.struct(rule_intent(F.col("text"), **(rules or {})).alias("r"), condition_urgency(F.col("text"), conditions, followed).alias("c"))
    df = per_text(queries.select("qid", "text"), read, "_read").select("qid", "_read.r", "_read.c")
    r = F.col("r")
    if model is None:
        df = df.select("qid", "r", "c", F.col("r").alias("m"))
    else:
        m = model.select(
            F.col("qid").alias("_mq"),
            F.struct("phase", "urgency", "phase_confidence", "urgency_confidence").alias("_m"),
        )
        df = df.join(m, df.qid == F.col("_mq"), "left")
        has, mm = F.col("_m").isNotNull(), F.col("_m")
        unsure = has & ((mm["phase"] == "unknown") | (mm["phase_confidence"] < 0.7))
        helped = unsure & (r["phase"] != "unknown") & (r["phase_confidence"] > 0.6)
        unsure_u = (mm["urgency"] == "unknown") | (mm["urgency_confidence"] < 0.7)
        take_u = has & unsure_u & (r["urgency"] != "unknown") & (r["urgency_confidence"] > 0.6)
        df = df.select(
            "qid",
            "r",
            "c",
            F.when(~has, r)
            .otherwise(
                F.struct(
                    F.when(helped, r["phase"]).when(unsure, "initial").otherwise(mm["phase"]).alias("phase"),
                    F.when(take_u, r["urgency"]).otherwise(mm["urgency"]).alias("urgency"),
                    F.when(helped, r["phase_confidence"]).when(unsure, 0.6).otherwise(mm["phase_confidence"]).alias(
                        "phase_confidence"
                    ),
                    F.when(take_u, r["urgency_confidence"]).otherwise(mm["urgency_confidence"]).alias(
                        "urgency_confidence"
                    ),
                    F.when(helped, "hybrid").when(unsure, "default").otherwise("model").alias("source"),
                )
            )
            .alias("m"),
        )
    m, c = F.col("m"), F.col("c")
    settle = c.isNotNull() & ((m["urgency"] == "unknown") | (m["urgency_confidence"] < 0.7))
    return df.select(
        "qid",
        m["phase"].alias("phase"),
        F.when(settle, c["urgency"]).otherwise(m["urgency"]).alias("urgency"),
        m["phase_confidence"].alias("phase_confidence"),
        F.when(settle, c["confidence"]).otherwise(m["urgency_confidence"]).alias("urgency_confidence"),
        F.when(settle, F.concat(m["source"], F.lit("+condition-default"))).otherwise(m["source"]).alias("source"),
        c["condition"].alias("condition"),
    )


def name_class(text: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """First class with any raw substring in the lower-cased text, else ``unknown``."""
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, parts in classes:
        ladder = ladder.when(contains_any(F.lower(text), parts), F.lit(name))
    return ladder.otherwise("unknown")


def intent_boost(
    phase: Column, urgency: Column, phase_conf: Column, urgency_conf: Column, item_phase: Column, item_urgency: Column
) -> Column:
    """Multiplier of an item's score given the query intent."""
    by_phase = (
        F.when((phase == "unknown") | (phase_conf <= 0.6), 1.0)
        .when(item_phase == phase, 1.5)
        .when((phase == "initial") & (item_phase == "surveillance"), 0.5)
        .when((phase == "surveillance") & (item_phase == "initial"), 0.7)
        .otherwise(1.0)
    )
    by_urgency = (
        F.when((urgency == "unknown") | (urgency_conf <= 0.6), 1.0)
        .when(item_urgency == urgency, 1.3)
        .when((urgency == "acute") & (item_urgency == "routine"), 0.6)
        .otherwise(1.0)
    )
    return by_phase * by_urgency


def rerank_by_intent(
    hits: DataFrame, intents: DataFrame, items: DataFrame, k: int, phases: list = packs.NAME_PHASES,
    urgencies: list = packs.NAME_URGENCIES,
) -> DataFrame:
    """(qid, id, score, boost, rank): ``hits(qid, id, score, rank)`` re-sorted by score times boost.
    ``items(id, name[, phase])``; a stored phase wins over the one read from the name. Queries whose
    phase is unknown keep their order."""
    name = F.col("name")
    stored = F.col("phase") if "phase" in items.columns else F.lit(None).cast("string")
    tagged = items.select(
        "id",
        F.coalesce(stored, name_class(name, phases)).alias("_ip"),
        name_class(name, urgencies).alias("_iu"),
    )
    joined = hits.withColumnRenamed("rank", "_before").join(tagged, "id").join(
        intents.select("qid", "phase", "urgency", "phase_confidence", "urgency_confidence"), "qid"
    )
    boost = intent_boost(
        F.col("phase"), F.col("urgency"), F.col("phase_confidence"), F.col("urgency_confidence"), F.col("_ip"), F.col("_iu")
    )
    scored = joined.withColumn("boost", F.when(F.col("phase") == "unknown", 1.0).otherwise(boost))
    order = F.when(F.col("phase") == "unknown", 0.0).otherwise(F.round(F.col("score") * F.col("boost"), 9))
    return top_k(scored.withColumn("_o", order), ["qid"], [F.desc("_o"), F.asc("_before")], k).select(
        "qid", "id", "score", "boost", "rank"
    )


def token_ids(text: Column, vocabulary: dict[str, int], length: int = 32) -> Column:
    """struct(ids, mask): class mark, token ids, end mark, padding up to ``length``. The vocabulary is
    a literal of the classifier, not data."""
    toks = F.slice(
        F.regexp_extract_all(F.lower(text), F.lit(r"((?<!\w)\w(?:[\w/-]*\w)?(?!\w))"), F.lit(1)), 1, length - 2
    )
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    unk = vocabulary.get("[UNK]", 1)
    body = F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unk)))
    ids = F.concat(F.array(F.lit(vocabulary.get("[CLS]", 2))), body, F.array(F.lit(vocabulary.get("[SEP]", 3))))
    n = F.size(ids)
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(vocabulary.get("[PAD]", 0)), F.lit(length) - n)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("mask"),
    )
