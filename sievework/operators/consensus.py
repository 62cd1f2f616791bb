"""Consensus over rated items: summary cards, best picks, quick references.

``items(scenario_id, topic, region, seq, pos, item, short, modality, rating, contrast)``: one row per
rated item of a scenario; ``seq`` is the order of scenarios, ``pos`` the order inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.text import contains_any, title_case
from .ranking import first_by, full_row_number, top_k

HIGH, MIDDLE = 7, 5


def is_imaging(
    modality: Column, name: Column, modalities: list[str] = packs.IMAGING_MODALITIES, parts: list[str] = packs.IMAGING_NAME_PARTS
) -> Column:
    return modality.isin(modalities) | contains_any(F.lower(name), parts)


def is_named_mri(modality: Column, name: Column, parts: list[str] = packs.MRI_NAME_PARTS) -> Column:
    return F.coalesce(modality == "MRI", F.lit(False)) | F.coalesce(contains_any(F.upper(name), parts), F.lit(False))


def rating_band(rating: Column) -> Column:
    """Display band of a rating: >= 7, >= 4, below."""
    label = F.when(rating >= 7, "Usually Appropriate").when(rating >= 4, "May Be Appropriate")
    css = F.when(rating >= 7, "high").when(rating >= 4, "mid")
    return F.struct(label.otherwise("Usually Not Appropriate").alias("label"), css.otherwise("low").alias("class"))


def item_summary(items: DataFrame) -> DataFrame:
    """(scenario_id, n_high, n_middle, has_positive, top_item, top_rating): items rated 7 and more,
    then 5 and 6; the first of the best rated one is the top."""
    kept = items.filter(F.col("rating") >= MIDDLE)
    best = F.min(F.struct((-F.col("rating")).alias("r"), "pos", "item"))
    return kept.groupBy("scenario_id").agg(
        F.sum((F.col("rating") >= HIGH).cast("long")).alias("n_high"),
        F.sum((F.col("rating") < HIGH).cast("long")).alias("n_middle"),
        (F.max("rating") >= HIGH).alias("has_positive"),
        best.getField("item").alias("top_item"),
        (-best.getField("r")).alias("top_rating"),
    )


def rated_lists(items: DataFrame) -> DataFrame:
    """(scenario_id, band, rank, item, rating): the ``high`` (7 and more) and ``middle`` (5, 6) list of a scenario, best first.
    Lists are rows in order, so that a scenario with very many items is numbered by many tasks."""
    band = F.when(F.col("rating") >= HIGH, "high").otherwise("middle")
    kept = items.filter(F.col("rating") >= MIDDLE).select("scenario_id", band.alias("band"), (-F.col("rating")).alias("_r"), "pos", "item", "rating")
    return full_row_number(kept, ["scenario_id", "band"], ["_r", "pos", "item"]).select("scenario_id", "band", "rank", "item", "rating")


def consensus_cards(
    scenarios: DataFrame,
    items: DataFrame,
    min_scenarios: int = 3,
    strong: float = 0.70,
    moderate: float = 0.40,
    max_alternatives: int = 3,
) -> DataFrame:
    """One card per topic. ``scenarios(scenario_id, topic, region, seq, name)``; ``items`` as in the
    module text, already limited to eligible ones.

    Counts are partial-aggregated per (topic, item) first; only those totals meet per topic, so a
    topic holding a third of all scenarios costs one row per distinct item.
    """
    totals = scenarios.groupBy("topic").agg(F.count("*").alias("total")).filter(F.col("total") >= min_scenarios)
    by_region = scenarios.groupBy("topic", "region").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    region = first_by(by_region.withColumn("_n", -F.col("n")), ["topic"], ["_n", "first"], ["region"]).select(
        "topic", "region"
    )
    samples = (
        top_k(scenarios.select("topic", "seq", "name"), ["topic"], [F.asc("seq")], 3)
        .groupBy("topic")
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.substring("name", 1, 80).alias("name")))).alias("_s"))
        .select("topic", F.transform("_s", lambda s: s["name"]).alias("sample_scenarios"))
    )
    rated = (
        items.filter(F.col("rating") >= MIDDLE)
        .groupBy("topic", "scenario_id")
        .agg(F.lit(1).alias("_x"))
        .groupBy("topic")
        .agg(F.count("*").alias("with_imaging"))
    )
    counts = (
        items.filter(F.col("rating") >= HIGH)
        .groupBy("topic", "item")
        .agg(F.count("*").alias("count"), F.min(F.struct("seq", -F.col("rating"), "pos")).alias("first"))
    )
    tops = counts.groupBy("topic").agg(F.max("count").alias("top_count"))
    joined = counts.join(tops, "topic").join(totals, "topic")
    equal = (F.col("count") >= F.col("top_count") * 0.9) | (
        (F.col("count") >= F.col("top_count") * 0.85) & (F.col("count") / F.col("total") >= 0.3)
    )
    marked = joined.withColumn("equal", equal).withColumn("_neg", -F.col("count"))
    equals = (
        marked.filter("equal")
        .groupBy("topic")
        .agg(
            F.array_sort(F.collect_list(F.struct("_neg", "first", "item"))).alias("_e"),
            F.sum("count").alias("covered"),
        )
        .select("topic", "covered", F.transform("_e", lambda e: e["item"]).alias("equivalent"))
    )
    pct = F.bround(F.lit(100) * F.col("count") / F.col("total")).cast("int")
    common = top_k(marked, ["topic"], [F.asc("_neg"), F.asc("first"), F.asc("item")], 8, "_r")
    others = (
        common.filter(~F.col("equal"))
        .withColumn("percentage", pct)
        .filter("percentage >= 10")
        .groupBy("topic")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("_r", "item", "percentage", "count"))), 1, max_alternatives).alias("_a"))
        .select(
            "topic",
            F.transform(
                "_a", lambda a: F.struct(a["item"].alias("name"), a["percentage"].alias("percentage"), a["count"].alias("count"))
            ).alias("alternatives"),
        )
    )
    card = (
        totals.join(region, "topic")
        .join(samples, "topic")
        .join(rated, "topic", "left")
        .join(tops, "topic", "left")
        .join(equals, "topic", "left")
        .join(others, "topic", "left")
    )
    total = F.col("total")
    none_share = (total - F.coalesce("with_imaging", F.lit(0))) / total
    base = F.coalesce(F.col("top_count"), F.lit(0)) / total
    consensus = F.when(
        (F.size("equivalent") > 1) & (F.col("covered") / total >= 0.8), F.greatest(base, F.lit(0.7))
    ).otherwise(base)
    kind = (
        F.when(F.col("_none") > 0.6, "CLINICAL_FIRST")
        .when(F.col("_consensus") >= strong, "STRONG")
        .when(F.col("_consensus") >= moderate, "CONDITIONAL")
        .otherwise("HIGH_VARIANCE")
    )
    shown = F.when(
        F.size("equivalent") > 1,
        F.array_join(F.transform(F.slice("equivalent", 1, 3), lambda p: F.substring(p, 1, 25)), " OR "),
    ).otherwise(F.col("equivalent")[0])
    return (
        card.withColumn("_none", none_share)
        .withColumn("_consensus", consensus)
        .withColumn("card_type", kind)
        .select(
            "topic",
            title_case(F.translate("topic", "_", " ")).alias("display_name"),
            "card_type",
            total.alias("scenario_count"),
            "region",
            F.col("equivalent")[0].alias("primary_name"),
            shown.alias("primary_display"),
            F.coalesce("equivalent", F.array().cast("array<string>")).alias("equivalent"),
            F.coalesce("top_count", F.lit(0)).alias("primary_count"),
            F.bround(F.lit(100) * F.col("_consensus")).cast("int").alias("consensus_pct"),
            F.coalesce("alternatives", F.array().cast("array<struct<name:string,percentage:int,count:bigint>>")).alias(
                "alternatives"
            ),
            F.bround(F.lit(100) * F.col("_none")).cast("int").alias("no_imaging_pct"),
            (
                (F.col("card_type") == "HIGH_VARIANCE")
                | ((F.col("card_type") == "CLINICAL_FIRST") & (F.col("_none") < 0.8))
            ).alias("detailed_search"),
            "sample_scenarios",
        )
    )


def card_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("card_type").agg(F.count("*").alias("n"))


def modality_preference(modality: Column, contrast: Column, table: list = packs.MODALITY_PREFERENCE, other: int = 9) -> Column:
    ladder = F.when(F.lit(False), F.lit(other))
    for name, needs, rank in table:
        hit = F.upper(modality) == name
        ladder = ladder.when(hit if needs is None else hit & (contrast == needs), rank)
    return ladder.otherwise(other)


def best_item(items: DataFrame, table: list = packs.MODALITY_PREFERENCE) -> DataFrame:
    """One item per scenario: rating, then modality preference, then shortest name, then position."""
    keyed = items.select(
        "scenario_id",
        (-F.col("rating")).alias("_r"),
        modality_preference(F.col("modality"), F.col("contrast"), table).alias("_m"),
        F.length("item").alias("_l"),
        "pos",
        "item",
        "modality",
        "contrast",
    )
    best = first_by(keyed, ["scenario_id"], ["_r", "_m", "_l", "pos"], ["item", "modality", "contrast"])
    return best.select(
        "scenario_id", "item", "modality", (-F.col("_r")).alias("rating"), "contrast", (F.col("_r") > -HIGH).alias("no_strong")
    )


def ordered_items(items: DataFrame, priority: Column) -> DataFrame:
    """Full order of every scenario's items by rating, context priority (0 to 100) and position."""
    keyed = items.withColumns({"_rating": -F.col("rating"), "_priority": -priority})
    return full_row_number(keyed, ["scenario_id"], ["_rating", "_priority", "pos"]).drop("_rating", "_priority")


def context_priority(scenario: Column, modality: Column, name: Column, rules: list = packs.CONTEXT_PRIORITIES, otherwise: int = packs.PLAIN_PRIORITY) -> Column:
    """Modality priority that depends on the scenario's wording; larger comes first. The first rule that holds of
    ``(words of the scenario, modalities, words of the name, priority)`` counts; no words hold always."""
    ladder = F.when(F.lit(False), F.lit(None).cast("int"))
    for wording, modalities, words, priority in rules:
        holds = modality.isin(modalities)
        if wording:
            holds = holds & contains_any(F.lower(scenario), wording)
        if words:
            holds = holds & contains_any(F.lower(name), words)
        ladder = ladder.when(holds, priority)
    return ladder.otherwise(otherwise)


def quick_reference(items: DataFrame, pathways: list[tuple[str, list[str]]], k: int = 3) -> DataFrame:
    """(group_id, pathway, modality, item, rating, rank). ``items`` carry ``group_id`` and ``phase``;
    the two best items of each scenario are collected per pathway, made distinct by (modality, item)
    keeping the first, and the ``k`` best rated remain."""
    path = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, phases in pathways:
        path = path.when(F.lower("phase").isin(phases), F.lit(name))
    strong = items.filter((F.col("rating") >= HIGH) & (F.col("item") != "") & (F.col("modality") != ""))
    two = top_k(strong, ["group_id", "scenario_id"], [F.desc("rating"), F.asc("pos")], 2, "_r")
    tagged = two.withColumn("pathway", path).filter("pathway is not null")
    distinct = first_by(tagged, ["group_id", "pathway", "modality", "item"], ["seq", "_r"], ["rating"])
    return top_k(distinct, ["group_id", "pathway"], [F.desc("rating"), F.asc("seq"), F.asc("_r")], k).select(
        "group_id", "pathway", "modality", "item", "rating", "rank"
    )


def mode_of(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Most frequent value per key, the first seen on ties."""
    counted = df.groupBy(key, value).agg((-F.count("*")).alias("_n"), F.min(seq).alias("_f"))
    return first_by(counted, [key], ["_n", "_f"], [value]).select(key, value, (-F.col("_n")).alias("n"))


def title_groups(scenarios: DataFrame, items: DataFrame, title: Column) -> DataFrame:
    """(key, title, variants, mean_items, high_rated): rows whose display title is equal ignoring
    case. ``scenarios(scenario_id, name, seq)``; counts per group, first spelling kept."""
    per = items.groupBy("scenario_id").agg(
        F.count("*").alias("_n"), F.sum((F.col("rating") >= HIGH).cast("long")).alias("_h")
    )
    rows = scenarios.withColumn("title", title).join(per, "scenario_id", "left")
    return rows.groupBy(F.lower("title").alias("key")).agg(
        F.min(F.struct("seq", "title")).getField("title").alias("title"),
        F.min("seq").alias("first_position"),
        F.count("*").alias("variants"),
        F.floor(F.sum(F.coalesce("_n", F.lit(0))) / F.count("*") + 0.5).cast("long").alias("mean_items"),
        F.sum(F.coalesce("_h", F.lit(0))).alias("high_rated"),
    )
