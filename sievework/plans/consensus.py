"""Consensus over lineitem x part as rated items; customers or orders are the scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import first_alias
from ..operators import consensus
from ..session import table
from .registry import query

# part types read as modalities
MODALITY = [("STANDARD", "MRI"), ("ECONOMY", "CT"), ("MEDIUM", "US"), ("PROMO", "Radiography"), ("LARGE", "PET"), ("SMALL", "Other")]

MODALITY_SQL = "CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MODALITY) + " ELSE p_type END"


def items_sql(scenario: str, item: str) -> str:
    return (
        "o AS (SELECT o_orderkey, o_custkey, o_orderpriority, n_name AS topic, r_name AS region FROM orders JOIN customer ON "
        "c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), "
        f"it AS (SELECT {scenario} AS scenario_id, topic, region, {scenario} AS seq, l_orderkey * 16 + l_linenumber AS pos, "
        f"{item} AS item, {MODALITY_SQL} AS modality, CAST(1 + CAST(l_quantity AS INTEGER) % 9 AS INTEGER) AS rating, "
        "l_linenumber % 3 AS contrast, l_partkey, o_orderpriority, p_name, p_type FROM lineitem JOIN o ON o_orderkey = "
        "l_orderkey JOIN part ON p_partkey = l_partkey), "
        f"sc AS (SELECT DISTINCT {scenario} AS scenario_id, topic, region, {scenario} AS seq, 'Scenario ' || {scenario} AS name "
        "FROM o)"
    )


def orders_with_topic(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    customer = table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return table(spark, sf, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("n_name").alias("topic"), F.col("r_name").alias("region")
    )


def rated_items(spark, sf, scenario="o_custkey", item="p_type"):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    joined = lines.join(orders_with_topic(spark, sf), F.col("o_orderkey") == F.col("l_orderkey")).join(
        part, F.col("p_partkey") == F.col("l_partkey")
    )
    return joined.select(
        F.col(scenario).alias("scenario_id"),
        "topic",
        "region",
        F.col(scenario).alias("seq"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"),
        F.col(item).alias("item"),
        first_alias(F.col("p_type"), MODALITY).alias("modality"),
        (1 + F.col("l_quantity").cast("int") % 9).alias("rating"),
        (F.col("l_linenumber") % 3).alias("contrast"),
        "o_orderpriority",
        "p_name",
        "p_type",
    )


def scenarios(spark, sf, scenario="o_custkey"):
    return (
        orders_with_topic(spark, sf)
        .select(F.col(scenario).alias("scenario_id"), "topic", "region", F.col(scenario).alias("seq"))
        .distinct()
        .withColumn("name", F.concat(F.lit("Scenario "), F.col("scenario_id").cast("string")))
    )


def cards_sql(scenario: str, item: str, eligible: str = "TRUE") -> str:
    return (
        f"WITH {items_sql(scenario, item)}, el AS (SELECT * FROM it WHERE {eligible}), "
        "tot AS (SELECT topic, count(*) AS total FROM sc GROUP BY 1 HAVING count(*) >= 3), "
        "reg AS (SELECT topic, region FROM (SELECT topic, region, count(*) AS n, min(seq) AS f FROM sc GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, f) = 1), "
        "sam AS (SELECT topic, list(left(name, 80) ORDER BY seq) AS sample_scenarios FROM (SELECT * FROM sc QUALIFY row_number() "
        "OVER (PARTITION BY topic ORDER BY seq) <= 3) GROUP BY 1), "
        "img AS (SELECT topic, count(DISTINCT scenario_id) AS wi FROM el WHERE rating >= 5 GROUP BY 1), "
        "cnt AS (SELECT topic, item, count(*) AS c, min((seq, -rating, pos)) AS f FROM el WHERE rating >= 7 GROUP BY ALL), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, f, item) AS r, max(c) OVER (PARTITION BY topic) AS tc "
        "FROM cnt JOIN tot USING (topic)), "
        "mk AS (SELECT *, c >= tc * 0.9 OR (c >= tc * 0.85 AND c / total >= 0.3) AS eq FROM rk), "
        "eqs AS (SELECT topic, list(item ORDER BY r) AS equivalent, sum(c) AS covered, max(tc) AS tc FROM mk WHERE eq GROUP BY 1), "
        "alt AS (SELECT topic, list({'name': item, 'percentage': CAST(round_even(100 * c / total, 0) AS INTEGER), 'count': c} "
        "ORDER BY r)[1:3] AS alternatives FROM mk WHERE r <= 8 AND NOT eq AND round_even(100 * c / total, 0) >= 10 GROUP BY 1), "
        "b AS (SELECT *, (total - coalesce(wi, 0)) / total AS nn, CASE WHEN len(equivalent) > 1 AND covered / total >= 0.8 THEN "
        "greatest(tc / total, 0.7) ELSE coalesce(tc, 0) / total END AS cons FROM tot JOIN reg USING (topic) JOIN sam USING (topic) "
        "LEFT JOIN img USING (topic) LEFT JOIN eqs USING (topic) LEFT JOIN alt USING (topic)), "
        "k AS (SELECT *, CASE WHEN nn > 0.6 THEN 'CLINICAL_FIRST' WHEN cons >= 0.7 THEN 'STRONG' WHEN cons >= 0.4 THEN "
        "'CONDITIONAL' ELSE 'HIGH_VARIANCE' END AS card_type FROM b) "
        "SELECT topic, 'Nation ' || split_part(topic, '_', 2) AS display_name, card_type, total AS scenario_count, region, "
        "equivalent[1] AS primary_name, CASE WHEN len(equivalent) > 1 THEN array_to_string(list_transform(equivalent[1:3], "
        "lambda x: left(x, 25)), ' OR ') ELSE equivalent[1] END AS primary_display, coalesce(equivalent, []) AS equivalent, "
        "coalesce(tc, 0) AS primary_count, CAST(round_even(100 * cons, 0) AS INTEGER) AS consensus_pct, "
        "coalesce(alternatives, []) AS alternatives, CAST(round_even(100 * nn, 0) AS INTEGER) AS no_imaging_pct, "
        "card_type = 'HIGH_VARIANCE' OR (card_type = 'CLINICAL_FIRST' AND nn < 0.8) AS detailed_search, sample_scenarios FROM k"
    )


def _cards(name: str, scenario: str, item: str, eligible: str | None = None):
    @query(name, sql=cards_sql(scenario, item, eligible or "TRUE"))
    def run(spark, sf):
        rows = rated_items(spark, sf, scenario, item)
        if eligible:
            rows = rows.filter(eligible)
        return consensus.consensus_cards(scenarios(spark, sf, scenario), rows)

    return run


_cards("consensus_cards_by_type", "o_custkey", "p_type")
_cards("consensus_cards_by_brand", "o_custkey", "p_brand")
_cards("consensus_cards_by_name", "o_custkey", "p_name")
_cards("consensus_cards_small_only", "o_orderkey", "p_type", "p_type = 'SMALL'")


@query(
    "card_type_counts",
    sql=f"SELECT card_type, count(*) AS n FROM ({cards_sql('o_custkey', 'p_brand')}) GROUP BY 1",
)
def card_type_counts(spark, sf):
    cards = consensus.consensus_cards(scenarios(spark, sf), rated_items(spark, sf, item="p_brand"))
    return consensus.card_counts(cards)


IT = f"WITH {items_sql('o_custkey', 'p_name')}"


@query(
    "item_summary",
    sql=IT + " SELECT scenario_id, CAST(count(*) FILTER (rating >= 7) AS BIGINT) AS n_high, CAST(count(*) FILTER (rating < 7) AS "
    "BIGINT) AS n_middle, max(rating) >= 7 AS has_positive, arg_min(item, (-rating, pos, item)) AS top_item, max(rating) AS "
    "top_rating FROM it WHERE rating >= 5 GROUP BY 1",
)
def item_summary(spark, sf):
    return consensus.item_summary(rated_items(spark, sf, item="p_name"))


@query(
    "rating_bands",
    sql=IT + " SELECT CASE WHEN rating >= 7 THEN 'Usually Appropriate' WHEN rating >= 4 THEN 'May Be Appropriate' ELSE "
    "'Usually Not Appropriate' END AS label, CASE WHEN rating >= 7 THEN 'high' WHEN rating >= 4 THEN 'mid' ELSE 'low' END AS "
    "class, count(*) AS n FROM it GROUP BY ALL",
)
def rating_bands(spark, sf):
    band = consensus.rating_band(F.col("rating"))
    rows = rated_items(spark, sf, item="p_name").select(band.alias("b")).select("b.*")
    return rows.groupBy("label", "class").agg(F.count("*").alias("n"))


PREF = (
    "CASE WHEN upper(modality) = 'US' THEN 0 WHEN upper(modality) = 'MRI' AND contrast = 0 THEN 1 WHEN upper(modality) = 'CT' AND "
    "contrast = 0 THEN 2 WHEN upper(modality) = 'MRI' THEN 3 WHEN upper(modality) = 'CT' THEN 4 WHEN upper(modality) = "
    "'RADIOGRAPHY' THEN 5 ELSE 9 END"
)


@query(
    "best_item",
    sql=IT + f" SELECT scenario_id, item, modality, rating, contrast, rating < 7 AS no_strong FROM it QUALIFY row_number() OVER "
    f"(PARTITION BY scenario_id ORDER BY rating DESC, {PREF}, length(item), pos, item, modality, contrast) = 1",
)
def best_item(spark, sf):
    return consensus.best_item(rated_items(spark, sf, item="p_name"))


@query(
    "context_ordered_items",
    sql=IT + ", g AS (SELECT scenario_id, pos, o_orderpriority, max(rating) AS rating, "
    "min(modality) AS modality FROM it GROUP BY ALL), p AS (SELECT scenario_id, pos, rating, modality, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE modality WHEN 'CT' "
    "THEN 90 WHEN 'Radiography' THEN 85 WHEN 'MRI' THEN 70 WHEN 'US' THEN 40 ELSE 30 END ELSE CASE modality WHEN 'MRI' THEN 60 "
    "WHEN 'CT' THEN 55 WHEN 'US' THEN 40 WHEN 'Radiography' THEN 35 ELSE 30 END END AS priority FROM g) "
    "SELECT scenario_id, pos, rating, modality, priority, row_number() OVER (PARTITION BY scenario_id ORDER BY rating DESC, "
    "priority DESC, pos) AS rank FROM p",
)
def context_ordered_items(spark, sf):
    # a position can repeat in the test table: its best rating stands for it
    items = (
        rated_items(spark, sf, item="p_name")
        .groupBy("scenario_id", "pos", "o_orderpriority")
        .agg(F.max("rating").alias("rating"), F.min("modality").alias("modality"))
    )
    wording = F.when(F.col("o_orderpriority") == "1-URGENT", "trauma, urgent").otherwise("routine")
    priority = consensus.context_priority(wording, F.col("modality"), F.lit("plain"))
    rows = items.select("scenario_id", "pos", "rating", "modality", priority.alias("priority"))
    return consensus.ordered_items(rows, F.col("priority"))


@query(
    "quick_reference",
    sql=IT + ", s AS (SELECT *, split_part(o_orderpriority, '-', 2) AS phase FROM it WHERE rating >= 7), "
    "two AS (SELECT *, row_number() OVER (PARTITION BY topic, scenario_id ORDER BY rating DESC, pos) AS r FROM s QUALIFY r <= 2), "
    "tg AS (SELECT *, CASE WHEN phase IN ('URGENT', 'HIGH', 'MEDIUM') THEN 'acute' WHEN phase IN ('LOW', 'NOT SPECIFIED') THEN "
    "'followup' END AS pathway FROM two), d AS (SELECT * FROM tg WHERE pathway IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "
    "topic, pathway, modality, item ORDER BY seq, r) = 1) SELECT topic AS group_id, pathway, modality, item, rating, CAST(rank AS "
    "INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic, pathway ORDER BY rating DESC, seq, r) AS rank FROM d) "
    "WHERE rank <= 3",
)
def quick_reference(spark, sf):
    items = (
        rated_items(spark, sf, item="p_name")
        .withColumn("phase", F.split("o_orderpriority", "-")[1])
        .withColumn("group_id", F.col("topic"))
    )
    return consensus.quick_reference(
        items, [("acute", ["urgent", "high", "medium"]), ("followup", ["low", "not specified"])]
    )


@query(
    "primary_region",
    sql=IT + ", c AS (SELECT item, region, count(*) AS n, min(pos) AS f FROM it GROUP BY ALL) SELECT item, region, n FROM c QUALIFY "
    "row_number() OVER (PARTITION BY item ORDER BY n DESC, f) = 1",
)
def primary_region(spark, sf):
    return consensus.mode_of(rated_items(spark, sf, item="p_name"), "item", "region", "pos")


# an item's full name says what it shows, whatever its modality is called
NAMED = "CASE l_linenumber % 4 WHEN 0 THEN 'MR ' || p_name WHEN 1 THEN 'CTA ' || p_name WHEN 2 THEN 'X-ray ' || p_name ELSE p_name END"
ELIGIBLE = (
    "(modality IN ('CT', 'MRI', 'US', 'XR', 'PET', 'NM', 'Mammo', 'Fluoro') OR regexp_matches(lower(item), 'cta|mra|mrv|ctv|angiograph|venograph|radiograph|"
    "x-ray|xray'))"
)


def named_items(spark, sf, scenario="o_custkey"):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("MR ", "CTA ", "X-ray ", "")]), ((F.col("pos") % 16) % 4 + 1).cast("int"))
    return rated_items(spark, sf, scenario, "p_name").withColumn("item", F.concat(lead, "p_name"))


@query("consensus_cards_imaging", sql=cards_sql("o_custkey", NAMED, ELIGIBLE))
def consensus_cards_imaging(spark, sf):
    """Cards of the items that are imaging by modality or by name."""
    rows = named_items(spark, sf).filter(consensus.is_imaging(F.col("modality"), F.col("item")))
    return consensus.consensus_cards(scenarios(spark, sf), rows)


@query(
    "rated_lists",
    sql=f"WITH {items_sql('o_custkey', NAMED)} SELECT scenario_id, CASE WHEN rating >= 7 THEN 'high' ELSE 'middle' END AS band, row_number() OVER (PARTITION BY "
    "scenario_id, rating >= 7 ORDER BY rating DESC, pos, item) AS rank, item, rating FROM it WHERE rating >= 5 AND (modality = 'MRI' OR contains(upper(item), "
    "'MRI') OR contains(upper(item), 'MR ') OR contains(upper(item), 'MRCP'))",
)
def rated_lists(spark, sf):
    """The magnetic resonance items of a scenario, by modality or name, in two lists."""
    rows = named_items(spark, sf).filter(consensus.is_named_mri(F.col("modality"), F.col("item")))
    return consensus.rated_lists(rows)


@query(
    "title_groups",
    sql=f"WITH {items_sql('o_orderkey', 'p_name')}, p AS (SELECT scenario_id, count(*) AS n, count(*) FILTER (rating >= 7) AS h FROM it GROUP BY 1), r AS (SELECT "
    "seq, CASE WHEN seq % 2 = 0 THEN upper(topic) ELSE topic END AS title, coalesce(n, 0) AS n, coalesce(h, 0) AS h FROM sc LEFT JOIN p USING (scenario_id)) "
    "SELECT lower(title) AS key, arg_min(title, seq) AS title, min(seq) AS first_position, count(*) AS variants, CAST(floor(sum(n) / count(*) + 0.5) AS BIGINT) "
    "AS mean_items, CAST(sum(h) AS BIGINT) AS high_rated FROM r GROUP BY 1",
)
def title_groups(spark, sf):
    title = F.when(F.col("seq") % 2 == 0, F.upper("topic")).otherwise(F.col("topic"))
    return consensus.title_groups(scenarios(spark, sf, "o_orderkey"), rated_items(spark, sf, "o_orderkey", "p_name"), title)
