"""Catalogue jobs: parts are entries or step types, order lines their steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalogue as ca
from ..session import table
from .registry import query, values_sql
from .routing import BASE, catalogue, requests
from .texts import SLUG

CAT = BASE[BASE.index("ca AS (") :]
STEPS = (
    "st AS (SELECT l_orderkey AS entry, l_linenumber AS pos, min(p_name) AS name, CAST(max(l_quantity) AS INTEGER) AS seconds, "
    "bool_or(l_returnflag = 'R') AS is_post FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"
)


def steps(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return li.groupBy(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("pos")).agg(
        F.min("p_name").alias("name"), F.max("l_quantity").cast("int").alias("seconds"), F.max(F.col("l_returnflag") == "R").alias("is_post")
    )


@query("faceted_catalogue", sql=f"WITH {CAT} SELECT seq, name FROM ca WHERE region = 'america' AND uses AND (contains(lower(name), 'bolt') OR "
       "contains(lower(display), 'bolt') OR contains(array_to_string(keywords, ' '), 'bolt') OR contains(lower(indications), 'bolt'))")
def faceted_catalogue(spark, sf):
    return ca.faceted(catalogue(spark, sf), "america", "with", "Bolt").select("seq", "name")


TYPES = (
    "ty AS (SELECT p_partkey AS id, CASE p_type WHEN 'STANDARD' THEN 'T2 ' WHEN 'ECONOMY' THEN 'STIR' WHEN 'MEDIUM' THEN 'T1 ' ELSE 'DWI' END || "
    "CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN p_name ELSE '' END AS name, p_size % 2 = 1 AS is_post, [p_brand, p_type] AS regions, p_name AS "
    "purpose FROM part)"
)


@query("step_types", sql=f"WITH {TYPES} SELECT id, name FROM ty WHERE (contains(lower(name), 'r') OR contains(lower(purpose), 'r')) AND "
       "(starts_with(lower(name), 't2') OR lower(name) IN ('flair', 'stir') OR contains(lower(name), 'haste')) AND NOT is_post AND "
       "list_contains(regions, 'Brand#7')")
def step_types(spark, sf):
    p = table(spark, sf, "part")
    lead = F.when(F.col("p_type") == "STANDARD", "T2 ").when(F.col("p_type") == "ECONOMY", "STIR").when(F.col("p_type") == "MEDIUM", "T1 ").otherwise("DWI")
    types = p.select(
        F.col("p_partkey").alias("id"), F.concat(lead, F.when(F.col("p_type").isin("STANDARD", "MEDIUM"), F.col("p_name")).otherwise("")).alias("name"),
        (F.col("p_size") % 2 == 1).alias("is_post"), F.array("p_brand", "p_type").alias("regions"), F.col("p_name").alias("purpose"),
    ).withColumn("display", F.col("name"))
    return ca.step_types(types, "R", "T2", True, "Brand#7").select("id", "name")


@query(
    "validated_rows",
    sql="SELECT p_partkey AS id, NOT (p_type = 'SMALL' AND p_size > 25) AS ok, list_filter([CASE WHEN p_size > 45 THEN 'name is required' END, CASE "
    "WHEN p_type = 'PROMO' THEN 'region is required' END, CASE WHEN p_size % 5 = 0 THEN 'at least one step is required' END], lambda x: x IS NOT "
    "NULL) AS errors, CASE WHEN p_type = 'LARGE' THEN 'suggested' ELSE 'verified' END AS provenance FROM part",
)
def validated_rows(spark, sf):
    p = table(spark, sf, "part")
    modality = F.when(F.col("p_type") == "SMALL", "Other").otherwise(F.col("p_type"))
    short = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_brand"))
    name = F.when(F.col("p_size") > 45, "  ").otherwise(F.col("p_name"))
    region = F.when(F.col("p_type") != "PROMO", F.col("p_brand"))
    source = F.when(F.col("p_type") == "LARGE", "ai_generated")
    return p.select(
        F.col("p_partkey").alias("id"), ca.well_formed(F.col("p_name"), short, modality).alias("ok"),
        ca.validation_errors(name, region, F.col("p_size") % 5).alias("errors"), ca.provenance(F.coalesce(source, F.lit(""))).alias("provenance"),
    )


@query(
    "tag_suggestions",
    sql="WITH ty AS (SELECT o_orderkey AS rid, CASE o_orderstatus WHEN 'F' THEN 'lt' WHEN 'O' THEN 'ol' ELSE 'w g' END AS q FROM orders), "
    "tg AS (SELECT min(p_partkey) AS seq, p_name AS tag FROM part GROUP BY 2), sl AS (SELECT DISTINCT l_orderkey AS rid, p_name AS tag FROM lineitem "
    "JOIN part ON p_partkey = l_partkey) SELECT rid, tag, CAST(row_number() OVER (PARTITION BY rid ORDER BY seq) AS INTEGER) AS "
    "rank FROM ty JOIN tg ON contains(tag, q) WHERE (rid, tag) NOT IN (SELECT rid, tag FROM sl) QUALIFY rank <= 8",
)
def tag_suggestions(spark, sf):
    n = F.col("o_orderstatus")
    typed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), F.when(n == "F", "LT").when(n == "O", "ol").otherwise("w g").alias("q"))
    part = table(spark, sf, "part")
    tags = part.groupBy(F.col("p_name").alias("tag")).agg(F.min("p_partkey").alias("seq"))
    chosen = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    return ca.tag_suggestions(typed, tags, chosen.select(F.col("l_orderkey").alias("rid"), F.col("p_name").alias("tag")).distinct())


@query("related_entries", sql=f"WITH {CAT} SELECT a.name, b.name AS related, CAST(row_number() OVER (PARTITION BY a.name ORDER BY b.seq) AS INTEGER) AS "
       "rank FROM ca a JOIN ca b ON a.region = b.region AND a.name <> b.name QUALIFY rank <= 4")
def related_entries(spark, sf):
    return ca.related(catalogue(spark, sf))


@query(
    "expanded_templates",
    sql="WITH t AS (SELECT l_orderkey AS template, {'line': l_linenumber, 'part': l_partkey} AS pos, p_name AS type_id, l_linestatus AS plane FROM lineitem JOIN "
    "part ON p_partkey = l_partkey), lib AS (SELECT p_name AS type_id, arg_min(p_brand, p_partkey) AS name, arg_min(p_size, p_partkey) AS seconds FROM part "
    "WHERE p_type = 'SMALL' GROUP BY 1), k AS (SELECT template, type_id || '_' || plane AS step_id, min(pos) AS pos, any_value(plane || ' ' || name) AS name, "
    "any_value(seconds) AS seconds FROM t JOIN lib USING (type_id) GROUP BY ALL) SELECT template, row_number() OVER (PARTITION BY template ORDER BY pos, step_id) - 1 "
    "AS sort_order, step_id, name, seconds, FALSE AS is_post FROM k",
)
def expanded_templates(spark, sf):
    part = table(spark, sf, "part")
    t = table(spark, sf, "lineitem").join(part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("template"), F.struct("l_linenumber", "l_partkey").alias("pos"),
        F.col("p_name").alias("type_id"), F.col("l_linestatus").alias("plane"),
    )
    lib = part.filter("p_type = 'SMALL'").groupBy(F.col("p_name").alias("type_id")).agg(F.min(F.struct("p_partkey", "p_brand", "p_size")).alias("f"))
    lib = lib.select("type_id", F.col("f.p_brand").alias("name"), F.col("f.p_size").alias("seconds"), F.lit(False).alias("is_post"))
    return ca.expand_templates(t, lib)


@query(
    "evidence",
    sql=f"WITH {BASE}, mt AS (SELECT p_name AS entry, o_custkey AS id, max(l_discount) AS relevance FROM lineitem JOIN part ON p_partkey = l_partkey JOIN "
    "orders ON o_orderkey = l_orderkey GROUP BY ALL), "
    "ls AS (SELECT entry, id, CAST(relevance AS DOUBLE) AS score, 1 AS tier, id AS o FROM mt QUALIFY row_number() OVER (PARTITION BY entry ORDER BY id) "
    "<= 5), sh AS (SELECT name AS entry FROM ca LEFT JOIN ls ON name = entry GROUP BY 1 HAVING count(ls.id) < 3), "
    "h AS (SELECT name AS entry, scenario_id AS id, count(DISTINCT rid) AS n FROM rq JOIN ca ON ca.region = rq.region AND name = split_part(item, ' ', 2) || ' ' || split_part(item, ' ', 3) GROUP BY "
    "ALL), ex AS (SELECT entry, id, n * 10.0 AS score, 2 AS tier, id AS o FROM h WHERE entry IN (SELECT entry FROM sh) AND (entry, id) NOT IN (SELECT "
    "entry, id FROM ls)) SELECT entry, id, CAST(score AS DOUBLE) AS score, tier, CAST(row_number() OVER (PARTITION BY entry ORDER BY tier, o) AS INTEGER) "
    "AS rank FROM (SELECT * FROM ls UNION ALL SELECT * FROM ex) QUALIFY rank <= 5",
)
def evidence(spark, sf):
    c, r = catalogue(spark, sf), requests(spark, sf)
    m = (
        table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("p_name").alias("entry"), F.col("o_custkey").alias("id")).agg(F.max("l_discount").alias("relevance"))
        .withColumn("pos", F.col("id"))
    )
    named = r.withColumn("name", F.concat_ws(" ", F.split("item", " ")[1], F.split("item", " ")[2]))
    hits = named.join(c.select("name", "region"), ["name", "region"]).groupBy(F.col("name").alias("entry"), F.col("scenario_id").alias("id")).agg(
        F.count("*").alias("n_hits")
    )
    scenarios = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    return ca.evidence(c.select(F.col("name").alias("entry")), m, scenarios, hits)


@query("two_key_index", sql=f"WITH {CAT}, k AS (SELECT seq, 0 AS o, lower(section) AS key, section AS topic FROM ca UNION ALL SELECT seq, 1, lower(name), "
       "section FROM ca) SELECT key, arg_max(topic, (seq, o)) AS topic FROM k GROUP BY 1")
def two_key_index(spark, sf):
    return ca.two_key_index(catalogue(spark, sf).select("seq", F.col("section").alias("topic"), F.col("name").alias("display")))


@query("region_group_counts", sql="SELECT region, n, CAST(list_position(['asia','europe','america','other'], region) AS INTEGER) AS position FROM (SELECT "
       "lower(coalesce(CASE WHEN c_acctbal >= 0 THEN r_name END, 'other')) AS region, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey "
       "JOIN region ON r_regionkey = n_regionkey GROUP BY 1) WHERE region IN ('asia','europe','america','other')")
def region_group_counts(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(
        table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    rows = c.select(F.when(F.col("c_acctbal") >= 0, F.col("r_name")).alias("region"))
    return ca.region_counts(rows, ["asia", "europe", "america", "other"])


@query("step_statistics", sql=f"WITH {STEPS} SELECT entry, count(*) AS total_steps, CAST(count(*) FILTER (NOT is_post) AS BIGINT) AS pre_count, "
       "CAST(count(*) FILTER (is_post) AS BIGINT) AS post_count, CAST(coalesce(sum(seconds) FILTER (NOT is_post), 0) AS BIGINT) AS pre_seconds, "
       "CAST(coalesce(sum(seconds) FILTER (is_post), 0) AS BIGINT) AS post_seconds, CAST(sum(seconds) AS BIGINT) AS total_seconds FROM st GROUP BY 1")
def step_statistics(spark, sf):
    return ca.step_statistics(steps(spark, sf))




@query("scoped_time", sql=f"WITH {STEPS} SELECT entry, CAST(floor(sum(seconds) * greatest(1.0, any_value(CASE o_orderpriority WHEN '1-URGENT' THEN 1.4 WHEN "
       "'2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 1.25 ELSE 1.0 END))::DOUBLE + 0.5) AS BIGINT) AS seconds FROM st JOIN orders ON o_orderkey = entry GROUP BY 1")
def scoped_time(spark, sf):
    o = table(spark, sf, "orders")
    tags = o.select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("tag"))
    rate = F.when(F.col("tag") == "1-urgent", 1.4).when(F.col("tag") == "2-high", 0.7).when(F.col("tag") == "3-medium", 1.25)
    multipliers = o.select(F.lower("o_orderpriority").alias("tag")).distinct().withColumn("multiplier", rate).filter("multiplier is not null")
    st = steps(spark, sf).join(o.select(F.col("o_orderkey").alias("entry")), "entry", "left_semi")
    return ca.scoped_time(st, tags, multipliers)


@query("estimated_minutes", sql=f"WITH {STEPS}, g AS (SELECT entry, sum(CASE WHEN is_post THEN 4 ELSE 3 END) AS g FROM st GROUP BY 1), s AS (SELECT o_orderkey "
       "AS entry, CASE o_orderstatus WHEN 'F' THEN 25 WHEN 'P' THEN 0 END AS m FROM orders) SELECT entry, CASE WHEN coalesce(nullif(m, 0), g, 0) > 0 THEN '~' || "
       "CAST(coalesce(nullif(m, 0), g) AS BIGINT) || ' min' ELSE 'N/A' END AS text FROM s FULL JOIN g USING (entry)")
def estimated_minutes(spark, sf):
    m = F.when(F.col("o_orderstatus") == "F", 25).when(F.col("o_orderstatus") == "P", 0)
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), m.alias("minutes"))
    return ca.estimated_minutes(steps(spark, sf), stored)


@query("first_seen_regions", sql=f"WITH {BASE}, f AS (SELECT item, region, min(rid) AS s FROM rq GROUP BY ALL) SELECT item, list(region ORDER BY s) AS regions "
       "FROM f GROUP BY 1")
def first_seen_regions(spark, sf):
    return ca.first_seen_regions(requests(spark, sf), "item", "rid")




@query("nested_recommendations", sql="SELECT l_orderkey AS id, l_linestatus AS variant, p_name AS procedure, CAST(l_quantity AS INTEGER) % 10 AS rating FROM "
       "lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber < 4 AND CAST(l_quantity AS INTEGER) % 10 >= 7 AND l_linestatus < 'P'")
def nested_recommendations(spark, sf):
    """Orders as nested documents: line states are the variants, lines the ratings."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    rating = F.struct(
        F.when(F.col("l_linenumber") < 4, "MRI").otherwise("CT").alias("modality"), (F.col("l_quantity").cast("int") % 10).alias("rating"),
        F.col("p_name").alias("name"),
    )
    variants = li.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(rating).alias("ratings"))
    docs = variants.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linestatus").alias("name"), "ratings"))).alias("variants")
    )
    return ca.nested_recommendations(docs)


@query("flattened_sections", sql="SELECT doc_id AS id, 'pearls' AS section, CAST(i - 1 AS INTEGER) AS pos, md5(p[i]) AS text FROM (SELECT doc_id, p, "
       "unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) UNION ALL SELECT doc_id, 'flags', "
       "CAST(i - 1 AS INTEGER), md5(p[i]) FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, "
       "','), lambda x: length(x) > 40) AS p FROM documents))")
def flattened_sections(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.split("text", "\n").alias("pearls"), F.filter(F.split("text", ","), lambda x: F.length(x) > 40).alias("flags")
    )
    return ca.flatten_sections(d, "id", ["pearls", "flags"]).withColumn("text", F.md5("text"))


@query("first_marker", sql=f"WITH {STEPS} SELECT entry, pos, is_post, coalesce(pos = min(pos) FILTER (is_post) OVER (PARTITION BY entry), FALSE) AS "
       "marker_before FROM st")
def first_marker(spark, sf):
    return ca.first_marker(steps(spark, sf))


@query("renumbered_steps", sql=f"WITH {STEPS} SELECT entry, pos, row_number() OVER (PARTITION BY entry ORDER BY pos) - 1 AS sort_order FROM st WHERE seconds > 10")
def renumbered_steps(spark, sf):
    return ca.renumber(steps(spark, sf).filter("seconds > 10").select("entry", "pos"), "entry", "pos")


@query("latest_entries", sql="SELECT o_custkey AS owner, o_orderkey AS entry, o_orderdate AS updated_at, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY "
       "o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 5")
def latest_entries(spark, sf):
    from ..operators.ranking import top_k

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("updated_at"))
    return top_k(o, ["owner"], [F.desc("updated_at"), F.asc("entry")], 5)


ENVELOPE = "'{\"version\":\"1.0.0\",\"exported_at\":\"2024-01-01T00:00:00Z\",\"source\":\"builder\",\"protocol\":{\"name\":\"' || p_name || '\",\"body_region\":\"' || p_brand || '\",\"total_time_seconds\":' || p_size || '}}'"


@query("exported_envelopes", sql=f"SELECT {ENVELOPE} AS json FROM part")
def exported_envelopes(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_name").alias("name"), F.col("p_brand").alias("body_region"), F.col("p_size").cast("long").alias("total_time_seconds")
    )
    return ca.export_envelope(p, "1.0.0", "builder", F.lit("2024-01-01T00:00:00Z"), ["name", "body_region", "total_time_seconds"])


@query("imported_records", sql="SELECT p_partkey AS id, 0 AS pos, p_name AS name, p_name AS display_name, p_brand AS body_region, FALSE AS uses_contrast, '' AS "
       "notes, '' AS indications, CAST(p_size AS BIGINT) AS total_time_seconds FROM part WHERE p_size < 40")
def imported_records(spark, sf):
    """Exported envelopes read back; a part of them is cut short and must be rejected."""
    p = table(spark, sf, "part")
    body = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("body_region"), F.col("p_size").cast("long").alias("total_time_seconds"))
    whole = F.to_json(F.struct(F.lit("1.0.0").alias("version"), body.alias("protocol")))
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 40, whole).otherwise(F.substring(whole, 1, 30)).alias("json"))
    return ca.import_envelopes(rows, "json")


@query("text_records", sql=f"WITH {STEPS}, s AS (SELECT entry, pos, name, is_post, row_number() OVER (PARTITION BY entry ORDER BY pos) AS n FROM st) SELECT entry, "
       "'Protocol: ' || entry || chr(10) || 'Contrast: ' || CASE WHEN bool_or(is_post) THEN 'Yes' ELSE 'No' END || chr(10) || chr(10) || 'Sequences:' || chr(10) "
       "|| string_agg(n || '. ' || name || CASE WHEN is_post THEN ' (post-contrast)' ELSE '' END, chr(10) ORDER BY n) AS body FROM s GROUP BY 1")
def text_records(spark, sf):
    st = steps(spark, sf).withColumn("entry", F.col("entry").cast("string"))
    entries = st.groupBy("entry").agg(F.max("is_post").alias("uses_contrast")).withColumn("display", F.lit(""))
    out = ca.text_records(entries, st)
    return out.withColumn("entry", F.col("entry").cast("long"))


@query(
    "page_records",
    sql=f"WITH {STEPS}, m AS (SELECT l_orderkey AS entry, l_shipdate, l_discount AS relevance, {{'line': l_linenumber, 'part': l_partkey}} AS pos, 'case ' || l_suppkey AS "
    "scenario FROM lineitem), b AS (SELECT entry, list(scenario ORDER BY r) AS scenarios FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY relevance "
    "DESC, pos, scenario) AS r FROM m QUALIFY r <= 5) GROUP BY 1), s AS (SELECT entry, list(name || '|' || CASE WHEN is_post THEN 'Post-contrast' ELSE "
    "'Pre-contrast' END ORDER BY pos) AS steps FROM st GROUP BY 1) SELECT o_orderkey AS entry, 'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'P' THEN "
    "'Order ' || o_orderkey || ' MRI protocol sequences and clinical indications.' ELSE 'for ' || o_orderpriority END AS meta, o_orderstatus IN ('F', 'O') AS "
    "region_link, steps, scenarios FROM orders LEFT JOIN s ON s.entry = o_orderkey LEFT JOIN b ON b.entry = o_orderkey",
)
def page_records(spark, sf):
    status = F.col("o_orderstatus")
    tagged = F.concat(F.lit("<p>for <b>"), "o_orderpriority", F.lit("</b></p>"))
    entries = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry"), F.concat_ws(" ", F.lit("Order"), "o_orderkey").alias("title"),
        F.when(status != "P", tagged).alias("indications"), status.alias("region"),
    )
    li = table(spark, sf, "lineitem")
    m = li.select(
        F.col("l_orderkey").alias("entry"), F.col("l_discount").alias("relevance"),
        F.struct("l_linenumber", "l_partkey", F.concat_ws(" ", F.lit("case"), "l_suppkey").alias("s")).alias("pos"),
        F.concat_ws(" ", F.lit("case"), "l_suppkey").alias("scenario"),
    )
    return ca.page_records(entries, steps(spark, sf), m, ["F", "O"])


def slug_rows(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("seq"), tx.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("base"), tx.slugify(F.col("p_brand")).alias("disc")
    )


SLUG_SQL = (
    f"b AS (SELECT p_partkey AS seq, {SLUG.format(x="p_name || ' ' || p_type")} AS base, {SLUG.format(x='p_brand')} AS disc FROM part), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS rb FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY base, disc, rb > 1 "
    "ORDER BY seq) AS rd FROM r), sl AS (SELECT seq, CASE WHEN rb = 1 THEN base WHEN rd = 1 THEN base || '-' || disc ELSE base || '-' || disc || '-' || rd "
    "END AS slug FROM q)"
)


@query("unique_slugs", sql=f"WITH {SLUG_SQL} SELECT seq, slug FROM sl")
def unique_slugs(spark, sf):
    return ca.unique_slugs(slug_rows(spark, sf)).select("seq", "slug")


FIXED_PAGES = [
    ("/", "1.0", "weekly"), ("/about/", "0.5", "monthly"), ("/privacy-policy.html", "0.3", "yearly"), ("/regions/asia/", "0.8", "monthly"),
    ("/regions/europe/", "0.8", "monthly"),
]


@query("url_list", sql=f"WITH {SLUG_SQL}, " + values_sql("fixed", "loc, priority, changefreq", FIXED_PAGES) + " SELECT '/protocols/' || slug || '/' AS loc, "
       "'0.7' AS priority, 'monthly' AS changefreq FROM sl UNION ALL SELECT * FROM fixed")
def url_list(spark, sf):
    return ca.url_list(ca.unique_slugs(slug_rows(spark, sf)), FIXED_PAGES, ("/protocols/%s/", "0.7", "monthly"))


@query("cached_labels", sql="WITH c AS (SELECT DISTINCT left(md5(text), 16) AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT doc_id AS id, "
       "CASE WHEN key IS NOT NULL THEN 'screening' WHEN length(text) > 2000 THEN 'surveillance' ELSE 'initial' END AS value, CASE WHEN key IS NOT NULL THEN 'cache' "
       "WHEN length(text) > 2000 THEN 'scored' ELSE 'default' END AS origin FROM documents LEFT JOIN c ON key = left(md5(text), 16)")
def cached_labels(spark, sf):
    from ..operators.texts import with_cache

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    cache = d.join(good, "id", "left_semi").select(tx.cache_key(F.col("text")).alias("key"), F.lit("screening").alias("value")).distinct()
    scored = d.filter(F.length("text") > 2000).select("id", F.lit("surveillance").alias("value"))
    return with_cache(d, cache, scored, "text", "initial").select("id", "value", "origin")
