"""Routing of order lines to part names as catalogue entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as ro
from ..operators.routing import RouteRule
from ..session import materialise, table
from .registry import literal, query

BASE = (
    "rq AS (SELECT rid, arg_min(item, (item, scenario)) AS item, arg_min(scenario, (item, scenario)) AS scenario, any_value(scenario_id) "
    "AS scenario_id, any_value(region) AS region, bool_or(nc) AS needs FROM (SELECT l_orderkey * 16 + l_linenumber AS rid, 'MRI ' || "
    "p_name || CASE l_linenumber % 3 WHEN 0 THEN ' without IV contrast' WHEN 1 THEN ' with IV contrast' ELSE ' without and with IV "
    "contrast' END AS item, c_mktsegment || ' ' || o_orderpriority AS scenario, o_custkey AS scenario_id, lower(r_name) AS region, "
    "l_linenumber % 3 <> 0 AS nc FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer "
    "ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY rid), "
    "ca AS (SELECT seq, name, name || ' ' || p_type AS display, CASE p_type WHEN 'STANDARD' THEN 'asia' WHEN 'ECONOMY' THEN 'europe' WHEN "
    "'MEDIUM' THEN 'africa' ELSE 'america' END AS region, lower(p_type) AS section, split_part(name, ' ', 2) AS body_part, "
    "string_split(name, ' ') AS keywords, p_type || ' ' || p_brand AS indications, p_size % 2 = 1 AS uses FROM (SELECT p_name AS name, "
    "min(p_partkey) AS seq FROM part GROUP BY 1) JOIN part ON p_partkey = seq)"
)

RULES = [
    RouteRule(("cold anvil", "absent entry"), item_any=("anvil",), scenario_any=("urgent",)),
    RouteRule(("absent entry",), item_any=("bolt",)),
    RouteRule(("hot bolt", "new bolt"), item_all=("bolt",), item_none=("old",), scenario_none=("low",)),
    RouteRule(("large plate", "red plate"), item_any=("plate",), region="asia", plain_only=True),
    RouteRule(("blue ring",), item_any=("ring", "rod"), scenario_any=("household", "building")),
]
OTHER_RULES = RULES[:3] + [RouteRule(("old rod",), item_any=("rod",), scenario_any=("household",)), *RULES[3:]]


def _has(x, ws):
    return "(" + " OR ".join(f"contains({x}, {literal(w)})" for w in ws) + ")"


def _rule_sql(rules) -> str:
    rows = []
    for i, r in enumerate(rules):
        c = [f"contains(i, {literal(w)})" for w in r.item_all] + [f"NOT contains(i, {literal(w)})" for w in r.item_none]
        c += [f"NOT contains(s, {literal(w)})" for w in r.scenario_none]
        if r.item_any:
            c.append(_has("i", r.item_any))
        if r.scenario_any:
            c.append(_has("s", r.scenario_any))
        if r.region:
            c.append(f"region = {literal(r.region)}")
        names = ", ".join(literal(t) for t in r.targets)
        plain = " AND NOT uses" if r.plain_only else ""
        rows.append(
            f"SELECT rid, {i} AS n, (SELECT arg_min(name, seq) FROM ca WHERE name IN ({names}){plain}) AS entry FROM (SELECT rid, "
            f"lower(item) AS i, lower(scenario) AS s, region FROM rq) WHERE {' AND '.join(c)}"
        )
    return "(SELECT rid, arg_min(entry, n) AS entry FROM (" + " UNION ALL ".join(rows) + ") WHERE entry IS NOT NULL GROUP BY rid)"


MATCHES = (
    "mt AS (SELECT p_name AS entry, o_custkey AS scenario_id, max(l_discount) AS relevance FROM lineitem JOIN part ON p_partkey = "
    "l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), "
    "me AS (SELECT rid, entry FROM rq JOIN mt USING (scenario_id) JOIN ca ON ca.name = entry QUALIFY row_number() OVER (PARTITION BY rid "
    "ORDER BY CAST(needs <> uses AS INTEGER), relevance DESC, seq) = 1)"
)
#: Matches by lines that came back only: without that meaning no request is left for the stages behind them.
RETURNED = MATCHES.replace("GROUP BY ALL", "WHERE l_returnflag = 'R' GROUP BY ALL", 1)
REGION_TERMS = [("asia", ["hot", "red"]), ("europe", ["bolt", "brand#1"]), ("africa", ["medium"])]
IMPORTANT, BODY = ["house", "mach"], ["building", "low"]
TERMS = (
    "tm AS (SELECT rid, region, needs, list_distinct(CASE region " + " ".join(f"WHEN '{r}' THEN {literal(t)}" for r, t in REGION_TERMS)
    + " ELSE [] END || list_filter(regexp_split_to_array(regexp_replace(lower(scenario), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda "
    "w: length(w) > 3 AND (" + " OR ".join(f"contains(w, '{x}')" for x in IMPORTANT) + f" OR w IN ({', '.join(literal(b) for b in BODY)}))) "
    "|| list_filter([regexp_extract(lower(item), 'mri\\s+(\\w+)', 1)], lambda w: w <> '')) AS terms FROM rq)"
)
SCORES = (
    "ut AS (SELECT DISTINCT region, needs, list_sort(terms) AS terms FROM tm), us AS (SELECT ut.region, needs, terms, name AS entry, seq, "
    "CASE WHEN lower(ca.region) = ut.region OR contains(section, ut.region) THEN 15 ELSE 0 END + coalesce(list_sum(list_transform(terms, "
    "lambda t: CASE WHEN contains(lower(name), t) OR contains(lower(display), t) THEN 10 ELSE 0 END + CASE WHEN len(list_filter(keywords, "
    "lambda k: contains(k, t) OR contains(t, k))) > 0 THEN 5 ELSE 0 END + CASE WHEN contains(lower(indications), t) THEN 2 ELSE 0 END)), 0) "
    "+ CASE WHEN needs AND uses THEN 8 WHEN NOT needs AND NOT uses THEN 5 WHEN needs AND NOT uses THEN -3 ELSE 0 END AS score FROM ut, ca), "
    "ub AS (SELECT * FROM us WHERE score >= 5 QUALIFY row_number() OVER (PARTITION BY region, needs, terms ORDER BY score DESC, seq) = 1), "
    "bs AS (SELECT rid, entry, CAST(score AS BIGINT) AS score FROM tm JOIN ub ON tm.region = ub.region AND tm.needs = ub.needs AND "
    "list_sort(tm.terms) = ub.terms)"
)


def requests(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    cust = table(spark, sf, "customer").join(geo, F.col("n_nationkey") == F.col("c_nationkey"))
    o = table(spark, sf, "orders").join(cust, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "o_custkey", "r_name", F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("scenario")
    )
    use = F.col("l_linenumber") % 3
    wording = F.when(use == 0, " without IV contrast").when(use == 1, " with IV contrast").otherwise(" without and with IV contrast")
    rows = (
        li.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
        .join(o, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("rid"), F.concat(F.lit("MRI "), "p_name", wording).alias("item"),
            "scenario", F.col("o_custkey").alias("scenario_id"), F.lower("r_name").alias("region"), (use != 0).alias("n"),
        )
    )
    return rows.groupBy("rid").agg(
        F.min(F.struct("item", "scenario")).alias("f"), F.first("scenario_id").alias("scenario_id"),
        F.first("region").alias("region"), F.max("n").alias("needs_contrast"),
    ).select("rid", "f.item", "f.scenario", "scenario_id", "region", "needs_contrast")


def catalogue(spark, sf):
    p = table(spark, sf, "part")
    one = p.groupBy("p_name").agg(F.min(F.struct("p_partkey", "p_type", "p_brand", "p_size")).alias("f")).select("p_name", "f.*")
    region = F.when(F.col("p_type") == "STANDARD", "asia").when(F.col("p_type") == "ECONOMY", "europe").when(
        F.col("p_type") == "MEDIUM", "africa"
    ).otherwise("america")
    return one.select(
        F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("display"),
        region.alias("region"), F.lower("p_type").alias("section"), F.split("p_name", " ")[1].alias("body_part"),
        F.split("p_name", " ").alias("keywords"), F.concat_ws(" ", "p_type", "p_brand").alias("indications"),
        (F.col("p_size") % 2 == 1).alias("uses_contrast"),
    )


def returned(spark, sf):
    return explicit(spark, sf, table(spark, sf, "lineitem").filter("l_returnflag = 'R'"))


def explicit(spark, sf, lines=None):
    lines = table(spark, sf, "lineitem") if lines is None else lines
    return (
        lines.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("p_name").alias("entry"), F.col("o_custkey").alias("scenario_id"))
        .agg(F.max("l_discount").alias("relevance"))
    )


def with_terms(spark, sf):
    t = ro.search_terms(F.col("scenario"), F.col("item"), F.col("region"), REGION_TERMS, IMPORTANT, BODY)
    return requests(spark, sf).withColumn("terms", t)


@query("route_by_rules", sql=f"WITH {BASE} SELECT * FROM {_rule_sql(RULES)}")
def route_by_rules(spark, sf):
    return ro.route_by_rules(requests(spark, sf), catalogue(spark, sf), RULES)


@query("route_by_explicit_match", sql=f"WITH {BASE}, {MATCHES} SELECT rid, entry FROM me")
def route_by_explicit_match(spark, sf):
    return ro.route_by_matches(requests(spark, sf), explicit(spark, sf), catalogue(spark, sf))


@query("needs_contrast", sql=f"WITH {BASE} SELECT rid, contains(lower(item), 'with iv contrast') OR contains(lower(item), 'with and without') AS "
       "needed FROM rq")
def needs_contrast(spark, sf):
    flag = F.lit(None).cast("int")
    return requests(spark, sf).select("rid", ro.needs_contrast(flag, F.col("item")).alias("needed"))


@query("search_terms", sql=f"WITH {BASE}, {TERMS} SELECT rid, list_sort(terms) AS terms FROM tm")
def search_terms(spark, sf):
    return with_terms(spark, sf).select("rid", F.array_sort("terms").alias("terms"))


@query("route_by_score", sql=f"WITH {BASE}, {TERMS}, {SCORES} SELECT rid, entry, score FROM bs")
def route_by_score(spark, sf):
    return ro.best_scored(with_terms(spark, sf), catalogue(spark, sf))


RESOLVED = (
    f"WITH {BASE}, {RETURNED}, {TERMS}, {SCORES}, rl AS {_rule_sql(RULES)}, re AS (SELECT rid, entry, 'curated' AS match_type, 'rules' AS "
    "stage FROM rl UNION ALL SELECT rid, entry, 'curated', 'explicit' FROM me WHERE rid NOT IN (SELECT rid FROM rl) UNION ALL SELECT rid, "
    "entry, 'suggested', 'scored' FROM bs WHERE rid NOT IN (SELECT rid FROM rl) AND rid NOT IN (SELECT rid FROM me))"
)


@query("resolved_routes", sql=RESOLVED + " SELECT rid, entry, match_type, stage FROM re")
def resolved_routes(spark, sf):
    return ro.resolve(with_terms(spark, sf), catalogue(spark, sf), RULES, returned(spark, sf))


COVER = (
    f"WITH {BASE}, {MATCHES}, rl AS {_rule_sql(RULES)}, dn AS (SELECT rid FROM rl UNION SELECT rid FROM me WHERE entry LIKE 'old%') "
)


def covered(spark, sf):
    r, c = materialise(requests(spark, sf), "requests"), catalogue(spark, sf)
    rules = ro.route_by_rules(r, c, RULES)
    old = ro.route_by_matches(r, explicit(spark, sf), c).filter("entry like 'old%'")
    return r, rules.unionByName(old)


@query(
    "routing_coverage",
    sql=COVER + "SELECT region, item, count(*) AS total, count(dn.rid) AS routed, count(*) - count(dn.rid) AS unrouted, "
    "round(count(dn.rid) / count(*) * 100, 1) AS pct FROM rq LEFT JOIN dn USING (rid) GROUP BY ROLLUP (region, item)",
)
def routing_coverage(spark, sf):
    return ro.routing_coverage(*covered(spark, sf))


@query(
    "route_examples",
    sql=f"WITH {BASE}, rl AS {_rule_sql(RULES)} SELECT item, min(rid) AS rid, arg_min(entry, rid) AS entry, 'rules' AS stage FROM rq JOIN "
    "rl USING (rid) GROUP BY 1",
)
def route_examples(spark, sf):
    r = requests(spark, sf)
    routed = ro.route_by_rules(r, catalogue(spark, sf), RULES).withColumn("stage", F.lit("rules"))
    return ro.route_examples(r, routed)


EXPECTED = [("bolt", ["bolt"]), ("ring", ["ring", "gear"]), ("rod", ["rod"]), ("plate", ["plate"]), ("anvil", ["anvil"])]


@query(
    "route_audit",
    sql=f"WITH {BASE}, rl AS {_rule_sql(RULES)}, one AS (SELECT item, scenario, min(rid) AS rid, arg_min(region, rid) AS region FROM rq "
    "GROUP BY ALL), j AS (SELECT one.*, CASE WHEN entry = 'hot bolt' THEN 'gone' ELSE entry END AS entry FROM one LEFT JOIN rl USING (rid)) "
    "SELECT item, scenario, region, entry, CASE WHEN entry IS NULL THEN 'unrouted' WHEN entry NOT IN (SELECT name FROM ca) THEN 'missing "
    "target' WHEN (" + " OR ".join(f"contains(lower(item), '{p}')" for p, _ in EXPECTED) + ") AND NOT ("
    + " OR ".join(f"(contains(lower(item), '{p}') AND {_has('entry', ws)})" for p, ws in EXPECTED)
    + ") THEN 'mismatch' ELSE 'routed' END AS status FROM j",
)
def route_audit(spark, sf):
    r, c = requests(spark, sf), catalogue(spark, sf)
    routed = ro.route_by_rules(r, c, RULES).withColumn("entry", F.when(F.col("entry") == "hot bolt", "gone").otherwise(F.col("entry")))
    return ro.audit_routes(r, routed, c, EXPECTED)


CONTEXTS = [("urgent", ["urgent", "high"]), ("home", ["household", "furniture"]), ("work", ["machinery", "building"])]
AUDIT = (
    f"{BASE}, {RETURNED}, io AS (SELECT rid, region, item, list_filter([" + ", ".join(
        f"CASE WHEN {_has('lower(scenario)', ws)} THEN '{n}' END" for n, ws in CONTEXTS
    ) + "], lambda x: x IS NOT NULL) AS contexts FROM rq WHERE scenario_id NOT IN (SELECT scenario_id FROM mt) AND NOT (contains(item, "
    "'bolt') AND contains(lower(scenario), 'urgent')))"
)


def audit_issues(spark, sf):
    rule = F.contains("item", F.lit("bolt")) & F.contains(F.lower("scenario"), F.lit("urgent"))
    return ro.coverage_audit(requests(spark, sf), returned(spark, sf), CONTEXTS, rule)


@query("coverage_audit", sql=f"WITH {AUDIT} SELECT rid, region, item, contexts FROM io")
def coverage_audit(spark, sf):
    return audit_issues(spark, sf)


@query(
    "coverage_rollup",
    sql=f"WITH {AUDIT} SELECT dimension, value, count(*) AS n FROM (SELECT 'region' AS dimension, region AS value FROM io UNION ALL SELECT "
    "'kind', CASE WHEN contains(lower(item), 'bolt') OR contains(lower(item), 'rod') THEN 'metal' WHEN contains(lower(item), 'ring') THEN "
    "'round' ELSE 'other' END FROM io UNION ALL SELECT 'context', unnest(contexts) FROM io) GROUP BY ALL",
)
def coverage_rollup(spark, sf):
    return ro.coverage_rollup(audit_issues(spark, sf), [("metal", ["bolt", "rod"]), ("round", ["ring"])])


PARTS = [(r"\bhot bolt\b", "bolt_hot"), (r"\bbolt\b", "bolt"), (r"\b(ring|rod)\b", "ring"), (r"\bplate\b", "late"), (r"\bgizmo\b", "unknown_part")]
COMP = (
    "cm AS (SELECT DISTINCT item, CASE WHEN contains(lower(item), 'without and with') THEN 'both' WHEN contains(lower(item), 'without') THEN "
    "'none' ELSE 'with' END AS contrast, CASE " + " ".join(f"WHEN regexp_matches(lower(item), '{p}') THEN '{v}'" for p, v in PARTS)
    + " END AS body_part FROM rq)"
)


@query("name_components", sql=f"WITH {BASE}, {COMP} SELECT item, 'MRI' AS modality, contrast, body_part FROM cm")
def name_components(spark, sf):
    items = requests(spark, sf).select("item").distinct()
    return items.select("item", ro.name_components(F.col("item"), PARTS).alias("c")).select("item", "c.*")


@query(
    "router",
    sql=f"WITH {BASE}, {COMP}, rg AS (SELECT lower('MRI ' || p_name || ' with IV contrast') AS k, arg_min(p_brand, p_partkey) AS e FROM part "
    "GROUP BY 1), f AS (SELECT item, list(name ORDER BY seq)[1:3] AS entries FROM cm JOIN ca ON "
    "cm.body_part IS NOT NULL AND (contains(ca.body_part, replace(cm.body_part, '_', ' ')) OR contains(replace(cm.body_part, '_', ' '), "
    "ca.body_part)) WHERE name NOT IN ('hot ring', 'old bolt') GROUP BY 1) SELECT cm.item, CASE WHEN k IS NOT NULL THEN 'exact' WHEN "
    "f.entries IS NOT NULL THEN 'component' ELSE 'unmapped' END AS match_type, contrast, body_part, CASE WHEN k IS NOT NULL THEN [e] ELSE "
    "f.entries END AS entries FROM cm LEFT JOIN rg ON lower(item) = k LEFT JOIN f ON f.item = cm.item",
)
def router(spark, sf):
    registry = table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("MRI "), "p_name", F.lit(" with IV contrast")).alias("name"),
        F.array("p_brand").alias("entries"),
    )
    return ro.build_router(requests(spark, sf), registry, catalogue(spark, sf), PARTS, ["hot ring", "old bolt"])


ROUTES_SQL = (
    "rt AS (SELECT 'MRI ' || p_name || ' with IV contrast' AS item, p_partkey AS pos, p_brand AS entry, [p_type, CASE WHEN p_size > 25 THEN "
    "'urgent' ELSE 'machinery' END] AS context, CAST(p_size AS INTEGER) AS priority FROM part)"
)


def routes(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("MRI "), "p_name", F.lit(" with IV contrast")).alias("item"), F.col("p_partkey").alias("pos"),
        F.col("p_brand").alias("entry"),
        F.array("p_type", F.when(F.col("p_size") > 25, "urgent").otherwise("machinery")).alias("context"),
        F.col("p_size").cast("int").alias("priority"),
    )


@query(
    "route_choice",
    sql=f"WITH {BASE}, {ROUTES_SQL}, j AS (SELECT rid, entry, pos, priority, contains(lower(scenario), lower(context[1])) OR "
    "contains(lower(scenario), context[2]) AS hit FROM rq JOIN rt USING (item)) SELECT rid, entry, hit AS by_context FROM j QUALIFY "
    "row_number() OVER (PARTITION BY rid ORDER BY hit DESC, CASE WHEN hit THEN priority ELSE 0 END, pos) = 1",
)
def route_choice(spark, sf):
    return ro.choose_route(requests(spark, sf), routes(spark, sf))


@query(
    "route_supplements",
    sql=f"WITH {BASE}, {ROUTES_SQL} SELECT rid, 'always' AS kind, pos, entry AS reason FROM rq JOIN rt USING (item) WHERE priority > 48 UNION "
    "ALL SELECT rid, 'contextual', pos, entry FROM rq JOIN rt USING (item) WHERE priority < 3 AND (contains(lower(scenario), "
    "lower(context[1])) OR contains(lower(scenario), context[2]))",
)
def route_supplements(spark, sf):
    r = routes(spark, sf)
    always = r.filter("priority > 48").select("item", "pos", F.col("entry").alias("reason"))
    context = r.filter("priority < 3").select("item", "pos", F.col("context").alias("when"), F.col("entry").alias("reason"))
    return ro.supplements(requests(spark, sf), always, context)


@query(
    "match_labels",
    sql=f"WITH {BASE}, ls AS (SELECT body_part, list(name || ' household 1-urgent') AS names FROM ca GROUP BY 1) SELECT rid, CASE WHEN "
    "len(list_filter(names, lambda m: contains(lower(item), left(lower(m), 50)) OR contains(lower(m), left(lower(substr(item, 5, 8)), 50)))) "
    "> 0 THEN 'curated' ELSE 'suggested' END AS label FROM rq LEFT JOIN ls ON body_part = split_part(item, ' ', 3)",
)
def match_labels(spark, sf):
    listed = catalogue(spark, sf).groupBy("body_part").agg(
        F.collect_list(F.concat("name", F.lit(" household 1-urgent"))).alias("names")
    )
    r = requests(spark, sf).withColumn("body_part", F.split("item", " ")[2]).join(listed, "body_part", "left")
    return r.select("rid", ro.match_label(F.substring("item", 5, 8), F.col("names")).alias("label"))


@query("missing_definitions", sql="SELECT DISTINCT p_name || ' ' || p_type AS name FROM part WHERE p_size > 25 EXCEPT SELECT p_name || ' ' || "
       "p_type FROM part WHERE p_size < 3")
def missing_definitions(spark, sf):
    p = table(spark, sf, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_type"))
    return ro.missing_definitions(p.filter("p_size > 25").select("name").distinct(), p.filter("p_size < 3"))


@query(
    "route_differences",
    sql=f"WITH {BASE}, a AS {_rule_sql(RULES)}, b AS {_rule_sql(OTHER_RULES)} SELECT rid, a.entry AS left_entry, b.entry AS right_entry "
    "FROM a FULL JOIN b USING (rid) WHERE a.entry IS DISTINCT FROM b.entry",
)
def route_differences(spark, sf):
    r, c = requests(spark, sf), catalogue(spark, sf)
    return ro.route_differences(ro.route_by_rules(r, c, RULES), ro.route_by_rules(r, c, OTHER_RULES))


@query(
    "route_conflicts",
    sql="SELECT l_orderkey AS rid, l_linenumber AS pos, p_type = 'STANDARD' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS cross_region, o_orderpriority IN "
    "('2-HIGH', '5-LOW') AND l_linenumber % 3 = 0 AND l_linestatus <> 'F' AS contrast_mismatch, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    "JOIN part ON p_partkey = l_partkey",
)
def route_conflicts(spark, sf):
    """Lines as routed items: the priority gives the contexts, the line number the contrast, the part type the region."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")
    )
    urgent, high, low = (F.col("o_orderpriority") == x for x in ("1-URGENT", "2-HIGH", "5-LOW"))
    contexts = F.array_compact(F.array(F.when(urgent | high, "tumor"), F.when(high | low, "infection")))
    item = F.concat("p_name", F.when(F.col("l_linestatus") == "F", " Without and With contrast").otherwise(""))
    rows = li.select(
        F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), contexts.alias("contexts"), item.alias("item"),
        F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("contrast"), "p_type",
    )
    return ro.conflicts(rows, F.col("p_type") == "STANDARD").select("rid", "pos", "cross_region", "contrast_mismatch", "part")
