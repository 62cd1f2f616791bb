"""Routing of requests to catalogue entries: rule cascade, explicit matches, scored fallback, audits.

``requests(rid, item, scenario_id, scenario, region)``; ``catalogue(seq, name, display, region, section,
body_part, keywords, indications, uses_contrast)``. Catalogues and rule lists are small by nature, but
only literal rule lists are assumed so; catalogue joins leave the strategy to the planner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.rules import matches
from ..functions.text import contains_all, contains_any
from ..session import materialise
from .containment import phrase_pairs
from .ranking import first_by, top_k


@dataclass(frozen=True)
class RouteRule:
    """A target list ("A or B": the first in the catalogue) and its substring conditions."""

    targets: tuple[str, ...]
    item_all: tuple[str, ...] = ()
    item_any: tuple[str, ...] = ()
    item_none: tuple[str, ...] = ()
    scenario_any: tuple[str, ...] = ()
    scenario_none: tuple[str, ...] = ()
    region: str | None = None
    plain_only: bool = False

    def condition(self, item: Column, scenario: Column, region: Column) -> Column:
        c = contains_all(item, list(self.item_all)) & ~contains_any(item, list(self.item_none))
        c = c & ~contains_any(scenario, list(self.scenario_none))
        if self.item_any:
            c = c & contains_any(item, list(self.item_any))
        if self.scenario_any:
            c = c & contains_any(scenario, list(self.scenario_any))
        if self.region:
            c = c & (region == self.region)
        return c


def live_targets(rules: list[RouteRule], catalogue: DataFrame) -> list[tuple[RouteRule, str]]:
    """Rules whose target exists, with the entry they lead to. At most one catalogue row per literal
    target name comes to the driver."""
    names = sorted({t for r in rules for t in r.targets})
    known = first_by(
        catalogue.filter(F.col("name").isin(names)), ["name", "uses_contrast"], ["seq"], []
    ).collect()
    found = []
    for r in rules:
        fits = [(k.seq, k.name) for k in known if k.name in r.targets and not (r.plain_only and k.uses_contrast)]
        if fits:
            found.append((r, min(fits)[1]))
    return found


def route_by_rules(requests: DataFrame, catalogue: DataFrame, rules: list[RouteRule]) -> DataFrame:
    """(rid, entry): first rule that holds and whose target exists; a rule without target is passed over.
    The ladder is evaluated once per distinct (item, scenario, region)."""
    item, scenario, region = (F.coalesce(c, F.lit("")) for c in (F.lower("item"), F.lower("scenario"), F.col("region")))
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule, entry in live_targets(rules, catalogue):
        ladder = ladder.when(rule.condition(item, scenario, region), F.lit(entry))
    keys = ["item", "scenario", "region"]
    routed = requests.select(*keys).distinct().withColumn("entry", ladder).filter("entry is not null")
    routed = routed.select(*[F.col(k).alias(f"_{k}") for k in keys], "entry")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # nulls are read as empty texts, and may be routed
    return requests.join(routed, same).select("rid", "entry")


def route_by_matches(requests: DataFrame, matches_: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(rid, entry) from explicit ``matches_(entry, scenario_id, relevance)``: agreement on contrast
    first, then relevance, then catalogue order. ``requests`` carry ``needs_contrast``.

    A scenario keeps its best match with and its best match without contrast; no request meets any other."""
    m = first_by(
        matches_.withColumn("_r", -F.col("relevance")), ["entry", "scenario_id"], ["_r"], []
    ).join(catalogue.select(F.col("name").alias("entry"), "seq", "uses_contrast"), "entry")
    m = first_by(m, ["scenario_id", "uses_contrast"], ["_r", "seq"], ["entry"])
    joined = requests.select("rid", "scenario_id", "needs_contrast").join(m, "scenario_id")
    miss = (F.col("needs_contrast") != F.col("uses_contrast")).cast("int")
    return first_by(joined.withColumn("_m", miss), ["rid"], ["_m", "_r", "seq"], ["entry"]).select("rid", "entry")


def needs_contrast(flag: Column, name: Column, parts: list[str] = packs.CONTRAST_NAME_PARTS) -> Column:
    return F.coalesce(flag.isin(1, 2), F.lit(False)) | contains_any(F.lower(name), parts)


def search_terms(
    scenario: Column, item: Column, region: Column, region_terms: list = packs.REGION_TERMS,
    important: list[str] = packs.IMPORTANT_TERMS, body_parts: list[str] = packs.SEARCH_BODY_PARTS, lead: str = "mri",
) -> Column:
    """Distinct terms of a request: region words, important words and body parts of the scenario, and the
    word after ``lead`` in the item name."""
    widened = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, terms in region_terms:
        widened = widened.when(region == name, F.array(*[F.lit(t) for t in terms]))
    widened = widened.otherwise(F.array().cast("array<string>"))
    words = F.filter(
        F.split(F.regexp_replace(F.lower(scenario), r"[^A-Za-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 3
    )
    picked = F.filter(words, lambda w: contains_any(w, important) | w.isin(body_parts))
    after = F.regexp_extract(F.lower(item), lead + r"\s+(\w+)", 1)
    extra = F.when(after != "", F.array(after)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(widened, picked, extra))


def score_entries(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(rid, entry, seq, score) of every request x entry pair that shares something: region, a term in
    name, keywords or indications. ``requests(rid, region, terms, needs_contrast)``.

    Pairs are found per distinct term and per distinct region, never by pairing whole tables. An
    entry that shares nothing can reach at most 8 points, see ``best_scored``.
    """
    c = materialise(
        catalogue.select(
            "seq", F.col("name").alias("entry"), F.lower("name").alias("_n"), F.lower("display").alias("_d"),
            F.lower("region").alias("_reg"), F.lower("section").alias("_sec"),
            F.transform("keywords", lambda k: F.lower(k)).alias("_k"), F.lower("indications").alias("_i"), "uses_contrast",
        ),
        "catalogue",
    )
    r = materialise(requests.select("rid", "region", "terms", "needs_contrast"), "requests")
    terms = materialise(r.select(F.explode("terms").alias("needle")).distinct().withColumn("nid", F.col("needle")), "terms")

    def hits(text: Column, points: int) -> DataFrame:
        pairs = phrase_pairs(terms, c.select(F.col("seq").alias("tid"), text.alias("text")))
        return pairs.select(F.col("nid").alias("term"), F.col("tid").alias("seq"), F.lit(points).alias("p"))

    by_name = hits(F.concat_ws("\n", "_n", "_d"), 10)
    by_text = hits(F.col("_i"), 2)
    keywords = c.select("seq", F.explode(F.array_distinct("_k")).alias("kw"))
    kw = keywords.select("kw").distinct()
    forward = phrase_pairs(terms, kw.select(F.col("kw").alias("tid"), F.col("kw").alias("text")))
    backward = phrase_pairs(
        kw.select(F.col("kw").alias("nid"), F.col("kw").alias("needle")), terms.select(F.col("nid").alias("tid"), F.col("needle").alias("text"))
    )
    linked = forward.select(F.col("nid").alias("term"), F.col("tid").alias("kw")).unionByName(
        backward.select(F.col("tid").alias("term"), F.col("nid").alias("kw"))
    )
    by_keyword = linked.join(keywords, "kw").select("term", "seq", F.lit(5).alias("p")).distinct()
    per_term = materialise(by_name.unionByName(by_text).unionByName(by_keyword).groupBy("term", "seq").agg(F.sum("p").alias("p")), "per-term")
    from_terms = r.select("rid", F.explode("terms").alias("term")).join(per_term, "term").select("rid", "seq", "p")
    regions = r.select("region").distinct()
    same = phrase_pairs(
        regions.select(F.col("region").alias("nid"), F.col("region").alias("needle")),
        c.select(F.col("seq").alias("tid"), F.col("_sec").alias("text")),
    ).select(F.col("nid").alias("region"), F.col("tid").alias("seq"))
    equal = regions.join(c, F.col("region") == F.col("_reg")).select("region", "seq")
    region_pairs = same.unionByName(equal).distinct()
    from_region = r.select("rid", "region").join(region_pairs, "region").select("rid", "seq", F.lit(15).alias("p"))
    total = from_terms.unionByName(from_region).groupBy("rid", "seq").agg(F.sum("p").alias("p"))
    needs, uses = F.col("needs_contrast"), F.col("uses_contrast")
    contrast = F.when(needs & uses, 8).when(~needs & ~uses, 5).when(needs & ~uses, -3).otherwise(0)
    return (
        total.join(r.select("rid", "needs_contrast"), "rid")
        .join(c.select("seq", "entry", "uses_contrast"), "seq")
        .select("rid", "entry", "seq", (F.col("p") + contrast).alias("score"))
    )


def best_scored(requests: DataFrame, catalogue: DataFrame, floor: int = 5) -> DataFrame:
    """(rid, entry, score): best entry scoring at least ``floor``, earliest on ties. A request without any
    shared term or region falls back to the first entry that agrees on contrast.

    Requests of the same region, contrast and terms are scored once, and ``requests`` are read once."""
    profile = F.to_json(F.struct("region", "needs_contrast", F.array_sort("terms").alias("terms")))
    asked = materialise(requests.select("rid", profile.alias("profile")), "profiles")
    kinds = {c: requests.schema[c].dataType.simpleString() for c in ("region", "needs_contrast", "terms")}
    parsed = F.from_json("profile", ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    distinct = materialise(asked.select("profile").distinct().withColumn("_p", parsed).select("profile", "_p.*"), "distinct-profiles")
    best = _best_entries(distinct.withColumnRenamed("profile", "rid"), catalogue, floor)
    return asked.select("rid", "profile").join(best.withColumnRenamed("rid", "profile"), "profile").select("rid", "entry", "score")


def _best_entries(requests: DataFrame, catalogue: DataFrame, floor: int) -> DataFrame:
    scored = score_entries(requests, catalogue)
    firsts = first_by(catalogue.select("uses_contrast", "seq", F.col("name").alias("entry")), ["uses_contrast"], ["seq"], ["entry"])
    agreeing = requests.select("rid", "needs_contrast").join(
        firsts, requests.needs_contrast == firsts.uses_contrast
    ).select("rid", "entry", "seq", F.when(F.col("needs_contrast"), 8).otherwise(5).alias("score"))
    # the shared-nothing entry may also be the best one when all shared entries lose points on contrast
    pool = scored.unionByName(agreeing.withColumn("score", F.col("score").cast("long"))).filter(F.col("score") >= floor)
    return first_by(pool.withColumn("_s", -F.col("score")), ["rid"], ["_s", "seq"], ["entry"]).select(
        "rid", "entry", (-F.col("_s")).alias("score")
    )


def resolve(requests: DataFrame, catalogue: DataFrame, rules: list[RouteRule], explicit: DataFrame) -> DataFrame:
    """(rid, entry, match_type, stage): rules, then explicit matches (both curated), then the scored
    fallback (suggested). Each stage sees only what the earlier ones left."""
    requests = materialise(requests, "requests")
    first = materialise(route_by_rules(requests, catalogue, rules), "routed")
    left = materialise(requests.join(first.select("rid"), "rid", "left_anti"), "left")
    second = materialise(route_by_matches(left, explicit, catalogue), "matched")
    rest = materialise(left.join(second.select("rid"), "rid", "left_anti"), "rest")
    third = best_scored(rest, catalogue).select("rid", "entry")
    return (
        first.withColumn("match_type", F.lit("curated")).withColumn("stage", F.lit("rules"))
        .unionByName(second.withColumn("match_type", F.lit("curated")).withColumn("stage", F.lit("explicit")))
        .unionByName(third.withColumn("match_type", F.lit("suggested")).withColumn("stage", F.lit("scored")))
    )


def routing_coverage(requests: DataFrame, routed: DataFrame) -> DataFrame:
    """(region, item, total, routed, unrouted, pct) for every region and item and, with nulls, the
    subtotals per region and overall, in one pass."""
    done = routed.select("rid").distinct().withColumn("_ok", F.lit(1))
    joined = requests.join(done, "rid", "left")
    r = joined.rollup("region", "item").agg(F.count("*").alias("total"), F.count("_ok").alias("routed"))
    return r.withColumn("unrouted", F.col("total") - F.col("routed")).withColumn(
        "pct", F.round(F.col("routed") / F.col("total") * 100, 1)
    )


def route_examples(requests: DataFrame, routed: DataFrame) -> DataFrame:
    """First route per item: (item, entry, stage, rid)."""
    joined = requests.select("rid", "item").join(routed.select("rid", "entry", "stage"), "rid")
    return first_by(joined, ["item"], ["rid"], ["entry", "stage"])


def audit_routes(requests: DataFrame, routed: DataFrame, catalogue: DataFrame, expected: list[tuple[str, list[str]]]) -> DataFrame:
    """(item, scenario, region, entry, status) per distinct (item, scenario): unrouted, missing target,
    mismatch (the entry name holds none of the words expected for the item's parts) or routed."""
    one = first_by(requests, ["item", "scenario"], ["rid"], ["region"])
    names = catalogue.select(F.col("name").alias("entry")).distinct().withColumn("_known", F.lit(True))
    joined = one.join(routed.select("rid", "entry"), "rid", "left").join(names, "entry", "left")
    item, entry = F.lower("item"), F.lower("entry")
    concerned, fine = F.lit(False), F.lit(False)
    for part, words in expected:
        has = F.contains(item, F.lit(part))
        concerned = concerned | has
        fine = fine | (has & contains_any(entry, words))
    status = (
        F.when(F.col("entry").isNull(), "unrouted")
        .when(F.col("_known").isNull(), "missing target")
        .when(concerned & ~fine, "mismatch")
        .otherwise("routed")
    )
    return joined.select("item", "scenario", "region", "entry", status.alias("status"))


def coverage_audit(
    requests: DataFrame, matched: DataFrame, contexts: list[tuple[str, list[str]]], covered: Column
) -> DataFrame:
    """(rid, region, item, contexts): requests without explicit match and without a covering rule.
    ``matched(scenario_id)``, ``covered`` is the rule condition."""
    open_ = requests.join(matched.select("scenario_id").distinct(), "scenario_id", "left_anti").filter(~covered)
    low = F.lower("scenario")
    labels = F.array_compact(F.array(*[F.when(contains_any(low, ws), F.lit(n)) for n, ws in contexts]))
    return open_.select("rid", "region", "item", labels.alias("contexts"))


def coverage_rollup(issues: DataFrame, kinds: list[tuple[str, list[str]]]) -> DataFrame:
    """(dimension, value, n) by region, by context (multi-valued) and by item kind."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, parts in kinds:
        kind = kind.when(contains_any(F.lower("item"), parts), F.lit(name))
    rows = F.concat(
        F.array(F.struct(F.lit("region").alias("dimension"), F.col("region").alias("value"))),
        F.array(F.struct(F.lit("kind").alias("dimension"), kind.otherwise("other").alias("value"))),
        F.transform("contexts", lambda c: F.struct(F.lit("context").alias("dimension"), c.alias("value"))),
    )
    return issues.select(F.explode(rows).alias("r")).groupBy("r.dimension", "r.value").agg(F.count("*").alias("n"))


def name_components(
    name: Column, parts: list[tuple[str, str]] = packs.BODY_PARTS
) -> Column:
    """struct(modality, contrast, body_part) read from a procedure name."""
    low = F.lower(name)

    def has(x):
        return F.contains(low, F.lit(x))

    modality = (
        F.when(has("mra ") | F.startswith(low, F.lit("mra")), "MRA")
        .when(has("mrv "), "MRV")
        .when(has("mrcp"), "MRCP")
        .when(has("pet/mri"), "PET/MRI")
        .otherwise("MRI")
    )
    contrast = (
        F.when(has("without and with") | has("with and without"), "both")
        .when(has("without"), "none")
        .when(has("with iv contrast") | has("with contrast"), "with")
        .otherwise("unknown")
    )
    part = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in parts:
        part = part.when(matches(low, pattern), F.lit(value))
    return F.struct(modality.alias("modality"), contrast.alias("contrast"), part.alias("body_part"))


def build_router(
    names: DataFrame, registry: DataFrame, catalogue: DataFrame, parts: list[tuple[str, str]], excluded: list[str], limit: int = 3
) -> DataFrame:
    """(item, match_type, contrast, body_part, entries): registry entry of the same name (first wins), else
    up to ``limit`` catalogue entries whose body part contains or is contained in the item's, else
    unmapped. ``registry(seq, name, entries)``. An entry without body part matches every part."""
    items = materialise(names.select("item").distinct(), "items")
    reg = first_by(registry.withColumn("_k", F.lower("name")), ["_k"], ["seq"], ["entries"])
    exact = items.join(reg, F.lower("item") == F.col("_k")).select("item", F.lit("exact").alias("match_type"), "entries")
    comp = name_components(F.col("item"), parts)
    rest = materialise(items.join(exact.select("item"), "item", "left_anti").withColumn("c", comp), "unmatched")
    wanted = rest.filter("c.body_part is not null").select(F.translate("c.body_part", "_", " ").alias("part")).distinct()
    offered = catalogue.filter(~F.col("name").isin(excluded)).select("seq", F.col("name").alias("entry"), F.lower("body_part").alias("bp"))
    bodies = offered.select("bp").distinct()
    pairs = phrase_pairs(
        wanted.select(F.col("part").alias("nid"), F.col("part").alias("needle")), bodies.select(F.col("bp").alias("tid"), F.col("bp").alias("text"))
    ).select(F.col("nid").alias("part"), F.col("tid").alias("bp"))
    reverse = phrase_pairs(
        bodies.select(F.col("bp").alias("nid"), F.col("bp").alias("needle")), wanted.select(F.col("part").alias("tid"), F.col("part").alias("text"))
    ).select(F.col("tid").alias("part"), F.col("nid").alias("bp"))
    every = wanted.withColumn("bp", F.lit(""))
    per_part = top_k(
        pairs.unionByName(reverse).unionByName(every).distinct().join(offered, "bp"), ["part"], [F.asc("seq")], limit
    ).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("_e"))
    found = rest.join(per_part, F.translate("c.body_part", "_", " ") == F.col("part"), "left").select(
        "item",
        F.when(F.col("_e").isNull(), "unmapped").otherwise("component").alias("match_type"),
        F.transform("_e", lambda e: e["entry"]).alias("entries"),
    )
    both = exact.unionByName(found)
    c = name_components(F.col("item"), parts)
    return both.select(
        "item", "match_type", c["contrast"].alias("contrast"), c["body_part"].alias("body_part"), "entries"
    )


def choose_route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(rid, entry, by_context): among the routes of the item the lowest priority with a context word in
    the scenario, else the first. ``routes(item, pos, entry, context, priority)``, context an array.

    Of routes with the same item and context only the best one on a hit and the first one can be chosen; they meet the
    distinct pairs of item and scenario, and each request looks its pair up."""
    kept = routes.groupBy("item", "context").agg(
        F.min(F.struct(F.coalesce("priority", F.lit(0)).alias("_p"), "pos", "entry")).alias("_hit"), F.min(F.struct("pos", "entry")).alias("_first")
    )
    pairs = requests.select("item", "scenario").distinct()
    hit = F.exists("context", lambda w: F.contains(F.lower("scenario"), F.lower(w)))
    joined = pairs.join(kept, "item").withColumn("_h", hit)
    taken = F.when(F.col("_h"), F.col("_hit")).otherwise(F.struct(F.lit(0).alias("_p"), "_first.pos", "_first.entry"))
    scored = joined.select("item", "scenario", (~F.col("_h")).cast("int").alias("_miss"), taken.alias("_t")).select("item", "scenario", "_miss", "_t.*")
    best = first_by(scored, ["item", "scenario"], ["_miss", "_p", "pos"], ["entry"]).select(
        F.col("item").alias("_item"), F.col("scenario").alias("_scenario"), "entry", (F.col("_miss") == 0).alias("by_context")
    )
    same = (F.col("item") == F.col("_item")) & F.col("scenario").eqNullSafe(F.col("_scenario"))
    return requests.select("rid", "item", "scenario").join(best, same).select("rid", "entry", "by_context")


def supplements(requests: DataFrame, always: DataFrame, contextual: DataFrame) -> DataFrame:
    """(rid, kind, pos, reason): additions of an item that always apply, or whose ``when`` words occur in
    the scenario. ``always(item, pos, reason)``, ``contextual(item, pos, when, reason)``.

    The result lists every request with every addition of its item. Requests with any are written once, those of an item side
    by side: the same additions follow each other then, and files of the result shrink to a fraction."""
    items = materialise(always.select("item").unionByName(contextual.select("item")).distinct(), "items")
    asking = requests.select("rid", "item", F.lower("scenario").alias("_s")).join(items, "item", "left_semi")
    base = materialise(asking.sortWithinPartitions("item", "_s"), "asking")
    a = base.join(always, "item").select("rid", F.lit("always").alias("kind"), "pos", "reason")
    c = base.join(contextual, "item").filter(F.exists("when", lambda w: F.contains(F.col("_s"), F.lower(w))))
    return a.unionByName(c.select("rid", F.lit("contextual").alias("kind"), "pos", "reason"))


def match_label(scenario: Column, listed: Column) -> Column:
    """curated when the first 50 characters of either name occur in the other one, else suggested."""
    low = F.lower(scenario)
    near = F.exists(
        listed,
        lambda m: F.contains(low, F.substring(F.lower(m), 1, 50)) | F.contains(F.lower(m), F.substring(low, 1, 50)),
    )
    return F.when(F.coalesce(near, F.lit(False)), "curated").otherwise("suggested")


def missing_definitions(definitions: DataFrame, catalogue: DataFrame) -> DataFrame:
    return definitions.join(catalogue.select("name").distinct(), "name", "left_anti")


def route_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Requests two rule sets route differently: (rid, left_entry, right_entry)."""
    j = left.select("rid", F.col("entry").alias("left_entry")).join(
        right.select("rid", F.col("entry").alias("right_entry")), "rid", "full_outer"
    )
    return j.filter(~F.col("left_entry").eqNullSafe(F.col("right_entry")))


def conflicts(rows: DataFrame, spine: Column, both: list[str] = packs.BOTH_CONTRASTS) -> DataFrame:
    """``rows(..., contexts, contrast, item)`` with the two concerns of a route as flags: ``cross_region``, a spine item with a
    tumour context, and ``contrast_mismatch``, an infection context with an item that neither takes contrast nor names both
    ways. A missing contrast counts as none."""
    def asked(context: str) -> Column:
        return F.coalesce(F.array_contains("contexts", context), F.lit(False))

    plain = (F.coalesce("contrast", F.lit(0)) == 0) & ~contains_any(F.lower("item"), both)
    return rows.withColumns({
        "cross_region": F.coalesce(spine, F.lit(False)) & asked("tumor"), "contrast_mismatch": F.coalesce(asked("infection") & plain, asked("infection")),
    })
