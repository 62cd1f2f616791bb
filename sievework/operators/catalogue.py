"""Catalogue of records with ordered steps: filters, validation, timing, templates, export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.text import js_round
from .ranking import first_by, full_row_number, last_by, top_k


def faceted(catalogue: DataFrame, region: str = "all", contrast: str = "all", text: str = "") -> DataFrame:
    """Region, contrast (``with``/``without``) and free text over name, display, keywords, indications."""
    if region != "all":
        catalogue = catalogue.filter(F.lower(F.coalesce("region", F.lit(""))) == region)
    if contrast != "all":
        catalogue = catalogue.filter(F.col("uses_contrast") if contrast == "with" else ~F.col("uses_contrast"))
    if text:
        fields = [F.lower("name"), F.lower("display"), F.lower(F.array_join("keywords", " ")), F.lower("indications")]
        found = F.lit(False)
        for f in fields:
            found = found | F.contains(F.coalesce(f, F.lit("")), F.lit(text.lower()))
        catalogue = catalogue.filter(found)
    return catalogue


def step_types(types: DataFrame, text: str = "", category: str = "all", without_post: bool = False, region: str = "all") -> DataFrame:
    """Step types by text, category alias (contrast, t1, t2, dwi or a plain category), contrast and region."""
    name, post = F.lower("name"), F.col("is_post")
    if text.strip():
        q = text.strip().lower()
        types = types.filter(
            F.contains(name, F.lit(q)) | F.contains(F.lower("display"), F.lit(q)) | F.contains(F.lower("purpose"), F.lit(q))
        )
    alias = category.lower()
    if alias in ("contrast", "+c"):
        types = types.filter(post)
    elif alias == "t1":
        types = types.filter(F.startswith(name, F.lit("t1")) | F.contains(name, F.lit("mprage")))
    elif alias == "t2":
        types = types.filter(
            (F.startswith(name, F.lit("t2")) | name.isin("flair", "stir") | F.contains(name, F.lit("haste"))) & ~post
        )
    elif alias == "dwi":
        types = types.filter(name.isin("dwi", "swi"))
    elif alias != "all":
        types = types.filter(F.col("category") == category)
    if without_post:
        types = types.filter(~post)
    if region != "all":
        types = types.filter(F.array_contains("regions", region))
    return types


def well_formed(name: Column, short: Column, modality: Column) -> Column:
    """False for blank names and for modality Other without a distinct short name."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    copy = (modality == "Other") & ((F.coalesce(short, F.lit("")) == "") | (short == name))
    return ~blank & ~F.coalesce(copy, F.lit(False))


def validation_errors(name: Column, region: Column, steps: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(name), F.lit("")) == "", "name is required"),
            F.when(F.coalesce(region, F.lit("")) == "", "region is required"),
            F.when(F.coalesce(steps, F.lit(0)) == 0, "at least one step is required"),
        )
    )


def provenance(source: Column) -> Column:
    return F.when(source == "ai_generated", "suggested").otherwise("verified")


def tag_suggestions(typed: DataFrame, tags: DataFrame, selected: DataFrame, n: int = 8) -> DataFrame:
    """(rid, tag, rank): tags containing the typed text and not selected for the record yet.
    ``typed(rid, q)``, ``tags(seq, tag)``, ``selected(rid, tag)``."""
    from .containment import phrase_pairs

    low = tags.select("seq", "tag", F.lower("tag").alias("low"))
    pairs = phrase_pairs(
        typed.select(F.col("rid").alias("nid"), F.lower("q").alias("needle")),
        low.select(F.col("seq").alias("tid"), F.col("low").alias("text")),
    ).select(F.col("nid").alias("rid"), F.col("tid").alias("seq"))
    open_ = pairs.join(low, "seq").join(selected.select("rid", F.lower("tag").alias("low")), ["rid", "low"], "left_anti")
    return top_k(open_, ["rid"], [F.asc("seq")], n).select("rid", "tag", "rank")


def related(catalogue: DataFrame, n: int = 4) -> DataFrame:
    """(name, related, rank): the first ``n`` other entries of the same region. Only the first ``n`` + 1
    entries of a region can appear, so the region list is cut before the join."""
    heads = top_k(catalogue.select("region", "seq", F.col("name").alias("related")), ["region"], [F.asc("seq")], n + 1, "_h")
    pairs = catalogue.select("name", "region").join(heads, "region").filter("name <> related")
    return top_k(pairs, ["name"], [F.asc("seq")], n).select("name", "related", "rank")


def expand_templates(template_steps: DataFrame, library: DataFrame) -> DataFrame:
    """(template, sort_order, step_id, name, seconds, is_post): template steps found in the library,
    duplicates of (type, plane) dropped, renumbered from zero."""
    known = template_steps.join(library, "type_id").withColumn("step_id", F.concat_ws("_", "type_id", "plane"))
    one = first_by(known, ["template", "step_id"], ["pos"], ["name", "plane", "seconds", "is_post"])
    numbered = full_row_number(one, ["template"], ["pos", "step_id"], "_n")
    return numbered.select(
        "template", (F.col("_n") - 1).alias("sort_order"), "step_id", F.concat_ws(" ", "plane", "name").alias("name"), "seconds", "is_post"
    )


def evidence(entries: DataFrame, matches: DataFrame, scenarios: DataFrame, hits: DataFrame, n: int = 5, enough: int = 3) -> DataFrame:
    """(entry, id, score, tier): the first ``n`` listed scenarios; entries with fewer than ``enough`` of
    them are topped up with keyword hits of their region. ``matches(entry, id, pos, relevance)``,
    ``hits(entry, id, n_hits)`` limited to the region, ``scenarios(id, seq)``."""
    listed = top_k(matches, ["entry"], [F.asc("pos")], n, "_r").join(scenarios, "id").select(
        "entry", "id", F.col("relevance").cast("double").alias("score"), F.lit(1).alias("tier"), F.col("pos").alias("o")
    )
    counts = listed.groupBy("entry").agg(F.count("*").alias("_n"))
    short = entries.join(counts, "entry", "left").filter(F.coalesce("_n", F.lit(0)) < enough).select("entry")
    extra = (
        hits.join(short, "entry", "left_semi")
        .join(listed.select("entry", "id"), ["entry", "id"], "left_anti")
        .join(scenarios, "id")
        .select("entry", "id", (F.col("n_hits") * 10.0).alias("score"), F.lit(2).alias("tier"), F.col("seq").alias("o"))
    )
    return top_k(listed.unionByName(extra), ["entry"], [F.asc("tier"), F.asc("o")], n).select("entry", "id", "score", "tier", "rank")


def two_key_index(cards: DataFrame) -> DataFrame:
    """(key, topic): cards by topic and, if different, by display name; the later card wins."""
    by_topic = cards.select("seq", F.lit(0).alias("o"), F.lower("topic").alias("key"), "topic")
    by_name = cards.filter(F.lower("display") != F.lower("topic")).select(
        "seq", F.lit(1).alias("o"), F.lower("display").alias("key"), "topic"
    )
    return last_by(by_topic.unionByName(by_name).filter("key <> ''"), ["key"], ["seq", "o"], ["topic"]).select("key", "topic")


def region_counts(catalogue: DataFrame, order: list[str] = packs.REGION_ORDER, other: str = "other") -> DataFrame:
    """(region, n, position) in the fixed order; a missing region counts as other, unlisted ones go."""
    position = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("region")).cast("int")
    counted = catalogue.groupBy(F.lower(F.coalesce("region", F.lit(other))).alias("region")).agg(F.count("*").alias("n"))
    return counted.withColumn("position", position).filter("position > 0")


def step_statistics(steps: DataFrame) -> DataFrame:
    """Counts and times before and after contrast per entry."""
    post, t = F.col("is_post"), F.coalesce("seconds", F.lit(0))
    return steps.groupBy("entry").agg(
        F.count("*").alias("total_steps"),
        F.sum((~post).cast("long")).alias("pre_count"),
        F.sum(post.cast("long")).alias("post_count"),
        F.sum(F.when(~post, t).otherwise(0)).alias("pre_seconds"),
        F.sum(F.when(post, t).otherwise(0)).alias("post_seconds"),
        F.sum(t).alias("total_seconds"),
    )


def scoped_time(steps: DataFrame, tags: DataFrame, multipliers: DataFrame) -> DataFrame:
    """(entry, seconds): summed step time times the largest multiplier of the entry's tags, at least 1."""
    top = tags.select("entry", F.lower("tag").alias("tag")).join(multipliers, "tag").groupBy("entry").agg(F.max("multiplier").alias("_m"))
    base = steps.groupBy("entry").agg(F.sum(F.coalesce("seconds", F.lit(0))).alias("_t"))
    factor = F.greatest(F.lit(1.0), F.coalesce("_m", F.lit(1.0)))
    return base.join(top, "entry", "left").select("entry", js_round(F.col("_t") * factor).alias("seconds"))


def estimated_minutes(steps: DataFrame, stored: DataFrame) -> DataFrame:
    """(entry, text): the stored minutes, else 4 per step after contrast and 3 before."""
    guess = steps.groupBy("entry").agg(F.sum(F.when(F.col("is_post"), 4).otherwise(3)).alias("_g"))
    joined = stored.join(guess, "entry", "full_outer")
    minutes = F.coalesce(F.when(F.col("minutes") != 0, F.col("minutes")).cast("long"), "_g", F.lit(0))
    return joined.select("entry", F.when(minutes > 0, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min"))).otherwise("N/A").alias("text"))


def first_seen_regions(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, regions): distinct regions in first-seen order; one row per region meets per key."""
    firsts = rows.groupBy(key, "region").agg(F.min(seq).alias("_s"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_s", "region"))).alias("_r")).select(
        key, F.transform("_r", lambda r: r["region"]).alias("regions")
    )


def nested_recommendations(scenarios: DataFrame, floor: int = 7, modality: str = "MRI", first: int = 2) -> DataFrame:
    """(id, variant, procedure, rating) from nested ``variants[{name, ratings[{modality, rating, name}]}]``:
    the first variants' good ratings of one modality."""
    v = scenarios.select("id", F.explode(F.slice("variants", 1, first)).alias("v"))
    r = v.select("id", F.col("v.name").alias("variant"), F.explode("v.ratings").alias("r"))
    return r.filter((F.col("r.modality") == modality) & (F.col("r.rating") >= floor)).select(
        "id", "variant", F.col("r.name").alias("procedure"), F.col("r.rating").alias("rating")
    )


def flatten_sections(entries: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """(key, section, pos, text) of array columns; empty sections have no rows."""
    def rows_of(section: str) -> Column:
        texts = F.coalesce(F.col(section), F.array().cast("array<string>"))
        return F.transform(texts, lambda t, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), t.alias("text")))

    packed = F.concat(*[rows_of(s) for s in sections])
    return entries.select(key, F.explode(packed).alias("x")).select(key, "x.*")


def first_marker(steps: DataFrame) -> DataFrame:
    """(entry, pos, is_post, marker_before): marks the first step after contrast."""
    firsts = steps.filter("is_post").groupBy("entry").agg(F.min("pos").alias("_f"))
    return steps.join(firsts, "entry", "left").select(
        "entry", "pos", "is_post", F.coalesce(F.col("pos") == F.col("_f"), F.lit(False)).alias("marker_before")
    )


def renumber(rows: DataFrame, key: str, pos: str, out: str = "sort_order") -> DataFrame:
    """Dense positions from zero after inserts, removals and moves."""
    return full_row_number(rows, [key], [pos], out).withColumn(out, F.col(out) - 1)


def export_envelope(rows: DataFrame, version: str, source: str, exported_at: Column, columns: list[str]) -> DataFrame:
    """One JSON envelope per record."""
    return rows.select(
        F.to_json(
            F.struct(
                F.lit(version).alias("version"), exported_at.alias("exported_at"), F.lit(source).alias("source"),
                F.struct(*columns).alias("protocol"),
            )
        ).alias("json")
    )


IMPORT_RECORD = (
    "struct<name:string,display_name:string,body_region:string,uses_contrast:boolean,notes:string,indications:string,"
    "total_time_seconds:bigint>"
)


def import_envelopes(rows: DataFrame, json: str) -> DataFrame:
    """Records of JSON envelopes holding one ``protocol`` or a ``protocols`` list, defaults filled in, rows
    without a name dropped. Malformed text yields no records."""
    parsed = rows.select(*[c for c in rows.columns if c != json], F.from_json(json, f"struct<protocol:{IMPORT_RECORD},protocols:array<{IMPORT_RECORD}>>").alias("e"))
    records = F.when(F.col("e.protocol").isNotNull(), F.array("e.protocol")).otherwise(F.col("e.protocols"))
    kept = [c for c in rows.columns if c != json]
    p = parsed.select(*kept, F.posexplode(records).alias("pos", "p")).filter(F.coalesce("p.name", F.lit("")) != "")
    return p.select(
        *kept, "pos", "p.name", F.coalesce(F.nullif("p.display_name", F.lit("")), "p.name").alias("display_name"),
        F.coalesce("p.body_region", F.lit("")).alias("body_region"), F.coalesce("p.uses_contrast", F.lit(False)).alias("uses_contrast"),
        F.coalesce("p.notes", F.lit("")).alias("notes"), F.coalesce("p.indications", F.lit("")).alias("indications"),
        F.coalesce("p.total_time_seconds", F.lit(0)).alias("total_time_seconds"),
    )


def text_records(entries: DataFrame, steps: DataFrame) -> DataFrame:
    """(entry, body): header lines and the numbered steps of an entry as plain text."""
    mark = F.when(F.col("is_post"), " (post-contrast)").otherwise("")
    lines = steps.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("pos", "name", mark.alias("m")))).alias("_s")).select(
        "entry", F.transform("_s", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["name"], s["m"])).alias("_l")
    )
    head = F.array(
        F.concat(F.lit("Protocol: "), F.coalesce(F.nullif("display", F.lit("")), "entry")),
        F.concat(F.lit("Contrast: "), F.when(F.col("uses_contrast"), "Yes").otherwise("No")),
        F.lit(""),
        F.lit("Sequences:"),
    )
    joined = entries.join(lines, "entry", "left")
    return joined.select("entry", F.array_join(F.concat(head, F.coalesce("_l", F.array().cast("array<string>"))), "\n").alias("body"))


def page_records(entries: DataFrame, steps: DataFrame, matches: DataFrame, regions: list[str]) -> DataFrame:
    """One denormalised record per entry: title, meta, region link flag, ordered steps, top five scenarios.
    ``entries(entry, title, indications, region)``."""
    from ..functions.text import strip_tags

    ordered = steps.groupBy("entry").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name", F.when(F.col("is_post"), "Post-contrast").otherwise("Pre-contrast").alias("phase")))).alias("steps")
    )
    best = top_k(matches, ["entry"], [F.desc("relevance"), F.asc("pos")], 5).groupBy("entry").agg(
        F.array_sort(F.collect_list(F.struct("rank", "scenario"))).alias("_b")
    )
    plain = strip_tags(F.col("indications"))
    meta = F.when(plain != "", F.substring(plain, 1, 155)).otherwise(
        F.concat(F.col("title"), F.lit(" MRI protocol sequences and clinical indications."))
    )
    return (
        entries.join(ordered, "entry", "left").join(best, "entry", "left")
        .select(
            "entry", "title", meta.alias("meta"), F.col("region").isin(regions).alias("region_link"),
            F.transform("steps", lambda s: F.concat(s["name"], F.lit("|"), s["phase"])).alias("steps"),
            F.transform("_b", lambda b: b["scenario"]).alias("scenarios"),
        )
    )


def url_list(slugs: DataFrame, fixed: list[tuple[str, str, str]], page: tuple[str, str, str]) -> DataFrame:
    """(loc, priority, changefreq) of the ``fixed`` pages and of every slug, which takes the place of ``%s`` in ``page``."""
    head = slugs.sparkSession.createDataFrame(fixed, "loc string, priority string, changefreq string")
    loc, priority, often = page
    return head.unionByName(slugs.select(F.format_string(loc, "slug").alias("loc"), F.lit(priority).alias("priority"), F.lit(often).alias("changefreq")))


def unique_slugs(rows: DataFrame, seq: str = "seq", base: str = "base", disc: str = "disc") -> DataFrame:
    """Adds ``slug``: the base for its first claimant, then base-disc, base-disc-2, ... in ``seq`` order.

    Every row goes through its own list of candidates and takes the first that no earlier row holds.
    Rows of one (base, disc) share the list, so the n-th of them starts n places down; then each slug
    keeps its earliest claimant, the refused row and the later rows of its group move one place on,
    and this repeats until no slug is claimed twice. The outcome is the sequential one.
    """
    from ..session import materialise

    r = rows.select(F.col(seq).alias("seq"), F.col(base).alias("base"), F.col(disc).alias("disc"))
    heads = r.groupBy("base").agg(F.min("seq").alias("_head"))
    led = full_row_number(r, ["base", "disc"], ["seq"], "_n").join(heads, "base")
    group_leads = led.groupBy("base", "disc").agg(F.max((F.col("seq") == F.col("_head")).cast("int")).alias("_leads"))
    state = materialise(
        led.join(group_leads, ["base", "disc"]).select(
            "seq", "base", "disc", F.col("_n").alias("n"), (F.col("_n") - F.col("_leads")).cast("long").alias("place")
        ),
        "slugs",
    )
    while True:
        place = F.col("place")
        slug = (
            F.when(place == 0, F.col("base"))
            .when(place == 1, F.concat_ws("-", "base", "disc"))
            .otherwise(F.concat_ws("-", "base", "disc", place.cast("string")))
        )
        claimed = state.withColumn("slug", slug)
        holders = claimed.groupBy("slug").agg(F.min("seq").alias("_holder"), F.count("*").alias("_c")).filter("_c > 1")
        refused = materialise(
            claimed.join(holders, "slug").filter(F.col("seq") > F.col("_holder")).groupBy("base", "disc").agg(F.min("n").alias("_from")),
            "refused",
        )
        if refused.isEmpty():
            return rows.join(claimed.select(F.col("seq").alias(seq), "slug"), seq)
        moved = F.when(F.col("n") >= F.col("_from"), place + 1).otherwise(place)
        state = materialise(
            state.join(refused, ["base", "disc"], "left").select("seq", "base", "disc", "n", moved.alias("place")), "slugs"
        )
