"""Titles of long comma-separated names, equivalence keys and near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.rules import ascii_borders
from ..functions.text import SPACE, contains_any
from ..session import materialise
from .ranking import first_by


def shorten(col: Column, rules: list[tuple[str, str]] = packs.QUALIFIER_SHORTENINGS) -> Column:
    for pattern, new in rules:
        col = F.regexp_replace(col, "(?i)" + pattern, new)
    return col


def _parts(title: Column) -> Column:
    return F.transform(F.split(title, ","), lambda p: F.trim(p))


def format_title(
    title: Column,
    classes: list[tuple[str, str, list[str]]] = packs.QUALIFIERS,
    shortenings: list[tuple[str, str]] = packs.QUALIFIER_SHORTENINGS,
) -> Column:
    """Condition, body part and up to four distinguishing qualifiers of a name with 3+ parts."""

    def classify(q: Column) -> Column:
        low = F.lower(q)
        ladder = F.when(F.lit(False), F.lit("other"))
        for name, pattern, parts in classes:
            hit = contains_any(low, parts)
            ladder = ladder.when(hit | low.rlike(pattern) if pattern else hit, F.lit(name))
        return ladder.otherwise("other")

    parts = _parts(title)
    tagged = F.transform(F.slice(parts, 2, F.size(parts)), lambda q: F.struct(classify(q).alias("c"), q.alias("q")))

    def of(name: str, limit: int | None = None) -> Column:
        kept = F.transform(F.filter(tagged, lambda t: t["c"] == name), lambda t: t["q"])
        return kept if limit is None else F.slice(kept, 1, limit)

    none = F.array().cast("array<string>")
    severe = F.size(of("severity")) > 0
    core = F.concat(
        of("size"),
        of("severity", 1),
        F.when(severe, of("purpose", 1)).otherwise(none),
        of("subtype", 1),
        of("clinical", 2),
        F.when(severe, none).otherwise(of("purpose", 1)),
    )
    with_imaging = F.when(F.size(core) < 3, F.concat(core, of("imaging", 1))).otherwise(core)
    chosen = F.when(F.size(with_imaging) > 0, with_imaging).otherwise(of("other", 2))
    shown = F.transform(F.slice(chosen, 1, 4), lambda q: shorten(q, shortenings))
    body = of("body")
    text = F.concat(
        parts[0],
        F.when(F.size(body) > 0, F.concat(F.lit(" - "), F.array_join(body, "/"))).otherwise(""),
        F.when(F.size(shown) > 0, F.concat(F.lit(" ("), F.array_join(shown, ", "), F.lit(")"))).otherwise(""),
    )
    return F.when(F.size(parts) <= 2, title).otherwise(text)


def differentiator(name: Column, title: Column, skip: list[str]) -> Column:
    """Last two parts whose first ten characters the title lacks; all later parts when none is left."""
    parts = _parts(name)
    rest = F.slice(parts, 2, F.size(parts))
    kept = F.filter(
        rest,
        lambda p: ~contains_any(F.lower(p), skip) & ~F.contains(F.lower(title), F.substring(F.lower(p), 1, 10)),
    )
    last = F.when(F.size(kept) > 2, F.slice(kept, -2, 2)).otherwise(kept)
    return F.array_join(F.when(F.size(kept) > 0, last).otherwise(rest), ", ")


def equivalence_key(name: Column, rules: list[tuple[str, str]] = packs.EQUIVALENCE) -> Column:
    """Order-independent key of a procedure name: expanded abbreviations, aliases, sorted words."""
    s = F.trim(F.regexp_replace(F.lower(name), SPACE + "+", " "))
    for pattern, new in rules:
        s = F.regexp_replace(s, "(?i)" + ascii_borders(pattern), new.replace("$", r"\$"))
    s = F.trim(F.regexp_replace(s, SPACE + "+", " "))
    return F.array_join(F.array_sort(F.split(s, " ")), " ")


def _trims(key: Column, most: int = 4) -> Column:
    """The key with up to ``most`` characters cut off its ends, itself left out."""
    cuts = [(i, j) for i in range(most + 1) for j in range(most + 1 - i) if i + j > 0]
    pieces = [F.when(F.length(key) >= i + j, F.substring(key, F.lit(i + 1), F.length(key) - (i + j))) for i, j in cuts]
    return F.array_distinct(F.array_compact(F.array(*pieces)))


def drop_equivalent(rows: DataFrame, group: str, key: str, seq: str) -> DataFrame:
    """Rows kept by a greedy pass per group in ``seq`` order: a row goes when an earlier kept one has
    the same key, or one key contains the other with a length difference below five.

    Keys that conflict differ by at most four characters at the ends, so conflicts come from an
    equi-join on trimmed keys. Then rounds decide every key whose earlier conflicts are all decided,
    which gives the sequential result without holding a group in one task. All rounds see one row
    per (group, key).
    """
    distinct = materialise(
        rows.groupBy(group, key).agg(F.min(seq).alias("seq")).select(F.col(group).alias("g"), F.col(key).alias("k"), "seq"),
        "keys",
    )
    pieces = distinct.select("g", F.col("k").alias("long"), F.col("seq").alias("long_seq"), F.explode(_trims(F.col("k"))).alias("k"))
    pairs = pieces.join(distinct, ["g", "k"]).filter(F.col("seq") != F.col("long_seq"))
    edges = materialise(
        pairs.select(
            "g",
            F.greatest("seq", "long_seq").alias("late"),
            F.least("seq", "long_seq").alias("early"),
        ).distinct(),
        "edges",
    )
    open_rows, kept = distinct.select("g", "seq"), None
    while True:
        waiting = edges.join(open_rows.withColumnRenamed("seq", "early"), ["g", "early"], "left_semi")
        blocked = waiting.select("g", F.col("late").alias("seq")).distinct()
        winners = materialise(open_rows.join(blocked, ["g", "seq"], "left_anti"), "winners")
        kept = winners if kept is None else kept.unionByName(winners)
        losers = edges.join(winners.withColumnRenamed("seq", "early"), ["g", "early"], "left_semi").select(
            "g", F.col("late").alias("seq")
        )
        open_rows = materialise(
            open_rows.join(winners, ["g", "seq"], "left_anti").join(losers.distinct(), ["g", "seq"], "left_anti"), "open"
        )
        if open_rows.isEmpty():
            break
    chosen = kept.withColumnRenamed("g", "_g").withColumnRenamed("seq", "_seq")
    return rows.join(chosen, (rows[group] == F.col("_g")) & (rows[seq] == F.col("_seq")), "left_semi")


def first_per_key(rows: DataFrame, group: str, key: str, seq: str, keep: list[str]) -> DataFrame:
    return first_by(rows, [group, key], [seq], keep)
