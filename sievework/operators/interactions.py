"""Interaction-log behaviours over a stored log: debounce, expiry, recent lists, toggles, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import last_by, next_value, top_k


def micros(ts: str):
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def debounce(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Last event of every burst: kept when no event of the key follows within the gap."""
    timed = events.withColumn("_us", micros(ts))
    ahead = next_value(timed, [key], "_us", "_next")
    return ahead.filter(F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= int(gap_seconds * 1_000_000))).drop(
        "_us", "_next"
    )


def ttl_misses(events: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Distinct (k, t), t in microseconds, of the requests a cache would miss; expiry counts from the stored miss.

    Every request points to the first one of its key at least the expiry later. Misses are what the
    first request reaches along these pointers; doubling the pointers finds them in log(chain) joins
    on (key, ts), so a busy key is never walked in one task. The pointer search looks at one expiry
    span of a key at a time."""
    ttl = ttl_seconds * 1_000_000
    points = materialise(events.select(F.col(key).alias("k"), micros(ts).alias("t")).distinct(), "points")
    spans = points.withColumn("b", F.floor(F.col("t") / ttl)).groupBy("k", "b").agg(F.min("t").alias("start"))
    after = F.lead("start").over(Window.partitionBy("k").orderBy("b"))
    next_span = spans.select("k", "b", after.alias("later"), F.lead("b").over(Window.partitionBy("k").orderBy("b")).alias("later_b"))
    follow = next_span.select(
        "k", (F.col("b") + 1).alias("b"), "later", F.col("later_b").alias("lb")
    )  # keyed by the span a pointer from b lands in
    second = spans.select("k", "b", F.lead("start").over(Window.partitionBy("k").orderBy("b")).alias("beyond"))
    aims = points.select("k", (F.col("t") + ttl).alias("t"), F.col("t").alias("src"), F.floor(F.col("t") / ttl).alias("from_b")).withColumn(
        "b", F.floor(F.col("t") / ttl)
    )
    marks = points.select("k", "t", F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("from_b"), F.floor(F.col("t") / ttl).alias("b"))
    ordered = Window.partitionBy("k", "b").orderBy(F.col("t"), F.col("src").isNull()).rowsBetween(1, Window.unboundedFollowing)
    real = F.when(F.col("src").isNull(), F.col("t"))
    near = aims.unionByName(marks).withColumn("near", F.min(real).over(ordered)).filter("src is not null")
    beyond = second.join(follow.select("k", "b"), ["k", "b"], "left_semi")
    pointers = (
        near.join(beyond, ["k", "b"], "left")
        .join(follow, ["k", "b"], "left")
        .select(
            "k",
            F.col("src").alias("t"),
            # the landing span may hold nothing late enough, or nothing at all
            F.coalesce("near", F.when(F.col("lb") > F.col("b"), F.col("later")), "beyond").alias("to"),
        )
    )
    jump = materialise(pointers.filter(F.col("to").isNotNull()), "jumps")
    reached = materialise(points.groupBy("k").agg(F.min("t").alias("t")), "reached")
    while not jump.isEmpty():
        step = reached.join(jump, ["k", "t"]).select("k", F.col("to").alias("t"))
        reached = materialise(reached.unionByName(step).distinct(), "reached")
        hop = jump.select("k", F.col("t").alias("to"), F.col("to").alias("to2"))
        jump = materialise(jump.join(hop, ["k", "to"]).select("k", "t", F.col("to2").alias("to")), "jumps")
    return reached


def ttl_dedup(events: DataFrame, key: str, ts: str, ttl_seconds: int) -> DataFrame:
    """Adds ``hit``: whether a request is answered by the stored result of an earlier one."""
    misses = ttl_misses(events, key, ts, ttl_seconds)
    timed = events.withColumn("_us", micros(ts))
    joined = timed.join(misses, (timed[key] == misses.k) & (timed["_us"] == misses.t), "left")
    return joined.select(*[timed[c] for c in events.columns], misses.t.isNull().alias("hit"))


def recent_distinct(events: DataFrame, key: str, text: str, ts: str, n: int = 10) -> DataFrame:
    """(key, text, ts, rank): newest distinct texts per key, ignoring case, two characters and more."""
    rows = events.select(key, ts, F.trim(text).alias("text")).filter(F.length("text") >= 2)
    latest = last_by(rows.withColumn("_low", F.lower("text")), [key, "_low"], [ts], ["text"])
    return top_k(latest, [key], [F.desc(ts), F.asc("_low")], n).select(key, "text", ts, "rank")


def toggle_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Members: key tuples toggled an odd number of times."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles")).filter(F.col("toggles") % 2 == 1)


def apply_changes(base: DataFrame, log: DataFrame, key: str, ts: str, op: str = "op") -> DataFrame:
    """Rows after a change log: the last change per key wins, a deletion removes. ``log`` has the columns of
    ``base`` plus ``op`` (upsert or delete); base rows are older than any change."""
    fields = [c for c in base.columns if c not in (key, ts)]
    changes = log.select(key, ts, op, *fields, F.lit(1).alias("_late"))
    rows = base.select(key, ts, F.lit("upsert").alias(op), *fields, F.lit(0).alias("_late")).unionByName(changes)
    last = last_by(rows, [key], ["_late", ts, op], fields)
    return last.filter(F.col(op) != "delete").select(*base.columns)


def duplicate_changes(rows: DataFrame, key: str, name: str, suffix: str = "-copy") -> DataFrame:
    """Upserts that copy rows under a new key and a name marked (Copy)."""
    return rows.withColumn(key, F.concat(F.col(key).cast("string"), F.lit(suffix))).withColumn(
        name, F.concat(name, F.lit(" (Copy)"))
    ).withColumn("op", F.lit("upsert"))
