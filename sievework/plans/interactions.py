"""Interaction-log jobs over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interactions as it
from ..session import table
from .registry import query

GAP, TTL = 6 * 3600, 12 * 3600


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "debounced_events",
    sql=f"SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n IS NULL OR n - ts >= INTERVAL {GAP} SECOND",
)
def debounced_events(spark, sf):
    return it.debounce(events(spark, sf), "user_id", "ts", GAP).select("event_id", "user_id", "ts")


@query(
    "ttl_cache_hits",
    sql=f"WITH RECURSIVE e AS (SELECT DISTINCT event_type || '-' || user_id AS k, ts FROM events), m AS (SELECT k, min(ts) AS ts FROM e GROUP BY 1 UNION ALL "
    f"SELECT m.k, (SELECT min(e.ts) FROM e WHERE e.k = m.k AND e.ts >= m.ts + INTERVAL {TTL} SECOND) FROM m WHERE m.ts IS NOT NULL) SELECT event_id, "
    "(event_type || '-' || user_id, ts) NOT IN (SELECT (k, ts) FROM m WHERE ts IS NOT NULL) AS hit FROM events",
)
def ttl_cache_hits(spark, sf):
    e = events(spark, sf).withColumn("k", F.concat_ws("-", "event_type", "user_id"))
    return it.ttl_dedup(e, "k", "ts", TTL).select("event_id", "hit")


@query(
    "recent_distinct",
    sql="WITH l AS (SELECT user_id, event_type || ' ' || CAST(json_extract(props, '$.k') AS INTEGER) % 20 AS t, max(ts) AS ts FROM events GROUP BY ALL) SELECT "
    "user_id, t AS text, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, t) AS INTEGER) AS rank FROM l QUALIFY rank <= 10",
)
def recent_distinct(spark, sf):
    e = events(spark, sf).withColumn("text", F.concat_ws(" ", "event_type", (F.col("k") % 20).cast("string")))
    return it.recent_distinct(e, "user_id", "text", "ts")


@query(
    "toggle_state",
    sql="SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS toggles FROM events GROUP BY ALL HAVING count(*) % 2 = 1",
)
def toggle_state(spark, sf):
    return it.toggle_state(events(spark, sf), ["user_id", "k"])


@query(
    "applied_changes",
    sql="WITH b AS (SELECT c_custkey AS user_id, c_name AS name FROM customer), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, "
    "arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1) SELECT coalesce(l.user_id, b.user_id) AS user_id, CASE WHEN l.user_id IS NULL THEN name ELSE "
    "'edit ' || id END AS name FROM b FULL JOIN l USING (user_id) WHERE last IS NULL OR last <> 'error'",
)
def applied_changes(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.to_timestamp(F.lit("2000-01-01")).alias("ts"), F.col("c_name").alias("name")
    )
    log = events(spark, sf).select(
        "user_id", "ts", F.concat_ws(" ", F.lit("edit"), "event_id").alias("name"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op")
    )
    return it.apply_changes(base, log, "user_id", "ts").select("user_id", "name")
