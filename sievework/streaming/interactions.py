"""The interaction-log behaviours on unbounded input, and micro-batch scoring of arriving queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.interactions import apply_changes


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """(key, ts, n) of the last event per burst, emitted when the watermark passes the burst."""
    return (
        events.withWatermark(ts, watermark)
        .groupBy(F.col(key), F.session_window(ts, gap))
        .agg(F.max(ts).alias("_last"), F.count("*").alias("n"))
        .select(key, F.col("_last").alias(ts), "n")
    )


class _Toggles(StatefulProcessor):
    """Keeps the keys that are members only: a key toggled off is as if it had never been there."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.member = handle.getValueState("member", "on boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        odd = sum(len(frame) for frame in rows) % 2 == 1
        on = self.member.exists() != odd
        if on:
            self.member.update((True,))
        else:
            self.member.clear()
        yield pd.DataFrame({**{name: [value] for name, value in zip(self.keys, key, strict=True)}, "member": [on]})

    def close(self) -> None:
        pass


def toggle_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, member) of the key tuples toggled in a micro-batch, for update mode. State holds the members."""
    fields = [events.schema[k] for k in keys]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("member", T.BooleanType())])
    return events.select(*keys).groupBy(*keys).transformWithStateInPandas(_Toggles(keys), schema, "Update", "None")


class _TtlCache(StatefulProcessor):
    """Requests of a key wait in a list until the watermark has passed them, and are then answered in the order of their
    times, however they arrived. One timer per key: for the earliest waiting request or, if none waits, the expiry of the
    stored result, which empties the state."""

    def __init__(self, key: str, ttl: int):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint")
        self.stored = handle.getValueState("stored", "at bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _remind(self, at: int | None) -> None:
        """One timer, at microseconds ``at`` rounded up."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))
            self.timer.update((-(-at // 1000),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        new = [int(at) for frame in rows for at in frame.iloc[:, -1] if at >= now]  # older ones come too late
        if new:
            self.waiting.appendList([(at,) for at in new])
            due = self.timer.get()[0] * 1000 if self.timer.exists() else None
            if due is None or min(new) < due:
                self._remind(max(min(new), now + 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = sorted(at for (at,) in self.waiting.get()) if self.waiting.exists() else []
        due = [at for at in waiting if at <= now]
        later = waiting[len(due) :]
        stored = self.stored.get()[0] if self.stored.exists() else None
        hits = []
        for at in due:
            hit = stored is not None and at - stored < self.ttl
            stored = stored if hit else at
            hits.append(hit)
        if later:
            self.waiting.put([(at,) for at in later])
        else:
            self.waiting.clear()
        expired = stored is None or stored + self.ttl <= now
        if expired:
            self.stored.clear()
        else:
            self.stored.update((stored,))
        self._remind(later[0] if later else None if expired else stored + self.ttl)
        if due:
            yield pd.DataFrame({self.key: [key[0]] * len(due), "_us": due, "hit": hits})

    def close(self) -> None:
        pass


def ttl_dedup_stream(events: DataFrame, key: str, ts: str, ttl_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """(key, ts, hit) for append mode, in the order of event times: a request is answered when the watermark passes it.

    Requests that come later than ``watermark`` allows are dropped. A key's state goes when its stored result has expired
    and no request waits. Needs the RocksDB state store."""
    timed = events.withWatermark(ts, watermark).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("_us", T.LongType()), T.StructField("hit", T.BooleanType())])
    answered = timed.groupBy(key).transformWithStateInPandas(_TtlCache(key, ttl_seconds * 1_000_000), schema, "Append", "EventTime")
    return answered.select(key, F.timestamp_micros("_us").alias(ts), "hit")


class _Recent(StatefulProcessor):
    """The ``n`` newest distinct texts of a key, by event time whatever order they arrive in; a key without new texts for
    ``idle`` is forgotten."""

    def __init__(self, key: str, n: int, idle: int | None):
        self.key, self.n, self.idle = key, n, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "low string", "at bigint, text string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {low: value for (low,), value in self.seen.iterator()} if self.seen.exists() else {}
        before = set(seen)
        changed: set[str] = set()
        for frame in rows:
            for text, at in zip(frame.iloc[:, -3], frame.iloc[:, -1], strict=True):  # columns come by place
                text = (text or "").strip()
                if len(text) >= 2 and (text.lower() not in seen or seen[text.lower()][0] <= at):
                    seen[text.lower()] = (int(at), text)
                    changed.add(text.lower())
        newest = sorted(seen, key=lambda low: (-seen[low][0], low))[: self.n]
        for low in newest:
            if low in changed:
                self.seen.updateValue((low,), seen[low])
        for low in before - set(newest):
            self.seen.removeKey((low,))
        if newest and self.idle is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            due = max(-(-(seen[newest[0]][0] + self.idle) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame({self.key: [key[0]], "recent": [[seen[low][1] for low in newest]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_distinct_stream(events: DataFrame, key: str, text: str, ts: str, n: int = 10, watermark: str = "0 seconds", idle_seconds: int | None = None) -> DataFrame:
    """(key, recent): the newest distinct texts of a key after each micro-batch, for update mode; state holds ``n`` texts.

    With ``idle_seconds`` a key is forgotten when the watermark is that far past its newest text; texts later than
    ``watermark`` allows are dropped then. Needs the RocksDB state store."""
    timed = events if idle_seconds is None else events.withWatermark(ts, watermark)
    rows = timed.select(key, text, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    schema = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("recent", T.ArrayType(T.StringType()))])
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    return rows.groupBy(key).transformWithStateInPandas(_Recent(key, n, idle), schema, "Update", "None" if idle is None else "EventTime")


def write_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that writes every micro-batch to its own folder. A repeated batch overwrites its
    folder, so the result holds each batch once. ``transform`` may be any batch operator, which is how
    ranked searches score an arriving query stream against stored corpus tables."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, base: DataFrame, log_path: str, key: str, ts: str) -> DataFrame:
    """Rows after the change log written by ``write_batches``."""
    return apply_changes(base, spark.read.parquet(log_path).drop("batch"), key, ts)


def exact_lookup_stream(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Stream-static join of arriving queries with the stored synonym table."""
    from ..operators.lookup import normalise_queries, resolve_exact

    return resolve_exact(normalise_queries(queries), synonyms)
