import datetime as dt
import random

from pyspark.sql import functions as F

from sievework.operators import interactions as it
from sievework.streaming import interactions as st

START = dt.datetime(2024, 1, 1)


def log(n=200, users=3, seed=4):
    rnd = random.Random(seed)
    secs = sorted(rnd.sample(range(0, 4000), n))
    return [(rnd.randrange(users), START + dt.timedelta(seconds=s), rnd.choice(["Aa", "aa", "bb", "c", "dd "])) for s in secs]


def expected_hits(data, ttl):
    stored, out = {}, []
    for u, t, _ in data:
        hit = u in stored and (t - stored[u]).total_seconds() < ttl
        if not hit:
            stored[u] = t
        out.append((u, t, hit))
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame(data, "u int, ts timestamp, q string")


def stream_of(spark, data, folder, parts=3):
    size = -(-len(data) // parts)
    for i in range(parts):
        frame(spark, data[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("u int, ts timestamp, q string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_ttl_batch(spark):
    for ttl in (60, 300, 1000):
        data = log()
        got = sorted((r.u, r.ts, r.hit) for r in it.ttl_dedup(frame(spark, data), "u", "ts", ttl).collect())
        assert got == expected_hits(data, ttl)


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def finished(stream, mode, name):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


END = START + dt.timedelta(days=1)


def test_ttl_stream_of_unordered_batches(spark, tmp_path):
    """Five batches, each shuffled, with requests up to 200 s late; equals the batch result."""
    data = log(120)
    rnd = random.Random(1)
    arrival = sorted(data, key=lambda r: r[1] + dt.timedelta(seconds=rnd.uniform(0, 200)))
    arrival += [(9, END, "end"), (8, END, "end")]
    s = st.ttl_dedup_stream(stream_of(spark, arrival, str(tmp_path / "in"), 5), "u", "ts", 300, "400 seconds")
    query = finished(s, "append", "ttl")
    got = sorted((r.u, r.ts, r.hit) for r in spark.table("ttl").collect() if r.u < 8)
    assert got == expected_hits(data, 300)
    assert len(query.recentProgress) >= 5


def test_ttl_stream_forgets(spark, tmp_path):
    """Once the results have expired, the state of keys 0 to 2 is gone; that of 9 has not expired."""
    data = log(40)
    s = st.ttl_dedup_stream(stream_of(spark, [*data, (9, END, "end"), (9, END, "end")], str(tmp_path / "in"), 3), "u", "ts", 60)
    finished(s, "append", "ttl_state")
    assert sorted((r.u, r.ts, r.hit) for r in spark.table("ttl_state").collect() if r.u < 9) == expected_hits(data, 60)
    checkpoint = str(tmp_path / "ck")
    again = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    again.awaitTermination()
    for name, keys in (("stored", {9}), ("timer", {9})):
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("key.u").collect()
        assert {r.u for r in rows} == keys


def test_late_requests_are_dropped(spark, tmp_path):
    late = [(1, START + dt.timedelta(hours=5), "a"), (1, START + dt.timedelta(hours=6), "a"), (1, START, "a"), (1, START + dt.timedelta(hours=9), "a"), (2, END, "a")]
    s = st.ttl_dedup_stream(stream_of(spark, late, str(tmp_path / "in"), 5), "u", "ts", 60)
    finished(s, "append", "late")
    assert sorted(r.ts.hour for r in spark.table("late").filter("u = 1").collect()) == [5, 6, 9]


def test_debounce_batch(spark):
    data = log()
    got = sorted((r.u, r.ts) for r in it.debounce(frame(spark, data), "u", "ts", 30).collect())
    want = []
    for u in range(3):
        ts = [t for v, t, _ in data if v == u]
        want += [(u, a) for a, b in zip(ts, ts[1:] + [None]) if b is None or (b - a).total_seconds() >= 30]
    assert got == sorted(want)


def test_debounce_stream(spark, tmp_path):
    data = log(80)
    s = st.debounce_stream(stream_of(spark, data, str(tmp_path / "in"), 1), "u", "ts", "30 seconds", "0 seconds")
    st.write_batches(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.u, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.u, r.ts) for r in it.debounce(frame(spark, data), "u", "ts", 30).collect()}
    assert got and got <= batch and len(batch - got) <= 3


def test_recent_and_toggle(spark):
    data = log()
    got = it.recent_distinct(frame(spark, data), "u", "q", "ts", 2).orderBy("u", "rank").collect()
    for u in range(3):
        seen = {}
        for v, t, q in data:
            if v == u and len(q.strip()) >= 2:
                seen[q.strip().lower()] = (t, q.strip())
        want = [x[1] for x in sorted(seen.values(), reverse=True)][:2]
        assert [r.text for r in got if r.u == u] == want
    toggles = {(r.u, r.q) for r in it.toggle_state(frame(spark, data), ["u", "q"]).collect()}
    counts = {}
    for u, _, q in data:
        counts[u, q] = counts.get((u, q), 0) + 1
    assert toggles == {k for k, n in counts.items() if n % 2}


def test_recent_stream_of_unordered_batches(spark, tmp_path):
    data = log(90)
    arrival = data[:]
    random.Random(3).shuffle(arrival)
    s = st.recent_distinct_stream(stream_of(spark, arrival, str(tmp_path / "in"), 4), "u", "q", "ts", 2)
    finished(s, "update", "recent")
    got = {r.u: r.recent for r in spark.table("recent").collect()}  # the last batch of a key comes last
    want = it.recent_distinct(frame(spark, data), "u", "q", "ts", 2).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l"))
    assert got == {r.u: [x.text for x in r.l] for r in want.collect()}


def test_recent_stream_forgets_idle_keys(spark, tmp_path):
    data = [(1, START, "old"), (2, END, "new"), (3, END, "new"), (1, END + dt.timedelta(seconds=5), "back")]
    s = st.recent_distinct_stream(stream_of(spark, data, str(tmp_path / "in"), 4), "u", "q", "ts", 5, "10 seconds", 60)
    finished(s, "update", "idle")
    assert [r.recent for r in spark.table("idle").collect() if r.u == 1] == [["old"], ["back"]]


def test_toggle_stream_keeps_members_only(spark, tmp_path):
    data = log(91)
    s = st.toggle_stream(stream_of(spark, data, str(tmp_path / "in"), 4), ["u", "q"])
    query = finished(s, "update", "toggles")
    last = {(r.u, r.q): r.member for r in spark.table("toggles").collect()}
    members = {(r.u, r.q) for r in it.toggle_state(frame(spark, data), ["u", "q"]).collect()}
    assert {k for k, on in last.items() if on} == members
    assert state_rows(query) == len(members)


def test_changes_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, START, "a"), (2, START, "b")], "id int, ts timestamp, name string")
    later = START + dt.timedelta(hours=1)
    changes = [(2, later, "upsert", "b2"), (1, later, "delete", None), (3, later, "upsert", "c"), (2, later + dt.timedelta(1), "upsert", "b3")]
    spark.createDataFrame(changes, "id int, ts timestamp, op string, name string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id int, ts timestamp, op string, name string").parquet(str(tmp_path / "in"))
    st.write_batches(s, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.id, r.name) for r in st.current_rows(spark, base, str(tmp_path / "log"), "id", "ts").collect())
    assert got == [(2, "b3"), (3, "c")]


def test_scoring_stream(spark, tmp_path):
    from sievework.operators.lexical import keyword_search

    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id int, text string").withColumn("name", F.col("text"))
    spark.createDataFrame([(1, "alpha"), (2, "gamma ray")], "qid int, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("qid int, text string").parquet(str(tmp_path / "in"))
    st.write_batches(s, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: keyword_search(b, corpus)).awaitTermination()
    assert {(r.qid, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1), (2, 2)}
