import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import sharding


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_once_and_steps_to_neighbours(dimensions, bits):
    cells = np.indices((1 << bits,) * dimensions).reshape(dimensions, -1)
    places = sharding.hilbert_places(cells, bits)
    assert sorted(places.tolist()) == list(range(cells.shape[1]))
    along = cells[:, np.argsort(places)]
    assert (np.abs(np.diff(along, axis=1)).sum(axis=0) == 1).all()


def rows_of(n, seed=4):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice(["en", "de", None]), int(10 * rng.paretovariate(2)), "s") for k in range(n)]
    return rows + [rows[0]] * 30 + [(None, None, None, 1, "t")] * 3


SCHEMA = "doc_id long, source string, lang string, size long, shard string"


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_laws_slots_and_order(spark, law):
    rows = rows_of(700)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.hilbert_shards(docs, ["source", "lang", "size"], 16, law, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.source, r.lang, r["size"]) for r in got) == Counter(r[:4] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(16)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    ends = [(min(r.curve for r in by[k]), max(r.curve for r in by[k])) for k in range(16)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))  # runs of the curve
    if law == "rows":
        counts = [len(s) for s in by.values()]
        assert max(counts) - min(counts) <= 1
    else:
        share = sum(r[3] for r in rows) / 16
        assert all(abs(sum(r["size"] for r in s) - share) <= max(r[3] for r in rows) for s in by.values())
    again = sharding.hilbert_shards(docs.repartition(3), ["source", "lang", "size"], 16, law, ["doc_id"]).collect()
    assert {(r.doc_id, r["shard"], r.slot) for r in again if r.doc_id} == {(r.doc_id, r["shard"], r.slot) for r in got if r.doc_id}


def brute_places(rows, bits):
    def cells(values):
        known = sorted(v for v in values if v is not None)
        counts, before, firsts = Counter(known), 0, {}
        for v in sorted(counts):
            firsts.setdefault((2 * before + counts[v]) * (2**bits - 1) // (2 * len(known)), v)
            before += counts[v]
        return [0 if v is None else sum(b <= v for b in firsts.values()) for v in values]

    grid = np.array([cells([r[k] for r in rows]) for k in (1, 2, 3)])
    return sharding.hilbert_places(grid, bits)


def test_places_equal_brute_force(spark):
    rows = rows_of(200, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = docs.select("doc_id", "source", "lang", "size", sharding.place(docs, ["source", "lang", "size"], 4).alias("p")).collect()
    want = Counter(zip((r[:4] for r in rows), brute_places(rows, 4).tolist(), strict=True))
    assert Counter(((r.doc_id, r.source, r.lang, r["size"]), r.p) for r in got) == want


def test_ranges_prune_shards_in_every_dimension(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, rng.random(), rng.random(), rng.random()) for k in range(4000)], "doc_id long, x double, y double, z double")
    dealt = sharding.hilbert_shards(docs, ["x", "y", "z"], 64, ties=["doc_id"])
    ranges = sharding.shard_ranges(dealt, ["x", "y", "z"])
    for d in "xyz":  # an order by one dimension would read all 64 for the two others
        assert sharding.matching_shards(ranges, {d: (0.0, 0.2)}).count() <= 32
    box = {d: (0.4, 0.45) for d in "xyz"}
    touched = {r.shard for r in sharding.matching_shards(ranges, box).collect()}
    inside = dealt.filter(" and ".join(f"{d} between 0.4 and 0.45" for d in "xyz")).select("shard").distinct().collect()
    assert {r.shard for r in inside} <= touched and len(touched) <= 16
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select(F.countDistinct("shard")).first()[0] == 64


def test_few_rows_no_rows_and_nulls(spark):
    def dealt(rows, law):
        return sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA), ["source", "size"], 16, law, ["doc_id"])

    for law in ("rows", "bytes"):
        assert dealt([], law).count() == 0 and {"curve", "shard", "slot"} <= set(dealt([], law).columns)
        got = dealt([(1, None, None, None, "x"), (2, "a", None, 5, "x")] if law == "rows" else [(1, None, None, 0, "x"), (2, "a", None, 5, "x")], law).collect()
        assert len(got) == 2 and all(0 <= r["shard"] < 16 for r in got)
    nan = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "doc_id long, x double")
    assert [r.doc_id for r in sharding.hilbert_shards(nan, ["x"], 3, ties=["doc_id"]).orderBy("shard").collect()] == [3, 2, 1]


def test_too_many_bits_and_unknown_laws(spark):
    docs = spark.range(1)
    with pytest.raises(ValueError):
        sharding.place(docs, ["id"] * 8, 8)
    with pytest.raises(ValueError):
        sharding.hilbert_shards(docs, ["id"], 2, "size")
