"""Numbering, order keys, null requests, rule packs and stage folders."""

import re

import pytest
from pyspark.sql import functions as F

from sievework.functions import packs
from sievework.operators.consensus import ordered_items
from sievework.operators.ranking import full_row_number, next_value
from sievework.operators.routing import RouteRule, best_scored, route_by_rules
from sievework.session import materialise, release, shared_folder


def test_numbering_of_one_hot_concentrated_key_with_ties(spark):
    rows = [(1, k // 3, f"s{k % 3}") for k in range(3000)] + [(k, 0, "a") for k in range(2, 40)] + [(None, 5, "x"), (None, None, "y")]
    frame = spark.createDataFrame(rows, "k long, pos long, step string").repartition(5)
    got = {(r.k, r.pos, r.step): r.n for r in full_row_number(frame, ["k"], ["pos", "step"], "n").collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        expected |= {r: n + 1 for n, r in enumerate(own)}
    assert got == expected


def test_next_value_of_a_hot_key(spark):
    values = [k * k % 997 for k in range(2000)]
    got = next_value(spark.createDataFrame([(7, v) for v in values], "k int, v int"), ["k"], "v", "after").collect()
    ordered = sorted(values)
    assert sorted((r.v, r.after if r.after is not None else 10**9) for r in got) == sorted(zip(ordered, [*ordered[1:], 10**9]))


def test_large_positions_dont_reach_into_the_rating(spark):
    big = 1 << 45
    frame = spark.createDataFrame([(1, 7, 0), (1, 8, big), (1, 8, big * 9), (1, 8, 1)], "scenario_id int, rating int, pos long")
    got = sorted(ordered_items(frame, F.lit(10)).collect(), key=lambda r: r.rank)
    assert [(r.rating, r.pos) for r in got] == [(8, 1), (8, big), (8, big * 9), (7, 0)]


def _catalogue(spark):
    rows = [(1, "alpha", "alpha x", "asia", "asia", "ring", ["ring"], "old ring", True), (2, "beta", "beta y", None, "", "bolt", ["bolt"], "", False)]
    return spark.createDataFrame(
        rows, "seq long, name string, display string, region string, section string, body_part string, keywords array<string>, indications string, uses_contrast boolean"
    )


def test_requests_with_nulls_are_routed(spark):
    requests = spark.createDataFrame(
        [(1, "ring", "case", "asia"), (2, "ring", None, "asia"), (3, "ring", "case", None), (4, None, None, None)], "rid int, item string, scenario string, region string"
    )
    rule = RouteRule(targets=("alpha",), item_all=("ring",))
    got = route_by_rules(requests, _catalogue(spark), [rule]).collect()
    assert sorted((r.rid, r.entry) for r in got) == [(1, "alpha"), (2, "alpha"), (3, "alpha")]


def test_equal_requests_are_scored_alike(spark):
    requests = spark.createDataFrame(
        [(k, "asia" if k % 2 else None, ["ring", "old"] if k % 3 else ["old", "ring"], k % 5 == 0) for k in range(40)],
        "rid int, region string, terms array<string>, needs_contrast boolean",
    )
    got = {r.rid: (r.entry, r.score) for r in best_scored(requests, _catalogue(spark)).collect()}
    assert len(got) == 40
    for k in range(10, 40):
        assert got[k] == got[k - 10] or k % 3 != (k - 10) % 3
    assert got[1] == got[7] == got[11]


@pytest.mark.parametrize("pack", [name for name in dir(packs) if name.isupper()])
def test_shipped_packs_are_plain_and_compile(pack):
    """No value has stray blanks at line breaks, and every pattern compiles."""

    def strings(x):
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            yield from strings(list(x.items()))
        elif isinstance(x, (list, tuple)):
            for y in x:
                yield from strings(y)

    for value in strings(getattr(packs, pack)):
        assert "- t" not in value and "\n" not in value and "~" not in value
        if "\\b" in value or "(?" in value:
            re.compile(re.sub(r"\\p\{\w+\}", "[a-z]", value))


def test_need_to_know_is_a_clinical_qualifier():
    clinical = next(words for name, _, words in packs.QUALIFIERS if name == "clinical")
    assert "need-to-know" in clinical and "post " in clinical


def test_stages_lie_in_the_configured_folder_and_can_go(spark):
    stage = materialise(spark.range(5), "test")
    assert stage.stage_path.startswith(shared_folder(spark))
    assert stage.count() == 5
    release(stage)
    with pytest.raises(Exception, match="(?i)does not exist|not found"):
        spark.read.parquet(stage.stage_path).count()
