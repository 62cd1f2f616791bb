"""Conflict flags, registry names, previews, named predicates and full lists."""

from pyspark.sql import functions as F

from sievework.functions import packs
from sievework.functions.text import canonical_name
from sievework.operators import concepts, consensus, routing


def test_conflicts(spark):
    rows = spark.createDataFrame(
        [
            (1, ["tumor"], 1, "MRI spine"), (2, ["infection"], 0, "MRI foot"), (3, ["infection"], None, "CT W/WO"), (4, ["infection"], 1, "CT"), (5, None, 0, "MRI spine"),
            (6, ["infection"], None, None),
        ],
        "id int, contexts array<string>, contrast int, item string",
    )
    got = {r.id: (r.cross_region, r.contrast_mismatch) for r in routing.conflicts(rows, F.contains("item", F.lit("spine"))).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, True)}


def test_canonical_names(spark):
    rows = spark.createDataFrame([("  MRI Head  without IV contrast",), ("CT lumbar   spine with IV contrast",), ("Headache without and with IV contrast",), (None,)], "n string")
    got = [r[0] for r in rows.select(canonical_name(F.col("n"), packs.REGISTRY_CONTRAST, packs.REGISTRY_PARTS)).collect()]
    # words that stand together with single blanks count; "with IV contrast" wins over the longer wording
    assert got == ["mri brain wo_contrast", "ct lumbar spine w_contrast", "headache without and w_contrast", None]


def test_preview(spark):
    rows = [(1, i, "b" if i < 3 else "a", i) for i in range(1, 9)] + [(2, 5, None, 1)]
    got = {r.concept_id: (r.total, r.regions, r.ids) for r in concepts.mapping_preview(spark.createDataFrame(rows, "concept_id int, id int, region string, rank int")).collect()}
    assert got == {1: (8, ["b", "a"], [1, 2, 3, 4, 5]), 2: (1, [], [5])}


def test_named_predicates(spark):
    rows = spark.createDataFrame([("MRI", None), ("CT", "mrcp of"), ("x", "MR brain"), ("x", "amr"), (None, "y")], "m string, n string")
    assert [r[0] for r in rows.select(consensus.is_named_mri(F.col("m"), F.col("n"))).collect()] == [True, True, True, False, False]


def test_rated_lists_of_a_hot_scenario(spark):
    rows = spark.range(5000).selectExpr("0 AS scenario_id", "id AS pos", "concat('i', id) AS item", "cast(id % 10 AS int) AS rating")
    got = consensus.rated_lists(rows).collect()
    high = sorted((r["rank"], r.rating) for r in got if r.band == "high")
    assert [r for r, _ in high] == list(range(1, 1501)) and [x for _, x in high] == [9] * 500 + [8] * 500 + [7] * 500
    assert len(got) == 2500
