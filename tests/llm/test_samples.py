from sievework.llm.samples import sampled


def test_small_tables_stay_whole_and_large_ones_are_bounded(spark):
    rows = spark.range(20_000)
    assert sampled(rows, 20_000, "id").count() == 20_000
    some = sorted(r.id for r in sampled(rows, 2_000, "id").collect())
    assert 1_500 < len(some) <= 2_000
    assert some == sorted(r.id for r in sampled(rows.repartition(7), 2_000, "id").collect())
    assert sampled(rows.filter("id < 0"), 10, "id").collect() == []
