import numpy as np

from sievework.llm import mixing


def brute_targets(sizes, weights, total, most):
    """Water level by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * w, most * s) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(low * w, most * s) for s, w in zip(sizes, weights)]


def test_targets_equal_water_level():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        sizes, weights = rng.integers(1, 1000, n).tolist(), rng.integers(1, 5, n).tolist()
        got = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2)
        assert np.allclose(got, brute_targets(sizes, weights, 1.5 * sum(sizes), 2), rtol=1e-6)


def test_leaves_of_the_tree_hold_the_quotas():
    quotas, shards = [40, 7, 0, 133], 13
    runs = [mixing.shard_quotas(quotas, shards, k, 5) for k in range(shards)]
    for s, quota in enumerate(quotas):
        blocks = sorted(b for run in runs for b in range(run[s][0], run[s][0] + run[s][1]))
        assert blocks == list(range(quota))
    totals = [sum(n for _, n in run) for run in runs]
    assert max(totals) - min(totals) <= 4


def test_mix_meets_targets_and_repeats(docs, words):
    texts = [words(5 + k % 40, k) for k in range(800)] + [None, "", " "]
    frame = docs(texts).withColumnRenamed("n_chars", "s").withColumnRenamed("lang", "place")
    sizes = mixing.sized(frame).cache()
    runs = []
    for partitions in (3, 7):
        draws, sources = mixing.mix(sizes.repartition(partitions), block_words=256, shard_words=4096)
        runs.append(sorted((r.doc_id, r.copy, r.shard, r.slot) for r in draws.collect()))
    assert runs[0] == runs[1]
    assert len({r[2] for r in runs[0]}) > 3
    assert len({r[:2] for r in runs[0]}) == len(runs[0])
    target = {r.source: (r.source_size, r.target) for r in sources.collect()}
    of = {r.doc_id: (r.source, r.size) for r in sizes.collect()}
    taken = dict.fromkeys(target, 0)
    for doc_id, *_ in runs[0]:
        taken[of[doc_id][0]] += of[doc_id][1]
    assert abs(sum(t for _, t in target.values()) - 1.5 * sum(n for n, _ in target.values())) < 1e-6
    for source, (_, wanted) in target.items():
        assert abs(taken[source] - wanted) <= 45
    assert max(r[1] for r in runs[0]) <= 2


def test_empty_table_and_words_nowhere(docs):
    draws, sources = mixing.mix(mixing.sized(docs([])))
    assert draws.collect() == [] and sources.collect() == []
    draws, sources = mixing.mix(mixing.sized(docs([None, ""])))
    assert draws.collect() == [] and len(sources.collect()) == 2


def test_repeated_and_null_ids_get_their_own_share(docs, words):
    from collections import Counter

    texts = [words(3 + k % 9, k) for k in range(400)] + ["a b c d"] * 2 + ["e f"] * 3
    ids = [None if k % 3 == 0 else k // 2 for k in range(400)] + [1000, 1000, None, None, None]
    frame = docs(texts, ids)
    sizes = mixing.sized(frame).cache()
    draws, sources = mixing.mix(sizes, block_words=64, shard_words=1024)
    drawn = draws.collect()
    rows = Counter((r.doc_id, r.source, r.mark, r["size"]) for r in sizes.collect())
    copies = Counter((r.doc_id, r.source, r.mark, r["size"], r["copy"]) for r in drawn)
    assert all(n == rows[key[:4]] and key[4] < 2 for key, n in copies.items())  # each row once per copy, at most twice
    for source, _, target in sources.collect():
        assert abs(sum(r["size"] for r in drawn if r.source == source) - target) <= 22
