import random
import re

from pyspark.sql import functions as F

from sievework.llm import minhash


def shingles(text, width):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not ws:
        return set()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


def edited(text, n, seed):
    rng = random.Random(seed)
    ws = text.split(" ")
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"w{rng.randrange(10**6)}"
    return " ".join(ws)


def test_components_equal_brute_force(docs, words):
    base = words(150, 1)
    texts = [None, "", " \n", "one", "ONE", "one two", "one  two", "a b c", "A B c", "ß b c"]
    texts += [edited(base, k % 9, k) for k in range(120)]  # a group of near copies, many too far apart
    texts += [words(60, 100 + k) for k in range(30)] + [words(60, 101), base, base.upper()]
    passage = words(60, 7)
    texts += [f"{passage} {words(60, 500 + k)}" for k in range(25)]  # share a passage, aren't copies
    for width, percent, rows in ((3, 85, 7), (5, 80, 6)):
        got = minhash.near_duplicates(docs(texts), width=width, percent=percent, rows=rows).collect()
        assert [(r.n_shingles, r.component_id) for r in sorted(got, key=lambda r: r.id)] == brute(texts, width, percent)
        assert all(r.kept == (r.id == r.component_id) for r in got)


def test_long_words_and_texts(docs, words):
    long = words(30_000, 2)
    texts = [long, edited(long, 20, 1), "x" * 50_000, "x" * 50_000 + "y", "x" * 50_000]
    got = {r.id: r.component_id for r in minhash.near_duplicates(docs(texts), width=3, percent=85, rows=7).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def test_repeated_rows_null_ids_and_empty_table(docs):
    frame = docs(["a b c d"] * 4 + ["e"], [7, 7, None, 3, 9]).withColumnRenamed("lang", "node").withColumn("label", F.lit(1))
    got = minhash.near_duplicates(frame).collect()
    assert sorted((r.component_id, r.kept) for r in got) == [(3, False), (3, False), (3, False), (3, True), (9, True)]
    assert minhash.near_duplicates(docs([])).collect() == []


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (200, 200)]
    rows = minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_signatures_agree_as_sets_do():
    rng = random.Random(1)
    import numpy as np

    shared = np.array([rng.getrandbits(63) for _ in range(300)], np.uint64)
    other = np.array([rng.getrandbits(63) for _ in range(100)], np.uint64)
    a, b = (minhash.signature(np.concatenate((shared, x)), 512) for x in (other[:50], other[50:]))
    assert abs((a == b).mean() - 300 / 400) < 0.08
