import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from sievework.llm import sketch_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    rows = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words_of(text) if w in c)
            if score > 0:
                scored.append((-score, i is None, i))
        rows += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def found(spark, docs, items, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = sketch_search.ranked_search(frame.selectExpr("*", "1 as score", "2 as item"), asked.selectExpr("*", "3 as rank"), **how)
    return sorted((tuple(r) for r in rows.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    hostile = "A_b\x00cÉD-9\x7fz  q  \U0001f600x﻿[]`{|}~@"
    assert [w.decode() for w in sketch_search.terms(hostile.encode())] == words_of(hostile)
    assert sketch_search.terms(None) == sketch_search.terms(b"") == sketch_search.terms(b" .,\n") == []


@pytest.mark.parametrize("width", [1, 64, 1024])
def test_equals_brute_force(spark, width):
    rng = random.Random(8)
    stock = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)]
    docs = [(k, " ".join(rng.choices(stock, k=rng.choice([1, 5, 40, 300])))) for k in range(150)]
    docs += [(1000 - k, docs[5][1]) for k in range(40)]  # a group of copies with equal scores
    docs += [(2000, None), (2001, ""), (2002, "... !"), (None, docs[5][1]), (None, "w1"), (5, docs[5][1]), (2003, "W1 " * 60_000 + "café CAFÉ")]
    items = [(k, " ".join(rng.choices(stock, k=rng.choice([1, 8, 30])))) for k in range(12)]
    items += [(50, docs[5][1]), (51, None), (52, "?"), (53, "nowhere"), (54, "café w1 w1"), (None, "w2"), (54, "w7")]
    assert found(spark, docs, items, width=width) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(sketch_search, "BLOCK_BYTES", 8)
    docs, items = [(k, f"a{k % 3} b{k % 5} c") for k in range(30)], [(k, f"a{k % 3} c b1") for k in range(6)]
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_tables_without_rows(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_are_never_below_scores():
    rng = random.Random(2)
    counts = [Counter(f"w{rng.randrange(60)}".encode() for _ in range(rng.choice([1, 9, 80]))) for _ in range(50)]
    factors = np.array([sketch_search.length_factor(sum(c.values()), 50, 1500) for c in counts])
    for width in (1, 8, 4096):
        folded = sketch_search.sketches(counts, factors, width)
        for word in (f"w{k}".encode() for k in range(70)):
            exact = [sketch_search.impact(c[word], int(m)) if word in c else 0 for c, m in zip(counts, factors, strict=True)]
            assert (folded[crc32(word) % width] >= exact).all()
