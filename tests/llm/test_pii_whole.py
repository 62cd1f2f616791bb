"""Beyond the bound the trees and thresholds of ``pii`` come from every candidate, by sums from the tasks."""

import random

import numpy as np

from sievework.llm import pii


def rows(n):
    rng = random.Random(4)
    out = {}
    for k in range(n):
        kind = k % 4
        x = (*[float(kind == j) for j in range(4)], *[float(rng.randint(0, 60)) for _ in range(3)])
        label = int((x[4] > 20) != (x[5] > 30)) if rng.random() < 0.98 else k % 2
        count = 1 + rng.randint(0, 30) * (k % 50 == 0)
        out[x, label] = (list(x), label, kind + 1, count, count // 4 if count > 1 else int(rng.random() < 0.25))
    return list(out.values())


def test_sums_give_the_trees_of_all_candidates(spark):
    data = rows(3_000)
    counted = spark.createDataFrame(data, "x array<double>, label int, kind int, n long, held long").repartition(5)
    x, y = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    rest, held = np.array([r[3] - r[4] for r in data], float), np.array([r[4] for r in data], float)
    for k in range(4):
        rest[x[:, k] > 0] *= min(1.0, 600 / 4 / rest[x[:, k] > 0].sum())
    one = pii.Boosted().fit(x[rest > 0], y[rest > 0], rest[rest > 0])
    all_ = pii.boosted(counted, 600)
    assert np.abs(one.predict(x) - all_.predict(x)).max() < 1e-4
    scores = pii.held_scores(counted, all_)
    assert sum(r.n for r in scores) == held.sum() and sum(r.right for r in scores) == (held * y).sum()


def test_no_candidate_is_left_out_of_a_large_corpus(docs, words, monkeypatch):
    from tests.llm.test_pii import corpus

    met = []
    monkeypatch.setattr(pii, "held_scores", lambda counted, trees, given=pii.held_scores: met.append(counted.count()) or given(counted, trees))
    frame = docs(corpus(words))
    distinct = pii.candidates(frame).count()
    judge = pii.fit(frame, most_candidates=100)
    assert met == [distinct] and distinct > 100
    assert [s[0] for s in pii.find("please call (415) 555-2671 or write", judge)] == ["phone"]
