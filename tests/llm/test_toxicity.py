import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import toxicity


def corpus(words, n=900):
    """A ninth of the texts hold words of a list that no one stated, spread over two made-up languages."""
    rng = random.Random(9)
    bad = [[f"zork{x}" for x in ("a", "en", "ist", "um", "ok", "il")], ["idiot", "moron", "scum", "trash"]]
    texts, toxic = [], []
    for k in range(n):
        ws = words(40, k).split(" ")
        is_toxic = k % 9 == 0
        if is_toxic:
            for w in rng.sample(bad[k % 2], 3):
                ws.insert(rng.randrange(len(ws)), w)
        texts.append(" ".join(ws))
        toxic.append(int(is_toxic))
    return texts, toxic


def test_held_out_accuracy(spark, docs, words):
    texts, toxic = corpus(words)
    frame = docs(texts + [None, ""])
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(toxic)] + [(0, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    rows = frame.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held"), toxicity.score(F.col("text"), model).alias("score")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score >= 0.3, toxic[r.doc_id]) for r in rows if r.held and r.doc_id < len(texts)]
    assert len(held) > 150
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 0.3 for r in rows if r.doc_id >= len(texts))


def test_label_model_finds_rates_and_dependences():
    rng = np.random.default_rng(3)
    n = 60_000
    y = rng.random(n) < 0.2
    fires = rng.random((n, toxicity.N_VOTERS)) < np.where(y[:, None], 0.6, 0.02)
    copied = rng.random(n) < 0.9
    fires[copied, 2] = fires[copied, 1]  # one voter mostly repeats another
    bits = (fires << np.arange(toxicity.N_VOTERS)).sum(axis=1)
    patterns, counts = np.unique(bits, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float), np.zeros((len(patterns), 2)), 0.2)
    assert model.parents[2] == 1 or model.parents[1] == 2
    p = model.posterior(bits)
    assert ((p > 0.5) == y).mean() > 0.98
    assert abs(p.mean() - 0.2) < 0.02


def test_no_rows_and_no_toxic_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs([]), none)
    assert model.classifier.score("some text") < 0.3
    model = toxicity.fit(docs(["a b", None, "c"]), spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int"))
    assert model.classifier.score("") < 0.3


def test_shouting_counts_the_whole_text():
    lexicons = toxicity.lexicons({})
    late, rare = "word " * 300 + "LOUD " * 60, "word " * 3000 + "LOUD " * 60
    assert lexicons.votes(late) != lexicons.votes("word " * 360) == lexicons.votes(rare)


def test_label_model_equals_sums_over_classes():
    rng = np.random.default_rng(5)
    n = toxicity.N_VOTERS
    patterns = np.unique(rng.integers(0, 2**n, 300))
    model = toxicity.fit_label_model(patterns, rng.integers(1, 50, len(patterns)).astype(float), np.zeros((len(patterns), 2)), 0.3)
    for pattern, found in zip(patterns, model.posterior(patterns)):
        joint = [1 - model.prior, model.prior]
        for y in (0, 1):
            for j, parent in enumerate(model.parents):
                rate = model.rates[y, j, pattern >> parent & 1 if parent >= 0 else 0]
                joint[y] *= rate if pattern >> j & 1 else 1 - rate
        assert abs(found - joint[1] / sum(joint)) < 1e-9


def test_own_labels_bear_on_anchors_only(spark, docs, words):
    """Rows whose votes say nothing of toxicity are not learnt as toxic, whatever their own label says."""
    texts, toxic = corpus(words)
    frame = docs(texts)
    wrong = [1 - t if k % 45 == 1 else t for k, t in enumerate(toxic)]  # a fiftieth of the clean rows labelled toxic
    model = toxicity.fit(frame, spark.createDataFrame(list(enumerate(wrong)), "doc_id long, toxic int"))
    scores = [model.classifier.score(t) for t in texts]
    assert sum((s >= 0.3) == bool(t) for s, t in zip(scores, toxic)) / len(texts) > 0.98


def test_repeated_ids_and_large_labels(spark, docs, words):
    texts, toxic = corpus(words, 400)
    twice = docs(texts).unionByName(docs([t + " end" for t in texts]))
    labels = spark.createDataFrame([(k, 3 * t) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    one, two = toxicity.fit(twice, labels), toxicity.fit(twice.repartition(7), labels)
    assert one.classifier.weights == two.classifier.weights
    assert sum((one.classifier.score(t) >= 0.3) == bool(y) for t, y in zip(texts, toxic)) / len(texts) > 0.97
