import random
import re

from sievework.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 14 <= len(digits) <= 19 and pii.luhn(digits)
            else:
                ok = kind == "email" or 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def base(text):
    found = [m for m in pii.base_matches(text or "") if m[3]]
    return [(k, a, b) for a, b, k, _ in sorted(found, key=lambda m: (m[0], pii.KINDS.index(m[2])))]


def test_base_rules_equal_plain_patterns():
    rng = random.Random(6)
    letters = "ab1.2@-+() 3,9\né"
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert base(text) == brute(text), text
    for text in ["1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "x@y..z a@b.c.", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 123-4567 8", "255.256.1.1"]:
        assert base(text) == brute(text)


def test_scans_are_linear():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "+1" + "(" * 200_000, "a at " * 50_000, "1-" * 100_000):
        pii.base_matches(text)
        pii.proposals(text)
        pii.bare_numbers(text)


def corpus(words, n=300):
    rng = random.Random(2)
    texts = []
    for k in range(n):
        text = words(30, k)
        spans = [
            f"user.{k}@mail{k % 7}.example.com", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", "4111 1111 1111 1111",
            f"order {rng.randint(10**13, 10**14)}", f"version {k}.{k}", f"{rng.randint(1900, 2100)}-{k % 12}-01 {rng.randint(10**6, 10**9)}",
        ]
        texts.append(f"{text} {spans[k % len(spans)]} {words(10, 1000 + k)}")
    return texts


def test_added_spans_and_base_spans(docs, words):
    texts = corpus(words) + [None, "", "x" * 100_000]
    frame = docs(texts)
    judge = pii.fit(frame)
    asked = texts + ["please call (415) 555-2671 or write", "host 10[.]1[.]2[.]3 is up", "pay with 4539/5787/6362/1486 today", words(200, 77)]
    for text in asked:
        found = pii.find(text, judge)
        assert [(k, a, b) for k, a, b, ok, _ in found if ok] == brute(text)
    assert [s[0] for s in pii.find(asked[-4], judge)] == ["phone"]
    assert [s[0] for s in pii.find(asked[-3], judge)] == ["ip"]
    assert pii.find(asked[-1], judge) == []


def test_tied_vectors_are_learnt_from(docs, words):
    """Many candidates of few distinct vectors: none of the kinds is lost, and a hot vector doesn't take all the room."""
    texts = ["call +1 (415) 555-2671 now", "host 10.1.2.3 is up", "host 1.2.300.4 is down", "write to a.b@mail.example.com today"] * 1_000
    texts += ["order 12345678901234 of 2020"] * 2_000 + corpus(words)
    judge = pii.fit(docs(texts), most_candidates=300)
    assert all(judge.thresholds[kind] <= 1 for kind in ("email", "ip", "phone"))
    assert [s[0] for s in pii.find("call (415) 555-2671 now", judge)] == ["phone"]
    assert [s[0] for s in pii.find("host 10[.]1[.]2[.]3 is up", judge)] == ["ip"]
    assert [s[0] for s in pii.find("write to a dot b at mail dot example dot com today", judge)] in ([], ["email"])


def test_weighted_vectors_keep_hot_ones_and_sums(spark):
    rows = [([float(k), 0.0], k % 2, 1 + k % 2, 1, 0) for k in range(5_000)] + [([-1.0, 0.0], 1, 1, 100_000, 25_000)] + [([-2.0, float(k)], 0, 3, 1, 0) for k in range(7)]
    counted = spark.createDataFrame(rows, "x array<double>, label int, kind int, n long, held long")
    whole = pii.weighted(counted, 6_000).collect()
    assert len(whole) == len(rows) and {r.scale for r in whole} == {1.0}
    some = pii.weighted(counted, 1_000).collect()
    assert 700 < len(some) <= 1_000
    assert sum(r.kind == 3 for r in some) == 7 and [(r.n, r.scale) for r in some if r.x[0] == -1] == [(100_000, 1.0)]
    assert abs(sum(r.n * r.scale for r in some) - 105_007) < 1_000


def test_equal_scores_pass_together():
    import numpy as np

    x = np.array([[1.0, 0, 0, 0]] * 2)
    assert pii.calibrated(pii.Boosted(), x, np.array([1.0, 0.0]), 0.9, np.array([3.0, 1.0]))["email"] == 2.0
    assert pii.calibrated(pii.Boosted(), x, np.array([1.0, 0.0]), 0.9, np.array([99.0, 1.0]))["email"] == 0.5


def test_columns_and_redaction(docs, words):
    from pyspark.sql import functions as F

    texts = ["mail a@b.example now", None, "", "no data"]
    judge = pii.Judge(pii.Boosted(), dict.fromkeys(pii.KINDS, 2.0))
    frame = docs(texts).withColumn("found", pii.spans(F.col("text"), judge))
    rows = sorted(frame.withColumn("clean", pii.redacted(F.col("text"), F.col("found"))).collect(), key=lambda r: r.doc_id)
    assert [r.clean for r in rows] == ["mail [email] now", None, "", "no data"]
    assert [len(r.found) for r in rows] == [1, 0, 0, 0]


def test_nothing_to_learn(docs):
    judge = pii.fit(docs([]))
    assert pii.find("a@b.cd 10[.]1[.]2[.]3", judge) == [("email", 0, 6, True, 1.0)]


def test_trees_learn_an_interaction():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 6)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    x[:, 5] += rng.random(2000)
    assert ((pii.Boosted().fit(x, y).predict(x) > 0.5) == y).mean() > 0.99


def test_every_form_is_found_and_many_spans_are_told_apart(docs, words):
    judge = pii.fit(docs(corpus(words)))
    asked = {
        "email": ["write to info at firma dot com today", "mail anna[at]firma[dot]org now", "mail anna (at) firma.net now"],
        "ip": ["host 10[.]1[.]2[.]3 is up", "host 10(.)1(.)2(.)3 is up"],
        "card": ["pay with 4539/5787/6362/1486 today", "pay with 4539_5787_6362_1486 today", "pay with 4539.5787.6362.1486 today"],
        "phone": ["call (415) 555-2671 now", "call 415-555-2671 now"],
    }
    assert all([s[0] for s in pii.find(text, judge)] == [kind] for kind, texts in asked.items() for text in texts)
    many = " and ".join(asked["phone"][:1] * 3000 + ["+1 415 555 2671"] * 3000)
    found = [(a, b) for _, a, b, _, _ in pii.find(many, judge)]
    assert len(found) == 6000 and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
