import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import automaton, cards, catalogue, concepts, consensus, lexical, lookup, routing, termscan, titles, vector
from sievework.operators.containment import phrase_pairs, skew_join, words_containing, words_within
from sievework.operators.ranking import full_row_number, next_value


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    return sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(120)} | {"x" * 70, "ab" * 40})


@pytest.fixture(params=["automaton", "split automaton", "joins"])
def way(request, monkeypatch):
    """Dictionaries of any size: one scan, several scans, or the joins beyond them."""
    if request.param == "split automaton":
        monkeypatch.setattr(automaton, "MOST_CHARS", 40)
        monkeypatch.setattr(automaton, "MOST_SCANS", 1000)
    elif request.param == "joins":
        monkeypatch.setattr(automaton, "MOST_SCANS", 0)


def test_words_containing(spark, words, way):
    needles = words[::3] + ["a", "ab", "zz"]
    got = rows(words_containing(spark.createDataFrame([(w,) for w in set(needles)], "needle string"), spark.createDataFrame([(w,) for w in words], "word string")), "needle", "word")
    assert got == sorted((n, w) for n in set(needles) for w in words if n in w)


def test_words_within(spark, words):
    terms = words[::4] + ["ab" * 40, "x" * 70]
    got = rows(words_within(spark.createDataFrame([(w,) for w in set(terms)], "term string"), spark.createDataFrame([(w,) for w in words], "word string")), "term", "word")
    assert sorted(set(got)) == sorted((t, w) for t in set(terms) for w in words if w in t)


@pytest.mark.parametrize("whole", [False, True])
def test_phrase_pairs(spark, whole, way):
    rnd = random.Random(9)

    def text(n):
        return " ".join("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(n))

    needles = [(i, text(rnd.randint(1, 4))) for i in range(40)]
    texts = [(i, text(rnd.randint(1, 12))) for i in range(30)]
    got = rows(phrase_pairs(spark.createDataFrame(needles, "nid int, needle string"), spark.createDataFrame(texts, "tid int, text string"), whole), "nid", "tid")
    pad = (lambda s: f" {s} ") if whole else (lambda s: s)
    assert got == sorted((n, t) for n, a in needles for t, b in texts if pad(a) in pad(b))


def test_skew_join_matches_plain(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    want = rows(big.join(small, "k"), "k", "id", "v")
    assert rows(skew_join(big, small, "k", F.col("id"), [1, 2]), "k", "id", "v") == want


def test_full_row_number_and_next(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("aab"), v) for v in rnd.sample(range(10_000), 400)]
    df = spark.createDataFrame(data, "k string, v long")
    got = {(r.k, r.v): r["rank"] for r in full_row_number(df, ["k"], "v").collect()}
    nxt = {(r.k, r.v): r.n for r in next_value(df, ["k"], "v", "n").collect()}
    for key in "ab":
        vs = sorted(v for k, v in data if k == key)
        assert [got[key, v] for v in vs] == list(range(1, len(vs) + 1))
        assert [nxt[key, v] for v in vs] == vs[1:] + [None]


def synonyms(spark):
    data = [(0, "PE", "pe"), (1, "mass", "mass"), (2, "renal mass", "kidney"), (3, "appendicitis", "app"), (4, "osteomyelitis", "bone"), (5, "vertebral osteomyelitis", "spine"), (6, "mass", "mass2")]
    return spark.createDataFrame(data, "seq int, synonym string, concept_id string")


def test_lookup_cascade(spark):
    q = spark.createDataFrame(
        [(1, "pe"), (2, "pseudotumor cerebri"), (3, "adrenal mass"), (4, "vertebral osteomyelitis t5"), (5, "appendicitus"), (6, "zzz")], "qid int, text string"
    )
    got = {r.qid: (r.concept_id, r.stage) for r in lookup.resolve(q, synonyms(spark), "longest").collect()}
    assert got == {1: ("pe", "exact"), 3: ("mass2", "substring"), 4: ("spine", "substring"), 5: ("app", "fuzzy")}
    first = {r.qid: r.concept_id for r in lookup.resolve(q, synonyms(spark), "first").collect()}
    assert first[3] == "mass2" and first[4] == "bone"


def test_near_words(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (5, 6, 20, 31, 32, 33, 34, 60, 90)]

    def edits(w):
        i = rnd.randrange(len(w))
        return [w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], w]

    others = sorted({e for w in base for e in edits(w) + edits(w)})
    got = rows(lookup.near_words(spark.createDataFrame([(w,) for w in base], "word string"), spark.createDataFrame([(w,) for w in others], "word string")), "word", "near", "distance")

    def lev(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            prev, d = d, np.zeros(len(b) + 1, int)
            d[0] = i
            for j, y in enumerate(b, 1):
                d[j] = min(prev[j] + 1, d[j - 1] + 1, prev[j - 1] + (x != y))
        return int(d[-1])

    assert got == sorted((a, b, lev(a, b)) for a in base for b in others if lev(a, b) <= 1)


def test_keyword_search_phrase_and_boost(spark):
    corpus = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet soup"), (3, "x y")], "id int, text string").withColumn("name", F.col("text"))
    q = spark.createDataFrame([(1, "alpha"), (2, "x y")], "qid int, text string")
    boosted = spark.createDataFrame([(2,), (3,)], "id int")
    got = rows(lexical.keyword_search(q, corpus, boosted=boosted), "qid", "id", "score")
    # query 2 has no word of two characters: only the phrase scores
    assert got == [(1, 1, 18), (1, 2, 18), (2, 3, 17)]


def test_dictionary_scan_of_nulls_and_ties(spark):
    needles = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b c")], "nid int, needle string")
    texts = spark.createDataFrame([("x", "aa b c"), ("y", None), ("z", ""), ("x", "b  c a")], "tid string, text string")
    assert rows(automaton.contained(needles, texts), "nid", "tid") == [(1, "x"), (1, "x"), (2, "x"), (2, "x"), (5, "x")]
    assert rows(automaton.contained(needles, texts, True), "nid", "tid") == [(1, "x"), (2, "x"), (5, "x")]
    assert automaton.contained(needles.filter("nid > 9"), texts).collect() == []


def brute_keyword(docs, queries, k, boosted):
    out = []
    for q, text in queries:
        terms = {w for w in text.split(" ") if len(w) >= 2}
        scored = []
        for d, name in docs:
            words = {w for w in name.split(" ") if len(w) >= 2}
            score = sum(3 if w == t else 1 for w in words for t in terms if w in t or t in w) + 15 * (text in name)
            if score:
                scored.append((-score - 2 * (d in boosted), d))
        out += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 3])
def test_keyword_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(termscan, "QUERY_BLOCK", block)
    monkeypatch.setattr(termscan, "KEPT_WORDS", 5)
    monkeypatch.setattr(termscan, "SLICE", 7)
    rnd = random.Random(6)

    def text(n):
        return " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(n))

    docs = [(k, text(rnd.randint(1, 12))) for k in range(90)]
    docs += [(200 + k, docs[3][1]) for k in range(20)]
    queries = [(k, text(rnd.randint(1, 4))) for k in range(10)] + [(10, docs[3][1]), (11, "zz"), (12, "a")]
    corpus = spark.createDataFrame([(d, n, n) for d, n in docs], "id int, name string, text string").repartition(4)
    flag = spark.createDataFrame([(d,) for d in range(0, 300, 7)], "id int")
    got = rows(lexical.keyword_search(spark.createDataFrame(queries, "qid int, text string"), corpus, boosted=flag, k=5), "qid", "id", "score", "rank")
    assert got == brute_keyword(docs, queries, 5, set(range(0, 300, 7)))


def test_searches_of_nothing_and_of_documents(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, "alpha", "alpha")], "id int, name string, text string")
    none = spark.createDataFrame([], "qid int, text string")
    assert lexical.keyword_search(none, corpus).collect() == lexical.bm25_search(none, corpus).collect() == []
    one = spark.createDataFrame([(1, "alpha"), (2, None)], "qid int, text string")
    assert lexical.keyword_search(one, corpus.filter("id > 1")).collect() == lexical.bm25_search(one, corpus.filter("id > 1")).collect() == []
    monkeypatch.setattr(termscan, "QUERY_CHARS", 3)
    with pytest.raises(ValueError):
        lexical.keyword_search(one, corpus)


def test_bm25_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(termscan, "QUERY_BLOCK", 4)
    rnd = random.Random(7)
    docs = [(k, " ".join(rnd.choice(["aa", "bb", "cc", "dd", f"w{k % 13}"]) for _ in range(rnd.randint(1, 30)))) for k in range(80)]
    docs += [(200 + k, docs[0][1]) for k in range(12)]
    queries = [(k, " ".join(rnd.sample(["aa", "bb", "cc", "dd", "w1", "w5", "nowhere"], 3))) for k in range(9)]
    n, avgdl = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    df = {w: sum(w in t.split() for _, t in docs) for w in {w for _, t in docs for w in t.split()}}
    want = []
    for q, text in queries:
        scored = []
        for d, t in docs:
            w = t.split()
            s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / avgdl)) for x in set(text.split()) if x in w)
            if s:
                scored.append((-round(s, 9), d))
        want += [(q, d, r + 1) for r, (_, d) in enumerate(sorted(scored)[:10])]
    got = lexical.bm25_search(spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(docs, "id int, text string").repartition(3))
    assert rows(got, "qid", "id", "rank") == sorted(want)


def test_bm25_fuzzy_retry(spark):
    corpus = spark.createDataFrame([(1, "vertebra fracture"), (2, "knee pain")], "id int, text string")
    q = spark.createDataFrame([(1, "knee"), (2, "fractura"), (3, "(knee)")], "qid int, text string")
    got = rows(lexical.bm25_search(q, corpus), "qid", "id", "stage")
    assert got == [(1, 2, "plain"), (2, 1, "fuzzy"), (3, 2, "stripped")]


def test_vector_topk_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 6)) * np.array([3, 1, 1, 1, 1, 1])
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(600 + i, base[i].tolist()) for i in range(20)]
    monkeypatch.setattr(vector, "BLOCK_ROWS", 64)
    df = spark.createDataFrame(data, "id int, vector array<double>")
    got = vector.vector_topk(df.withColumnRenamed("id", "qid"), df, 5, skip_self=True).collect()
    m = np.array([v for _, v in data])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -9)
    assert len(got) == 5 * len(data)
    for r in got[:400]:
        assert abs(np.sort(sims[r.qid])[::-1][r["rank"] - 1] - r.score) < 1e-9


def test_vector_topk_cells_recall(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 256)
    folder = "/root/testdata/sf0.1/embeddings.parquet"
    v = spark.read.parquet(folder).selectExpr("vec_id as id", "embedding as vector")
    q = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    exact, near = (rows(vector.vector_topk(q, v, 10, True, m), "qid", "id") for m in ("exact", "cells"))
    assert len(exact) == len(near) == 1000
    assert len(set(exact) & set(near)) >= 900
    with pytest.raises(ValueError):
        vector.vector_topk(q, v, method="hash")


def test_greedy_duplicates(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("gh"), "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))), i) for i in range(150)]
    got = rows(titles.drop_equivalent(spark.createDataFrame(data, "g string, k string, seq int"), "g", "k", "seq"), "seq")
    want = []
    for g in "gh":
        seen = []
        for gg, k, i in data:
            if gg != g or k in seen or any((k in s or s in k) and abs(len(k) - len(s)) < 5 for s in seen):
                continue
            seen.append(k)
            want.append((i,))
    assert got == sorted(want)


def test_unique_slugs(spark):
    rnd = random.Random(8)
    fixed = [("mri", "brain"), ("mri", "seizure"), ("mri", "seizure"), ("mri-seizure", "x"), ("mri-seizure-2", "q"), ("mri", "seizure"), ("a", "b"), ("a-b", "c"), ("a", "b")]
    data = fixed + [(rnd.choice(["a", "a-b", "a-b-2"]), rnd.choice(["b", "c", "2"])) for _ in range(40)]
    df = spark.createDataFrame([(i, b, d) for i, (b, d) in enumerate(data)], "seq int, base string, disc string")
    got = {r.seq: r.slug for r in catalogue.unique_slugs(df).collect()}
    seen, want = set(), {}
    for i, (b, d) in enumerate(data):
        slug, n = b, 2
        if slug in seen:
            slug = f"{b}-{d}"
            while slug in seen:
                slug, n = f"{b}-{d}-{n}", n + 1
        seen.add(slug)
        want[i] = slug
    assert got == want


def test_relevance(spark):
    corpus = spark.createDataFrame([(1, "one two", "r"), (2, "one not", "r"), (3, "one", "s"), (4, "k1", "r")], "id int, name string, region string")
    cs = spark.createDataFrame([("c",), ("d",)], "concept_id string")
    kw = [("c", k, "pos") for k in ("one", "five", "six")] + [("c", "not", "neg")] + [("d", f"k{i}x" if i else "k1", "pos") for i in range(10)]
    regions = spark.createDataFrame([("c", "r")], "concept_id string, region string")
    got = rows(concepts.keyword_relevance(corpus, cs, spark.createDataFrame(kw, "concept_id string, keyword string, kind string"), regions), "concept_id", "id", "relevance")
    assert got == [("c", 1, 0.53)]


def test_cards_edges(spark):
    sc = spark.createDataFrame([(i, t, "r", i, f"s{i}") for i, t in enumerate(["a"] * 5 + ["b"] * 2)], "scenario_id int, topic string, region string, seq int, name string")
    it = spark.createDataFrame(
        [(0, "a", 0, 1, "x", 8), (1, "a", 1, 1, "y", 8), (2, "a", 2, 1, "z", 3)], "scenario_id int, topic string, seq int, pos int, item string, rating int"
    )
    card = consensus.consensus_cards(sc, it).collect()
    assert len(card) == 1 and card[0].no_imaging_pct == 60 and card[0].card_type == "HIGH_VARIANCE"
    assert card[0].primary_name == "x" and card[0].equivalent == ["x", "y"]


def test_card_match(spark):
    c = spark.createDataFrame([(0, "stroke", "Stroke", 5), (1, "acute stroke", "Acute Stroke", 1), (2, "knee pain", "Knee Pain", 9)], "seq int, topic string, display string, scenario_count int")
    q = spark.createDataFrame([(1, "Stroke"), (2, "an acute stroke today"), (3, "pain in knee"), (4, "nothing")], "qid int, text string")
    got = rows(cards.match_cards(q, c), "qid", "topic", "exact")
    assert got == [(1, "stroke", True), (2, "acute stroke", False), (3, "knee pain", False)]


def test_vectors_with_many_copies_and_blocks(spark, monkeypatch):
    """A third of the rows is one vector, blocks are small on both sides; a query's row doesn't grow with the cells it visits."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 5)).tolist()
    data = [(i, v) for i, v in enumerate(base)] + [(300 + i, base[0]) for i in range(150)]
    monkeypatch.setattr(vector, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector, "TILE_ROWS", 30)
    df = spark.createDataFrame(data, "id int, vector array<double>")
    got = rows(vector.vector_topk(df.withColumnRenamed("id", "qid"), df, 4, skip_self=True), "qid", "rank", "id")
    m = np.array([v for _, v in data])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(np.einsum("ik,jk->ij", m, m), 12)
    np.fill_diagonal(sims, -9)
    wanted = [(q, r + 1, int(i)) for q in range(len(data)) for r, i in enumerate(np.lexsort((np.arange(len(data)), -sims[q]))[:4])]
    assert got == wanted
    qs = vector.pa.table({"qid": [7], "v": [m[0].tobytes()], "met": [bytes([0b01000000])]})
    cs = vector.pa.table({"id": [3, 2, 9], "v": [m[0].tobytes(), m[1].tobytes(), m[0].tobytes()], "cell": vector.pa.array([1, 0, 1], "int32")})
    at, near, _ = vector._block_best(qs, cs, 2, 2, False)
    assert at.tolist() == [0, 0] and near.tolist() == [0, 2]


def test_routes_of_an_item_are_reduced_before_requests(spark):
    routes = spark.createDataFrame(
        [("a", 3, "x", ["urgent"], 2), ("a", 1, "y", ["urgent"], 2), ("a", 0, "z", ["home"], 1), ("a", 5, "w", ["urgent"], None)]
        + [("a", 100 + i, "n", ["never"], 0) for i in range(500)],
        "item string, pos int, entry string, context array<string>, priority int",
    )
    requests = spark.createDataFrame([(1, "a", "urgent call"), (2, "a", "plain"), (3, "a", "urgent call"), (4, "b", "plain")], "rid int, item string, scenario string")
    chosen = routing.choose_route(requests, routes.filter("entry <> 'w'"))
    assert rows(chosen, "rid", "entry", "by_context") == [(1, "y", True), (2, "z", False), (3, "y", True)]
    assert rows(routing.choose_route(requests, routes), "rid", "entry")[0] == (1, "w")  # no priority counts as 0
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[-1].count("Aggregate") == 2  # routes and requests, each before they meet


def test_matches_are_reduced_before_requests(spark):
    names = spark.createDataFrame([(i, f"e{i}", i % 2 == 0) for i in range(40)], "seq int, name string, uses_contrast boolean")
    matches = spark.createDataFrame([(f"e{i}", s, float(i // 4 % 3)) for i in range(40) for s in (1, 2)] + [("e1", 3, 1.0)], "entry string, scenario_id int, relevance double")
    requests = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, None), (4, 3, True), (5, 4, True)], "rid int, scenario_id int, needs_contrast boolean")
    routed = routing.route_by_matches(requests, matches, names)
    assert rows(routed, "rid", "entry") == [(1, "e8"), (2, "e9"), (3, "e8"), (4, "e1")]
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [scenario_id" in plan.split("Join")[1]  # at most one match per scenario and contrast meets requests
