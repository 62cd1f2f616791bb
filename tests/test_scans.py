"""Scans that hand on what they find without listing pairs in a shuffle."""

import math
import random

from pyspark.sql import functions as F

from sievework.operators import lexical, routing
from sievework.operators import termscan
from sievework.operators.termscan import Holders, Links


def test_links_equal_plain_containment():
    rng = random.Random(5)
    strings = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    links, holders = Links(strings, 3, 1), Holders(strings + ["a\nb"])
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        want = [k for k, s in enumerate(strings) for _ in range(3 if s == word else s in word or word in s)]
        assert sorted(links.row(word).tolist()) == want
        assert holders.of(word) == [k for k, s in enumerate(strings + ["a\nb"]) if word in s]
    assert holders.of("a\nb") == [len(strings)] and holders.of("") == []


def test_points_of_many_documents_are_found_at_once(monkeypatch):
    rng = random.Random(9)

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))

    terms = {t: rng.sample(range(5), rng.randint(1, 3)) for t in (word("ab") for _ in range(40))}
    documents = [{word("abc") for _ in range(rng.randint(0, 12))} for _ in range(30)]
    for min_len in (1, 3):
        want = [[0] * 5 for _ in documents]
        for row, held in zip(want, documents, strict=True):
            for t, asking in terms.items():
                one_sided = sum((t in w and len(t) >= min_len) or (w in t and len(w) >= min_len) for w in held - {t})
                for q in asking:
                    row[q] += 2 * one_sided + 3 * (t in held)
        points = termscan._Points(terms, 5, 3, 2, min_len)
        for most in (100_000, 7):
            monkeypatch.setattr(termscan, "KEPT_WORDS", most)
            assert points.of(documents).tolist() == want
    assert termscan._Points({}, 2, 3, 1, 1).of(documents[:2]).tolist() == [[0, 0], [0, 0]]


def test_statistics_count_words_where_rows_are_read(spark, monkeypatch):
    texts = [(1, "An-anvil an bolt"), (2, "bolt"), (2, "bolt bolt"), (3, "ring bolt ring"), (3, "ring ring bolt"), (4, ""), (5, None), (None, "x"), (None, "x")]
    corpus = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    want = {
        (1, 4, "an", 2), (1, 4, "anvil", 1), (1, 4, "bolt", 1), (2, 1, "bolt", 1), (2, 2, "bolt", 2), (3, 3, "ring", 4), (3, 3, "bolt", 2),
        (None, 1, "x", 2),
    }
    for most in (500_000, 3):
        monkeypatch.setattr(termscan, "COUNTED_WORDS", most)
        tf, df, totals = lexical.bm25_statistics(corpus)
        assert sorted(map(repr, tf.select("id", "dl", "word", "tf").collect())) == sorted(repr(r) for r in spark.createDataFrame(list(want), tf.select("id", "dl", "word", "tf").schema).collect())
        assert {(r.word, r.df) for r in df.collect()} == {("an", 1), ("anvil", 1), ("bolt", 4), ("ring", 1), ("x", 1)}
        assert (totals.first().n, totals.first().avgdl) == (9, 15 / 9)
    tf, _, totals = lexical.bm25_statistics(corpus, F.split("text", "o"))
    assert ("An-anvil an b", 1) in {(r.word, r.tf) for r in tf.collect()} and totals.first().avgdl == 13 / 8
    none = lexical.bm25_statistics(corpus.filter("id > 9"))
    assert none[0].count() == 0 and tuple(none[2].first()) == (0, None)
    plan = termscan.word_counts(corpus.select("id", F.col("text").alias("w")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_term_scores_leave_the_scan_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "anvil an bolts a"), (2, "an anvil"), (3, ""), (4, "bolt"), (4, "bolt bolts")], "id long, text string")
    terms = spark.createDataFrame([("anvil",), ("bolt",), ("x",), ("an",)], "word string")
    rows = {(r.term, r.id): r.points for r in lexical.term_scores(terms, texts).collect()}
    # rows of one id are one text: "bolt" counts once
    assert rows == {("anvil", 1): 4, ("an", 1): 4, ("bolt", 1): 1, ("anvil", 2): 4, ("an", 2): 4, ("bolt", 4): 4}
    once = lexical.term_scores(terms, texts.filter("id < 4"))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert lexical.term_scores(terms.filter("word = ''"), texts).count() == 0


def test_autocomplete_equals_its_ladder_over_several_blocks(spark, monkeypatch):
    from sievework.operators import cards as cd

    rng = random.Random(8)
    words = ["an", "anvil", "bolt", "bolts", "ring", "r", "old ring", "hot bolt", "ringbolt"]
    cards = [(k, f"{rng.choice(words)} {rng.choice(words)}" if k % 2 else f"{rng.choice(words)}{k}", None if k % 3 else f"The {rng.choice(words)}", k * 40) for k in range(40)]
    aliases = [(w[:3], cards[3 * k][1].lower()) for k, w in enumerate(words)]
    asked = [(k, t) for k, t in enumerate([*words, "the ring", "an old ring and bolts", "RING r ring", "zz", "hot  bolt", "x"])]

    def score(q, topic, display, count):
        t, d = topic.lower(), (display or topic).lower()
        n = sum(any(w in x or x in w for x in t.split()) for w in q.split())
        alias = any(topic == t and (a in q or q in a) for a, topic in aliases)
        ladder = [(q in (t, d), 100), (t.startswith(q) or d.startswith(q), 80), (q in t or q in d, 60), (t in q, 50), (alias, 70), (n > 0, 30 + 10 * n)]
        return next((points + min(count / 100, 5) for holds, points in ladder if holds), 0)

    want = set()
    for qid, text in asked:
        found = sorted((-score(text.lower(), t, d, n), seq, t) for seq, t, d, n in cards if len(text) > 1 and score(text.lower(), t, d, n))
        want |= {(qid, t, -s, rank) for rank, (s, _, t) in enumerate(found[:8], 1)}
    tables = (
        spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(cards, "seq int, topic string, display string, scenario_count int"),
        spark.createDataFrame(aliases, "alias string, topic string"),
    )
    for chars in (200_000, 300):
        monkeypatch.setattr(cd, "BLOCK_CHARS", chars)
        out = cd.autocomplete(*tables)
        assert {tuple(r) for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_counted_in_the_scan(spark, monkeypatch):
    from sievework.operators import concepts as co

    corpus = spark.createDataFrame([(1, "An Anvil and bolts", "en"), (2, "bolt", "de"), (3, None, "en"), (4, "ring bolt badword", None)], "id long, name string, region string")
    concepts = spark.createDataFrame([(10,), (20,), (30,), (40,)], "concept_id int")
    keywords = spark.createDataFrame(
        [(10, "anvil", "pos"), (10, "Bolt", "pos"), (10, "bolt", "pos"), (10, "zzz", "pos"), (20, "bolt", "pos"), (20, "badword", "neg"), (30, "an", "neg"), (50, "bolt", "pos")],
        "concept_id int, keyword string, kind string",
    )
    regions = spark.createDataFrame([(10, "en"), (40, "en")], "concept_id int, region string")
    for chars in (1_000_000, 10):
        monkeypatch.setattr(co, "MOST_CHARS", chars)
        found = co.keyword_relevance(corpus, concepts, keywords, regions)
        assert {tuple(r) for r in found.collect()} == {(10, 1, "en", 0.95), (20, 1, "en", 0.53), (20, 2, "de", 0.53)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_patterns_are_read_once_per_distinct_text(spark):
    from pyspark.sql import functions as F
    from sievework.operators import intent

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "qid int, text string")
    out = intent.per_text(rows, F.upper("text"), "v")
    assert sorted(map(tuple, out.select("qid", "v").collect())) == [(1, "A"), (2, "A"), (3, None), (4, "B")]
    assert "upper" not in out._jdf.queryExecution().executedPlan().toString()


def test_scored_and_resolved_routes_read_the_requests_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(region):
        read.add(1)
        return region

    reading = F.udf(seen, "string").asNondeterministic()
    rows = [(1, "MRI bolt", "acute", 7, "asia", True, ["hot", "bolt"]), (2, "MRI rod", "acute", 7, None, False, []), (3, "MRI rod", None, 8, "asia", True, ["bolt", "hot"])]
    requests = spark.createDataFrame(
        rows, "rid long, item string, scenario string, scenario_id long, region string, needs_contrast boolean, terms array<string>"
    ).withColumn("region", reading("region"))
    entries = [(1, "hot bolt", "hot bolt", "asia", "x", "bolt", ["hot", "bolt"], "y", True), (2, "rod", "rod", "europe", "x", "rod", ["rod"], "y", False)]
    catalogue = spark.createDataFrame(
        entries, "seq long, name string, display string, region string, section string, body_part string, keywords array<string>, indications string, uses_contrast boolean"
    )
    best = routing.best_scored(requests, catalogue).collect()
    assert read.value == len(rows)
    assert sorted((r.rid, r.entry) for r in best) == [(1, "hot bolt"), (2, "rod"), (3, "hot bolt")]
    matched = spark.createDataFrame([("rod", 8, 0.5)], "entry string, scenario_id long, relevance double")
    found = routing.resolve(requests, catalogue, [routing.RouteRule(("hot bolt",), item_any=("bolt",))], matched).collect()
    assert read.value == 2 * len(rows)
    assert sorted((r.rid, r.entry, r.stage) for r in found) == [(1, "hot bolt", "rules"), (2, "rod", "scored"), (3, "rod", "explicit")]


def test_queries_of_the_same_words_are_searched_once(spark, monkeypatch):
    asked, plain = [], lexical.bm25_top_k
    monkeypatch.setattr(lexical, "bm25_top_k", lambda docs, weights, queries, *a: asked.append(queries) or plain(docs, weights, queries, *a))
    corpus = spark.createDataFrame([(1, "anvil bolt"), (2, "bolt bolt ring"), (3, ""), (4, None)], "id long, text string")
    texts = ["bolt anvil", "Anvil  bolt", "ring", "*bolt", "annvil", "zzzz"]
    queries = spark.createDataFrame([(i, texts[i % 6]) for i in range(60)], "qid long, text string")
    got = lexical.bm25_search(queries, corpus, 2).collect()
    assert asked == [2, 1, 1]  # plain, stripped, fuzzy
    of: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        of.setdefault(r.qid, []).append((r.stage, r.id))
    want = [[("plain", 1), ("plain", 2)], [("plain", 1), ("plain", 2)], [("plain", 2)], [("stripped", 2), ("stripped", 1)], [("fuzzy", 1)], None]
    assert all(sorted(of.get(i, [])) == sorted(want[i % 6] or []) for i in range(60))
    scores = {(r.qid % 6, r.id): r.score for r in got}
    idf, avgdl = [math.log(1 + (4 - df + 0.5) / (df + 0.5)) for df in (1, 2)], 5 / 4
    assert scores[2, 2] == round(idf[0] * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avgdl)), 9)
    assert scores[0, 2] == round(idf[1] * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avgdl)), 9)


def test_names_are_searched_without_an_index_of_all_words(spark, monkeypatch):
    rng = random.Random(6)
    words = ["anvil", "bolt", "an", "vil", "ring", "boltring", "plate"]
    corpus = spark.createDataFrame(
        [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), [rng.choice(words)]) for i in range(60)] + [(99, None, None)], "id long, name string, keywords array<string>"
    )
    queries = spark.createDataFrame([(i, " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(1, 4)))) for i in range(40)], "qid long, text string")
    built, build = [], lexical.WordIndex.build
    monkeypatch.setattr(lexical.WordIndex, "build", staticmethod(lambda *a: built.append(a) or build(*a)))
    scanned = sorted(lexical.name_search(queries, corpus, 5).collect())
    assert scanned and not built
    monkeypatch.setattr(lexical, "contained", lambda *a: None)
    assert sorted(lexical.name_search(queries, corpus, 5).collect()) == scanned and len(built) == 2


def test_supplements_list_the_requests_of_an_item_side_by_side(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(item):
        read.add(1)
        return item

    reading = F.udf(seen, "string").asNondeterministic()
    items = ["bolt", "rod", "ring", None]
    requests = spark.createDataFrame([(i, items[i % 4], ["Acute pain", None][i // 4 % 2]) for i in range(40)], "rid long, item string, scenario string").coalesce(1)
    always = spark.createDataFrame([("bolt", 1, "a"), ("bolt", 2, "b"), ("rod", 3, "c"), (None, 4, "d")], "item string, pos int, reason string")
    contextual = spark.createDataFrame([("rod", 5, ["acute", "x"], "e"), ("bolt", 6, ["zz"], "f"), ("gear", 7, ["acute"], "g")], "item string, pos int, when array<string>, reason string")
    found = routing.supplements(requests.withColumn("item", reading("item")), always, contextual).collect()
    assert read.value == 40
    want = {(i, "always", p, r) for i in range(0, 40, 4) for p, r in ((1, "a"), (2, "b"))} | {(i, "always", 3, "c") for i in range(1, 40, 4)}
    want |= {(i, "contextual", 5, "e") for i in range(1, 40, 8)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    item = [items[r.rid % 4] for r in found if r.kind == "always"]
    assert sum(a != b for a, b in zip(item, item[1:], strict=False)) == 1
