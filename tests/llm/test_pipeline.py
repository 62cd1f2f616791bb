import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.test_exact_and_lines import brute_lines
from tests.llm.test_minhash import brute, edited


def corpus(words):
    texts = []
    for k in range(260):
        text = words(40, k)
        if k % 8 == 0:
            text += " idiot moron scum"
        texts.append(text)
    texts += [edited(texts[1], 1, k) for k in range(5)] + [texts[2]] * 4 + [None, "", " ", "Ünï 日本\n\nx"]
    return [f"{t}\nThe same line everywhere" if t and k % 3 == 0 else t for k, t in enumerate(texts)]


def test_stages_equal_brute_force(spark, docs, words, tmp_path):
    texts = corpus(words)
    frame = docs(texts)
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    toxic = {k for k in range(260) if k % 8 == 0}
    spark.createDataFrame([(k, int(k in toxic)) for k in range(260)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")

    one = corpus_pipeline.without_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).cache()
    assert one.columns == frame.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert toxic.isdisjoint(kept) and len(kept) == len(texts) - len(toxic)

    two = corpus_pipeline.without_common_lines(spark, one, folder).cache()
    assert two.columns == frame.columns
    assert {r.doc_id: r.text or "" for r in two.collect()} == brute_lines(list(kept.items()), 10, 1, True)

    three = corpus_pipeline.without_near_copies(spark, two, folder).cache()
    assert three.columns == frame.columns
    rows = sorted(two.collect(), key=lambda r: r.doc_id)
    labels = brute([r.text for r in rows], 5, 80)
    first = {rows[k].doc_id for k, (_, label) in enumerate(labels) if label == k}
    assert {r.doc_id for r in three.collect()} == first

    four = corpus_pipeline.mixed(spark, three, folder).cache()
    assert four.columns == frame.columns
    size = {r.doc_id: len((r.text or "").split()) for r in three.collect()}
    taken = sum(size[r.doc_id] for r in four.collect())
    assert abs(taken - 1.5 * sum(size.values())) < 300

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    five = corpus_pipeline.encoded(spark, four, folder).collect()
    text_of = {r.doc_id: r.text for r in three.collect()}
    assert len(five) == four.count()
    for r in five:
        assert r.ids == library.encode(text_of[r.doc_id] or "") and r.round_trip

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in five)


def test_shared_passages_stay_in_the_first_document(spark, docs, words):
    passage, short = words(50, 901), words(49, 902)
    texts = [f"{words(60, 2 * k)}\n{passage if k % 2 else '  ' + passage.upper()}\n{short}\n{words(60, 2 * k + 1)}" for k in range(3)]
    got = {r.doc_id: r.text for r in corpus_pipeline.without_common_lines(spark, docs(texts), "").collect()}
    assert got == {0: texts[0]} | {k: "\n".join(t.split("\n")[:1] + t.split("\n")[2:]) for k, t in enumerate(texts) if k}


def test_repeated_ids_and_clashing_columns(spark, docs, words):
    from pyspark.sql import functions as F

    texts = [words(30, k) for k in range(60)] + [words(20, 99), words(20, 98), None]
    frame = docs(texts, [*range(60), 7, 7, None]).withColumns({c: F.lit(5) for c in ("_score", "shard", "slot", "copy", "mark", "_doc_id", "size", "s")})
    drawn = corpus_pipeline.mixed(spark, frame, "")
    assert drawn.columns == frame.columns
    rows = drawn.collect()
    per_text = {t: sum(r.text == t for r in rows if r.doc_id == 7 and r.source == "a") for t in (texts[7], texts[60], texts[61])}
    assert max(per_text.values()) <= 2 and {r.shard for r in rows} == {5}


def test_no_rows(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
