import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import pieces
from sievework.llm.queries import piece_model

EDGE = [None, "", " ", "  two  blanks ", "a\n\nb\t c", "▁x y▁", "<s> </s> <0x0A>", "日本語の🎉𝒳", "a\x00b", "é é", " \n lead", "line \nend", "x" * 3000, " " * 700 + "z", "the " * 2000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_encoding_equals_the_library(library):
    model = pieces.model_at(piece_model())
    rng = random.Random(3)
    letters = " ▁ab\n\té日x🎉\x00<s>0theing.,"
    for text in [t or "" for t in EDGE] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]:
        ids = library.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)


def test_decoding_any_ids_equals_the_library(library):
    model = pieces.model_at(piece_model())
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.randrange(262) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_backtracking_without_word_cuts_gives_the_same(library):
    """The search itself over whole texts, not split at words."""
    model = pieces.model_at(piece_model())
    for text in ["unbelievable internationalisation", "a  b   c    d", "thtionerstinghe andre"]:
        escaped = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert model._laid(escaped) == library.encode(text)


def test_columns(docs, library):
    frame = docs(EDGE + EDGE).withColumn("ids", F.lit("clash"))
    coded = frame.select("doc_id", "text", pieces.encode(F.col("text"), piece_model()).alias("coded"))
    rows = coded.withColumn("back", pieces.decode(F.col("coded"), piece_model())).collect()
    assert len(rows) == 2 * len(EDGE)
    for r in rows:
        assert r.coded == library.encode(r.text or "")
        assert r.back == library.decode(r.coded)


def test_empty_texts_among_plain_words(docs, library):
    """No text here holds a double, leading or trailing blank."""
    for texts in (["", None, "plain words", "", "a\n\nb", "\n", "\nx", None, "end"], [None, "", ""], ["word", ""], ["", "word"]):
        coded = docs(texts).coalesce(1).select("text", pieces.encode(F.col("text"), piece_model()).alias("coded"))
        rows = coded.withColumn("back", pieces.decode(F.col("coded"), piece_model())).collect()
        assert [r.text for r in rows] == texts
        for r in rows:
            assert r.coded == library.encode(r.text or "")
            assert r.back == library.decode(r.coded)


def test_empty_table(docs):
    frame = docs([]).select(pieces.encode(F.col("text"), piece_model()).alias("ids"))
    assert frame.select(pieces.decode(F.col("ids"), piece_model())).collect() == []


def test_checked_encoding_equals_both_steps(spark):
    texts = [None, "", " ", "a  b\n c", "▁x", "plain words", "� ￾\x00é😀", "tail ", "x" * 40_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    both = rows.select("*", pieces.encode_checked(F.col("text"), piece_model()).alias("c"), pieces.encode(F.col("text"), piece_model()).alias("ids"))
    got = both.select("c.*", F.col("ids").alias("own"), (pieces.decode(F.col("ids"), piece_model()) == plain).alias("same")).collect()
    assert len(got) == len(texts) and all(r.ids == r.own and r.round_trip == r.same for r in got)
    none = rows.limit(0).select(pieces.encode_checked(F.col("text"), piece_model()).alias("c"))
    assert none.collect() == []


def test_checked_encoding_hands_on_slices_and_bounds_its_words(library):
    """A batch of many long texts leaves in slices, and words met once don't pile up."""
    import pyarrow as pa

    model = pieces.model_at(piece_model())
    texts = [" ".join(f"w{i}x{k}" for k in range(4_000)) for i in range(100)]
    model.forget()
    sizes, rows = [], []
    for part in pieces._checked(model, [pa.array(texts), pa.array([], pa.string())]):
        sizes.append(len(model.words) + len(model.words.older))
        rows += [(part.nbytes, r) for r in part.to_pylist()]
    assert len({n for n, _ in rows}) > 1 and max(n for n, _ in rows) < 16 << 20
    assert max(sizes) <= 2 * pieces.CHECKED_WORDS
    assert [r["ids"] for _, r in rows[:3]] == [library.encode(t) for t in texts[:3]]
    assert len(rows) == len(texts) and all(r["round_trip"] for _, r in rows)
    assert not model.words and model.most_words == pieces.CACHED_WORDS
