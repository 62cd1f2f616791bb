import time

import pytest
from pyspark.sql import functions as F

from sievework.functions import packs
from sievework.functions import text as tx
from sievework.functions.rules import best_class, context_map
from sievework.operators import intent
from sievework.operators.routing import name_components
from sievework.operators.titles import equivalence_key, format_title, shorten


@pytest.mark.parametrize(
    "raw,want",
    [("Guillain-Barré", "guillain barre"), ("", ""), (None, ""), ("a\t b  c/d_e", "a b c d e"), ("STRASSE ß", "strasse ß")],
)
def test_norm(one, raw, want):
    assert one(tx.norm, raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("MRI Brain W/O Contrast", "mri-brain-wo-contrast"),
        ("MRI Brain W/ & W/O Contrast", "mri-brain-w-and-wo-contrast"),
        ("CT Abdomen & Pelvis W/ Contrast", "ct-abdomen-and-pelvis-w-contrast"),
    ],
)
def test_slugify(one, raw, want):
    assert one(tx.slugify, raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("mri knee w/o contrast", "MRI Knee Without Contrast"),
        ("MRI Breast W/WO Contrast", "MRI Breast With And Without Contrast"),
        ("MRCP abdomen", "MRCP Abdomen"),
    ],
)
def test_display_name(one, raw, want):
    assert one(tx.display_name, raw) == want


def test_small_expressions(one):
    assert one(lambda c: tx.truncate(c, 10), "abcdefghijkl") == "abcdefg..."
    assert one(tx.key_terms, "rule out brain mass") == "brain mass"
    assert one(tx.key_terms, "brain-stem mass") == "brain-stem"
    assert one(tx.list_items, "see:\n1. **Alpha**\n2. Beta: more\n3. C") == ["Alpha", "Beta"]
    assert one(tx.lead_sentences, "# Head. Second one! Third?") == "Head.  Second one!"
    assert one(tx.embedded_json, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(tx.escape_html, "a<b & c>") == "a&lt;b &amp; c&gt;"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Don't stop, the \u00fcber cat!", "dont stop ber cat"), ("x - y zebra", "zebra"), ("a--b cat", "a--b cat"), ("\u00e9-a-b dog", "a-b"), ("the of", None), ("", None),
    ],
)
def test_key_terms(one, raw, want):
    assert one(tx.key_terms, raw) == want


def test_key_terms_of_a_long_run_takes_linear_time(one):
    run = "x" * 100_000
    start = time.time()
    assert one(lambda c: tx.key_terms(F.concat(c, F.repeat(F.lit("x"), F.lit(99_999)))), "x") == run
    assert one(lambda c: tx.key_terms(F.concat(F.repeat(F.lit("x"), F.lit(100_000)), c)), " a-b") == "a-b"
    assert time.time() - start < 20


def test_norm_blanks(one):
    assert one(tx.norm, "\u00c9-x__y/ /z\u00a0\u3000\ufeff\t\n a\u200bb ") == "e x y z a\u200bb"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Suspected stroke, initial evaluation", "initial"),
        ("nothing here", "initial"),
        ("treated tumor, surveillance", "surveillance"),
        ("high risk screening", "screening"),
        ("high risk, recurrence", "surveillance"),
    ],
)
def test_phase(one, raw, want):
    from pyspark.sql import functions as F

    assert one(lambda c: best_class(F.lower(c), packs.PHASES, "initial"), raw) == want


def test_context(one):
    got = one(lambda c: context_map(c, packs.CONTEXTS), "known metastatic disease in a child")
    assert got == {"tumor_location": "metastatic", "clinical_status": "known", "age_group": "pediatric"}


@pytest.mark.parametrize(
    "text,phase,urgency",
    [
        ("pulmonary embolism", "initial", "acute"), ("suspected PE", "initial", "acute"), ("DVT", "initial", "acute"),
        ("aortic dissection", "initial", "acute"), ("history of PE follow-up", "surveillance", None),
        ("known DVT surveillance", "surveillance", None), ("lung cancer follow-up", "surveillance", None),
        ("brain tumor staging", "initial", None), ("routine screening mammogram", "surveillance", "routine"),
    ],
)
def test_intent_cases(spark, text, phase, urgency):
    q = spark.createDataFrame([(1, text)], "qid int, text string")
    row = intent.classify_intent(q).first()
    assert row.phase == phase
    assert urgency is None or row.urgency == urgency


def test_condition_order_and_override(one):
    got = one(intent.condition_urgency, "follow-up of pulmonary embolism")
    assert (got.condition, got.urgency, got.confidence) == ("pulmonary embolism", "routine", 0.75)
    assert one(intent.condition_urgency, "spectacular") is None


def test_tokens(one):
    got = one(lambda c: intent.token_ids(c, {"[CLS]": 2, "[SEP]": 3, "[UNK]": 1, "[PAD]": 0, "knee": 7, "follow-up": 9}, 6), "Knee pain, follow-up")
    assert got.ids == [2, 7, 1, 9, 3, 0] and got.mask == [1, 1, 1, 1, 1, 0]


def test_components(one):
    got = one(name_components, "MRI head without and with IV contrast")
    assert (got.modality, got.contrast, got.body_part) == ("MRI", "both", "brain")


def test_titles(one):
    assert one(format_title, "Knee pain, acute") == "Knee pain, acute"
    got = one(format_title, "Liver lesion, 2 cm, high risk, screening, next imaging study")
    assert got == "Liver lesion (2 cm, high risk, screening)"
    assert one(shorten, "Posttreatment risk factors") == "post-tx RF"
    assert one(equivalence_key, "CT brain without contrast") == one(equivalence_key, "NCCT of the head")
