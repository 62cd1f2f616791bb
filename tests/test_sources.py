import json

import numpy as np
import pytest

from sievework.sources import readers, writers


def test_corpus_and_missing(spark, tmp_path):
    for region in ("neuro", "spine"):
        body = {"region": "ignored", "scenarios": [{"id": region[0], "name": region, "procedures": [{"name": "MRI", "rating": 8}]}]}
        (tmp_path / f"{region}.json").write_text(json.dumps(body))
    corpus = readers.load_corpus(spark, str(tmp_path))
    assert sorted((r.region, r.id) for r in corpus.collect()) == [("neuro", "n"), ("spine", "s")]
    assert readers.load_procedures(corpus).first().rating == 8
    assert readers.load_corpus(spark, str(tmp_path / "absent")).count() == 0


def test_catalogue_flags(spark, tmp_path):
    data = [{"name": "A", "uses_contrast": 1, "sequences": [{"sequence_name": "T1", "is_post_contrast": True, "sort_order": 2}], "scenario_matches": [{"scenario_id": "7", "relevance_score": 0.5}]}, {"name": "B"}]
    (tmp_path / "c.json").write_text(json.dumps(data))
    entries, steps, matches = readers.load_catalogue(spark, str(tmp_path / "c.json"))
    assert {r.name: r.uses_contrast for r in entries.collect()} == {"A": True, "B": False}
    assert steps.first().is_post_contrast is True and matches.first().scenario_id == "7"


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"heart attack": ["mi", "infarct"], "b": []}))
    got = sorted((r.term, r.pos, r.synonym) for r in readers.load_dictionary(spark, str(tmp_path / "d.json")).collect())
    assert got == [("heart attack", 0, "mi"), ("heart attack", 1, "infarct")]


def test_packed_vectors(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(7, 4)).astype("<f2")
    (tmp_path / "v.bin").write_bytes(m.tobytes())
    (tmp_path / "v.json").write_text(json.dumps({"dim": 4, "count": 7, "ids": [f"x{i}" for i in range(7)]}))
    got = {r.id: r.vector for r in readers.load_vectors(spark, str(tmp_path / "v.bin"), str(tmp_path / "v.json")).collect()}
    assert len(got) == 7 and np.allclose(got["x3"], m[3].astype("float32"))


def test_legacy_layouts(spark, tmp_path):
    step = {"type": "T1", "planes": ["AX", "SAG"], "contrast": "no", "note": ""}
    (tmp_path / "a.json").write_text(json.dumps({"category": "abd", "protocols": [{"study": "liver", "scanner": ["1.5T"], "sequences": [step]}]}))
    (tmp_path / "b.json").write_text(json.dumps({"protocols": [{"section": ["peds"], "studies": [{"study": "brain", "layout": {"leftCard": {"sequences": [step]}}}]}]}))
    got = sorted((r.category, r.study, r.plane) for r in readers.load_legacy(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).collect())
    assert got == [("abd", "liver", "AX"), ("abd", "liver", "SAG"), ("peds", "brain", "AX"), ("peds", "brain", "SAG")]


def test_packed_folder(spark, tmp_path):
    path = str(tmp_path / "m")
    m = np.random.default_rng(1).normal(size=(101, 5)).astype("<f2").astype("float32")
    rows = [(f"v{i}", m[i].tolist()) for i in range(101)]
    writers.write_vectors(spark.createDataFrame(rows[:3], "id string, vector array<float>"), path)
    writers.write_vectors(spark.createDataFrame(rows, "id string, vector array<float>").repartition(3), path, 20)
    readers.load_vectors(spark, path)  # registers the format
    for size in (1, 7, 64, 10_000):  # ranges smaller than a row, across rows, of a whole matrix
        back = spark.read.format("packed_vectors").option("rangeBytes", size).load(path).collect()
        assert len(back) == 101 and all(np.array_equal(r.vector, m[int(r.id[1:])]) for r in back)


def test_packed_empty_and_wrong(spark, tmp_path):
    path = str(tmp_path / "m")
    none = spark.createDataFrame([], "id string, vector array<float>")
    writers.write_vectors(none, path)
    assert readers.load_vectors(spark, path).count() == 0
    (tmp_path / "bad.bin").write_bytes(b"123")
    (tmp_path / "bad.json").write_text(json.dumps({"dim": 4, "count": 7, "ids": []}))
    with pytest.raises(Exception, match="expected 7 rows"):
        readers.load_vectors(spark, str(tmp_path / "bad.bin"), str(tmp_path / "bad.json")).collect()
    for wrong in ([[1.0], [1.0, 2.0]], [[1.0], None], [[1.0, None]]):
        with pytest.raises(Exception, match="vectors of one length"):
            writers.write_vectors(spark.createDataFrame([("a", v) for v in wrong], "id string, vector array<float>").coalesce(1), path)


def test_step_library_and_report(spark, tmp_path):
    body = {"sequence_types": [{"id": "t1", "name": "T1", "planes": ["AX"], "rationale": {"purpose": "anatomy"}}, {"id": "t2"}]}
    (tmp_path / "l.json").write_text(json.dumps(body))
    assert [(r.seq, r.id, r.purpose) for r in readers.load_step_library(spark, str(tmp_path / "l.json")).collect()] == [(0, "t1", "anatomy"), (1, "t2", None)]
    writers.write_report({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "a")).count() == 3 and spark.read.json(str(tmp_path / "r" / "b")).count() == 2
