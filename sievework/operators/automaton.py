"""Dictionary matching by a multi-pattern automaton: every text is read once, whatever the number of patterns.

The patterns are a dictionary, not a corpus. Their characters are counted first: up to ``MOST_CHARS`` go into one
automaton (a trie with failure links, shipped to the tasks), up to ``MOST_SCANS`` times as many are split by hash into
several, each with its own scan. Beyond that ``contained`` returns None and callers take their join by shared grams, which
has no such bound. Nothing but true matches leaves the tasks: there are no candidate pairs to verify.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 1_000_000
MOST_SCANS = 4
#: Automata a Python worker keeps: tasks of one scan share theirs.
_KEPT: dict[str, object] = {}


def automaton(key: str, patterns: list[str]):
    if key not in _KEPT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            built.add_word(pattern, k)
        built.make_automaton()
        while len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = built
    return _KEPT[key]


def _scan(patterns: list[str], whole_words: bool):
    key = uuid.uuid4().hex
    edged = [f" {p} " for p in patterns] if whole_words else patterns

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton(key, edged).iter
        for batch in batches:
            rows: list[int] = []
            hits: list[int] = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    met = {k for _, k in find(f" {text} " if whole_words else text)}
                    hits += met
                    rows += [row] * len(met)
                if len(hits) > 500_000:
                    yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(rows)), pa.array(hits, pa.int32())], names=["tid", "k"])
                    rows, hits = [], []
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(rows, pa.int64())), pa.array(hits, pa.int32())], names=["tid", "k"])

    return found


def contained(needles: DataFrame, texts: DataFrame, whole_words: bool = False) -> DataFrame | None:
    """All (nid, tid) of ``needles(nid, needle)`` and ``texts(tid, text)`` whose text contains the needle, at word borders
    (blanks and ends) if ``whole_words``; None if the needles are too many for automata. Empty needles match nothing."""
    asked = needles.filter("needle <> ''")
    strings = asked.select("needle").distinct()
    chars = strings.agg(F.sum(F.length("needle") + 1)).first()[0] or 0
    scans = -(-chars // MOST_CHARS)
    if scans > MOST_SCANS:
        return None
    spark = texts.sparkSession
    nid, tid = needles.schema["nid"].dataType, texts.schema["tid"].dataType
    schema = T.StructType([T.StructField("tid", tid), T.StructField("k", T.IntegerType())])
    result = None
    for part in range(scans):
        mine = strings.filter(F.pmod(F.xxhash64("needle"), F.lit(scans)) == part) if scans > 1 else strings
        patterns = sorted(r.needle for r in mine.collect())
        numbers = spark.createDataFrame(list(enumerate(patterns)), "k int, needle string")
        hits = texts.select("tid", "text").mapInArrow(_scan(patterns, whole_words), schema)
        pairs = hits.join(asked.join(F.broadcast(numbers), "needle").select("k", "nid"), "k").select("nid", "tid")
        result = pairs if result is None else result.unionByName(pairs)
    if result is None:
        return spark.createDataFrame([], T.StructType([T.StructField("nid", nid), T.StructField("tid", tid)]))
    return result
