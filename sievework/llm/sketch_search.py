"""Ranked lexical search over hashed max-sketches.

A document's impacts (what a term adds to a score, before the query term's weight) fold into a sketch of ``width``
coordinates: a term's hash names its coordinate, which keeps the largest impact of the terms that meet there. The sum of weight
times coordinate over an item's terms is never below the document's score. Items are looked up together in the sketches of a
slice of documents; for each item, documents are scored exactly by falling bound until the bound falls below the ``k``-th best
score so far. The result doesn't depend on ``width``, the number of exact scorings does.

Two scans of the documents and no shuffle of texts: the first counts terms and document frequencies of the items' terms, the
second searches and returns the ``k`` best of each task, which meet in one limited window. Items come in blocks of about
``BLOCK_BYTES`` of text, each with its own two scans: what a task holds of the items stays bounded.

Cases: null and empty texts have no terms; an item without terms, or whose terms occur nowhere, has no rows; weights are never
negative. Every item row is an item and every document row a document of its own, repeated ids included; null document ids
come last among equal scores. Tables without rows give none. Very long texts are cut into terms whole. Extra columns don't matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.ranking import top_k

BLOCK_BYTES = 4 << 20
WIDTH = 1024
#: Documents and bytes of text whose sketches are held at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Every byte outside terms becomes a blank, A-Z their lower case; bytes of other letters stay.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any other characters, A-Z lower-cased."""
    return text.translate(_FOLDED).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impact(tf, m):
    """What a term's ``tf`` occurrences are worth in a document of length factor ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_factor(length: int, n: int, total: int) -> int:
    return 25 + 75 * length * n // total


@dataclass
class Items:
    """A block of items: for each its terms with their numbers of occurrences times weights."""

    keys: list
    terms: list[Counter]
    weights: list[dict[bytes, int]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """Ids and UTF-8 texts of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES``."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary() if batch.column(1).type == pa.string() else pa.large_binary())
        start = size = 0
        for at in range(batch.num_rows):
            size += len(texts[at].as_buffer() or b"") if texts[at].is_valid else 0
            if at + 1 - start == SLICE_ROWS or size >= SLICE_BYTES or at + 1 == batch.num_rows:
                yield ids.slice(start, at + 1 - start).to_pylist(), texts.slice(start, at + 1 - start).to_pylist()
                start, size = at + 1, 0


def _statistics(vocabulary: list[bytes]):
    """Per task: document frequencies of the vocabulary (by its numbers), documents with terms (-1), their terms (-2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {word: k for k, word in enumerate(vocabulary)}
        df, with_terms, total = Counter(), 0, 0
        for _, texts in _slices(batches):
            for text in texts:
                if found := terms(text):
                    with_terms, total = with_terms + 1, total + len(found)
                    df.update(asked.keys() & set(found))
        rows = [(asked[word], n) for word, n in df.items()] + [(-1, with_terms), (-2, total)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    return count


def sketches(counts: list[Counter], factors: np.ndarray, width: int) -> np.ndarray:
    """``width`` x documents: each coordinate's largest impact among the document's terms that hash to it."""
    sizes = np.array([len(c) for c in counts])
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.fromiter(map(crc32, chain.from_iterable(counts)), np.uint32, sizes.sum()) % np.uint32(width)
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, sizes.sum())
    folded = np.zeros((width, len(counts)), np.int64)
    np.maximum.at(folded, (at.astype(np.intp), doc), impact(tf, factors[doc]))
    return folded


def _searched(block: Items, n: int, total: int, k: int, width: int, id_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(np.array([crc32(w) % width for w in ws], np.intp), np.array(list(ws.values()), np.int64), ws) for ws in block.weights]
        best: list[list[tuple]] = [[] for _ in asked]
        for ids, texts in _slices(batches):
            listed = [terms(text) for text in texts]
            held = [d for d, found in enumerate(listed) if found]
            if not held:
                continue
            counts = [Counter(listed[d]) for d in held]
            names = [ids[d] for d in held]
            factors = np.array([length_factor(len(listed[d]), n, total) for d in held], np.int64)
            folded = sketches(counts, factors, width)
            for (at, weights, ws), top in zip(asked, best, strict=True):
                if not len(at):
                    continue
                bounds = weights @ folded[at]
                least = top[0][0] if len(top) == k else 1
                near = np.flatnonzero(bounds >= least)
                for d in near[np.argsort(-bounds[near], kind="stable")].tolist():
                    if len(top) == k and bounds[d] < top[0][0]:
                        break
                    tfs, m = counts[d], int(factors[d])
                    score = sum(w * impact(tfs[word], m) for word, w in ws.items() if word in tfs)
                    if score > 0:
                        entry = (score, -math.inf if names[d] is None else -names[d])
                        if len(top) < k:
                            heapq.heappush(top, entry)
                        elif entry > top[0]:
                            heapq.heapreplace(top, entry)
        rows = [(item, None if key == -math.inf else -key, score) for item, top in enumerate(best) for score, key in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return search


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``documents(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    asked = items.select("item_id", F.col("text").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    key_type = asked.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", key_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.hash("item_id", "text"), F.lit(blocks)) == number).collect() if blocks > 1 else asked.collect()
        counted = [(r.item_id, Counter(terms(r.text.encode()))) for r in rows if r.text]
        block = Items([key for key, c in counted if c], [c for _, c in counted if c], [])
        vocabulary = sorted(set(chain.from_iterable(block.terms)))
        if not vocabulary:
            continue
        sums = docs.mapInArrow(_statistics(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r.term: r.n for r in sums.collect()}
        n, total = df.get(-1, 0), df.get(-2, 0)
        if not n:
            continue
        weights = {word: weight(n, df[k]) for k, word in enumerate(vocabulary) if df.get(k)}
        block.weights = [{word: times * weights[word] for word, times in c.items() if word in weights} for c in block.terms]
        hits = docs.mapInArrow(_searched(block, n, total, k, width, pa.int64()), "item int, doc_id long, score long")
        best = top_k(hits, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        keys = spark.createDataFrame(list(enumerate(block.keys)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", key_type)]))
        found = found.unionByName(best.join(F.broadcast(keys), "item").select("item_id", "rank", "doc_id", "score"))
    return found
