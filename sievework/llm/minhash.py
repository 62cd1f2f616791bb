"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first spreads shingles over the positions of a circle, the
second is read from there on, shifted by one for each further coordinate, so a shingle's values are one slice of it.
Documents with equal shingle sets form a class at once; only one of each class is banded. In a bucket, members meet
a leader, not each other. Members of buckets that then still hold several components meet by their rarest shingles, of
which similar sets have one in common for certain. No pair that could join two components goes unseen, and none within
a component is looked at. Shingles that a set holds alone bound its similarity to any other from above, so edited copies
that are too far apart don't meet either; nor do pairs whose one-bit sketches differ in more places than similar ones
do, but for a probability below ``MISS``. Pairs are confirmed on whole shingle sets.

The choice of bands misses a pair at the threshold with a probability of at most ``MISS``. Shingles are compared by
64-bit hashes. Documents without words have no shingles and are linked with nothing. Rows with the same id share
their class if their sets are equal; null ids are never the smallest. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import bits
from sievework.session import materialise, release

CIRCLE = 1 << 20
MISS = 1e-6
SKETCH_BITS = 2048
HEAD = 24
_ODD = np.random.default_rng(11).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(12).integers(0, 2**63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def bands_for(threshold: float, rows: int) -> int:
    """Bands of ``rows`` coordinates that miss a pair of this similarity with a probability of at most ``MISS``."""
    return int(np.ceil(np.log(MISS) / np.log1p(-(threshold**rows))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word after A-Z became lower case."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    solid = ~_BLANK[raw]
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.cumsum(solid) - 1
    first = at[starts]
    letters = _BYTE[raw[solid]]
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    laps, place = np.divmod(place, len(_ODD))  # for words longer than the table
    weights = _ODD[place] if not laps.any() else _mixed(_ODD[place] + laps.astype(np.uint64)) | np.uint64(1)
    return _mixed(np.add.reduceat(letters * weights, first) + lengths.astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of fewer words, of the whole sequence."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(width, len(words))
    joined = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        joined += words[k : len(words) - n + 1 + k] * _ODD[k]
    return np.unique(_mixed(joined))


@lru_cache(maxsize=2)
def _circle(size: int) -> np.ndarray:
    order = np.random.default_rng(13).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((order, order[: size - 1])), size)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: from each shingle's place on the circle, the second permutation is read on."""
    places = np.unique((shingles * _ODD[-1]) >> np.uint64(44))
    circle = _circle(size)
    out = np.full(size, CIRCLE, np.uint32)
    for k in range(0, len(places), 2048):
        np.minimum(out, circle[places[k : k + 2048]].min(axis=0), out=out)
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of ``SKETCH_BITS`` coordinates, packed into 64-bit words."""
    return np.packbits((signature(shingles, SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing(percent: int) -> int:
    """Bits in which the sketches of sets of at least this similarity differ, but for a probability of ``MISS``.

    A bit differs with half the probability that the coordinate does; five and a half deviations are allowed for."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(SKETCH_BITS * p + 5.5 * np.sqrt(SKETCH_BITS * p * (1 - p))))


def _fingerprint(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _signed(width: int, bands: int, rows: int):
    """Per document: id, node (hash of its set), number of shingles, bucket of each band."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _ODD[:bands] * np.uint64(2)
        for batch in batches:
            n, nodes = [], []
            buckets = np.zeros((len(batch), bands), np.int64)
            for k, text in enumerate(batch.column(1)):
                shingles = shingle_set(text.as_py(), width)
                n.append(len(shingles))
                if not len(shingles):
                    nodes.append(None)
                    continue
                nodes.append(np.uint64(_fingerprint(shingles)).astype(np.int64).item())
                coordinates = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
                buckets[k] = _mixed((coordinates * _ODD[64 : 64 + rows]).sum(axis=1, dtype=np.uint64) + seeds).view(np.int64)
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(buckets.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "n_shingles", "buckets"])

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                sets = [x for t in batch.column(0)[start : start + 256] if len(x := shingle_set(t.as_py(), width))]
                nodes = np.array([_fingerprint(x) for x in sets], np.uint64).view(np.int64)
                ends = pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32())
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                bits_ = np.concatenate([sketch(x) for x in sets]) if sets else np.zeros(0, np.int64)
                places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SKETCH_BITS // 64))
                columns = [pa.array(nodes), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(places, pa.array(bits_))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "sketch"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (smallest node reachable) for every node of the links ``a, b``.

    Alternates hanging a node's larger and its smaller neighbours on the smallest one until only stars are left;
    each round is a written table."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        following = materialise(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        release(edges)
        edges = following
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mapped(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` with the labels that ``moves`` (``node, label``) has for theirs."""
    moves = moves.select(F.col("node").alias("label"), F.col("label").alias("now"))
    return rows.join(moves, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def _alone(sets: DataFrame) -> DataFrame:
    """``node, own``: shingles of a set that no other one holds."""
    held = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return held.filter("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def _close(one: str, other: str, percent: int) -> str:
    """Whether two sets can be similar enough: what a set holds alone is in no intersection and in every union."""
    shared = f"least({one}.n_shingles - {one}.own, {other}.n_shingles - {other}.own)"
    either = f"greatest({one}.n_shingles + {other}.own, {other}.n_shingles + {one}.own)"
    return f"{one}.label <> {other}.label and 100 * {shared} >= {percent} * {either}"


MEMBER = ("own", "node", "n_shingles", "label")


def _leader_meetings(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` of each bucket's members with its leader, the one with the fewest shingles of its own."""
    lead = members.groupBy("bucket").agg(F.min(F.struct(*MEMBER)).alias("y"))
    return members.select("bucket", F.struct(*MEMBER).alias("x")).join(lead, "bucket").filter(_close("x", "y", percent)).select("x", "y")


def _rare_meetings(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` of different components that share one of their rarest shingles.

    Of n shingles, similar sets share all but n - ceil(n * percent / 100); so they share at least one of the first
    n - ceil(n * percent / 100) + 1 of each, in any common order. Rare ones first makes these few and meetings rare."""
    nodes = members.select(F.struct(*MEMBER).alias("x")).distinct()
    here = materialise(sets.join(nodes, F.col("node") == F.col("x.node")).dropDuplicates(["node"]).select("x", "shingles", "sketch"), "compared")
    held = here.select("x", F.explode("shingles").alias("shingle"))
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "shingle")))
    first = F.expr(f"int(x.n_shingles - (x.n_shingles * {percent} + 99) div 100 + 1)")
    ordered = held.join(often, "shingle").groupBy("x").agg(order.alias("ordered")).select("x", F.slice("ordered", F.lit(1), first).alias("ordered"))
    shared = F.transform(F.filter("ordered", lambda s: s["n"] > 1), lambda s: s["shingle"])
    ordered = ordered.withColumn("rare", shared).join(here.select(F.col("x").alias("of"), "sketch"), F.col("x.node") == F.col("of.node"))
    member = F.struct(*[F.col(f"x.{c}") for c in MEMBER], "sketch", F.slice("rare", 1, HEAD).alias("head"))
    rare = materialise(ordered.select(member.alias("x"), F.explode("rare").alias("shingle")), "rare")
    other = rare.select(F.col("x").alias("y"), "shingle")
    # A pair is taken at the first of the rare shingles that it shares, as far as the heads tell; repeats go later.
    once = "coalesce(get(array_intersect(x.head, y.head), 0), shingle) = shingle"
    apart = "aggregate(zip_with(x.sketch, y.sketch, (p, q) -> bit_count(p ^ q)), 0, (s, n) -> s + n)"
    met = rare.join(other, "shingle").filter(f"x.node < y.node and {_close('x', 'y', percent)} and {apart} <= {most_differing(percent)} and {once}")
    return met.select("x", "y")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """One row per document: ``id, node, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; ``node`` names the class of
    equal sets, ``component_id`` is the smallest id that links reach, and that document is kept."""
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    bands = bands_for(percent / 100, rows)
    schema = T.StructType([base.schema["id"]]).add("node", "long").add("n_shingles", "long").add("buckets", T.ArrayType(T.LongType()))
    signed = materialise(base.mapInArrow(_signed(width, bands, rows), schema), "signed")
    classes = materialise(signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("first_id")), "classes")
    heads = signed.join(classes.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("first_id")))
    banded = heads.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    members = meeting_all = materialise(banded.join(shared, "bucket").withColumn("label", F.col("node")), "members")

    # Whole sets, of the documents that share a bucket (and, as the filter is a bit filter, of a few more).
    meeting = members.select("node").distinct().join(classes, "node").select("first_id")
    cells = bits.cells_for(classes.count(), 16)
    words = bits.filter_words(cells)
    found = bits.bit_filter(meeting.select(bits.cell(F.col("first_id"), cells).alias("cell")), words)
    asked = bits.tested(base, F.col("id"), cells, found, words).filter("maybe").select("text")
    sets = materialise(asked.mapInArrow(_sets(width), "node bigint, shingles array<bigint>, sketch array<bigint>"), "sets")

    # A document with too many shingles of its own can't be similar to any other.
    members = members.join(_alone(sets), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    fewest = members.groupBy("bucket").agg(F.min("own").alias("fewest"))
    members = members.join(fewest, "bucket").filter(f"100 * (n_shingles - own) >= {percent} * (n_shingles + fewest)").drop("fewest")
    members = materialise(members, "members")
    release(meeting_all)

    met = labels = None
    for leaders in (True, False):
        pairs = _leader_meetings(members, percent) if leaders else _rare_meetings(members, sets, percent)
        here, there = F.struct("x.node", "x.label"), F.struct("y.node", "y.label")
        pairs = pairs.select(F.least(here, there).alias("x"), F.greatest(here, there).alias("y")).distinct()
        pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b"))
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        one, other = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        judged = pairs.join(one, "a").join(other, "b").withColumn("same", F.size(F.array_intersect("set_a", "set_b")))
        linked = (100 * F.col("same") >= percent * (F.size("set_a") + F.size("set_b") - F.col("same"))).alias("linked")
        tested = materialise(judged.select("a", "b", "label_a", "label_b", linked), "judged")
        met = tested.select("a", "b") if met is None else met.unionByName(tested.select("a", "b"))
        moves = components(tested.filter("linked").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        labels = moves if labels is None else _mapped(labels, moves).unionByName(moves.join(labels, "node", "left_anti"))
        if not leaders:
            break
        # Buckets within one component are done.
        left = _mapped(members, moves)
        mixed = left.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
        following = materialise(left.join(mixed, "bucket").select(members.columns), "members")
        release(members)
        members = following
        if members.isEmpty():
            break
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(smallest, "label").select("node", "component_id")
    return (
        signed.select("id", "node", "n_shingles")
        .join(by_class, "node", "left")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
