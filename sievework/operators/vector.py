"""Exact nearest neighbours of vectors and their fusion with lexical overlap.

The corpus is cut into cells around a bounded set of pivot vectors. The triangle inequality gives
every query a bound on its k-th distance and the cells that can hold a closer vector; only those are
visited. Blocks of queries meet blocks of the corpus, a row crosses once for each block of the other side, and each pair of
blocks returns its k best. Products in single precision rule rows out; what may be among the best is scored in doubles.

The approximate form is an inverted file: more and smaller cells, of which a query visits the nearest ``share`` only;
what it finds there is ranked by exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, words
from ..session import materialise
from .ranking import top_k

MAX_PIVOTS = 512
#: Share of the cells that the approximate form visits.
SHARE = 0.65
#: Rows of a block; a pair of blocks is one task's group.
BLOCK_ROWS = 16_384
#: Queries and corpus rows whose products are held at once.
TILE_QUERIES, TILE_ROWS = 2_048, 1_024


def l2_normalise(col: Column) -> Column:
    """Unit vector in doubles; a zero vector is divided by 1e-9."""
    v = F.transform(col, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    safe = F.when(length == 0, F.lit(1e-9)).otherwise(length)
    return F.transform(v, lambda x: x / safe)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ others.T)))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, skip_self: bool = False, method: str = "exact", share: float = SHARE) -> DataFrame:
    """(qid, id, score, rank) by cosine similarity; ties by id. ``queries(qid, vector)``,
    ``corpus(id, vector)``; ``skip_self`` leaves out the corpus row with the query's own id. ``method`` "cells" is the
    approximate form."""
    if method not in ("exact", "cells"):
        raise ValueError(f"no method {method}")
    c = materialise(corpus.select("id", l2_normalise(F.col("vector")).alias("v")), "vectors")
    q = materialise(queries.select("qid", l2_normalise(F.col("vector")).alias("v")), "query-vectors")
    n_corpus, n_queries = c.count(), q.count()
    if n_corpus == 0 or n_queries == 0:
        return q.select("qid").limit(0).selectExpr("qid", "cast(null as bigint) id", "0D score", "0 rank")
    wanted = k + 1 if skip_self else k
    n_pivots = int(min(MAX_PIVOTS, max(1, n_corpus // (512 if method == "exact" else 32))))
    picked = c.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()  # at most MAX_PIVOTS rows
    pivots = np.array([r.v for r in picked], dtype=np.float64)
    id_type = dict(c.dtypes)["id"]
    qid_type = dict(q.dtypes)["qid"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                v = _listed(part.column("v"))
                d = _distances(v, pivots)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), _packed(v), pa.array(d.argmin(axis=1).astype("int32")), pa.array(d.min(axis=1))], names=["id", "v", "cell", "reach"]
                )

    cells = materialise(c.mapInArrow(assign, f"id {id_type}, v binary, cell int, reach double"), "cells")
    sizes = {r.cell: (r.n, r.reach) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).collect()}
    radius = np.array([sizes.get(i, (0, -1.0))[1] for i in range(len(pivots))])
    filled = np.flatnonzero(radius >= 0)
    known_cell, known_reach = np.zeros(0, int), np.zeros(0)
    if method == "exact":
        nearest = top_k(cells.select("cell", "reach", "id"), ["cell"], [F.asc("reach"), F.asc("id")], wanted, "_r")
        known = nearest.select("cell", "reach").collect()  # at most MAX_PIVOTS * (k + 1) numbers
        known_cell, known_reach = np.array([r.cell for r in known]), np.array([r.reach for r in known])
    eps = 1e-9

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                v = _listed(part.column("v"))
                d = _distances(v, pivots)
                if method == "cells":
                    probes = max(1, int(np.ceil(share * len(filled))))
                    met = np.zeros(d.shape, bool)
                    np.put_along_axis(met, filled[np.argsort(d[:, filled], axis=1)[:, :probes]], True, axis=1)
                else:
                    upper = d[:, known_cell] + known_reach
                    at = min(wanted, upper.shape[1]) - 1
                    bound = np.partition(upper, at, axis=1)[:, at]
                    met = (radius >= 0) & (d - radius <= bound[:, None] + eps)
                yield pa.RecordBatch.from_arrays([part.column("qid"), _packed(v), _packed(np.packbits(met, axis=1))], names=["qid", "v", "met"])

    visiting = q.mapInArrow(visits, f"qid {qid_type}, v binary, met binary")
    # cells lie one after the other, and every BLOCK_ROWS rows make a block: a block holds few cells, or a part of a large one
    parts, q_parts = -(-n_corpus // BLOCK_ROWS), -(-n_queries // BLOCK_ROWS)
    ends = np.cumsum([sizes.get(i, (0, 0.0))[0] for i in range(len(pivots))]).tolist()
    start = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in [0, *ends[:-1]]]), F.col("cell") + 1)
    size = F.element_at(F.array(*[F.lit(int(sizes.get(i, (1, 0.0))[0])).cast("long") for i in range(len(pivots))]), F.col("cell") + 1)
    block = F.least(F.floor((start + F.pmod(F.xxhash64("id"), size)) / F.lit(BLOCK_ROWS)), F.lit(parts - 1)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = visiting.withColumn("qpart", F.pmod(F.xxhash64("qid"), F.lit(q_parts)).cast("int")).withColumn("part", every(parts))
    right = cells.select("id", "v", "cell", block.alias("part")).withColumn("qpart", every(q_parts))
    schema = pa.schema([("qid", _arrow_type(q, "qid")), ("id", _arrow_type(c, "id")), ("score", pa.float64())])

    def best(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not qs.num_rows or not cs.num_rows:
            return schema.empty_table()
        at, near, scores = _block_best(qs, cs, k, wanted, skip_self)
        columns = [qs.column("qid").take(pa.array(at)), cs.column("id").take(pa.array(near)), pa.array(scores)]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], schema=schema)

    keys = ["qpart", "part"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"qid {qid_type}, id {id_type}, score double")
    return top_k(hits, ["qid"], [F.desc("score"), F.asc("id")], k)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, rows) for start in range(0, batch.num_rows, rows))


def _listed(column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of doubles, all of the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _block_best(qs: pa.Table, cs: pa.Table, k: int, wanted: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``qs(qid, v, met)``, row of ``cs(id, v, cell)`` and score of the ``k`` best of each query in the cells it visits."""
    asked, met = _unpacked(qs.column("v"), np.float64), np.unpackbits(_unpacked(qs.column("met"), np.uint8), axis=1)
    given, cell = _unpacked(cs.column("v"), np.float64), cs.column("cell").to_numpy()
    qids, ids = (t.column(name).to_numpy() for t, name in ((qs, "qid"), (cs, "id")))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), np.int64)  # of an id among the sorted ones
    place[order] = np.arange(len(order))
    # of equal vectors only those with the smallest ids can be among the best
    equal = np.unique(given[order].view(f"V{given.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    grouped = np.argsort(equal, kind="stable")
    first = np.searchsorted(equal[grouped], equal[grouped])
    rows = order[grouped[np.arange(len(grouped)) - first < wanted]]
    rows = rows[np.argsort(cell[rows], kind="stable")]
    asked32, given32 = asked.astype(np.float32), given.astype(np.float32)
    margin = np.float32(1.2e-7 * (given.shape[1] + 8))
    floor = np.full(len(asked), -np.inf, np.float32)  # k-th best score so far
    top, near = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)

    def take(r: np.ndarray, c: np.ndarray) -> None:
        """Score pairs and merge them into the best ones of their queries."""
        scores = np.concatenate([np.einsum("ij,ij->i", asked[r[i : i + 65_536]], given[c[i : i + 65_536]]) for i in range(0, len(r), 65_536)])
        seen = np.unique(r)
        held_r, held_c, held_s = np.repeat(seen, k), near[seen].ravel(), top[seen].ravel()
        real = held_c >= 0
        r, c, scores = np.concatenate([r, held_r[real]]), np.concatenate([c, held_c[real]]), np.concatenate([scores, held_s[real]])
        by = np.lexsort((place[c], -scores, r))
        r, c, scores = r[by], c[by], scores[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        kept = rank < k
        top[r[kept], rank[kept]], near[r[kept], rank[kept]] = scores[kept], c[kept]
        floor[seen] = top[seen, k - 1]

    cuts = np.flatnonzero(np.diff(cell[rows])) + 1
    for run in np.split(rows, cuts):
        visiting = np.flatnonzero(met[:, cell[run[0]]])
        for tile in (run[i : i + TILE_ROWS] for i in range(0, len(run), TILE_ROWS)):
            turned = np.ascontiguousarray(given32[tile].T)
            for some in (visiting[i : i + TILE_QUERIES] for i in range(0, len(visiting), TILE_QUERIES)):
                scores = asked32[some] @ turned
                least = floor[some]
                new = np.isneginf(least)
                if len(tile) > wanted and new.any():
                    least[new] = np.partition(scores[new], len(tile) - wanted, axis=1)[:, len(tile) - wanted]
                hits = np.flatnonzero(scores >= (least - margin)[:, None])
                r, c = some[hits // len(tile)], tile[hits % len(tile)]
                if skip_self:
                    other = qids[r] != ids[c]
                    r, c = r[other], c[other]
                if len(r):
                    take(r, c)
    at, rank = np.nonzero(near >= 0)
    return at, near[at, rank], top[at, rank]


# Abbreviation and its full form, both matched as raw substrings.
ABBREVIATIONS = [
    ("llq", "left lower quadrant"), ("rlq", "right lower quadrant"), ("luq", "left upper quadrant"),
    ("ruq", "right upper quadrant"), ("mi", "myocardial infarction"), ("pe", "pulmonary embolism"),
    ("dvt", "deep vein thrombosis"), ("sah", "subarachnoid hemorrhage"), ("sdh", "subdural hematoma"),
    ("gca", "giant cell arteritis"), ("ich", "intracerebral hemorrhage"), ("ms", "multiple sclerosis"),
    ("ra", "rheumatoid arthritis"), ("oa", "osteoarthritis"), ("ibd", "inflammatory bowel disease"),
    ("hcc", "hepatocellular carcinoma"), ("rcc", "renal cell carcinoma"),
    ("copd", "chronic obstructive pulmonary disease"), ("als", "amyotrophic lateral sclerosis"),
    ("fuo", "fever of unknown origin"),
]


def lexical_overlap(q: Column, name: Column, keywords: Column, pairs: list[tuple[str, str]] = ABBREVIATIONS) -> Column:
    """tanh(weight / 4): 2 per query token (3+ characters) in the name, else 1 in the keywords, and
    3 per abbreviation pair present on both sides. All inputs normalised."""
    tokens = words(q, 3)
    weight = F.aggregate(
        tokens,
        F.lit(0),
        lambda acc, t: acc
        + F.when(F.contains(name, t), 2).when((keywords != "") & F.contains(keywords, t), 1).otherwise(0),
    )
    for short, full in pairs:
        def has(c, short=short, full=full):
            return F.contains(c, F.lit(short)) | F.contains(c, F.lit(full))

        weight = weight + F.when(has(q) & (has(name) | has(keywords)), 3).otherwise(0)
    return F.tanh(weight / F.lit(4.0))


def hybrid_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 8, pool: int | None = None, lam: float = 0.05,
    pairs: list[tuple[str, str]] = ABBREVIATIONS, encoded: DataFrame | None = None,
) -> DataFrame:
    """(qid, id, similarity, lexical, score, rank, vector_rank): vector pool re-ranked with a lexical
    bonus. ``queries(qid, text, vector)``, ``corpus(id, name, keywords, vector)``; where the vectors are a table of their own,
    ``encoded(id, vector)`` of rows of the corpus, its texts are not joined to them."""
    pool = pool or max(4 * k, 30)
    hits = vector_topk(queries.select("qid", "vector"), (corpus if encoded is None else encoded).select("id", "vector"), pool)
    if encoded is not None:
        corpus = corpus.join(encoded.select("id"), "id", "left_semi")
    q = queries.select("qid", norm(F.col("text")).alias("_q"))
    c = corpus.select("id", norm(F.col("name")).alias("_name"), norm(F.array_join("keywords", " ")).alias("_kw"))
    joined = hits.join(q, "qid").join(c, "id")
    scored = joined.select(
        "qid",
        "id",
        F.col("score").alias("similarity"),
        F.col("rank").alias("vector_rank"),
        lexical_overlap(F.col("_q"), F.col("_name"), F.col("_kw"), pairs).alias("lexical"),
    ).withColumn("score", F.col("similarity") + F.lit(lam) * F.col("lexical"))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("vector_rank")], k)


def rank_changes(fused: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, vector_rank, fused_rank, moved) for the union of both top-k lists of a pool that
    carries ``vector_rank`` and fused ``rank``; moved is up, down, same, or null outside one list."""
    seen = fused.filter((F.col("vector_rank") <= k) | (F.col("rank") <= k))
    v = F.when(F.col("vector_rank") <= k, F.col("vector_rank"))
    f = F.when(F.col("rank") <= k, F.col("rank"))
    moved = F.when(v > f, "up").when(v < f, "down").when(v == f, "same")
    return seen.select("qid", "id", v.alias("vector_rank"), f.alias("fused_rank"), moved.alias("moved"))
