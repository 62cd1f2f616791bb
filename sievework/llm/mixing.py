"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's target becomes whole passes over its documents and a part of one more. A source is permuted by keyed
hashes and cut into blocks, so that many documents share a block and all blocks of a source are about equal. The block
quotas of the sources are split among the output shards by a binary tree: each node hands its left half a multivariate
hypergeometric share, so the leaves' quotas are exact and sum up to the sources'. Shards draw disjoint runs of the
permuted blocks and shuffle locally, by another keyed hash.

Only totals per source and cuts reach the driver: a source is an entry of a mixture, at most ``MOST_SOURCES``. Null sources
come last. Null and empty texts have size 0 and are drawn like others. Rows that repeat an id within a source have one place
and are drawn together, each the same number of times; rows without an id are told apart by their texts (``mark``). All hashes
are keyed by the seed, so reruns agree. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 10_000
PLACE_BITS = 60
CUT_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is over goes to the others by weight."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def place(id_column: Column, mark: Column, seed: int) -> Column:
    """A document's place in the permutation of its source: 60 bits of a keyed hash."""
    name = F.coalesce(id_column.cast("string"), F.concat(F.lit("?"), mark), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 15), 16, 10).cast("long")


def cut_places(docs: DataFrame, wanted: dict[int, float]) -> dict[int, tuple[int, bool]]:
    """For each source number, the place up to which its documents add up to about ``wanted`` words.

    Goes down by 1024 stretches of places at a time, so no task or driver sees more than that many per source; ends when a
    stretch is one place. The flag tells whether the documents at the place itself belong in."""
    spark = docs.sparkSession
    low = {s: 0 for s in wanted}
    before = {s: 0 for s in wanted}
    out: dict[int, tuple[int, bool]] = {}
    shift = PLACE_BITS
    while low and shift > 0:
        shift = max(0, shift - CUT_BITS)
        starts = spark.createDataFrame([(s, p) for s, p in low.items()], "s int, low long")
        inside = docs.join(F.broadcast(starts), "s").withColumn("stretch", F.shiftright(F.col("place") - F.col("low"), shift))
        sums = inside.filter(f"stretch >= 0 and stretch < {1 << CUT_BITS}").groupBy("s", "stretch").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        by_source: dict[int, list] = {}
        for r in sums.collect():  # at most 1024 rows per source
            by_source.setdefault(r.s, []).append((r.stretch, r.words, r.n))
        for s in list(low):
            sum_before, at = before[s], None
            for stretch, words, n in sorted(by_source.get(s, [])):
                if sum_before + words >= wanted[s]:
                    at = (stretch, words, n)
                    break
                sum_before += words
            if at is None:
                out[s] = (low[s] + (1 << (shift + CUT_BITS)) - 1, True)
                del low[s]
                continue
            low[s] += at[0] << shift
            before[s] = sum_before
            if shift == 0 or at[2] == 1:
                # A single document (or rows of one place): in, if that comes nearer.
                closer = abs(sum_before + at[1] - wanted[s]) < abs(sum_before - wanted[s])
                out[s] = (low[s] + (1 << shift) - 1, True) if closer else (low[s] - 1, True)
                del low[s]
    return out


def shard_quotas(quotas: list[int], shards: int, leaf: int, seed: int) -> list[tuple[int, int]]:
    """(first block, number of blocks) per source for one leaf: walks down from the root, drawing each node's split.

    A node's draw is seeded by its place in the tree, so all leaves see the same tree whoever computes them."""
    low, high, left_of = 0, shards, [0] * len(quotas)
    own = list(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        share = sum(own) * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, share, method="marginals") if sum(own) else np.zeros(len(own), int)
        if leaf < middle:
            own, high = draw.tolist(), middle
        else:
            left_of = [a + int(b) for a, b in zip(left_of, draw)]
            own, low = [a - int(b) for a, b in zip(own, draw)], middle
    return list(zip(left_of, own))


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id, source, size`` and ``mark``, a digest of the text where the id is null."""
    mark = F.when(F.col(id_column).isNull(), F.md5(F.coalesce(F.col(text_column), F.lit(""))))
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n_words(F.col(text_column)).alias("size"), mark.alias("mark"))


def mix(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 17, block_words: int = 1 << 14, shard_words: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """Draws and sources of a mix of documents ``doc_id, source, size, mark`` (see ``sized``).

    ``draws``: one row per copy taken of each row, ``shard, slot, doc_id, source, mark, size, copy``; ``slot`` orders a shard. ``sources``:
    ``source, source_size, target``. Weights repeat over the sources by code point."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    rows = totals.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mixture of more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    words = [r.words or 0 for r in rows]
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    wanted = targets(words, weight, share * sum(words), most)
    sources = spark.createDataFrame([(i, r.source, w, t) for i, (r, w, t) in enumerate(zip(rows, words, wanted))], "s int, source string, source_size long, target double")

    numbered = sizes.join(F.broadcast(sources), sizes.source.eqNullSafe(sources.source)).select("doc_id", "mark", "s", sizes.source, "size", place(F.col("doc_id"), F.col("mark"), seed).alias("place"))
    numbered = materialise(numbered, "mix")
    passes = [int(t // w) if w else 0 for t, w in zip(wanted, words)]
    rest = {i: t - p * w for i, (t, p, w) in enumerate(zip(wanted, passes, words))}
    cuts = cut_places(numbered, {i: r for i, r in rest.items() if r > 0})

    # Blocks: equal stretches of places; each pass over a source takes all of its blocks, the last one up to the cut.
    bits = [max(0, int(w / block_words).bit_length()) for w in words]
    parts = []
    quotas = []
    for i, w in enumerate(words):
        end = cuts[i][0] if i in cuts else -1
        last = (end >> (PLACE_BITS - bits[i])) + 1 if end >= 0 else 0
        quotas.append(passes[i] * (1 << bits[i]) + last)
        parts.append((i, bits[i], passes[i], end))
    shards = max(1, round(sum(wanted) / shard_words))
    plan = spark.createDataFrame(parts, "s int, bits int, passes int, last long")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, s, a, a + n) for k in batch["id"] for s, (a, n) in enumerate(shard_quotas(quotas, shards, int(k), seed)) if n]
            yield pd.DataFrame(found, columns=["shard", "s", "low", "high"])

    runs = spark.range(shards).mapInPandas(leaves, "shard long, s int, low long, high long")
    # Ticket of a block in a pass: the blocks of a pass are permuted by an odd factor, passes follow one another.
    taken = numbered.join(F.broadcast(plan), "s").withColumn("block", F.expr(f"shiftright(place, {PLACE_BITS} - bits)"))
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes")))).filter("copy < passes or place <= last")
    whole = F.expr("(block * 2654435761 + copy * 40503) & (shiftleft(1L, bits) - 1)")
    ticket = F.when(F.col("copy") < F.col("passes"), F.expr("copy * shiftleft(1L, bits)") + whole).otherwise(F.expr("passes * shiftleft(1L, bits) + block"))
    copies = copies.withColumn("ticket", ticket)
    if shards == 1:
        dealt = copies.withColumn("shard", F.lit(0).cast("long"))
    else:
        tickets = runs.select("shard", "s", F.explode(F.sequence("low", F.col("high") - 1)).alias("ticket"))
        dealt = copies.join(tickets, ["s", "ticket"])
    slot = F.xxhash64(F.lit(seed), "doc_id", "mark", "copy", "shard")
    draws = dealt.select("shard", slot.alias("slot"), "doc_id", "source", "mark", "size", "copy")
    return draws, sources.select("source", "source_size", "target")
