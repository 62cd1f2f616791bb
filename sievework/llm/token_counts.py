"""Token counts of fields or sections by offset-mapped attribution.

Each document is encoded once, whole. The tokens' spans are then joined with the spans of its sections as intervals;
a token within one section is that section's, one that crosses a boundary goes by an explicit rule: to the section of
its ``first`` byte, of its ``last`` byte, or of ``most`` of its bytes (the earlier one of equals). A token may end inside a
character; spans are therefore compared as bytes, sections are given in code points.

Null and empty texts have no tokens. Sections must not overlap and come in order; tokens outside all of them count for
none. An empty section has no token. Very long texts and further columns need no care.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("first", "last", "most")
SECTIONS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str):
    """The encoding and the length in bytes of each token."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attributed(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Number of tokens per section, all given by byte positions."""
    counts = np.zeros(len(starts), np.int64)
    if not len(token_ends) or not len(starts):
        return counts
    token_starts = np.concatenate(([0], token_ends[:-1]))
    solid = np.flatnonzero(ends > starts)
    s, e = starts[solid], ends[solid]
    if not len(s):
        return counts
    first = np.searchsorted(e, token_starts, "right")
    last = np.searchsorted(s, token_ends, "left") - 1
    owner = np.where(first == last, first, -1)
    for t in np.flatnonzero(last > first):
        a, b = first[t], last[t]
        if rule == "most":
            shares = np.minimum(e[a : b + 1], token_ends[t]) - np.maximum(s[a : b + 1], token_starts[t])
            owner[t] = a + int(np.argmax(shares))
        else:
            byte = token_starts[t] if rule == "first" else token_ends[t] - 1
            at = a if rule == "first" else b
            owner[t] = at if s[at] <= byte < e[at] else -1
    if rule != "most":
        alone = np.flatnonzero(first == last)
        byte = token_starts[alone] if rule == "first" else token_ends[alone] - 1
        outside = (byte < s[np.minimum(first[alone], len(s) - 1)]) | (byte >= e[np.minimum(first[alone], len(s) - 1)])
        owner[alone[outside]] = -1
    counts[solid] = np.bincount(owner[owner >= 0], minlength=len(s))
    return counts


def line_sections(text: str) -> list[tuple[int, int]]:
    """Lines with the line end that closes them."""
    out, start = [], 0
    for line in text.split("\n"):
        out.append((start, start + len(line) + 1))
        start += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return out


def lines(text: Column) -> Column:
    """Sections of a text: one per line."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b} for a, b in line_sections(t or "")] for t in texts.to_pylist()], SECTIONS)

    return spans(text)


def token_counts(text: Column, sections: Column, ranks_file: str, pattern: str, rule: str = "most") -> Column:
    """``array<bigint>``: tokens of the whole text that each section of ``array<struct<start, end>>`` is given."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    @F.arrow_udf("array<bigint>")
    def counts(texts: pa.Array, spans: pa.Array) -> pa.Array:
        encoding, lengths = encoder(ranks_file, pattern)
        out, ends = [], [0]
        for k in range(len(texts)):
            text = texts[k].as_py() or ""
            raw = text.encode()
            values = spans[k].values if spans[k].is_valid else None
            starts, stops = (np.asarray(values.field(i), np.int64) for i in (0, 1)) if values is not None else (np.zeros(0, np.int64),) * 2
            if len(raw) != len(text):  # code points to bytes
                at = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                starts, stops = at[starts], at[stops]
            tokens = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.int64)
            out.append(attributed(np.cumsum(lengths[tokens]), starts, stops, rule))
            ends.append(ends[-1] + len(starts))
        flat = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return counts(text, sections)
