"""Bounded samples that rerun alike."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """``rows``, or of more than ``most`` those with the smallest hashes of ``keys``: five deviations fewer than ``most`` are
    expected, so that there are not more; this holds for keys that are distinct, as equal ones stay or go together. Every task drops its own; nothing is ordered or gathered."""
    n = rows.count()
    if n <= most:
        return rows
    share = max(0.0, most - 5 * math.sqrt(most)) / n
    return rows.filter(F.shiftrightunsigned(F.xxhash64(*keys), 2) < int(share * 2**62))
