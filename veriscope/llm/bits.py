"""A bit filter over long keys: a table of fixed size that says of most keys that they are not in a set, and never so of one that is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """BITS bits (4 MB), those of the keys modulo BITS set."""
    place = F.pmod(column, F.lit(BITS))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{column}`, {BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, BITS)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
