"""Filters of bounded size that tell which hashes a table may hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most: 32 MB. A table that is too large for it lets more pass, and none of its own is missing.
FILTER_BITS = 1 << 28


class Filter:
    """Hashes of a table, as bits at two places each: none of the table's is missing, others seldom pass."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            found &= ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found


def make_filter(hashes: DataFrame) -> Filter | None:
    """A filter of column h with 16 bits or more a hash as far as FILTER_BITS allow, None for an empty table."""
    n = hashes.count()
    if not n:
        return None
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (16 * n).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    got = places.select(F.shiftright("p", 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return Filter(out.view(np.uint8))
