"""A bitmap filter of fixed size over bigint keys, built by Spark and broadcast to Python workers.

Its size is set by ``bits`` alone, whatever the number of keys. It never misses a key; with more keys
it lets more strangers through, which costs later work and never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.arrays import U64, xxhash64_long

BITS = 1 << 26


def build(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The words of the bitmap: at most ``bits / 64`` rows come to the driver."""
    h = F.xxhash64(F.col(column).cast("long"))
    at = [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]
    rows = (
        keys.where(F.col(column).isNotNull())
        .select(F.explode(F.array(*at)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return words.view(U64)


def might_contain(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been among those that the bitmap was built from."""
    h = xxhash64_long(keys)
    last = U64(len(words) * 64 - 1)
    found = np.ones(len(keys), bool)
    for at in (h & last, (h >> U64(32)) & last):
        found &= (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
    return found
