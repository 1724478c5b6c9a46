"""A bit set of fixed size for picking wanted keys out of a scan; false hits are sorted out by a join afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A set of FILTER_BITS bits with those of all keys: a Bloom filter of one hash and fixed size."""
    words = FILTER_BITS // 64
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    got = keys.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("m")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = np.mod(keys.view(np.int64), FILTER_BITS)
    return (bits[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1
