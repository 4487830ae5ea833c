"""Sets of hashes as bitmaps of a fixed size, whatever the corpus, to send to all workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 8 MB.
BITS = 1 << 26
#: Bits of one of Spark's bitmaps.
_PART = 1 << 15


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of the hashes ``h``: hashes may share bits, but none is missed."""
    slot = F.col("h").bitwiseAND(bits - 1)
    found = hashes.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(_PART - 1)).alias("bits")).collect()
    out = np.zeros(max(bits, _PART) // 8, np.uint8)
    for at, part in found:
        out[at * (_PART // 8) :][: _PART // 8] = np.frombuffer(part, np.uint8)
    return out


def held_in(found: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    slot = hashes & np.uint64(bits - 1)
    return (found[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
