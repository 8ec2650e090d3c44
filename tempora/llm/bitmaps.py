"""Bitmaps of hashes: a filter of fixed size to broadcast, however many the hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 2**24 bits are 2 MiB; the driver receives 2**18 rows of 16 bytes at most.
BITS = 24


def collect_bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Packed bits set for the leading ``bits`` bits of each hash in a long column."""
    cell = F.shiftrightunsigned(column, 64 - bits)
    words = hashes.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return out


def cells(bitmap: np.ndarray) -> np.ndarray:
    """One boolean a bit, for look-ups by leading bits."""
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)


def contains(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(cells).bit_length() - 1
    return cells[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
