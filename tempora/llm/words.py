"""Words of whole texts as arrays: boundaries and 64-bit hashes, without a Python loop.

Texts of an Arrow batch are taken as one buffer of UTF-8 bytes.  A word is a
maximal run of word bytes inside one text; letters A-Z are folded to a-z unless
asked otherwise.
Hashes only select candidates or fingerprint sets; where equality decides a
result, callers compare the words themselves or 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding: digits, a-z, everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
# [^\x20\x09-\x0D]+: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[9:14] = SPACED[32] = False

_PRIME = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    up, down = np.full(size, _PRIME, np.uint64), np.full(size, pow(_PRIME, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    data: np.ndarray  # folded bytes of all texts
    starts: np.ndarray  # byte bounds of each word
    ends: np.ndarray
    first: np.ndarray  # of each text, and one more: index of its first word
    hashes: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


@cache
def _seeded(seed: int) -> np.ndarray:
    return _BYTES if not seed else np.random.default_rng(20 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: bool = True, folded: bool = True, seed: int = 0) -> Words:
    """``offsets`` bound the texts in ``data``; ``kind`` tells word bytes."""
    data = _LOWER[data] if folded else data
    size = len(data)
    inside = kind[data]
    before, after = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    before[1:], after[: size - 1 if size else 0] = inside, inside[1:]
    before[offsets] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before[:size])
    ends = np.flatnonzero(inside & ~after[:size]) + 1
    first = np.searchsorted(starts, offsets)
    if not hashed or not len(starts):
        return Words(data, starts, ends, first, np.zeros(len(starts), np.uint64))
    up, down = _powers(1 << max(21, (size + 1).bit_length()))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_seeded(seed)[data] * up[:size], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return Words(data, starts, ends, first, mix(hashes + (ends - starts).astype(np.uint64)))


def ngrams(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, and their first words' indices."""
    total = len(w.hashes)
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hashes[: total - size + 1].copy()
    for k in range(1, size):
        h = h * np.uint64(_PRIME) + w.hashes[k : total - size + 1 + k]
    last = np.repeat(w.first[1:], w.counts())[: len(h)]
    whole = np.flatnonzero(np.arange(len(h)) + size <= last)
    return mix(h[whole] + np.uint64(size)), whole


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with their texts as bytes and bounds; null counts as empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    rows = len(texts)
    if not rows:
        return
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64, rows + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, rows)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def bitmap_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells, of 2**bits, that hashes fall in."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)
