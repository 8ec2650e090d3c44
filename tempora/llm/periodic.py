"""Runs of repeated words, found from string synchronising sets.

A run is a stretch of consecutive words with smallest period q, of at least
``LEAST`` words and ``TIMES`` periods, that no neighbouring word extends.

Periods up to ``SMALL`` are detected directly: stretches of words equal to the
word q later.  These highly periodic regions are what a synchronising set leaves
out.  Larger periods come from one set for each scale t = 8, 16, 32 ...: position
i is in the set if, among the hashes of the t words from each of i ... i + t,
regions of a period up to t / 3 left aside, the smallest is at i or at i + t.
Membership depends on the 2t words from i on alone, and any t neighbouring
positions outside highly periodic regions have a member.  So both of two equal
copies at a distance q, 3t - 1 <= q < 6t - 1, have a member at the same place;
members whose 2t words are equal propose their distance as a period.  Equal
members are more than t / 3 words apart, so each meets a bounded number of later
ones.  A proposal is extended to both sides word by word, once for each run.

Words are compared by 64-bit hashes.

Results: null and empty texts have no words and no runs.  Rows are judged one by
one, so repeated rows get equal results and an empty table gives no rows; other
columns are ignored.  Texts of any length are taken whole; one text is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.llm.rowtypes import with_id
from tempora.llm.words import SPACED, chunks, mix, words

LEAST, TIMES = 24, 3
# The first scale is 8, whose set finds periods from 23 on.
SCALE, SMALL = 8, 22
_NONE = np.uint64(2**64 - 1)
Batches = Iterator[pa.RecordBatch]
# Ids of a batch and the texts' numbers of words: from which word on the first words repeat, and how many.
Unrolled = Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches of consecutive numbers, of at least so many."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    begin, end = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
    long = end - begin >= least
    return begin[long], end[long]


def _small_periods(h: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal stretches of each small period; ``left`` are the words up to the text's end."""
    for q in range(1, min(SMALL, len(h) - 1) + 1):
        same = np.flatnonzero((h[:-q] == h[q:]) & (left[:-q] > q))
        # Beyond what a run needs, to know the periodic parts of the first scales.
        begin, end = _stretches(same, min(2 * q, SCALE - q) if q <= SCALE // TIMES else 2 * q)
        yield q, begin, end + q


def _windows_least(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size + 1`` neighbours; ``size`` is a power of two."""
    width = 1
    while width < size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:-1], x[1:])


def _members(ids: np.ndarray, scale: int, periodic: list[tuple[int, int]], left: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set; ``ids`` are the hashes of ``scale`` words each."""
    ids = ids.copy()
    for begin, end in periodic:
        ids[begin : max(begin, end - scale + 1)] = _NONE
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least = _windows_least(ids, scale)
    inside = (least != _NONE) & ((least == ids[: len(least)]) | (least == ids[scale : scale + len(least)]))
    return np.flatnonzero(inside & (left[: len(least)] >= 2 * scale))


def _proposals(at: np.ndarray, contexts: np.ndarray, text: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members and periods: equal contexts of one text at a distance from ``low`` to ``high``."""
    order = np.lexsort((at, contexts))
    at, contexts, text = at[order], contexts[order], text[order]
    step = 1
    while step < len(at):
        apart = at[step:] - at[:-step]
        same = (contexts[step:] == contexts[:-step]) & (text[step:] == text[:-step]) & (apart <= high)
        if not same.any():
            return
        hit = np.flatnonzero(same & (apart >= low))
        yield at[hit], apart[hit]
        step += 1


def _equal(h: np.ndarray, a: int, b: int, most: int, back: bool) -> int:
    """How many words from ``a`` and ``b`` on, or before them, are equal."""
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        x, y = (h[a - done - n : a - done][::-1], h[b - done - n : b - done][::-1]) if back else (h[a + done : a + done + n], h[b + done : b + done + n])
        other = np.flatnonzero(x != y)
        if len(other):
            return done + int(other[0])
        done, size = done + n, size * 2
    return most


def runs(h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """``start, end, period`` of all runs of the texts whose words' hashes are ``h``.

    ``first`` are the indices of each text's first word, and one more.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    left = first[1:][text] - np.arange(len(h))
    found: dict[tuple[int, int], int] = {}
    # Highly periodic stretches by their period, as far as the sets need them.
    periodic: list[tuple[int, int, int]] = []

    def keep(begin: int, end: int, q: int) -> None:
        if end - begin >= max(LEAST, TIMES * q) and found.get((begin, end), q) >= q:
            found[begin, end] = q

    for q, begins, ends in _small_periods(h, left):
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            periodic.append((begin, end, q))
            keep(begin, end, q)
    ids, scale = h, 1
    # A run of the least period that a scale finds has so many words.
    while len(counts) and counts.max(initial=0) >= max(LEAST, TIMES * (3 * scale - 1)):
        if scale >= SCALE:
            regions = [(b, e) for b, e, q in periodic if TIMES * q <= scale and e - b >= scale]
            at = _members(ids, scale, regions, left)
            doubled = _doubled(ids, scale)
            grouped: dict[int, list[np.ndarray]] = {}
            for where, period in _proposals(at, doubled[at], text[at], 3 * scale - 1, 6 * scale - 2):
                for q in np.unique(period).tolist():
                    grouped.setdefault(q, []).append(where[period == q])
            for q, places in grouped.items():
                spots, i = np.unique(np.concatenate(places)), 0
                while i < len(spots):
                    x = int(spots[i])
                    low, high = int(first[text[x]]), int(first[text[x] + 1])
                    begin = x - _equal(h, x, x + q, x - low, back=True)
                    end = x + q + _equal(h, x, x + q, high - x - q, back=False)
                    if end - begin >= TIMES * q:
                        periodic.append((begin, end, q))
                        keep(begin, end, q)
                    # Members further on in the same stretch propose it again.
                    i = max(i + 1, int(np.searchsorted(spots, end - q, side="left")))
        ids, scale = _doubled(ids, scale), 2 * scale
    return sorted((b, e, q) for (b, e), q in found.items())


def _doubled(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice as many words, out of those of ``size``."""
    if len(ids) <= size:
        return np.zeros(0, np.uint64)
    return mix(ids[:-size] * np.uint64(0x9E3779B97F4A7C15) + ids[size:])


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words with a blank after each, and where each begins and the last ends."""
    sizes = ends - starts + 1
    bounds = np.append(0, np.cumsum(sizes))
    places = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    out = np.append(data, np.uint8(32))[np.minimum(places, len(data))]
    out[bounds[1:] - 1] = 32
    return out.tobytes(), bounds


def _scan(unrolled: Unrolled | None) -> Callable[[Batches], Batches]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, end, data, offsets in chunks(batch, "text"):
                w = words(data, offsets, SPACED, folded=False)
                ids, counts = batch.column("doc_id").slice(row, end - row), w.counts()
                order = np.arange(len(w.starts))
                if unrolled:
                    # Word i of a text, from word a on, is word a + (i - a) % p.
                    a, p = (np.repeat(x, counts) for x in unrolled(ids, counts))
                    base = np.repeat(w.first[:-1], counts)
                    i = order - base
                    order = base + np.where(i >= a, a + (i - a) % np.maximum(p, 1), i)
                found = runs(w.hashes[order], w.first)
                text = np.searchsorted(w.first, [b for b, _, _ in found], side="right") - 1
                spans: list[list[dict]] = [[] for _ in range(end - row)]
                kept = np.ones(len(order), bool)
                for t, (begin, stop, q) in zip(text.tolist(), found, strict=True):
                    spans[t].append({"start": begin - int(w.first[t]), "length": stop - begin, "period": q})
                    kept[begin + q : stop] = False
                order = order[kept]
                raw, bounds = _joined(data, w.starts[order], w.ends[order])
                last = np.append(0, np.cumsum(kept))[w.first]
                collapsed = [raw[bounds[x] : max(bounds[x], bounds[y] - 1)] for x, y in zip(last[:-1], last[1:], strict=True)]
                arrays = [ids, pa.array(counts.astype(np.int64)), pa.array(spans, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, unrolled: Unrolled | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document.

    ``runs`` are sorted by start, then end; ``collapsed`` are the words that no
    run has after its first period, joined by a blank.  ``unrolled`` may have
    each text's words, from one on, replaced by repeats of the first of them.
    """
    schema = with_id(docs, "doc_id", "doc_id", "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.select("doc_id", "text").mapInArrow(_scan(unrolled), schema)
