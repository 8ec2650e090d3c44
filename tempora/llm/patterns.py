"""Pattern packing of lengths: non-negative least squares over a histogram.

Patterns of one to three lengths that fill a sequence exactly are repeated so
that together they use up the histogram of lengths as closely as possible; the
counts are rounded down, and what is left is packed best-fit, longest first.

Everything here works on counts per length, so its time and memory depend on the
capacity and not on how many pieces there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MAX_PATTERNS = 40_000
STEPS = 150


class Run(NamedTuple):
    """Pieces of one length, by rank, put into consecutive sequences."""

    length: int
    rank: int  # of the first piece
    pieces: int
    sequence: int  # of the first piece
    place: int  # tokens before it there
    each: int  # pieces that follow one another in a sequence


def enumerate_patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows of three lengths, 0 for none, that sum to the capacity.

    Of the triples, those whose scarcest length is most frequent are taken.
    """
    capacity = len(histogram) - 1
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    single = np.array([[capacity, 0, 0]]) if histogram[capacity] else np.zeros((0, 3), int)
    low = have[2 * have <= capacity]
    pairs = np.stack([low, capacity - low, 0 * low], 1)
    pairs = pairs[histogram[pairs[:, 1]] > 0]
    a, b = np.meshgrid(have[3 * have <= capacity], low, indexing="ij")
    c = capacity - a - b
    fits = (a <= b) & (b <= c)
    triples = np.stack([a[fits], b[fits], c[fits]], 1)
    triples = triples[histogram[triples[:, 2]] > 0]
    scarce = histogram[triples].min(1)
    triples = triples[np.argsort(-scarce, kind="stable")[: max(0, MAX_PATTERNS - len(pairs))]]
    return np.concatenate([single, pairs, triples])


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared rest of the histogram.

    Multiplicative steps keep x non-negative and never raise the rest.
    """
    want = histogram.astype(float)
    want[0] = 0.0
    x = np.full(len(patterns), max(want.max(), 1.0) / 100)
    gain = want[patterns].sum(1)
    for _ in range(STEPS):
        made = np.zeros(len(want))
        for slot in patterns.T:
            made += np.bincount(slot, x, len(want))
        made[0] = 0.0
        x *= gain / np.maximum(made[patterns].sum(1), 1e-12)
    return x


def pack(histogram: np.ndarray) -> tuple[list[Run], int]:
    """Runs that place every piece of ``histogram`` (pieces by length), and the number of sequences."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    done, runs, sequences = np.zeros_like(left), [], 0

    def put(length: int, pieces: int, sequence: int, place: int, each: int = 1) -> None:
        runs.append(Run(length, int(done[length]), pieces, sequence, place, each))
        done[length] += pieces
        left[length] -= pieces

    patterns = enumerate_patterns(left)
    counts = fit_counts(patterns, left) if len(patterns) else np.zeros(0)
    for i in np.argsort(-counts, kind="stable"):
        lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        repeats = min(int(counts[i]), int((left[lengths] // times).min()))
        if counts[i] < 1:
            break
        if not repeats:
            continue
        place = 0
        for length in patterns[i][patterns[i] > 0]:
            put(int(length), repeats, sequences, place)
            place += int(length)
        sequences += repeats

    # Sequences by room left: ranges of equally filled ones.
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        while left[length]:
            best = next((r for r in range(length, capacity) if room[r]), None)
            if best is not None:
                start, many = room[best].pop()
                used = min(many, int(left[length]))
                put(length, used, start, capacity - best)
                room[best - length].append((start, used))
                if many > used:
                    room[best].append((start + used, many - used))
                continue
            each = capacity // length
            many, rest = divmod(int(left[length]), each)
            if many:
                put(length, many * each, sequences, 0, each)
                room[capacity - each * length].append((sequences, many))
                sequences += many
            if rest:
                put(length, rest, sequences, 0, rest)
                room[capacity - rest * length].append((sequences, 1))
                sequences += 1
    return runs, sequences
