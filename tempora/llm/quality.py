"""Quality by a factorisation machine over words, structure and metadata.

A text's features are ``WORD_CELLS`` hashed word counts of unit length, shares
and sizes that tell its structure, and the length that the table states.  The
machine adds to a linear score a product for each pair of features through
``RANK`` factors; the sum over all pairs is half the difference of the square of
sums and the sum of squares, so a text is scored in linear time.

Training takes at most ``SAMPLE`` labelled documents, whose features, a bounded
matrix, are fitted on the driver; scoring reads every whole text.

Results: null and empty texts have zero features.  Without both classes among
the training rows every score is the share of good ones, or 0.5 without rows.
Repeated rows get equal scores, an empty table gives no rows, other columns are
ignored; ``n_chars`` may be missing or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.rowtypes import with_id
from tempora.llm.samples import in_fold, labelled_sample
from tempora.llm.words import ALNUM, SPACED, Words, chunks, words
from tempora.sources.tables import scratch_dir

SAMPLE = 8_000
WORD_CELLS = 512
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.02, 1e-4
FOLDS, FOLD = 4, 2
_LINES = np.ones(256, dtype=bool)
_LINES[10] = False
Batches = Iterator[pa.RecordBatch]


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_CLASSES = (
    _class(bytes(range(65, 91))),
    _class(bytes(range(97, 123))),
    _class(b"0123456789"),
    _class(b" \t\r"),
    _class(b"!?"),
    _class(b"|"),
    _class(b"#$%&*@^~+=<>{}[]\\_"),
    _class(b".,;:'\"()-/"),
    _class(bytes(range(128, 256))),
)
STRUCTURE = len(_CLASSES) + 9


def _repeats(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct share, share of the most frequent, share equal to the one before."""
    rows, counts = len(w.first) - 1, w.counts()
    own = np.repeat(np.arange(rows, dtype=np.uint64), counts)
    total = np.maximum(counts, 1)
    keys = np.sort((own << np.uint64(40)) | (w.hashes >> np.uint64(24)))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(new, len(keys)))
    text = (keys[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(rows)
    np.maximum.at(most, text, sizes)
    again = np.zeros(len(own), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (own[1:] == own[:-1])
    return np.bincount(text, minlength=rows) / total, most / total, np.bincount(own.astype(np.int64), again, rows) / total


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """A row a text: hashed words, then structure, then the stated length."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, WORD_CELLS + STRUCTURE))
    w, tokens, lines = words(data, offsets, ALNUM), words(data, offsets, SPACED), words(data, offsets, _LINES)
    own = np.repeat(np.arange(rows), w.counts())
    cells = np.bincount(own * WORD_CELLS + (w.hashes % np.uint64(WORD_CELLS)).astype(np.int64), minlength=rows * WORD_CELLS)
    cells = np.log1p(cells.reshape(rows, WORD_CELLS))
    out[:, :WORD_CELLS] = cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-9)
    at = WORD_CELLS
    for kind in _CLASSES:
        sums = np.append(0, np.cumsum(kind[data]))
        out[:, at] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
        at += 1
    for column in (*_repeats(tokens), _repeats(lines)[0], _repeats(lines)[1]):
        out[:, at] = column
        at += 1
    for column in (np.log1p(tokens.counts()), np.log1p(lines.counts()), np.log1p(size / np.maximum(tokens.counts(), 1)), np.log1p(stated)):
        out[:, at] = column
        at += 1
    return out


class Machine(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # features x RANK

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) * self.scale, -5, 5)
        pairs = (x @ self.factors) ** 2 - (x**2) @ (self.factors**2)
        return self.bias + x @ self.linear + pairs.sum(1) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(rate: float) -> Machine:
    size, rate = WORD_CELLS + STRUCTURE, min(max(rate, 1e-3), 1 - 1e-3)
    return Machine(np.zeros(size), np.zeros(size), float(np.log(rate / (1 - rate))), np.zeros(size), np.zeros((size, RANK)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, by Adam over mini-batches in a seeded order."""
    if not 0 < y.sum() < len(y):
        return constant(float(y.mean()) if len(y) else 0.5)
    mean, spread = x.mean(0), x.std(0)
    mean[:WORD_CELLS] = 0.0
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    scale[:WORD_CELLS] = 1.0
    x = np.clip((x - mean) * scale, -5, 5).astype(np.float32)
    rng = np.random.default_rng(seed)
    rate = y.mean()
    p = [np.array([np.log(rate / (1 - rate))]), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], RANK))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for rows in (order[i : i + BATCH] for i in range(0, len(y), BATCH)):
            a = x[rows].astype(float)
            sums = a @ p[2]
            margin = p[0] + a @ p[1] + ((sums**2) - (a**2) @ (p[2] ** 2)).sum(1) / 2
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            slopes = [np.array([g.sum()]), a.T @ g + DECAY * p[1], a.T @ (g[:, None] * sums) - ((a**2).T @ g)[:, None] * p[2] + DECAY * p[2]]
            step += 1
            for k, slope in enumerate(slopes):
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope**2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(mean, scale, float(p[0][0]), p[1], p[2])


def _stated(docs: DataFrame):
    return F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)


def _per_chunk(make: Callable[[np.ndarray], pa.Array], extra: str, name: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, end, data, offsets in chunks(batch, "text"):
                x = features(data, offsets, np.maximum(np.asarray(batch.column("stated"))[row:end], 0))
                yield pa.RecordBatch.from_arrays([batch.column(extra).slice(row, end - row), make(x)], [extra, name])

    return run


def train(sample: DataFrame) -> Machine:
    """Fit to a bounded sample with the label in ``_y``."""
    rows = sample.select("text", _stated(sample).alias("stated"), "_y")
    packed = _per_chunk(lambda x: pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), "_y", "x")
    # At most SAMPLE rows of WORD_CELLS + STRUCTURE numbers of four bytes.
    got = rows.mapInArrow(packed, "_y double, x binary").collect()
    if not got:
        return constant(0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return fit(x, np.array([r["_y"] > 0 for r in got], float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id") -> DataFrame:
    """The id and ``score`` of every document."""
    rows = docs.select(id_col, "text", _stated(docs).alias("stated"))
    scored = _per_chunk(lambda x: pa.array(machine.score(x)), id_col, "score")
    return rows.mapInArrow(scored, with_id(docs, id_col, id_col, "score double"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels of all folds but one, then score every document."""
    return score(docs, trained(docs, labels)).withColumn("held_out", in_fold("doc_id", FOLDS, FOLD))


def trained(docs: DataFrame, labels: DataFrame) -> Machine:
    path = f"{scratch_dir(docs.sparkSession)}/sample"
    own = docs.select("doc_id", "text", _stated(docs).alias("n_chars"))
    return train(labelled_sample(own, labels, "quality", SAMPLE, ~in_fold("doc_id", FOLDS, FOLD), path))


def drop_rejected(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The documents that score ``least`` or more; columns as they are."""
    machine = trained(docs, labels)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column("_row").field("text")], ["text"])
            for row, end, data, offsets in chunks(own, "text"):
                x = features(data, offsets, np.maximum(np.asarray(batch.column("stated"))[row:end], 0))
                kept = pa.array(machine.score(x) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(row, end - row).filter(kept)], ["_row"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _stated(docs).alias("stated"))
    return rows.mapInArrow(run, rows.select("_row").schema).select("_row.*")
