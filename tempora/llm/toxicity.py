"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Texts are folded: lower case, homoglyphs and full-width letters to Latin ones,
digits and signs that stand for letters to those letters, everything else to one
blank between words.  The lexicon's entries are whole words and beginnings of
words, each weighted with the log ratio of the shares of toxic and clean training
documents that have it, less one standard error.  Exception phrases are an entry with the word before or
after it that clean documents have and toxic ones have not; a match inside one
does not count.  The weights found, as a sum, per word of the text, and the
heaviest, go through a logistic curve fitted to the training documents.

Training takes at most ``SAMPLE`` labelled documents.  Whatever is telling beyond
chance in them is an entry, however rare, at every size.  Scoring reads every
whole text.

Results: null and empty texts have no matches and get the curve's score for none.
Repeated rows get equal scores.  Without toxic or without clean training rows the
lexicon is empty and all scores are the share of toxic rows, or 0.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.rowtypes import with_id
from tempora.llm.samples import in_fold, labelled_sample
from tempora.sources.tables import scratch_dir

SAMPLE = 20_000
# Beginnings of words, in letters.
STEMS = range(4, 8)
# An entry is in so many toxic rows; its log ratio passes ``LEAST_WEIGHT`` by ``SURE`` standard
# errors, as thousands of beginnings are tried and some recur by chance, and weighs ``CHANCE`` less.
SUPPORT, SURE, CHANCE, LEAST_WEIGHT = 3, 2.5, 1.0, 0.7
EXCEPTION_SUPPORT = 3
FOLDS, FOLD = 5, 0
# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "Cyrillic": ("авеёіјкмнорсѕтухԁһ", "abeeijkmhopcstyxdh"),
    "Greek": ("αβεικνορτυχ", "abeikvoptux"),
}
SUBSTITUTES = ("013457@$", "oieastas")
Batches = Iterator[pa.RecordBatch]

_FOLD = {ord(a): b for source, target in [*HOMOGLYPHS.values(), SUBSTITUTES] for a, b in zip(source, target, strict=True)}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """`` word word `` with a blank at either end."""
    return _GAP.sub(" ", f" {(text or '').lower().translate(_FOLD)} ")


class Model(NamedTuple):
    entries: dict[str, float]  # `` word `` or `` beginning``
    exceptions: frozenset[str]  # `` word word ``
    curve: tuple[float, ...]  # bias, then a factor for each feature


def candidates(folded: str) -> set[str]:
    """Whole words and beginnings of words."""
    found = set(folded.split())
    return {f" {w} " for w in found} | {f" {w[:n]}" for w in found for n in STEMS if len(w) >= n}


def automaton(model: Model) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, weight in model.entries.items():
        out.add_word(key, (len(key), weight))
    for key in model.exceptions:
        out.add_word(key, (len(key), model.entries.get(key, 0.0), True))
    if len(out):
        out.make_automaton()
    return out


def matched(folded: str, machine: ahocorasick.Automaton) -> Iterator[tuple[int, int, float]]:
    """Begin, end and weight of the heaviest entry at each word that no exception covers."""
    if not len(machine):
        return
    best: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    for last, (size, weight, *exception) in machine.iter(folded):
        begin = last - size + 1
        if exception:
            covered.append((begin, last))
        elif begin not in best or weight > best[begin][1]:
            best[begin] = (last, weight)
    covered.sort()
    # In the order of begins, with the furthest end of the exceptions begun so far.
    reach, at = -1, 0
    for begin in sorted(best):
        while at < len(covered) and covered[at][0] <= begin:
            reach, at = max(reach, covered[at][1]), at + 1
        last, weight = best[begin]
        if last > reach:
            yield begin, last, weight


def _features(folded: str, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Sum of the weights found, the same per word, and the heaviest."""
    weights = [w for _, _, w in found]
    words = max(1, folded.count(" ") - 1)
    return np.log1p(sum(weights)), 100 * sum(weights) / words, max(weights, default=0.0)


def _counted(pick: Callable[[str], Iterable[str]]) -> Callable[[Batches], Batches]:
    """Documents of each class that have what ``pick`` yields, summed up in a task."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                seen[int(y > 0)].update(set(pick(fold(text))))
            keys = list(seen[0].keys() | seen[1].keys())
            counts = [pa.array([c[k] for k in keys], pa.int64()) for c in seen]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], ["key", "clean", "toxic"])

    return run


def _sums(rows: DataFrame, pick: Callable[[str], Iterable[str]]) -> DataFrame:
    counted = rows.select("text", "_y").mapInArrow(_counted(pick), "key string, clean long, toxic long")
    return counted.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _contexts(machine: ahocorasick.Automaton) -> Callable[[str], Iterator[str]]:
    def pick(folded: str) -> Iterator[str]:
        for begin, last, _ in matched(folded, machine):
            stop = folded.find(" ", max(last, begin + 1))
            before = folded.rfind(" ", 0, begin)
            after = folded.find(" ", stop + 1)
            if before >= 0:
                yield folded[before : stop + 1]
            if after >= 0:
                yield folded[begin : after + 1]

    return pick


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, ...]:
    """Logistic regression with a ridge, by damped Newton steps; the bias first."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    ridge = np.diag([1e-6, *[0.1] * x.shape[1]])

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ b).sum() - y @ (z @ b) + b @ ridge @ b / 2)

    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(b)), z.T @ (y - p) - ridge @ b)
        size = 1.0
        while size > 1e-4 and loss(b + size * step) > loss(b):
            size /= 2
        if size <= 1e-4:
            break
        b = b + size * step
    factors = b[1:] / spread
    return (float(b[0] - mean @ factors), *map(float, factors))


def train(sample: DataFrame) -> Model:
    totals = {bool(r["_y"]): r["count"] for r in sample.groupBy("_y").count().collect()}
    clean, toxic = totals.get(False, 0), totals.get(True, 0)
    if not clean or not toxic:
        rate = (toxic + 1e-3) / (clean + toxic + 1e-2) if toxic else 1e-3
        return Model({}, frozenset(), (float(np.log(rate / max(1 - rate, 1e-3))), 0.0, 0.0, 0.0))
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    ratio, error = F.log(a / (toxic + 1)) - F.log(b / (clean + 1)), F.sqrt(1 / a + 1 / b)
    telling = _sums(sample, candidates).where(F.col("toxic") >= SUPPORT).select("key", (ratio - CHANCE * error).alias("weight"), (ratio - SURE * error).alias("sure"))
    # As many as the bounded sample has.
    weights = {r["key"]: r["weight"] for r in telling.where(F.col("sure") >= LEAST_WEIGHT).collect()}
    # A longer entry that says no more than a beginning of it is left out.
    entries = {k: w for k, w in weights.items() if not any(weights.get(k[: n + 1], 0) >= w - 0.1 for n in STEMS if n + 1 < len(k.rstrip()))}
    model = Model(entries, frozenset(), (0.0,) * 4)
    contexts = _sums(sample, _contexts(automaton(model))).where((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_SUPPORT))
    exceptions = frozenset(r["key"] for r in contexts.select("key").collect())
    model = model._replace(exceptions=exceptions)

    def features(batches: Batches) -> Batches:
        machine = automaton(model)
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            x = np.array([_features(t, list(matched(t, machine))) for t in folded]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("_y")], ["a", "b", "c", "y"])

    rows = sample.select("text", "_y").mapInArrow(features, "a double, b double, c double, y double").toPandas()  # at most SAMPLE rows
    return model._replace(curve=fit_curve(rows[["a", "b", "c"]].to_numpy(), (rows["y"] > 0).to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, spans``: spans are the words matched and their weights."""
    span = pa.list_(pa.struct([("match", pa.string()), ("weight", pa.float64())]))

    def run(batches: Batches) -> Batches:
        machine, (bias, *factors) = automaton(model), model.curve
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text"):
                folded = fold(text.as_py())
                found = list(matched(folded, machine))
                margin = bias + np.dot(factors, _features(folded, found))
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
                spans.append([{"match": folded[i : j + 1].strip(), "weight": w} for i, j, w in found])
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "spans"])

    schema = with_id(docs, "doc_id", "doc_id", "score double, spans array<struct<match:string,weight:double>>")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels of all folds but one, then score every document."""
    path = f"{scratch_dir(docs.sparkSession)}/sample"
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", SAMPLE, ~in_fold("doc_id", FOLDS, FOLD), path)
    return score(docs, train(rows)).withColumn("held_out", in_fold("doc_id", FOLDS, FOLD))
