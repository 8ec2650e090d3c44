from __future__ import annotations

import random

import numpy as np
import pytest

from tempora.llm import neardup
from tempora.llm.components import components
from tests.llm import cases


def sets(text, size=5):
    w = cases.words(text, cases.SPACED)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    full = [(i, sets(t)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(full):
        for j, b in full[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return sorted(((i, len(sets(t)), top(i) if i is not None else None, i is None or top(i) == i) for i, t in rows), key=repr)


def run(spark, rows, percent, extra=False):
    docs = cases.documents(spark, [(i, t, None, None, None) for i, t in rows])
    return cases.rows_of(neardup.near_duplicates(cases.with_clashes(docs) if extra else docs, percent))


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"q{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 80)])
def test_matches_brute_force(spark, seed, percent):
    rnd = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = cases.prose(rnd, rnd.randint(60, 300)).split()
        for _ in range(rnd.randint(1, 8)):
            rows.append((i := i + rnd.randint(1, 5), edited(rnd, base, rnd.randint(0, 6))))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c"), (905, " "), (None, rows[0][1]), rows[4], rows[4]]
    rnd.shuffle(rows)
    assert run(spark, rows, percent, extra=True) == brute(rows, percent)


def test_chains_are_followed_beyond_any_one_bucket(spark):
    """Each text is similar to the next only; ids are in no helpful order."""
    rnd = random.Random(4)
    stream = [f"w{i}" for i in range(400)]
    order = list(range(40))
    rnd.shuffle(order)
    rows = [(order[k], " ".join(stream[k * 4 : k * 4 + 100])) for k in range(40)]
    got = run(spark, rows, 85)
    assert got == brute(rows, 85)
    assert {r[2] for r in got} == {0}


def test_large_group_of_near_copies(spark):
    """Copies of a text with edits of their own, of which pairs are often too far apart."""
    rnd = random.Random(6)
    base = cases.prose(rnd, 200).split()
    rows = [(i, edited(rnd, base, rnd.randint(1, 4))) for i in range(150)]
    assert run(spark, rows, 85) == brute(rows, 85)


def test_one_id_with_several_texts_is_one_document(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    assert {r[0]: r[2] for r in run(spark, [(5, a), (5, b), (3, a), (9, b)], 85)} == {3: 3, 5: 3, 9: 3}


def test_empty_table(spark):
    assert run(spark, [], 80) == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    same = np.mean([np.mean(neardup.signature(a[k:] ) == neardup.signature(b[k:])) for k in range(0, 60, 3)])
    assert abs(same - 2400 / 3600) < 0.1


def test_signature_does_not_depend_on_blocks(monkeypatch):
    a = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = neardup.signature(a)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    assert (neardup.signature(a) == whole).all()


def test_keep_first_keeps_one_of_each_group(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    left = neardup.keep_first(docs)
    assert left.columns == docs.columns
    marks = neardup.near_duplicates(docs)
    groups = marks.where("doc_id is not null").select("component_id").distinct().count()
    assert left.where("doc_id is not null").count() == groups
    assert left.where("doc_id is null").count() == docs.where("doc_id is null").count()


@pytest.mark.parametrize("links, expected", [
    ([], {}),
    ([(1, 1)], {}),
    ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}),
    ([(10, i) for i in range(10)], {i: 0 for i in range(11)}),
])
def test_components(spark, links, expected):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["id"]: r["component"] for r in components(df).collect()} == expected
