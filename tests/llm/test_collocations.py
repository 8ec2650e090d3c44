from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tempora.llm import collocations
from tests.llm import cases


def brute(rows, first, least, longest=5):
    """By definition: every phrase counted, every cut scored, every longer phrase looked into."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(cases.FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:first]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked, key=repr)


def texts(rnd, n):
    vocabulary = ["the", "of", "New", "york", "é", "a1", "x\x00", "naïve", "日本"]
    fixed = ["new york city", "once upon a time there", "é é é é é é", "of the"]

    def piece():
        return rnd.choice([" ", "\t", "  "]).join(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12)))

    return [rnd.choice([". ", "\n", ",", "\x0b"]).join(piece() for _ in range(rnd.randint(0, 6))) for _ in range(n)]


def found(spark, rows, first, least, parts=4):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], cases.SCHEMA)
    out = collocations.collocations(cases.with_clashes(docs).repartition(parts), first=first, least=least)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return cases.rows_of(out)


@pytest.mark.parametrize(("first", "least"), [(2000, 3), (7, 12)])
def test_against_brute_force(spark, first, least):
    rnd = random.Random(first)
    rows = [(rnd.choice(["en", "de", None]), t) for t in texts(rnd, 150)]
    assert found(spark, rows, first, least) == brute(rows, first, least)


def test_small_filters_and_blocks_give_the_same(spark):
    rnd = random.Random(4)
    docs = cases.documents(spark, texts(rnd, 80)).repartition(7)
    phrases, words = collocations.frequent_phrases(docs, 4)
    small, again = collocations.frequent_phrases(docs, 4, entries=50, block=64)
    assert cases.rows_of(phrases) == cases.rows_of(small) and cases.rows_of(words) == cases.rows_of(again)
    assert phrases.count() > 100


def test_permutation_is_undone_and_filters_add_up():
    rng = np.random.default_rng(1)
    for size in range(1, 6):
        ids = [rng.integers(0, 2**64, 1000, dtype=np.uint64) for _ in range(size)]
        back = collocations.unpermute(collocations.permute(ids))
        assert all((a == b).all() for a, b in zip(ids, back, strict=True))
    keys = [np.array([5, 5, 1, 5], np.uint64), np.array([2, 1, 9, 2], np.uint64)]
    held = collocations.Filter(2)
    for _ in range(2):
        held.add(keys, np.ones(4, np.uint64))
    assert [k.tolist() for k in held.keys] == [[1, 5, 5], [9, 1, 2]] and held.counts.tolist() == [2, 2, 4]


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b, " * 60_000)] * 3 + [("en", "c " * 100_000)] * 20
    assert found(spark, rows, 1, 100) == [("en", 1, "a b", 180_000, 180_000, 180_000, 2_360_000, 13_111)]


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found(spark, rows, 50, 3) == brute(rows, 50, 3)


def test_empty_table(spark):
    assert found(spark, [], 5, 1) == []
