from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tempora.llm import periodic, queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs by definition: for each period, maximal stretches; the smallest period of a stretch counts."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((b, e, q) for (b, e), q in found.items())


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for b, e, q in runs for i in range(b + q, e)}
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    values = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *values, *sha)


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = cases.rows_of(got)
    assert got == sorted((expected(*r) for r in rows), key=repr) and any(r[1] for r in got)


def fibonacci(n):
    a, b = "x", "xy"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def nested(rnd, depth):
    if not depth:
        return [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))]
    return nested(rnd, depth - 1) * rnd.randint(1, 5) + nested(rnd, depth - 1)


def made(rnd):
    n = rnd.randint(0, 500)
    period = [f"w{rnd.randrange(60)}" for _ in range(rnd.randint(1, 130))]
    spiked = ["a"] * rnd.randint(5, 40) + ["b"]
    return rnd.choice(
        [
            [rnd.choice("ab") for _ in range(n)],
            [f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 40))] + (period * 12)[:n] + period[:7],
            ((spiked * rnd.randint(1, 6) + ["c"] * rnd.randint(0, 3)) * 9)[:n],
            fibonacci(n),
            nested(rnd, 3)[:800],
        ]
    )


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    rnd = random.Random(seed)
    texts = [" ".join(made(rnd)) for _ in range(60)]
    out = periodic.find_runs(cases.with_clashes(cases.documents(spark, texts)).repartition(4)).collect()
    for r in out:
        words = texts[r["doc_id"] - 1].split(" ") if texts[r["doc_id"] - 1] else []
        runs = brute(words)
        assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]] == runs and r["n_words"] == len(words)
        dropped = {i for b, e, q in runs for i in range(b + q, e)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(words) if i not in dropped)


def test_letters_are_not_folded_and_white_space_is_ascii(spark):
    text = "\t".join(["Aa", "aa", "é é"] * 9) + "\n\x0b"
    (row,) = periodic.find_runs(cases.documents(spark, [text])).collect()
    assert [tuple(x) for x in row["runs"]] == [(0, 27, 3)] and row["collapsed"] == "Aa aa é é"


def test_long_text_of_one_word_and_of_one_long_period(spark):
    rnd = random.Random(5)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(40_000)]
    out = periodic.find_runs(cases.documents(spark, ["a " * 200_000, " ".join(long * 3 + long[:5])])).collect()
    assert sorted([tuple(x) for x in r["runs"]] for r in out) == [[(0, 120_005, 40_000)], [(0, 200_000, 1)]]


def test_awkward_rows(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    out = periodic.find_runs(docs).collect()
    assert len(out) == docs.count()
    assert all(r["runs"] == [] and r["n_words"] == 0 and r["collapsed"] == "" for r in out if r["doc_id"] in (51, 52, 53))


def test_empty_table(spark):
    assert periodic.find_runs(cases.documents(spark, [])).collect() == []
