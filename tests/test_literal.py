"""Parity variants against brute-force readings of their guards."""

from __future__ import annotations

import pytest

from tempora.operators import literal
from tempora.operators.periods import coalesce_periods, pack
from tests.support import day_sets, from_sets, islands, one, out, random_rows, rel, spans

K = ["k"]


def cases(b, p, guarded):
    """b, p: maximal periods of one key."""
    res = []
    for bf, bt in b:
        for pf, pt in p:
            if bf < pf:
                between = [q for q in p if bf < q[0] < pf]
                covering = [q for q in p if bf < q[1] and q[0] < pf]
                if not (covering if guarded else between):
                    res.append((bf, pf))
            if pt < bt:
                between = [q for q in p if pt < q[1] < bt]
                covering = [q for q in p if pt < q[1] and q[0] < bt]
                if not (covering if guarded else between):
                    res.append((pt, bt))
        for _, pt in p:
            for qf, _ in p:
                if pt < qf and not [q for q in p if pt < q[1] and q[0] < qf]:
                    res.append((pt, qf))
    return res


@pytest.mark.parametrize("guarded", [False, True])
@pytest.mark.parametrize("seed", [21, 22, 23])
def test_three_cases(spark, seed, guarded):
    keys = "abcdefghijklmnopqrst"
    lrows = random_rows(seed, 60, keys)
    rrows = random_rows(seed + 50, 90, keys)
    b, p = day_sets(lrows), day_sets(rrows)
    expected = {}
    for k in b:
        found = cases(islands(b[k]), islands(p.get(k, set())), guarded)
        expected[k] = {d for f, t in found for d in range(f, t)}
    got = literal.difference_cases(rel(spark, lrows), rel(spark, rrows), K, guarded)
    assert out(got) == from_sets(expected)


def test_three_cases_reach_outside_the_left_period(spark):
    got = literal.difference_cases(one(spark, (0, 5)), one(spark, (10, 12)), K, guarded=False)
    assert spans(got) == [(0, 10)]


def test_pairwise_keeps_days_that_one_set_leaves(spark):
    left = one(spark, (0, 10))
    right = rel(
        spark, [("a", 1, 0, 4), ("a", 2, 4, 10)], "k string, price int, from_d date, to_d date"
    )
    got = literal.difference_pairwise(left, pack(right, ["k", "price"]), K)
    assert spans(got) == [(0, 10)]


@pytest.mark.parametrize("seed", [31, 32])
def test_pairwise_against_brute_force(spark, seed):
    lrows = random_rows(seed, 60)
    rrows = [(k, i % 3, f, t) for i, (k, f, t) in enumerate(random_rows(seed + 1, 60))]
    b, p = day_sets(lrows), day_sets(rrows)
    expected = {}
    for k, days in b.items():
        sets = [s for pk, s in p.items() if pk[:1] == k]
        if sets:
            expected[k] = set().union(*[days - s for s in sets])
    right = coalesce_periods(
        rel(spark, rrows, "k string, price int, from_d date, to_d date"), ["k", "price"]
    )
    got = literal.difference_pairwise(
        coalesce_periods(rel(spark, lrows), K), pack(right, ["k", "price"]), K
    )
    assert out(got) == from_sets(expected)


def blocks(rows):
    every = islands(set().union(*day_sets(rows).values()))
    res = set()
    for k in {r[0] for r in rows}:
        mine = [(f, t) for kk, f, t in rows if kk == k and f < t]
        for gf, gt in every:
            if any(f == gf for f, _ in mine) and any(t == gt for _, t in mine):
                res.add((k, gf, gt))
    return sorted(res, key=repr)


@pytest.mark.parametrize("seed", range(41, 45))
def test_global_blocks(spark, seed):
    rows = random_rows(seed, 14, "abc", 30)
    assert out(literal.global_blocks(rel(spark, rows), K)) == blocks(rows)


def test_count_over_blocks(spark):
    # Two blocks of the whole table; only the first is opened and closed by 3 items.
    rows = [("x", i, 0, 5) for i in (1, 2, 3)] + [("x", 1, 7, 9), ("y", 2, 7, 9)]
    df = rel(spark, rows, "k string, item int, from_d date, to_d date")
    assert out(literal.count_blocks(df, ["item"], K, at_least=3)) == [("x", 0, 5)]
