from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import topk
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(math.floor(1024 * float(np.float32(x))) for x in v))
    out = []
    for q in sorted(whole):
        if q % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for a in whole[q] for i, vs in whole.items() if i != q for b in vs]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, rows, k, every=10):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    df = df.selectExpr("*", "1 as v", "2 as norm", "3 as bucket", "4 as score")
    return cases.rows_of(topk.top_products(df, F.col("vec_id") % every == 0, k).select("query_id", "rank", "vec_id", "score"))


@pytest.mark.parametrize("seed, spread", [(1, 0.0), (2, 1.5)])
def test_matches_brute_force_in_many_small_blocks(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 24)
    monkeypatch.setattr(topk, "QUERY_ROWS", 1)
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=6) * np.exp(spread * rng.normal())).astype(np.float32).tolist()) for i in range(260)]
    rows += [(500 + i, rows[7][1]) for i in range(60)]  # one vector, many ids: ties
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")]), (603, [float("inf")]), (604, []), (605, [0.0] * 6), (606, [2.0]), (None, [1.0]), rows[10], rows[10]]
    assert run(spark, rows, 5) == brute(rows, 5, 10)


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [0.5]), (2, [-0.5])]
    assert run(spark, rows, 10) == [(0, 1, 1, 524288), (0, 2, 2, -524288)]


def test_large_products_are_exact(spark):
    rows = [(0, [1e6, 1e6]), (1, [1e6, 1.0]), (2, [1e6, 2.0])]
    assert run(spark, rows, 2) == brute(rows, 2, 10)


def test_empty_table(spark):
    assert run(spark, [], 3) == [] and run(spark, [(3, [1.0])], 3) == []


def test_columns_of_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    own = df.select("*", *[F.lit("own").alias(c) for c in (*cases.free_names(df), "query_id", "norm", "block", "part", "e", "limit", "query", "candidate")])
    out = topk.top_products(own, F.col("vec_id") % 10 == 0, k=3)
    assert cases.rows_of(out) == brute(rows, 3, 10)


def test_plan_does_not_grow_with_the_buckets(spark, monkeypatch):
    """Each bucket is a number in a list, not an expression that others repeat."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)

    def plan(block_rows):
        monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
        out = topk.top_products(df, F.col("vec_id") % 100 == 0, k=3)
        assert cases.rows_of(out) == brute(rows, 3, 100)
        return len(out._jdf.queryExecution().optimizedPlan().toString())

    assert plan(6) < 4 * plan(200)  # 64 buckets, 2
