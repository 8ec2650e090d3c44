"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length.  The longest vectors give
each query a first threshold, its k-th best product so far.  In every further
bucket the threshold becomes a cosine, threshold / (|q| * longest): above 1 the
bucket is skipped before anything is shuffled; a high one lets the query's
largest coordinate rule vectors out; a low one, their lengths.  Products of
what is left are verified in whole numbers.

A bucket is dealt into blocks of about ``BLOCK_ROWS`` by a hash of the id, so
many vectors of equal length do not meet in one task; queries are in blocks too.

Results: null vectors and such with a null or non-finite component take no part;
vectors of different dimension are compared as if padded with zeros.  Equal rows
count once; a row is no candidate for a query of its own id.  Products beyond
53 bits are summed in wrapping 64-bit integers.  Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.sources.tables import replace_table, scratch_dir

BLOCK_ROWS = 8192
# Every vector is copied once for each block of queries that may need it; the first
# thresholds need one block of vectors, so there smaller blocks of queries spread the work.
QUERY_ROWS, FIRST_ROWS = 8192, 1024
# Buckets by length; each is dealt into as many blocks as its rows need.
MAX_BUCKETS = 64
# From this local cosine on, coordinates prune better than lengths.
COORDINATE_FROM = 0.5
# Lengths are rounded doubles; bounds give way by this share.
SLACK = 1e-9


def whole_numbers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query_ids))
    query_ids, ids, scores = query_ids[order], ids[order], scores[order]
    new = np.r_[True, query_ids[1:] != query_ids[:-1]] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    keep = place < k
    return pd.DataFrame({"query_id": query_ids[keep], "vec_id": ids[keep], "score": scores[keep]})


def _search(k: int):
    def block(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        width = max(max(map(len, queries["v"])), max(map(len, vectors["v"])), 1)
        q, v = _matrix(queries["v"], width), _matrix(vectors["v"], width)
        qn, vn = queries["norm"].to_numpy(), vectors["norm"].to_numpy()
        ids, qids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        least = queries["least"].to_numpy(np.float64)
        order = np.argsort(-vn, kind="stable")
        v, vn, ids = v[order], vn[order], ids[order]
        in_doubles = qn.max() * vn.max() < 2.0**52
        vd, qd = (v.astype(np.float64), q.astype(np.float64)) if in_doubles else (v, q)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            rows: np.ndarray | slice = slice(0, len(v))
            if np.isfinite(least[i]) and least[i] > 0 and qn[i] > 0:
                local = least[i] / (qn[i] * max(vn[0], 1e-300))
                if local > 1 + SLACK:
                    continue
                # Length pruning: sorted by length, a prefix is left.
                end = int(np.searchsorted(-vn, -(least[i] / qn[i]) * (1 - SLACK), side="right"))
                rows = slice(0, end)
                if local >= COORDINATE_FROM and end:
                    # Coordinate pruning: the product is at most the part of the
                    # largest coordinate plus the lengths of the two remainders.
                    c = int(np.argmax(np.abs(q[i])))
                    x, rest = float(q[i, c]), np.sqrt(max(qn[i] ** 2 - float(q[i, c]) ** 2, 0.0))
                    y = v[:end, c].astype(np.float64)
                    most = x * y + rest * np.sqrt(np.maximum(vn[:end] ** 2 - y**2, 0.0))
                    rows = np.flatnonzero(most >= least[i] - SLACK * qn[i] * vn[0] - 1e-6)
            score = vd[rows] @ qd[i]
            score = np.rint(score).astype(np.int64) if in_doubles else score
            own, at = ids[rows], np.flatnonzero(ids[rows] != qids[i])
            own, score = own[at], score[at]
            if len(score) > k:
                cut = np.partition(score, len(score) - k)[len(score) - k]
                own, score = own[score >= cut], score[score >= cut]
            best = np.lexsort((own, -score))[:k]
            found.append((np.full(len(best), qids[i]), own[best], score[best]))
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    return block


def _scored(queries: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Both sides have the ``block`` of vectors and the ``part`` of queries to meet in."""
    # Fresh column ids: both sides come from one table.
    own = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    return own.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long"
    )


def top_products(vectors: DataFrame, is_query: Column, k: int, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products."""
    spark = vectors.sparkSession
    scratch = scratch_dir(spark)
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), whole_numbers(vector, scale).alias("v"))
        .where("v is not null and vec_id is not null")
        .dropDuplicates(["vec_id", "v"])
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    )
    rows = replace_table(rows, f"{scratch}/vectors")
    total = rows.count()
    # Cuts between lengths: at most MAX_BUCKETS numbers reach the driver.
    buckets = max(1, min(MAX_BUCKETS, total // BLOCK_ROWS))
    cuts = sorted(set(rows.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.001))) if buckets > 1 else []
    # What differs by bucket stands in lists of at most MAX_BUCKETS numbers, each named once: expressions
    # that name all buckets are copied into each other by the optimizer, in the driver.
    bucket = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: F.col("norm") < c)) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table, block = [], 0
    for b in range(max(sizes) + 1):
        deal = -(-sizes[b]["n"] // BLOCK_ROWS) if b in sizes else 1
        table.append((deal, block, sizes[b]["longest"] if b in sizes else 0.0))
        block += deal
    deals, starts, lengths = (F.lit(list(x)) for x in zip(*table, strict=True))
    block_of = F.get(starts, "bucket") + F.pmod(F.xxhash64("vec_id", "v"), F.get(deals, "bucket"))
    placed = rows.select("vec_id", "v", "norm", block_of.cast("int").alias("block"))
    asking = rows.where("asks").select("vec_id", "v", "norm")

    def dealt(queries: DataFrame, size: int) -> tuple[DataFrame, int]:
        parts = max(1, -(-total // (100 * size)))
        return queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), parts

    # First thresholds from one block of the longest vectors, which are in the first bucket.
    start, parts = dealt(asking, FIRST_ROWS)
    start = start.withColumn("block", F.lit(0)).withColumn("least", F.lit(None).cast("double"))
    copies = placed.where("block = 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = replace_table(_scored(start, copies, k), f"{scratch}/first")
    if block > 1:
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
        known, _ = dealt(asking, QUERY_ROWS)
        known = known.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        # Buckets whose longest vector cannot reach the threshold get no copy of the query.
        reached = F.filter(
            F.sequence(F.lit(0), F.lit(len(table) - 1)),
            lambda b: F.col("least").isNull() | (F.col("norm") * F.get(lengths, b) * (1 + SLACK) >= F.col("least")),
        )
        known = known.withColumn("met", F.explode(reached)).withColumn("at", F.get(starts, "met"))
        each = F.explode(F.sequence("at", F.col("at") + F.get(deals, "met") - 1)).alias("block")
        met = known.select("vec_id", "v", "norm", "part", "least", each).where("block > 0")
        copies = placed.join(met.select("part", "block").distinct(), "block")
        found = found.unionByName(_scored(met, copies, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
