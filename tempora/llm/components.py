"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.sources.tables import replace_table, scratch_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _pointed(edges: DataFrame, node: str, other: str) -> DataFrame:
    """``node``'s edges with ``least``, the smallest id among it and its neighbours."""
    least = edges.groupBy(node).agg(F.min(F.least(node, other)).alias("least"))
    return edges.join(least, node)


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in the links ``a, b``; the smallest id names it.

    Each round connects a node's larger neighbours, then its smaller ones, to
    the smallest; only minima are grouped, so a hot node never meets its edges
    in one task.  Rounds are written out, which cuts the lineage.
    """
    scratch, step = scratch_dir(links.sparkSession), 0
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = replace_table(edges, f"{scratch}/0")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a")))
        large = _pointed(both, "u", "v").where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b")).distinct()
        pointed = _pointed(large, "b", "a")
        small = pointed.select(F.col("least").alias("a"), F.col("a").alias("b")).unionAll(pointed.select("least", "b"))
        step += 1
        edges = replace_table(small.where("a <> b").distinct(), f"{scratch}/{step}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(roots)
