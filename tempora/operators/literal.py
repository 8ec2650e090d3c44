"""Parity variants of difference and aggregation.

The published query texts differ from their stated intent.  These functions
return what the texts return; the intended operators are in ``algebra``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.spans import FROM, TO
from tempora.operators.periods import (
    Keys,
    coalesce_periods,
    hold,
    levels,
    sweep,
    valid,
)


def difference_pairwise(left: DataFrame, right_ss: DataFrame, keys: Keys) -> DataFrame:
    """Union over the right rows of (left - that row) = left - intersection.

    ``right_ss`` holds several packed rows per key.  A day is removed only when
    all of them cover it.  Keys without a right row are left out.
    """
    per_set = right_ss.select(*keys, F.posexplode("vt").alias("pos", "s")).select(
        *keys, "s.*", (F.col("pos") == 0).cast("int").alias("first")
    )
    steps = levels(left, keys, per_set, right_n=F.col("first"))
    return hold(steps, keys, (F.col("l") > 0) & (F.col("r") < F.col("nr")))


def difference_cases(
    left: DataFrame, right: DataFrame, keys: Keys, guarded: bool
) -> DataFrame:
    """Three-case difference, per key with left periods B and right periods P:

    1. from the start of each B to the next start of a P;
    2. from the last end of a P before the end of each B to that end;
    3. every gap between consecutive Ps, for keys that have a B.

    No case is clipped to B on its open side, so the result can reach outside
    B.  ``guarded`` drops case 1 where a P covers the start of B and case 2
    where a P covers the end.
    """
    b = coalesce_periods(left, keys)
    p = coalesce_periods(right, keys)
    none = F.lit(None).cast("date")
    points = F.array(
        F.struct(F.col(FROM).alias("t"), F.lit("open").alias("at")),
        F.struct(F.col(TO).alias("t"), F.lit("close").alias("at")),
    )

    def marks(df: DataFrame, is_left: bool) -> DataFrame:
        e = df.select(*keys, FROM, TO, F.explode(points).alias("e"))
        side = F.lit("b" if is_left else "p")
        return e.select(*keys, FROM, TO, "e.t", "e.at", side.alias("side"))

    rows = marks(b, True).unionByName(marks(p, False))
    day = F.date_diff("t", F.lit("1970-01-01").cast("date"))
    up = Window.partitionBy(*keys).orderBy(day.asc())
    down = Window.partitionBy(*keys).orderBy(day.desc())
    whole = Window.partitionBy(*keys)
    earlier = up.rangeBetween(Window.unboundedPreceding, -1)
    so_far = up.rangeBetween(Window.unboundedPreceding, 0)
    later = down.rangeBetween(Window.unboundedPreceding, -1)

    opens = (F.col("side") == "p") & (F.col("at") == "open")
    closes = (F.col("side") == "p") & (F.col("at") == "close")
    seen = rows.select(
        "*",
        F.min(F.when(opens, F.col("t"))).over(later).alias("next_open"),
        F.max(F.when(closes, F.col("t"))).over(earlier).alias("last_close"),
        F.max(F.when(opens, F.col(TO))).over(earlier).alias("reach_before"),
        F.max(F.when(opens, F.col(TO))).over(so_far).alias("reach"),
        F.max(F.col("side") == "b").over(whole).alias("has_left"),
    )
    start = (F.col("side") == "b") & (F.col("at") == "open")
    end = (F.col("side") == "b") & (F.col("at") == "close")
    if guarded:
        start = start & ~F.coalesce(F.col("reach") > F.col("t"), F.lit(False))
        end = end & ~F.coalesce(F.col("reach_before") >= F.col("t"), F.lit(False))
    gap = closes & F.col("has_left")
    cases = seen.select(
        *keys,
        F.when(start | gap, F.col("t")).when(end, F.col("last_close")).otherwise(none).alias(FROM),
        F.when(start | gap, F.col("next_open")).when(end, F.col("t")).otherwise(none).alias(TO),
    )
    return coalesce_periods(cases, keys)


def global_blocks(rel: DataFrame, keys: Keys) -> DataFrame:
    """Blocks of the whole table, kept for keys that open and close in them.

    Gaps are looked for among all rows instead of among those of the key: a
    maximal period of the whole table is returned for a key if the key has a
    row that starts with it and a row that ends with it.
    """
    rows = valid(rel)
    # One row per distinct day at most, so one task is enough.
    blocks = coalesce_periods(
        rows.groupBy(FROM).agg(F.max(TO).alias(TO)).withColumn("all", F.lit(0)), ["all"]
    ).select(F.col(FROM).alias("g_from"), F.col(TO).alias("g_to"))
    edges = F.array(
        F.struct(F.lit("s").alias("edge"), F.col("g_from").alias("t")),
        F.struct(F.lit("e").alias("edge"), F.col("g_to").alias("t")),
    )
    block_edges = blocks.select("*", F.explode(edges).alias("x")).select("g_from", "g_to", "x.*")
    row_edges = rows.select(*keys, F.col(FROM).alias("g_from"), F.col(TO).alias("g_to"))
    row_edges = row_edges.select(*keys, F.explode(edges).alias("x")).select(*keys, "x.*")
    hits = row_edges.join(block_edges, ["edge", "t"])
    both = hits.groupBy(*keys, "g_from", "g_to").agg(
        F.max(F.col("edge") == "s").alias("s"), F.max(F.col("edge") == "e").alias("e")
    )
    return both.where("s and e").select(
        *keys, F.col("g_from").alias(FROM), F.col("g_to").alias(TO)
    )


def count_blocks(rel: DataFrame, entity: Keys, by: Keys, at_least: int) -> DataFrame:
    """Aggregation over :func:`global_blocks` instead of coalesced rows."""
    return sweep(global_blocks(rel, [*entity, *by]), by, F.col("l") >= at_least)
