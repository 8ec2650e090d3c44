"""Kernels over interval rows ``(keys..., from_d, to_d)``.

A hot key cannot overload a task: each kernel first aggregates to at most one
row per (key, day), with map-side combining and a shuffle on both columns, and
only then windows per key.  A key therefore never has more rows in one window
than there are distinct days in the data, however many rows it started with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.spans import FROM, SPANS_TYPE, TO, spans_normal

Keys = Sequence[str]


def valid(df: DataFrame) -> DataFrame:
    """Drop rows with a missing bound and empty or inverted periods."""
    return df.where(F.col(FROM) < F.col(TO))


def coalesce_periods(df: DataFrame, keys: Keys) -> DataFrame:
    """Merge overlapping and adjacent periods per key into maximal ones."""
    return _merged(valid(df).groupBy(*keys, FROM).agg(F.max(TO).alias(TO)), keys)


def _merged(by_start: DataFrame, keys: Keys) -> DataFrame:
    """Maximal periods out of at most one row per key and start."""
    w = Window.partitionBy(*keys).orderBy(FROM)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = by_start.select(
        *keys,
        FROM,
        F.max(TO).over(before).alias("reached"),
        F.max(TO).over(whole).alias("last"),
    ).where(F.col("reached").isNull() | (F.col(FROM) > F.col("reached")))
    # A period ends where the rows before the next head had reached.
    end = F.coalesce(F.lead("reached").over(w), F.col("last"))
    return heads.select(*keys, FROM, end.alias(TO))


# Days whose coverage one number tells.
MASK_DAYS = 64


def coalesce_dense(df: DataFrame, keys: Keys) -> DataFrame:
    """As :func:`coalesce_periods`, for few keys with many periods each.

    Periods that start in the same 64 days are one state: the days they cover
    of these as bits, and the last day they reach.  States of a key are merged
    by OR and maximum before the shuffle, which so carries about the islands
    that a key has, not a row for each day on which some period starts.
    """
    start, end = F.unix_date(FROM), F.unix_date(TO)
    cell = F.floor(start / MASK_DAYS).cast("int")
    placed = valid(df).select(*keys, cell.alias("cell"), (start - cell * MASK_DAYS).alias("at"), end.alias("reach"))
    inside = F.least(F.col("reach") - F.col("cell") * MASK_DAYS, F.lit(MASK_DAYS)) - F.col("at")
    placed = placed.withColumn("n", inside.cast("int"))
    mask = F.expr("shiftleft(shiftrightunsigned(-1L, 64 - n), at)")
    states = placed.groupBy(*keys, "cell").agg(F.bit_or(mask).alias("mask"), F.max("reach").alias("reach"))
    # First and last bits of the islands of a state.
    edges = states.withColumns({"first": F.expr("mask & ~shiftleft(mask, 1)"), "last": F.expr("mask & ~shiftrightunsigned(mask, 1)")})

    def bits(name: str) -> Column:
        # All bits below a single one; there is no number less than the last bit alone.
        one = F.expr(f"array(coalesce(bit_count(try_subtract({name}, 1L)), {MASK_DAYS - 1}))")
        many = F.expr(f"filter(sequence(0, {MASK_DAYS - 1}), i -> getbit({name}, i) = 1)")
        return F.when(F.bit_count("first") == 1, one).otherwise(many)

    islands = edges.select(*keys, "cell", "reach", F.explode(F.arrays_zip(bits("first").alias("a"), bits("last").alias("z"))).alias("x"))
    base = F.col("cell") * MASK_DAYS
    # What covers the last of the days goes on as far as any period of the state.
    to = F.when(F.col("x.z") == MASK_DAYS - 1, F.col("reach")).otherwise(base + F.col("x.z") + 1)
    return _merged(islands.select(*keys, F.date_from_unix_date((base + F.col("x.a")).cast("int")).alias(FROM), F.date_from_unix_date(to.cast("int")).alias(TO)), keys)


def _bounds(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in (FROM, TO)})


def to_timestamps(df: DataFrame) -> DataFrame:
    """Periods of days as periods of time, from midnight to midnight.

    Kernels take either; day cells and :func:`coalesce_dense` are for days.
    """
    return _bounds(df, "timestamp_ntz")


def to_dates(df: DataFrame) -> DataFrame:
    """Periods of time that begin and end at midnight as periods of days."""
    return _bounds(df, "date")


def pack(df: DataFrame, keys: Keys, name: str = "vt") -> DataFrame:
    """One span set per key.  ``df`` must be coalesced on ``keys``."""
    spans = F.array_sort(F.collect_list(F.struct(FROM, TO)))
    kind = SPANS_TYPE.replace("date", df.schema[FROM].dataType.simpleString())
    return df.groupBy(*keys).agg(spans.cast(kind).alias(name))


def pack_union(df: DataFrame, keys: Keys, name: str = "vt") -> DataFrame:
    """One span set per key, the union of the sets of its rows.

    For keys whose rows are bounded, such as items, which have a row a day at most.
    """
    return df.groupBy(*keys).agg(F.flatten(F.collect_list(name)).alias(name)).withColumn(name, spans_normal(F.col(name)))


def unpack(df: DataFrame, name: str = "vt") -> DataFrame:
    """One row per span; an empty or NULL span set gives no rows."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.inline(name))


def _edges(
    df: DataFrame, keys: Keys, dl: Column, dr: Column, nl: Column, nr: Column
) -> DataFrame:
    """What each side gains on the day a period opens and loses when it closes."""
    zero = F.lit(0)

    def edge(day: str, *values: Column) -> Column:
        named = zip(("dl", "dr", "nl", "nr"), values)
        return F.struct(F.col(day).alias("t"), *[v.alias(n) for n, v in named])

    both = F.array(edge(FROM, dl, dr, nl, nr), edge(TO, -dl, -dr, zero, zero))
    return valid(df).select(*keys, F.explode(both).alias("e")).select(*keys, "e.*")


def _levels(edges: DataFrame, keys: Keys) -> DataFrame:
    steps = edges.groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in ("dl", "dr", "nl", "nr")])
    w = Window.partitionBy(*keys).orderBy("t")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return steps.select(
        *keys,
        "t",
        F.sum("dl").over(running).alias("l"),
        F.sum("dr").over(running).alias("r"),
        F.sum("nl").over(whole).alias("nl"),
        F.sum("nr").over(whole).alias("nr"),
    )


def levels(
    left: DataFrame,
    keys: Keys,
    right: DataFrame | None = None,
    right_n: Column | None = None,
) -> DataFrame:
    """How many left and right periods are open from each change day on.

    Columns: keys, ``t``, ``l`` and ``r`` (open from ``t`` until the next row),
    ``nl`` and ``nr`` (all rows of the key on each side).  ``right_n`` says what
    a right row adds to ``nr``, 1 by default.
    """
    one, zero = F.lit(1), F.lit(0)
    edges = _edges(left, keys, one, zero, one, zero)
    if right is not None:
        n = one if right_n is None else right_n
        edges = edges.unionByName(_edges(right, keys, zero, one, zero, n))
    return _levels(edges, keys)


def levels_within(rel: DataFrame, keys: Keys, left: Column, right: Column) -> DataFrame:
    """As :func:`levels`, both sides being conditions on the rows of one
    relation, which is read once.  A row can be on both sides."""
    rows = rel.where(left | right)
    l, r = [F.coalesce(side, F.lit(False)).cast("int") for side in (left, right)]
    return _levels(_edges(rows, keys, l, r, l, r), keys)


def hold(steps: DataFrame, keys: Keys, state: Column) -> DataFrame:
    """Maximal periods during which ``state`` is true of a step function."""
    w = Window.partitionBy(*keys).orderBy("t")
    flips = steps.select(*keys, "t", F.coalesce(state, F.lit(False)).alias("now"))
    flips = flips.select("*", F.lag("now", 1, False).over(w).alias("was"))
    flips = flips.where(F.col("now") != F.col("was"))
    spans = flips.select(*keys, F.col("t").alias(FROM), F.lead("t").over(w).alias(TO), "now")
    return spans.where("now").select(*keys, FROM, TO)


def sweep(
    left: DataFrame, keys: Keys, state: Column, right: DataFrame | None = None
) -> DataFrame:
    """Maximal periods per key where ``state`` holds; see :func:`levels`.

    One pass over the change days replaces any pairing of left and right rows.
    """
    return hold(levels(left, keys, right), keys, state)


def tcount(df: DataFrame, keys: Keys) -> DataFrame:
    """Temporal count ``(keys, from_d, to_d, n)``: how many rows are open.

    Equal neighbours are merged and stretches with no open row are left out.
    ``df`` must be coalesced per counted entity.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    steps = levels(df, keys).select(*keys, "t", F.col("l").alias("n"))
    steps = steps.select("*", F.lag("n", 1, 0).over(w).alias("was"))
    steps = steps.where(F.col("n") != F.col("was"))
    spans = steps.select(*keys, F.col("t").alias(FROM), F.lead("t").over(w).alias(TO), "n")
    return spans.where(F.col("n") > 0)


def split_timeline(df: DataFrame, keys: Keys) -> DataFrame:
    """Elementary periods between consecutive change days of each key."""
    days = valid(df).select(*keys, F.explode(F.array(FROM, TO)).alias("t")).distinct()
    w = Window.partitionBy(*keys).orderBy("t")
    spans = days.select(*keys, F.col("t").alias(FROM), F.lead("t").over(w).alias(TO))
    return spans.where(F.col(TO).isNotNull())


# Days to a cell: periods of weeks to years cover few, and few of a cell's periods miss a start in it.
CELL_DAYS = 32


def cell_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / CELL_DAYS).cast("int")


def in_cells(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """A row for each cell of days that the period touches."""
    return df.withColumn("cell", F.explode(F.sequence(cell_of(F.col(lower)), cell_of(F.date_sub(F.col(upper), 1)))))


def intersect_rows(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Temporal equi-join: the common period of each overlapping pair.

    Keeps the other columns of both sides.  Of two that overlap, the one that
    starts later starts inside the other: it is looked for in the cell of days
    where it starts, among the periods that touch that cell.  A pair is made
    once, and few are tested that do not overlap, however many periods a key
    has; a hot key is spread over its cells.
    """
    l = valid(left).withColumnsRenamed({FROM: "l_from", TO: "l_to"})
    r = valid(right).withColumnsRenamed({FROM: "r_from", TO: "r_to"})

    def met(first: DataFrame, lo: str, hi: str, then: DataFrame, start: str, ties: bool) -> DataFrame:
        """Pairs of which ``then`` starts inside ``first``, with ``ties`` on its first day too."""
        first, then = in_cells(first, lo, hi), then.withColumn("cell", cell_of(F.col(start)))
        after = F.col(start) >= F.col(lo) if ties else F.col(start) > F.col(lo)
        return first.alias("a").join(then.alias("b"), [*keys, "cell"]).where(after & (F.col(start) < F.col(hi)))

    rest = [*[c for c in left.columns if c not in (FROM, TO)], *[c for c in right.columns if c not in (FROM, TO, *keys)]]
    common = (F.greatest("l_from", "r_from").alias(FROM), F.least("l_to", "r_to").alias(TO))
    later = met(l, "l_from", "l_to", r, "r_from", True).select(*rest, *common)
    return later.unionAll(met(r, "r_from", "r_to", l, "l_from", False).select(*rest, *common))
