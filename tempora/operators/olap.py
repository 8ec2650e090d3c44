"""Temporal OLAP: fact totals over the periods of an algebra relation.

Facts are far larger than periods, so they are never shuffled row by row:
either the periods are provably small and are broadcast, or the facts that no
period may take are left out where they are read, and the rest is summed per
item and day.  The second form also bounds a hot item to one row per day before
it meets its periods.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.spans import FROM, TO, contains_day, spans_contain, spans_intersect
from tempora.operators.periods import CELL_DAYS, Keys, cell_of, in_cells, unpack, valid
from tempora.operators.sized import SHARED_BYTES, is_small, salted, small
from tempora.sources.tables import replace_table, scratch_dir

TOTAL = "decimal(18,2)"


# Facts are stored by ranges of so many date keys.
DATE_CELL, CELL_KEYS = "date_cell", 128
# Cells that tell which items and months a relation has: what a broadcast of
# them takes is bounded by their number, however large the relation is.
CELLS = 1 << 20


def with_date_cell(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DATE_CELL, F.floor(F.col("date_sk") / CELL_KEYS).cast("int"))


def with_day(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Replace the date key by the day.

    The calendar carries no hint: Spark broadcasts one of normal size by its
    own threshold.  A condition on the day then prunes facts stored by date.
    """
    days, on = calendar.select("date_sk", F.col("d").alias("sold_d")), ["date_sk"]
    if DATE_CELL in facts.columns:
        days, on = with_date_cell(days), [DATE_CELL, *on]
    return facts.join(days, on).drop(*on)


def pruned(facts: DataFrame, rel: DataFrame, key: str = "item_id") -> DataFrame:
    """Facts without most of those that no row of the relation takes.

    Days outside the relation's first and last are not read where facts are
    stored by date.  Of the rest, those stay whose item and month fall in a cell
    that the relation has; with too many rows for the cells all stay.
    """
    if FROM in rel.columns:
        periods = valid(rel.select(key, FROM, TO))
        first, end = (periods.agg(bound).scalar() for bound in (F.min(FROM), F.max(TO)))
        facts = facts.where((F.col("sold_d") >= first) & (F.col("sold_d") < end))
        rel, own = in_cells(periods, FROM, TO), [key, cell_of(F.col("sold_d"))]
        other = [key, "cell"]
    else:
        own = other = [key]
    taken = rel.select(F.pmod(F.xxhash64(*other), F.lit(CELLS)).cast("int").alias("_taken")).distinct()
    of = facts.withColumn("_taken", F.pmod(F.xxhash64(*own), F.lit(CELLS)).cast("int"))
    # Stored, so that Spark knows how few they are and broadcasts them by itself.
    taken = replace_table(taken, f"{scratch_dir(taken.sparkSession)}/taken")
    return of.join(taken, "_taken", "left_semi").drop("_taken")


def per_day(facts: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per item and day; the sum of missing amounts stays NULL."""
    return facts.groupBy(key, "sold_d").agg(F.sum("net_paid").alias("net_paid"))


def join_facts(
    facts: DataFrame,
    rel: DataFrame,
    condition: Column | Callable[[Column], Column] | None,
    rel_rows: int | None = None,
    key: str = "item_id",
    prune: bool = True,
) -> DataFrame:
    """Facts of each relation row: equal item, and the condition on the day.

    ``rel_rows`` is an upper bound of the rows of ``rel``.  ``prune`` works the
    relation out once more, to leave facts out before they are summed.  With the
    condition as a function of the day, facts are summed within their row.
    """
    if callable(condition) and not isinstance(condition, Column):
        return _paid(facts, rel, condition, key)
    if not is_small(rel, rel_rows):
        facts = per_day(pruned(facts, rel, key) if prune else facts, key)
    f, r = facts.alias("f"), small(rel, rel_rows).alias("r")
    on = F.col(f"f.{key}") == F.col(f"r.{key}")
    if condition is not None:
        on = on & condition
    return f.join(r, on).select("r.*", "f.sold_d", "f.net_paid")


def _paid(facts: DataFrame, rel: DataFrame, holds: Callable[[Column], Column], key: str) -> DataFrame:
    """Relation rows that have facts, each once, with their sum as ``net_paid``.

    The facts of an item stand beside its rows as a list, one entry a day at
    most, so there is no row for each pair, and what is to be summed over rows
    is not shuffled before it is summed within them.
    """
    daily = per_day(facts, key)
    kind = daily.schema["net_paid"].dataType
    kind = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
    days = F.collect_list(F.struct("sold_d", F.col("net_paid").cast(kind).alias("net_paid")))
    of = rel.join(daily.groupBy(key).agg(days.alias("_days")), key)
    of = of.withColumn("_days", F.filter("_days", lambda x: holds(x["sold_d"]))).where(F.size("_days") > 0)
    paid = F.aggregate("_days", F.lit(None).cast(kind), lambda s, x: F.coalesce((s + x["net_paid"]).cast(kind), s, x["net_paid"]))
    return of.select(*rel.columns, paid.alias("net_paid"))


def total(joined: DataFrame, group: Keys) -> DataFrame:
    return joined.groupBy(*group).agg(F.sum("net_paid").cast(TOTAL).alias("total_sales"))


def by_period(facts: DataFrame, periods: DataFrame, rel_rows: int | None = None) -> DataFrame:
    """Total per item and period of the sales on a day of the period."""
    inside = contains_day(F.col(FROM), F.col(TO), F.col("sold_d"))
    return total(join_facts(facts, periods, inside, rel_rows), ["item_id", FROM, TO])


def _with_sets(joined: DataFrame, packed: DataFrame) -> DataFrame:
    """Sum facts per item, then put the item's set beside the sum."""
    return packed.select("item_id", "vt").join(total(joined, ["item_id"]), "item_id")


def by_span_set(facts: DataFrame, packed: DataFrame, rel_rows: int | None = None) -> DataFrame:
    """Total per item and span set of the sales on a day of the set.

    ``packed`` has one set per item.  Facts meet its periods as rows, of which
    at most one holds a day; ``rel_rows`` bounds those.
    """
    inside = contains_day(F.col(FROM), F.col(TO), F.col("sold_d"))
    periods = unpack(packed.select("item_id", "vt"))
    return _with_sets(join_facts(facts, periods, inside, rel_rows), packed)


def by_span_set_any_day(
    facts: DataFrame, packed: DataFrame, rel_rows: int | None = None
) -> DataFrame:
    """As :func:`by_span_set` without a day test: all sales of the item."""
    return _with_sets(join_facts(facts, packed.select("item_id"), None, rel_rows), packed)


def _with_periods(
    members: DataFrame, category_periods: DataFrame, category_rows: int | None
) -> DataFrame:
    """Rows of a category with the list ``qs`` of all its periods.

    Categories are few and their item lists long: without a broadcast the rows
    of one are spread, and none is copied.  A broadcast is behind a bound of the
    cells of days that the periods touch, above what their lists take.
    """
    q = valid(category_periods.select("cat_id", FROM, TO))
    lists = q.groupBy("cat_id").agg(F.array_sort(F.collect_list(F.struct(FROM, TO))).alias("qs"))
    if category_rows is not None:
        # Of the stored periods, which are counted too.
        most = q.agg(F.coalesce(F.sum(F.ceil(F.datediff(TO, FROM) / CELL_DAYS) + 1), F.lit(0))).first()[0]
        # The table has the cells and keys of its rows besides.
        if is_small(q.withColumn("q", F.struct(FROM, TO)), 2 * most, SHARED_BYTES):
            return members.join(F.broadcast(lists), "cat_id")
    members, lists = salted(members, lists)
    return members.join(lists, ["cat_id", "salt"]).drop("salt")


def _members(
    item_category: DataFrame, category_periods: DataFrame, category_rows: int | None
) -> DataFrame:
    """Item periods in a category met with the periods of the category."""
    ic = valid(item_category.select("item_id", "cat_id", FROM, TO)).select("item_id", "cat_id", F.struct(FROM, TO).alias("ic"))
    of = _with_periods(ic, category_periods, category_rows)
    met = F.filter("qs", lambda q: (q[FROM] < F.col(f"ic.{TO}")) & (F.col(f"ic.{FROM}") < q[TO]))
    return _common(of.select("item_id", "cat_id", "ic", F.explode(met).alias("q")))


def _common(pairs: DataFrame) -> DataFrame:
    """Add the common period of ``ic`` and ``q``."""
    return pairs.withColumns({FROM: F.greatest(f"ic.{FROM}", f"q.{FROM}"), TO: F.least(f"ic.{TO}", f"q.{TO}")})


def by_category(
    facts: DataFrame,
    item_category: DataFrame,
    category_periods: DataFrame,
    category_rows: int | None = None,
) -> DataFrame:
    """Total per category and common period of the sales on a day of it."""
    inside = contains_day(F.col(FROM), F.col(TO), F.col("sold_d"))
    members = _members(item_category, category_periods, category_rows)
    return total(join_facts(facts, members, inside, prune=False), ["cat_id", FROM, TO])


def by_category_literal(
    facts: DataFrame,
    item_category: DataFrame,
    category_periods: DataFrame,
    category_rows: int | None = None,
) -> DataFrame:
    """Parity form: the day is tested against the category's period only, and
    groups are the raw period pairs although only their common part is shown,
    so equal-looking rows can occur.

    Every period of an item in a category gets the same sales of a period of
    the category, so these are summed once per item before they meet the pairs.
    """
    pairs = _members(item_category, category_periods, category_rows).select("item_id", "cat_id", "ic", "q")
    # Rows of an item together: neither grouping nor the join shuffles them again.
    met = pairs.repartition("item_id").groupBy("item_id", "cat_id", "q").agg(F.collect_list("ic").alias("ics"))
    paid = join_facts(facts, met, lambda day: contains_day(F.col(f"q.{FROM}"), F.col(f"q.{TO}"), day))
    totals = total(paid.withColumn("ic", F.explode("ics")), ["cat_id", "ic", "q"])
    return _common(totals).select("cat_id", FROM, TO, "total_sales")


def by_category_span_set(
    facts: DataFrame,
    item_category_ss: DataFrame,
    category_periods: DataFrame,
    category_rows: int | None = None,
) -> DataFrame:
    """Packed parity form: grouped by the value of the common span set, the
    day again tested against the category's set only.

    ``item_category_ss`` has one set per item and category; it meets the
    category's set in its row.  ``category_periods`` are that set as rows.
    """
    members = item_category_ss.select("item_id", "cat_id", "vt")
    sets = _with_periods(members, category_periods, category_rows)
    # Every period of the category's set counts, met by the item or not.
    sets = sets.withColumn("vt", spans_intersect(F.col("vt"), F.col("qs"))).where("vt is not null")
    paid = join_facts(facts, sets, lambda day: spans_contain(F.col("qs"), day))
    return total(paid, ["cat_id", "vt"])
