"""Column expressions over spans and span sets.

A span is ``struct<from_d: date, to_d: date>``, half-open.  A span set is a
sorted array of disjoint, non-adjacent spans.  All expressions are built-in
Spark functions; none of them leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.bind import let

FROM, TO = "from_d", "to_d"

SPAN_TYPE = "struct<from_d: date, to_d: date>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"


def span(lower: Column | str, upper: Column | str | None = None) -> Column:
    """``[lower, upper)``, or the single day ``[lower, lower + 1)``.

    NULL when a bound is missing or the period is empty.
    """
    lo = F.col(lower) if isinstance(lower, str) else lower
    if upper is None:
        hi = F.date_add(lo, 1)
    else:
        hi = F.col(upper) if isinstance(upper, str) else upper
    return F.when(lo < hi, F.struct(lo.alias(FROM), hi.alias(TO)))


def lower(s: Column) -> Column:
    return s[FROM]


def upper(s: Column) -> Column:
    return s[TO]


def overlap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Two half-open periods share at least one day."""
    return (from_a < to_b) & (from_b < to_a)


def contains_day(from_d: Column, to_d: Column, day: Column) -> Column:
    return (from_d <= day) & (day < to_d)


def spans_contain(spans: Column, day: Column) -> Column:
    """The span set covers the day."""
    return F.exists(spans, lambda s: contains_day(s[FROM], s[TO], day))


def _spans_of(steps: Column) -> Column:
    """The span set of a step function, given as sorted ``t, on``; NULL when empty.

    Of several steps of one day the last counts.
    """

    def turns(x: Column) -> Column:
        # The last step of each day, then those that differ from the one before.
        last = F.filter(x, lambda s, i: (i == F.size(x) - 1) | (F.get(x, i + 1)["t"] != s["t"]))
        return let(last, lambda y: F.filter(y, lambda s, i: s["on"] != F.coalesce(F.get(y, i - 1)["on"], F.lit(False))))

    def paired(y: Column) -> Column:
        opened = F.filter(F.sequence(F.lit(0), F.size(y) - 1), lambda i: i % 2 == 0)
        return F.when(F.size(y) > 0, F.transform(opened, lambda i: F.struct(F.get(y, i)["t"].alias(FROM), F.get(y, i + 1)["t"].alias(TO))))

    return let(let(steps, turns), paired)


def _edges(spans: Column, side: int) -> Column:
    """``t, side, i``: both bounds of sorted spans, numbered in their order."""

    def both(s: Column, i: Column) -> Column:
        return F.array(*[F.struct(t.alias("t"), F.lit(side).alias("side"), (2 * i + k).alias("i")) for k, t in enumerate((s[FROM], s[TO]))])

    return F.flatten(F.transform(spans, both))


def _states(a: Column, b: Column) -> Column:
    """``t, a, b``: whether either set holds from each bound on, in one merge of both.

    The bounds of a set open and close it in turn.  A bound's place among all,
    less its place among its own, is how many of the other set are before it.
    """

    def state(e: Column, place: Column) -> Column:
        own, other = e["i"] % 2 == 0, (place - e["i"]) % 2 == 1
        is_a = e["side"] == 0
        return F.struct(e["t"].alias("t"), F.when(is_a, own).otherwise(other).alias("a"), F.when(is_a, other).otherwise(own).alias("b"))

    known = F.filter(F.array(_edges(a, 0), _edges(b, 1)), lambda x: x.isNotNull())
    return F.transform(F.array_sort(F.flatten(known)), state)


def _combined(a: Column, b: Column, holds: Callable[[Column, Column], Column]) -> Column:
    steps = F.transform(_states(a, b), lambda s: F.struct(s["t"].alias("t"), holds(s["a"], s["b"]).alias("on")))
    return _spans_of(steps)


def spans_overlap(a: Column, b: Column) -> Column:
    """The two span sets share at least one day."""
    return spans_intersect(a, b).isNotNull()


def spans_intersect(a: Column, b: Column) -> Column:
    """Days of both span sets, NULL when there are none.

    As :func:`spans_union` and :func:`spans_minus`: one merge of both sets, whose
    size is the sum of theirs, without a shuffle.  A NULL set is empty.
    """
    return _combined(a, b, lambda x, y: x & y)


def spans_union(a: Column, b: Column) -> Column:
    """Days of either span set, NULL when there are none."""
    return _combined(a, b, lambda x, y: x | y)


def spans_minus(a: Column, b: Column) -> Column:
    """Days of the first span set that the second has not, NULL when there are none."""
    return _combined(a, b, lambda x, y: x & ~y)


def spans_normal(spans: Column) -> Column:
    """The span set of any spans, in any order and overlapping; NULL when empty.

    Starts and ends are sorted apart, so that the place of each among all of
    them tells how many spans are open.
    """
    good = F.filter(spans, lambda s: s[FROM] < s[TO])

    def sorted_days(x: Column, bound: str, kind: int) -> Column:
        days = F.array_sort(F.transform(x, lambda s: s[bound]))
        return F.transform(days, lambda t, i: F.struct(t.alias("t"), F.lit(kind).alias("kind"), i.alias("i")))

    def opened(e: Column, place: Column) -> Column:
        # Starts less ends so far, this one included.
        n = F.when(e["kind"] == 0, 2 * e["i"] + 1 - place).otherwise(place - 2 * e["i"] - 1)
        return F.struct(e["t"].alias("t"), (n > 0).alias("on"))

    def steps(x: Column) -> Column:
        return F.transform(F.array_sort(F.concat(sorted_days(x, FROM, 0), sorted_days(x, TO, 1))), opened)

    return F.when(F.size(spans) > 0, _spans_of(let(good, steps)))


def spans_text(spans: Column) -> Column:
    """``{[2001-01-01, 2001-02-01), ...}``"""
    parts = F.transform(
        spans,
        lambda s: F.concat(
            F.lit("["), s[FROM].cast("string"), F.lit(", "), s[TO].cast("string"), F.lit(")")
        ),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
