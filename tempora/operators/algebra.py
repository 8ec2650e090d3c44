"""Temporal algebra on interval rows.

Every operator returns maximal periods per key.  Inputs need not be coalesced
and are relations ``(keys..., from_d, to_d)`` with any further columns.  The
packed design uses the same operators between ``unpack`` and ``pack``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.spans import FROM, TO
from tempora.operators.periods import Keys, coalesce_periods, hold, levels_within, sweep


def selection(rel: DataFrame, condition: Column, keys: Keys) -> DataFrame:
    """When the condition holds for the key."""
    return coalesce_periods(rel.where(condition), keys)


def projection(rel: DataFrame, keys: Keys) -> DataFrame:
    """When the key has any row."""
    return coalesce_periods(rel, keys)


def join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """When the key has a row on both sides."""
    return sweep(left, keys, (F.col("l") > 0) & (F.col("r") > 0), right)


def union(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """When the key has a row on either side."""
    both = left.select(*keys, FROM, TO).unionByName(right.select(*keys, FROM, TO))
    return coalesce_periods(both, keys)


def _left_only(matched_only: bool) -> Column:
    state = (F.col("l") > 0) & (F.col("r") == 0)
    return state & (F.col("nr") > 0) if matched_only else state


def difference(
    left: DataFrame, right: DataFrame, keys: Keys, matched_only: bool = False
) -> DataFrame:
    """When the key has a row on the left and none on the right.

    ``matched_only`` leaves out keys that have no right row at any time.
    """
    return sweep(left, keys, _left_only(matched_only), right)


def difference_within(
    rel: DataFrame, keep: Column, remove: Column, keys: Keys, matched_only: bool = False
) -> DataFrame:
    """Difference of two selections of one relation, in one pass over it."""
    return hold(levels_within(rel, keys, keep, remove), keys, _left_only(matched_only))


def count_coalesced(rel: DataFrame, by: Keys, at_least: int) -> DataFrame:
    """When at least so many rows of the group hold at once.

    ``rel`` is coalesced per counted entity.  Groups may be few and large: rows
    are first reduced to one per group and change day.
    """
    if at_least < 1:
        raise ValueError("at_least must be 1 or more")
    return sweep(rel, by, F.col("l") >= at_least)


def count_when(rel: DataFrame, entity: Keys, by: Keys, at_least: int) -> DataFrame:
    """When at least so many entities are in the group at once."""
    return count_coalesced(coalesce_periods(rel, [*entity, *by]), by, at_least)
