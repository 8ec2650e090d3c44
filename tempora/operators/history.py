"""Warehouse construction: valid-time tables out of item versions.

Input columns: ``item_sk, item_id, from_d, to_d, item_desc, price, brand_id,
brand, cat_id, category``.  ``*_ss`` tables hold one packed span set per key,
the others one row per maximal period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.spans import span
from tempora.operators.periods import coalesce_dense, coalesce_periods, pack
from tempora.operators.sized import small


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows that come first per key, ties included.

    Spark prunes each input partition to its own first rows before the
    shuffle (window group limit), so a hot key ships few rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.rank().over(w)).where("place = 1").drop("place")


def item(scd: DataFrame) -> DataFrame:
    """Latest description per item; an unknown start counts as latest."""
    first = _first(
        scd.select("item_id", "item_desc", "from_d"),
        ["item_id"],
        [F.desc_nulls_first("from_d")],
    )
    return first.select("item_id", "item_desc")


def _representative(scd: DataFrame, key: str, name: str) -> DataFrame:
    """Name in the newest version of the smallest item id that has the key."""
    first = _first(
        scd.select(key, name, "item_id", "from_d"),
        [key],
        [F.asc_nulls_last("item_id"), F.desc_nulls_first("from_d")],
    )
    return first.select(key, name)


def brand(scd: DataFrame) -> DataFrame:
    return _representative(scd, "brand_id", "brand")


def category(scd: DataFrame) -> DataFrame:
    return _representative(scd, "cat_id", "category")


def lifespan(scd: DataFrame, key: str = "item_id") -> DataFrame:
    """Maximal periods in which the key has any version.

    Items have few versions each; brands and categories are few with many.
    """
    return (coalesce_periods if key == "item_id" else coalesce_dense)(scd, [key])


def with_lifespan(entities: DataFrame, scd: DataFrame, key: str) -> DataFrame:
    """Add the packed lifespan; NULL where no version has a valid period."""
    return entities.join(pack(lifespan(scd, key), [key]), key, "left")


def item_ss(scd: DataFrame) -> DataFrame:
    return with_lifespan(item(scd), scd, "item_id")


def brand_ss(scd: DataFrame) -> DataFrame:
    return with_lifespan(brand(scd), scd, "brand_id")


def category_ss(scd: DataFrame) -> DataFrame:
    return with_lifespan(category(scd), scd, "cat_id")


def attribute(scd: DataFrame, name: str) -> DataFrame:
    """Maximal periods per (item, attribute value); missing values are left out."""
    return coalesce_periods(scd.where(F.col(name).isNotNull()), ["item_id", name])


def attribute_ss(scd: DataFrame, name: str) -> DataFrame:
    return pack(attribute(scd, name), ["item_id", name])


def item_category(scd: DataFrame) -> DataFrame:
    return attribute(scd, "cat_id")


def item_category_ss(scd: DataFrame) -> DataFrame:
    return attribute_ss(scd, "cat_id")


def item_brand(scd: DataFrame) -> DataFrame:
    return attribute(scd, "brand_id")


def item_brand_ss(scd: DataFrame) -> DataFrame:
    return attribute_ss(scd, "brand_id")


def item_price(scd: DataFrame) -> DataFrame:
    return attribute(scd, "price")


def item_price_ss(scd: DataFrame) -> DataFrame:
    return attribute_ss(scd, "price")


def calendar_spans(calendar: DataFrame) -> DataFrame:
    """Add the one-day span ``[d, d + 1)`` to each calendar day."""
    return calendar.withColumn("day_span", span("d"))


def denormalise(facts: DataFrame, scd: DataFrame, scd_rows: int | None = None) -> DataFrame:
    """Put the natural item key on each fact; NULL where the key is unknown.

    ``scd_rows`` is an upper bound of the rows of ``scd``; with a small one the
    keys are broadcast and the facts are not shuffled.
    """
    keys = scd.select("item_sk", "item_id")
    return facts.join(small(keys, scd_rows), "item_sk", "left")


def build(scd: DataFrame) -> dict[str, DataFrame]:
    """All dimension tables by name; both designs."""
    return {
        "scd_item": scd,
        "item": item(scd),
        "item_ls": lifespan(scd),
        "item_price": item_price(scd),
        "brand": brand(scd),
        "category": category(scd),
        "item_brand": item_brand(scd),
        "item_category": item_category(scd),
        "item_ss": item_ss(scd),
        "item_price_ss": item_price_ss(scd),
        "brand_ss": brand_ss(scd),
        "category_ss": category_ss(scd),
        "item_brand_ss": item_brand_ss(scd),
        "item_category_ss": item_category_ss(scd),
    }
