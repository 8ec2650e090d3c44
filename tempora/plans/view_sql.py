"""The algebra relations as SQL text over stored tables, kept in the catalog.

A view is a name that any session of the catalog can query, and, where the
catalog itself is kept (a metastore), any later application.  The texts say
what the DataFrame form says: rows are first brought to one per key and day,
then one window per key does the rest.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tempora.functions.spans import SPANS_TYPE
from tempora.plans.algebra_views import NAMES
from tempora.sources import csv
from tempora.sources.tables import declare

EVERY = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def coalesced(rows: str, keys: str) -> str:
    """Maximal periods per key."""
    return f"""
    SELECT {keys}, MIN(from_d) AS from_d, MAX(to_d) AS to_d
    FROM (
      SELECT *, COUNT_IF(reach IS NULL OR reach < from_d) OVER (PARTITION BY {keys} ORDER BY from_d) AS island
      FROM (
        SELECT *, MAX(to_d) OVER (PARTITION BY {keys} ORDER BY from_d {EARLIER}) AS reach
        FROM (SELECT {keys}, from_d, MAX(to_d) AS to_d FROM ({rows}) WHERE from_d < to_d GROUP BY {keys}, from_d)))
    GROUP BY {keys}, island"""


def _edges(rows: str, key: str, side: str) -> str:
    """What a side gains on the day a period opens and loses when it closes."""
    gain = {"l": ("1, 0", "-1, 0"), "r": ("0, 1", "0, -1")}[side]
    # The alias drops the table's name; with it, a union of two bucketed tables
    # is not seen to keep their common partitioning.
    return f"""
        SELECT {key} AS {key}, STACK(2, from_d, {gain[0]}, to_d, {gain[1]}) AS (t, l, r)
        FROM ({rows}) WHERE from_d < to_d"""


def swept(keys: str, holds: str, left: str, right: str | None = None) -> str:
    """When ``holds`` is true of the rows open on each side, ``l`` and ``r``;
    ``has_r`` says whether the key has any row on the right."""
    edges = _edges(left, keys, "l") + (" UNION ALL " + _edges(right, keys, "r") if right else "")
    return coalesced(
        f"""
      SELECT {keys}, t AS from_d, until AS to_d
      FROM (
        SELECT {keys}, t, LEAD(t) OVER w AS until, SUM(l) OVER w AS l, SUM(r) OVER w AS r,
               MAX(opens) OVER (PARTITION BY {keys} ORDER BY t {EVERY}) > 0 AS has_r
        FROM (SELECT {keys}, t, SUM(l) AS l, SUM(r) AS r, MAX(r) AS opens FROM ({edges}) GROUP BY {keys}, t)
        WINDOW w AS (PARTITION BY {keys} ORDER BY t))
      WHERE until IS NOT NULL AND {holds}""",
        keys,
    )


def unpacked(sets: str, keys: str) -> str:
    return f"SELECT {keys}, s.from_d, s.to_d FROM (SELECT {keys}, EXPLODE(vt) AS s FROM {sets})"


def packed(rows: str, keys: str) -> str:
    spans = "ARRAY_SORT(COLLECT_LIST(STRUCT(from_d, to_d)))"
    return f"SELECT {keys}, CAST({spans} AS {SPANS_TYPE}) AS vt FROM ({rows}) GROUP BY {keys}"


def uncovered(left: str, right_sets: str, keys: str) -> str:
    """Left days that not all sets of the key cover, of keys that have a set."""
    every = f"SELECT {keys} AS k, COUNT(*) AS n FROM {right_sets} WHERE SIZE(vt) > 0 GROUP BY {keys}"
    edges = f"{_edges(left, keys, 'l')} UNION ALL {_edges(unpacked(right_sets, keys), keys, 'r')}"
    return coalesced(
        f"""
      SELECT {keys}, t AS from_d, until AS to_d
      FROM (
        SELECT {keys}, t, LEAD(t) OVER w AS until, SUM(l) OVER w AS l, SUM(r) OVER w AS r
        FROM (SELECT {keys}, t, SUM(l) AS l, SUM(r) AS r FROM ({edges}) GROUP BY {keys}, t)
        WINDOW w AS (PARTITION BY {keys} ORDER BY t))
      JOIN ({every}) ON {keys} = k
      WHERE until IS NOT NULL AND l > 0 AND r < n""",
        keys,
    )


def cases(left: str, right: str, keys: str, guarded: bool) -> str:
    """The three-case difference of :func:`literal.difference_cases`."""
    start, end = "side = 'b' AND at = 'open'", "side = 'b' AND at = 'close'"
    if guarded:
        start += " AND NOT COALESCE(reach > t, FALSE)"
        end += " AND NOT COALESCE(reach_before >= t, FALSE)"
    gap = "side = 'p' AND at = 'close' AND has_left"
    marks = " UNION ALL ".join(
        f"SELECT {keys} AS {keys}, from_d, to_d, STACK(2, from_d, 'open', to_d, 'close') AS (t, at), '{side}' AS side FROM ({coalesced(rows, keys)})"
        for side, rows in (("b", left), ("p", right))
    )
    by_day = f"PARTITION BY {keys} ORDER BY t RANGE BETWEEN"
    day = "INTERVAL 1 DAY"
    return coalesced(
        f"""
      SELECT {keys}, CASE WHEN ({start}) OR ({gap}) THEN t WHEN {end} THEN last_close END AS from_d,
             CASE WHEN ({start}) OR ({gap}) THEN next_open WHEN {end} THEN t END AS to_d
      FROM (
        SELECT *,
          MIN(CASE WHEN side = 'p' AND at = 'open' THEN t END) OVER ({by_day} {day} FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open,
          MAX(CASE WHEN side = 'p' AND at = 'close' THEN t END) OVER ({by_day} UNBOUNDED PRECEDING AND {day} PRECEDING) AS last_close,
          MAX(CASE WHEN side = 'p' AND at = 'open' THEN to_d END) OVER ({by_day} UNBOUNDED PRECEDING AND {day} PRECEDING) AS reach_before,
          MAX(CASE WHEN side = 'p' AND at = 'open' THEN to_d END) OVER ({by_day} UNBOUNDED PRECEDING AND CURRENT ROW) AS reach,
          MAX(side = 'b') OVER (PARTITION BY {keys}) AS has_left
        FROM ({marks}))""",
        keys,
    )


def whole_blocks(rows: str, keys: str) -> str:
    """Blocks of the whole table, for keys that open and close in them."""
    block = coalesced(f"SELECT 0 AS every, from_d, to_d FROM ({rows})", "every")
    return f"""
      SELECT {keys}, b_from AS from_d, b_to AS to_d
      FROM (SELECT {keys}, STACK(2, 's', from_d, 'e', to_d) AS (edge, t) FROM ({rows}) WHERE from_d < to_d)
      JOIN (SELECT b_from, b_to, STACK(2, 's', b_from, 'e', b_to) AS (b_edge, b_t)
            FROM (SELECT from_d AS b_from, to_d AS b_to FROM ({block})))
        ON edge = b_edge AND t = b_t
      GROUP BY {keys}, b_from, b_to HAVING COUNT(DISTINCT edge) = 2"""


def texts(table: dict[str, str], brand: int, price: int, more_than: int) -> dict[str, str]:
    """SQL text of every relation; ``table`` gives the SQL name of a stored table."""
    item, cat = "item_id", "cat_id"
    v = table["scd_item"]
    is_brand, is_dear = f"brand_id = {int(brand)}", f"price > {int(price)}"

    def where(name: str, condition: str) -> str:
        return f"(SELECT * FROM {table[name]} WHERE {condition})"

    brands, dear = where("item_brand", is_brand), where("item_price", is_dear)
    brand_sets, dear_sets = where("item_brand_ss", is_brand), where("item_price_ss", is_dear)
    brand_spans, dear_spans = unpacked(brand_sets, item), unpacked(dear_sets, item)
    of_versions = [f"SELECT * FROM {v} WHERE {c}" for c in (is_brand, is_dear)]
    join, left_only = "l > 0 AND r > 0", "l > 0 AND r = 0"
    blocks = whole_blocks(f"SELECT * FROM {v}", f"{item}, {cat}")
    return {
        "a1_selection_ss": f"SELECT {item}, vt FROM {brand_sets}",
        "a1_selection_tdw": coalesced(brands, item),
        "a1_selection_scd": coalesced(of_versions[0], item),
        "a2_projection_ss": packed(coalesced(unpacked(table["item_brand_ss"], item), item), item),
        "a2_projection_tdw": coalesced(f"SELECT * FROM {table['item_brand']}", item),
        "a2_projection_scd": coalesced(f"SELECT * FROM {v}", item),
        "a3_join_ss": packed(swept(item, join, brand_spans, dear_spans), item),
        "a3_join_tdw": swept(item, join, brands, dear),
        "a3_join_scd": coalesced(f"SELECT * FROM {v} WHERE {is_brand} AND {is_dear}", item),
        "a4_union_ss": packed(swept(item, "l + r > 0", brand_spans, dear_spans), item),
        "a4_union_tdw": swept(item, "l + r > 0", brands, dear),
        "a4_union_scd": coalesced(f"SELECT * FROM {v} WHERE {is_brand} OR {is_dear}", item),
        "a5_difference": swept(item, f"{left_only} AND has_r", *of_versions),
        "a5_difference_all": swept(item, left_only, *of_versions),
        "a5_difference_ss": packed(uncovered(brand_spans, dear_sets, item), item),
        "a5_difference_tdw": cases(brands, dear, item, guarded=False),
        "a5_difference_scd": cases(*of_versions, item, guarded=True),
        "a6_aggregation": swept(cat, f"l > {int(more_than)}", f"SELECT * FROM {table['item_category']}"),
        "a6_aggregation_ss": packed(swept(cat, f"l > {int(more_than)}", unpacked(table["item_category_ss"], f"{item}, {cat}")), cat),
        "a6_aggregation_tdw": swept(cat, f"l >= {int(more_than)}", f"SELECT * FROM {table['item_category']}"),
        "a6_aggregation_scd": swept(cat, f"l >= {int(more_than)}", blocks),
    }


# Stored tables that the texts read.
READ = ("scd_item", "item_brand", "item_price", "item_category", "item_brand_ss", "item_price_ss", "item_category_ss")


def create_views(
    spark: SparkSession,
    path: str,
    brand: int,
    price: int,
    more_than: int,
    prefix: str = "",
    names: list[str] = NAMES,
) -> list[str]:
    """Create a catalog view per relation over the tables stored under ``path``.

    Tables are declared first, bucketed ones with their buckets.  A view of the
    same name is replaced.  Returns the names, each after ``prefix``.
    """
    table = {name: declare(spark, f"{path}/{name}") for name in READ}
    loaded = spark.table(table["scd_item"])
    if "i_item_id" in loaded.columns:
        # As a load stores it, under the names of the file.
        renamed = ", ".join(f"`{a}` AS `{b}`" for a, b in csv.VERSION_COLUMNS.items())
        table["scd_item"] = f"(SELECT {renamed} FROM {table['scd_item']})"
    text = texts(table, brand, price, more_than)
    for name in names:
        spark.sql(f"CREATE OR REPLACE VIEW {prefix}{name} AS {text[name]}")
    return [f"{prefix}{name}" for name in names]
