"""Algebra and OLAP statements over a warehouse, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.spans import FROM
from tempora.operators import olap
from tempora.operators.periods import unpack
from tempora.operators.sized import is_small
from tempora.plans.algebra_views import NAMES, AlgebraViews
from tempora.sources.tables import replace_table, scratch_dir


@dataclass(frozen=True)
class VersionRows:
    """Upper bounds: all versions, those of the brand, and the dear ones."""

    every: int
    brand: int
    dear: int


# Rows of an item relation, at most: selection and projection only merge rows,
# two-sided operators cut the periods of one side by those of the other.
RELATION_ROWS: dict[str, Callable[[VersionRows], int]] = {
    "a1_selection": lambda n: n.brand,
    "a2_projection": lambda n: n.every,
    "a3_join": lambda n: n.brand + n.dear,
    "a4_union": lambda n: n.brand + n.dear,
    "a5_difference": lambda n: 2 * n.brand + n.dear,
}


@dataclass(frozen=True)
class Warehouse:
    """Tables of all designs by name, facts, and the bounds on version rows;
    without bounds nothing is broadcast."""

    table: Callable[[str], DataFrame]
    sales: DataFrame  # item_id, sold_d, net_paid: facts joined with the calendar
    rows: VersionRows | None
    views: AlgebraViews
    path: str | None = None  # where it is stored


def count_versions(views: AlgebraViews) -> VersionRows:
    """Exact bounds, in one pass over two columns of the stored versions."""
    flags = (F.count_if(views.is_brand), F.count_if(views.is_dear))
    return VersionRows(*views.table("scd_item").agg(F.count("*"), *flags).first())


def _sorted(df: DataFrame) -> DataFrame:
    """Totals are final reports: by entity, then by time."""
    return df.orderBy(*[c for c in ("item_id", "cat_id", FROM) if c in df.columns])


def _by_item(w: Warehouse, relation: str, design: str, total: Callable) -> Callable[[], DataFrame]:
    bound = RELATION_ROWS[relation](w.rows) if w.rows else None
    view = getattr(w.views, f"{relation}{design}")

    def run() -> DataFrame:
        rel, most = view(), bound
        if not is_small(_periods(rel), bound):
            # Facts are left out by it before they meet it: worked out once, not for each of these.
            # Spark would take it for as small as its file, whose values are packed.
            rel, most = replace_table(rel, f"{scratch_dir(rel.sparkSession)}/{relation}{design}").hint("merge"), None
        return _sorted(total(w.sales, rel, most))

    return run


def _periods(rel: DataFrame) -> DataFrame:
    return unpack(rel) if "vt" in rel.columns else rel


def _by_category(w: Warehouse, view: str, members: str, total: Callable) -> Callable[[], DataFrame]:
    def run() -> DataFrame:
        # Used twice and small beside versions and facts: worked out and counted once.
        periods = _periods(getattr(w.views, view)())
        periods = replace_table(periods, f"{scratch_dir(periods.sparkSession)}/{view}")
        bound = periods.count() if w.rows else None
        return _sorted(total(w.sales, w.table(members), periods, bound))

    return run


def statements(w: Warehouse) -> dict[str, Callable[[], DataFrame]]:
    out: dict[str, Callable[[], DataFrame]] = {n: getattr(w.views, n) for n in NAMES}
    for i, relation in enumerate(RELATION_ROWS, start=1):
        any_day = relation == "a5_difference"
        packed = olap.by_span_set_any_day if any_day else olap.by_span_set
        out[f"o{i}_ss"] = _by_item(w, relation, "_ss", packed)
        out[f"o{i}_tdw"] = _by_item(w, relation, "_tdw", olap.by_period)
        out[f"o{i}_scd"] = _by_item(w, relation, "_scd", olap.by_period)
    out["o5"] = _by_item(w, "a5_difference", "", olap.by_period)
    rows, sets = "item_category", "item_category_ss"
    out["o6_ss"] = _by_category(w, "a6_aggregation_ss", sets, olap.by_category_span_set)
    out["o6_tdw"] = _by_category(w, "a6_aggregation_tdw", rows, olap.by_category_literal)
    out["o6_scd"] = _by_category(w, "a6_aggregation_scd", rows, olap.by_category_literal)
    out["o6"] = _by_category(w, "a6_aggregation", rows, olap.by_category)
    return out


ITEM_TOTALS = [f"o{i}_{d}" for i in range(1, 6) for d in ("ss", "tdw", "scd")] + ["o5"]
CATEGORY_TOTALS = ["o6_ss", "o6_tdw", "o6_scd", "o6"]
STATEMENTS = [*NAMES, *ITEM_TOTALS, *CATEGORY_TOTALS]
