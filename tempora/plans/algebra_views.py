"""The algebra relations by name, over one set of dimension tables.

Each exists per physical design: ``_ss`` on packed span sets, ``_tdw`` on
interval rows, ``_scd`` on item versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators import algebra, literal
from tempora.operators.periods import pack, unpack

ITEM = ["item_id"]
CAT = ["cat_id"]


class AlgebraViews:
    """Parameters: the brand, the price limit, and the count to exceed."""

    def __init__(
        self,
        table: Callable[[str], DataFrame],
        brand: int,
        price: int,
        more_than: int,
    ) -> None:
        self.table = table
        self.is_brand = F.col("brand_id") == brand
        self.is_dear = F.col("price") > price
        self.more_than = more_than

    def brand_rows(self) -> DataFrame:
        return self.table("item_brand").where(self.is_brand)

    def dear_rows(self) -> DataFrame:
        return self.table("item_price").where(self.is_dear)

    def brand_sets(self) -> DataFrame:
        return self.table("item_brand_ss").where(self.is_brand)

    def dear_sets(self) -> DataFrame:
        return self.table("item_price_ss").where(self.is_dear)

    def _versions(self) -> DataFrame:
        return self.table("scd_item")

    def a1_selection_ss(self) -> DataFrame:
        return self.brand_sets().select("item_id", "vt")

    def a1_selection_tdw(self) -> DataFrame:
        return algebra.selection(self.table("item_brand"), self.is_brand, ITEM)

    def a1_selection_scd(self) -> DataFrame:
        return algebra.selection(self._versions(), self.is_brand, ITEM)

    def a2_projection_ss(self) -> DataFrame:
        return pack(algebra.projection(unpack(self.table("item_brand_ss")), ITEM), ITEM)

    def a2_projection_tdw(self) -> DataFrame:
        return algebra.projection(self.table("item_brand"), ITEM)

    def a2_projection_scd(self) -> DataFrame:
        return algebra.projection(self._versions(), ITEM)

    def a3_join_ss(self) -> DataFrame:
        both = algebra.join(unpack(self.brand_sets()), unpack(self.dear_sets()), ITEM)
        return pack(both, ITEM)

    def a3_join_tdw(self) -> DataFrame:
        return algebra.join(self.brand_rows(), self.dear_rows(), ITEM)

    def a3_join_scd(self) -> DataFrame:
        return algebra.selection(self._versions(), self.is_brand & self.is_dear, ITEM)

    def a4_union_ss(self) -> DataFrame:
        either = algebra.union(unpack(self.brand_sets()), unpack(self.dear_sets()), ITEM)
        return pack(either, ITEM)

    def a4_union_tdw(self) -> DataFrame:
        return algebra.union(self.brand_rows(), self.dear_rows(), ITEM)

    def a4_union_scd(self) -> DataFrame:
        return algebra.selection(self._versions(), self.is_brand | self.is_dear, ITEM)

    def _difference(self, matched_only: bool) -> DataFrame:
        return algebra.difference_within(
            self._versions(), self.is_brand, self.is_dear, ITEM, matched_only
        )

    def a5_difference(self) -> DataFrame:
        """Intended meaning: items that are dear at some time only."""
        return self._difference(matched_only=True)

    def a5_difference_all(self) -> DataFrame:
        """Intended meaning, items that are never dear included."""
        return self._difference(matched_only=False)

    def a5_difference_ss(self) -> DataFrame:
        """Parity: a day is removed only if every dear price covers it."""
        rows = literal.difference_pairwise(unpack(self.brand_sets()), self.dear_sets(), ITEM)
        return pack(rows, ITEM)

    def a5_difference_tdw(self) -> DataFrame:
        """Parity: three unclipped cases."""
        return literal.difference_cases(
            self.brand_rows(), self.dear_rows(), ITEM, guarded=False
        )

    def a5_difference_scd(self) -> DataFrame:
        """Parity: three unclipped cases with guards."""
        v = self._versions()
        return literal.difference_cases(
            v.where(self.is_brand), v.where(self.is_dear), ITEM, guarded=True
        )

    def a6_aggregation(self) -> DataFrame:
        """Intended meaning, as rows: more than the given number of items."""
        rows = self.table("item_category")
        return algebra.count_coalesced(rows, CAT, at_least=self.more_than + 1)

    def a6_aggregation_ss(self) -> DataFrame:
        """Strictly more than the given number of items."""
        rows = unpack(self.table("item_category_ss"))
        return pack(algebra.count_coalesced(rows, CAT, at_least=self.more_than + 1), CAT)

    def a6_aggregation_tdw(self) -> DataFrame:
        """Parity: at least the given number of items."""
        return algebra.count_coalesced(
            self.table("item_category"), CAT, at_least=self.more_than
        )

    def a6_aggregation_scd(self) -> DataFrame:
        """Parity: at least the given number, over blocks of the whole table."""
        return literal.count_blocks(self._versions(), ITEM, CAT, at_least=self.more_than)


NAMES = [n for n in vars(AlgebraViews) if n.startswith("a") and n[1].isdigit()]


def register(views: AlgebraViews, names: list[str] = NAMES) -> None:
    """Create a temporary SQL view per relation, under its name."""
    for name in names:
        getattr(views, name)().createOrReplaceTempView(name)
