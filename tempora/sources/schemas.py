"""Declared schemas of the three CSV inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the item, calendar and sales files.
ITEM = """
i_item_sk int, i_item_id char(16), i_rec_start_date date, i_rec_end_date date,
i_item_desc varchar(200), i_current_price decimal(7,2), i_wholesale_cost decimal(7,2),
i_brand_id int, i_brand char(50), i_class_id int, i_class char(50),
i_category_id int, i_category char(50), i_manufact_id int, i_manufact char(50),
i_size char(20), i_formulation char(20), i_color char(20), i_units char(10),
i_container char(10), i_manager_id int, i_product_name char(50)
"""

CALENDAR = """
d_date_sk int, d_date_id char(16), d_date date, d_month_seq int, d_week_seq int,
d_quarter_seq int, d_year int, d_dow int, d_moy int, d_dom int, d_qoy int,
d_fy_year int, d_fy_quarter_seq int, d_fy_week_seq int, d_day_name char(9),
d_quarter_name char(6), d_holiday char(1), d_weekend char(1),
d_following_holiday char(1), d_first_dom int, d_last_dom int, d_same_day_ly int,
d_same_day_lq int, d_current_day char(1), d_current_week char(1),
d_current_month char(1), d_current_quarter char(1), d_current_year char(1)
"""

SALES = """
ss_sold_date_sk int, ss_sold_time_sk int, ss_item_sk int, ss_customer_sk int,
ss_cdemo_sk int, ss_hdemo_sk int, ss_addr_sk int, ss_store_sk int, ss_promo_sk int,
ss_ticket_number int, ss_quantity int, ss_wholesale_cost decimal(7,2),
ss_list_price decimal(7,2), ss_sales_price decimal(7,2),
ss_ext_discount_amt decimal(7,2), ss_ext_sales_price decimal(7,2),
ss_ext_wholesale_cost decimal(7,2), ss_ext_list_price decimal(7,2),
ss_ext_tax decimal(7,2), ss_coupon_amt decimal(7,2), ss_net_paid decimal(7,2),
ss_net_paid_inc_tax decimal(7,2), ss_net_profit decimal(7,2)
"""


def _declare(text: str, **wider: str) -> T.StructType:
    """Padded and bounded strings are plain strings, with their declared kind noted."""
    fields = []
    for part in text.replace("\n", " ").split(", "):
        name, kind = part.split()
        kind = wider.get(name, kind)
        if "char" in kind:
            kind, length = kind.rstrip(")").split("(")
            field = T.StructField(name, T.StringType(), metadata={"kind": kind, "length": int(length)})
        else:
            field = T.StructType.fromDDL(f"{name} {kind}")[0]
        fields.append(field)
    return T.StructType(fields)


def item_schema(**wider: str) -> T.StructType:
    """Item versions; ``wider`` overrides single column types by name."""
    return _declare(ITEM, **wider)


def calendar_schema(**wider: str) -> T.StructType:
    return _declare(CALENDAR, **wider)


def sales_schema(**wider: str) -> T.StructType:
    return _declare(SALES, **wider)
