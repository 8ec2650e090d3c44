"""Warehouse inputs derived from the order and event tables.

``versions`` plays the versioned dimension, ``sales`` the fact, ``calendar``
the date dimension and ``runlog`` the log of timed queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators.sized import shared
from tempora.sources.tables import row_bound

# End of the open version of an item, day 0 of date keys, and
# the parameters of the registered queries.
OPEN_END = "2002-01-01"
EPOCH = "1990-01-01"
BRAND = 3
PRICE = 95000
MORE_THAN = 3
COARSE_MORE_THAN = 1
LOG_ONLY_OLAP = "signup"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_days(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """One row per item and ship day, valid until the item's next day.

    ``coarse``: suppliers are the items and line numbers their categories, few
    of each, so that some item keeps its category from the first day on.
    """
    key, category = ("l_suppkey", "l_linenumber") if coarse else ("l_partkey", "l_suppkey")
    days = (
        _table(spark, sf_dir, "lineitem")
        .groupBy(F.col(key).alias("item_id"), F.col("l_shipdate").cast("date").alias("from_d"))
        .agg(
            F.min(category).alias("cat_id"),
            F.min("l_linenumber").alias("brand_id"),
            F.min(F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"),
            # The smallest flag is R if some row has it and none a smaller one;
            # booleans keep this a hash aggregate, strings would force a sort.
            F.max(F.col("l_returnflag") == "R").alias("has_r"),
            F.max(F.col("l_returnflag") < "R").alias("has_less"),
        )
    )
    nxt = F.lead("from_d").over(Window.partitionBy("item_id").orderBy("from_d"))
    return days.withColumn("to_d", F.coalesce(nxt, F.lit(OPEN_END).cast("date")))


def versions(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Item versions; days flagged R are left out, which makes gaps."""
    return (
        item_days(spark, sf_dir, coarse)
        .where(F.col("has_less") | ~F.col("has_r"))
        .select("item_id", "from_d", "to_d", "cat_id", "brand_id", "price")
    )


def scd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with a surrogate key and descriptive names."""
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("from_d"))
    return versions(spark, sf_dir).withColumn("n", n).select(
        (F.col("item_id") * 100000 + F.col("n")).alias("item_sk"),
        "item_id",
        "from_d",
        "to_d",
        F.concat(F.lit("item "), "item_id", F.lit(" v"), "n").alias("item_desc"),
        "price",
        "brand_id",
        F.concat(F.lit("brand "), "brand_id").alias("brand"),
        "cat_id",
        F.concat(F.lit("category "), "cat_id").alias("category"),
    )


def _date_key(day: Column) -> Column:
    return F.date_diff(day, F.lit(EPOCH).cast("date"))


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the day of their order; orders are broadcast behind a bound of their rows only."""
    lines = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    orders = shared(orders, row_bound(spark, f"{sf_dir}/orders.parquet"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def sales(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Facts with the natural item key and a date key."""
    return _ordered_lines(spark, sf_dir).select(
        F.col("l_suppkey" if coarse else "l_partkey").alias("item_id"),
        _date_key(F.col("o_orderdate").cast("date")).alias("date_sk"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("net_paid"),
    )


def sales_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with surrogate keys, of which some match no version, and the item."""
    return _ordered_lines(spark, sf_dir).select(
        (F.col("l_partkey") * 100000 + 1 + F.col("l_orderkey") % 30).alias("item_sk"),
        _date_key(F.col("o_orderdate").cast("date")).alias("date_sk"),
        F.col("l_orderkey").alias("ticket"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("net_paid"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day between the first and last order or ship day."""
    ordered = _table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))
    shipped = _table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"))
    ends = (
        ordered.unionByName(shipped)
        .agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi"))
        .where(F.col("lo").isNotNull())
    )
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("d")).select(
        _date_key(F.col("d")).alias("date_sk"), "d"
    )


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed runs of queries on two sides; one query ran on the OLAP side only.

    ``plan`` is the plan document of the run, as the timing statement returns
    it: a one-element JSON array.
    """
    seconds = F.col("value").cast("decimal(12,2)")
    rows = F.get_json_object("props", "$.k").cast("bigint")
    side = F.when(F.col("user_id") % 2 == 0, "algebra").otherwise("olap")
    log = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("query_id"),
        (1 + F.col("event_id") % 6).cast("int").alias("run_id"),
        F.col("ts").alias("start_time"),
        seconds.alias("seconds"),
        side.alias("side"),
        F.format_string(
            '[{"Plan": {"Node Type": "Sort", "Actual Rows": %d}, '
            '"Planning Time": %d, "Execution Time": %s}]',
            rows,
            F.col("event_id") % 7,
            seconds.cast("string"),
        ).alias("plan"),
    )
    return log.where(~((F.col("side") == "algebra") & (F.col("query_id") == LOG_ONLY_OLAP)))
