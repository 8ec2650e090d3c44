"""Load: CSV files in, every warehouse table out as parquet."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.spans import span
from tempora.operators import history
from tempora.operators.periods import pack, unpack
from tempora.sources import csv
from tempora.sources.tables import open_bucketed, replace_bucketed, replace_table, row_bound, scratch_dir


WRITERS = 4
# Versions to a bucket, and of one item at most: a task holds a bucket.
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 8
ATTRIBUTES = {"brand_id": "item_brand", "cat_id": "item_category", "price": "item_price"}


TABLES = ["scd_item", "date_dim", "store_sales", "item", "item_ls", "brand", "category"]
TABLES += [*ATTRIBUTES.values(), *(f"{name}_ss" for name in ATTRIBUTES.values())]
TABLES += ["item_ss", "brand_ss", "category_ss"]


def per_item(name: str) -> bool:
    """Tables with a bounded number of rows per item; versions where they are unique."""
    return name.startswith("item_") or name == "scd_item"


def _with_set(entities: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    return entities.join(pack(periods, [key]), key, "left")


def load_dimensions(
    versions: DataFrame, out: str, buckets: int | None = None, hashed: bool = False
) -> dict[str, DataFrame]:
    """Derive and store the dimension tables of both designs.

    Each attribute is coalesced and packed at once, where its rows are: the
    interval rows and the lifespans of brands and categories are unpacked from
    the stored sets, without a shuffle.  With ``buckets`` the per-item tables are
    bucketed by item; ``hashed`` tells that the versions are so already.
    """

    def put(name: str, df: DataFrame, is_hashed: bool) -> tuple[str, DataFrame]:
        path = f"{out}/{name}"
        if buckets and per_item(name):
            return name, replace_bucketed(df, path, "item_id", buckets, is_hashed)
        return name, replace_table(df, path)

    def put_all(tables: dict[str, DataFrame], is_hashed: bool) -> dict[str, DataFrame]:
        # The writes do not depend on each other; Spark runs their jobs together.
        with ThreadPoolExecutor(WRITERS) as pool:
            return dict(pool.map(lambda t: put(*t, is_hashed), tables.items()))

    stored = put_all(
        {
            "item": history.item(versions),
            "item_ls": history.lifespan(versions),
            "brand": history.brand(versions),
            "category": history.category(versions),
            **{f"{name}_ss": pack(history.attribute(versions, attr), ["item_id", attr]) for attr, name in ATTRIBUTES.items()},
        },
        hashed,
    )
    rows = {name: unpack(stored[f"{name}_ss"]) for name in ATTRIBUTES.values()}
    derived = {**rows, "item_ss": _with_set(stored["item"], stored["item_ls"], "item_id")}
    for key, entity in (("brand_id", "brand"), ("cat_id", "category")):
        periods = history.lifespan(rows[ATTRIBUTES[key]], key)
        derived[f"{entity}_ss"] = _with_set(stored[entity], periods, key)
    # Out of the tables just stored, which are bucketed where asked for.
    return {**stored, **put_all(derived, buckets is not None)}


def _by_item(versions: DataFrame, buckets: int | None, rows: int) -> tuple[DataFrame, bool]:
    """Versions hashed by item, which all derived tables then read without a shuffle.

    Versions as read need not be unique: where an item has more than a task
    should hold they stay as they are, and each table spreads them by its keys.
    """
    most = versions.groupBy("item_id").count().agg(F.max("count")).first()[0]
    if most is None or most > BUCKET_ROWS:
        return versions, False
    buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    path = f"{scratch_dir(versions.sparkSession)}/versions"
    return replace_bucketed(versions, path, "item_id", buckets), True


def load(
    spark: SparkSession,
    folder: str,
    out: str,
    buckets: int | None = None,
    scale: int | None = None,
    multi_line: bool = False,
    **wider: str,
) -> dict[str, DataFrame]:
    """Read the three CSV files of ``folder`` and store 16 tables under ``out``.

    ``scale`` takes the files of that scale factor below ``folder``;
    ``multi_line`` allows line breaks in quoted fields of the items;
    ``wider`` overrides declared column types, for files with larger amounts.
    Versions and facts are stored as read; only derived tables, in which the
    rows of an item are bounded, can be bucketed.
    """
    folder = folder if scale is None else csv.scale_dir(folder, scale)
    items = replace_table(csv.read_items(spark, folder, multi_line, **wider), f"{out}/scd_item")
    versions, rows = csv.as_versions(items), row_bound(spark, f"{out}/scd_item")
    own, hashed = _by_item(versions, buckets, rows)
    stored = {"scd_item": items, **load_dimensions(own, out, buckets, hashed)}
    dates = csv.read_calendar(spark, folder).withColumn("d_datespan", span("d_date"))
    stored["date_dim"] = replace_table(dates, f"{out}/date_dim")
    facts = csv.read_sales(spark, folder, **wider).withColumn("item_sk", F.col("ss_item_sk"))
    facts = history.denormalise(facts, versions, rows)
    facts = facts.drop("item_sk").withColumnRenamed("item_id", "ss_item_id")
    stored["store_sales"] = replace_table(facts, f"{out}/store_sales")
    return stored


def reopen(spark: SparkSession, out: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables of an earlier :func:`load`.

    ``buckets`` must be what they were loaded with; None reads plain files.
    """

    def table(name: str) -> DataFrame:
        # Versions are stored as read, unbucketed.
        if buckets and per_item(name) and name != "scd_item":
            return open_bucketed(spark, f"{out}/{name}", "item_id", buckets)
        return spark.read.parquet(f"{out}/{name}")

    return {name: table(name) for name in TABLES}
