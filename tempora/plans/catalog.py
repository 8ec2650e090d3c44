"""Registered queries by name; each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.sizes import pretty_size
from tempora.functions.spans import (
    FROM,
    TO,
    contains_day,
    lower,
    span,
    spans_intersect,
    spans_minus,
    spans_overlap,
    spans_text,
    spans_union,
    upper,
)
from tempora.operators import algebra, history, literal, olap, quality, reports
from tempora.operators.periods import (
    coalesce_dense,
    coalesce_periods,
    intersect_rows,
    pack,
    pack_union,
    split_timeline,
    tcount,
    to_dates,
    to_timestamps,
    unpack,
)
from tempora.plans import algebra_views
from tempora.plans import view_sql as view_sql_text
from tempora.plans.algebra_views import NAMES, AlgebraViews
from tempora.plans.load import load
from tempora.plans.statements import (
    CATEGORY_TOTALS,
    ITEM_TOTALS,
    STATEMENTS,
    Warehouse,
    count_versions,
    statements,
)
from tempora.plans.stored import derive_and_store, derived_once, from_load, reopened
from tempora.sources import csv, derived, schemas
from tempora.sources.tables import log_runs, replace_table, row_bound, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

# Amounts and keys of the derived tables exceed the declared types.
WIDER = {
    "i_item_sk": "bigint",
    "i_category_id": "bigint",
    "i_current_price": "decimal(12,2)",
    "ss_item_sk": "bigint",
    "ss_ticket_number": "bigint",
    "ss_net_paid": "decimal(12,2)",
}

# What category totals read for the categories' periods and for their members.
USED_TWICE = {"item_category", "item_category_ss"}


class Inputs:
    """Dimension tables and facts over one data folder."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, store: str = "", coarse: bool = False
    ) -> None:
        """``store`` writes versions once to shared storage, for queries that
        derive many tables from them: ``"versions"`` their periods and
        attributes only, ``"named"`` also keys and names.  ``coarse``: see
        :func:`derived.item_days`."""
        self.spark, self.sf_dir, self._coarse = spark, sf_dir, coarse
        self._store, self._kept = store, {}
        self._versions = derived.versions(spark, sf_dir, coarse)
        self._named = derived.scd(spark, sf_dir)
        if store == "versions":
            self._versions = replace_table(self._versions, f"{scratch_dir(spark)}/versions")
        elif store:
            self._named = replace_table(self._named, f"{scratch_dir(spark)}/scd_item")
            self._versions = self._named
        more_than = derived.COARSE_MORE_THAN if coarse else derived.MORE_THAN
        self.views = AlgebraViews(self.table, derived.BRAND, derived.PRICE, more_than)

    def table(self, name: str) -> DataFrame:
        if name == "scd_item":
            return self._versions
        build = getattr(history, name)
        if self._store != "versions" or name not in USED_TWICE:
            return build(self.table("scd_item"))
        if name not in self._kept:
            self._kept[name] = replace_table(build(self.table("scd_item")), f"{scratch_dir(self.spark)}/{name}")
        return self._kept[name]

    def named(self) -> DataFrame:
        return self._named

    def facts(self) -> DataFrame:
        """Facts as the star has them: an item, a date key and an amount."""
        return derived.sales(self.spark, self.sf_dir, self._coarse)

    def sales(self) -> DataFrame:
        """Facts with their day, which the calendar has."""
        return olap.with_day(self.facts(), self.calendar())

    def sales_keys(self) -> DataFrame:
        return derived.sales_keys(self.spark, self.sf_dir)

    def calendar(self) -> DataFrame:
        return derived.calendar(self.spark, self.sf_dir)

    def side(self, side: str) -> DataFrame:
        return derived.runlog(self.spark, self.sf_dir).where(F.col("side") == side)

    def version_bound(self) -> int:
        """Versions are at most one per order line."""
        return row_bound(self.spark, f"{self.sf_dir}/lineitem.parquet")


def as_text(df: DataFrame) -> DataFrame:
    """Publish span sets as text."""
    return df.withColumn("vt", spans_text(F.col("vt")))


# --- history -----------------------------------------------------------------


def _history(name: str, named: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Inputs(spark, sf_dir)
        df = getattr(history, name)(w.named() if named else w.table("scd_item"))
        return as_text(df) if "vt" in df.columns else df

    return run


def hist_vt(entity: str, key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = Inputs(spark, sf_dir)
        return as_text(getattr(history, f"{entity}_ss")(w.named())).select(key, "vt")

    return run


def dim_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = history.calendar_spans(Inputs(spark, sf_dir).calendar())
    return days.select("date_sk", "d", "day_span.from_d", "day_span.to_d")


def fact_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with its natural key, NULL where the item key is unknown."""
    w = Inputs(spark, sf_dir)
    return history.denormalise(w.sales_keys().drop("item_id"), w.named(), w.version_bound())


def fact_denorm_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where no bound proves the versions small."""
    w = Inputs(spark, sf_dir)
    return history.denormalise(w.sales_keys().drop("item_id"), w.named())


# --- checks ------------------------------------------------------------------


def chk_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every primary and unique key of the warehouse."""
    w = derived_once(spark, sf_dir)
    keys = {
        "scd_item": [("scd_item", ["item_sk"]), ("scd_item", ["item_id", FROM])],
        "item": [("item", ["item_id"])],
        "item_ss": [("item_ss", ["item_id"])],
        "item_ls": [("item_ls", ["item_id", FROM])],
        "brand": [("brand", ["brand_id"])],
        "brand_ss": [("brand_ss", ["brand_id"])],
        "category": [("category", ["cat_id"])],
        "category_ss": [("category_ss", ["cat_id"])],
        "item_category": [("item_category", ["item_id", "cat_id", FROM])],
        "item_brand": [("item_brand", ["item_id", "brand_id", FROM])],
        "item_price": [("item_price", ["item_id", "price", FROM, TO])],
        "item_category_ss": [("item_category_ss", ["item_id", "cat_id"])],
        "item_brand_ss": [("item_brand_ss", ["item_id", "brand_id"])],
        "item_price_ss": [("item_price_ss", ["item_id", "price"])],
        "date_dim": [("date_dim", ["date_sk"])],
        "store_sales": [("store_sales", ["item_sk", "date_sk", "ticket"]), ("lines", ["ticket", "line"])],
    }
    return _union(quality.unique_report(w[table], own) for table, own in keys.items())


def chk_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of the warehouse."""
    w = derived_once(spark, sf_dir)
    keys = {
        "item": "item_id",
        "item_ss": "item_id",
        "brand": "brand_id",
        "brand_ss": "brand_id",
        "category": "cat_id",
        "category_ss": "cat_id",
        "date_dim": "date_sk",
        "scd_item": "item_sk",
    }
    pointing = {
        "item_ls": {"item": "item_id"},
        "item_category": {"item": "item_id", "category": "cat_id"},
        "item_brand": {"item": "item_id", "brand": "brand_id"},
        "item_price": {"item": "item_id"},
        "item_category_ss": {"item_ss": "item_id", "category_ss": "cat_id"},
        "item_brand_ss": {"item_ss": "item_id", "brand_ss": "brand_id"},
        "item_price_ss": {"item": "item_id"},
        "store_sales": {"date_dim": "date_sk", "scd_item": "item_sk", "item": "item_id"},
    }
    children = [
        (w[name], [(f"{name} -> {parent}", fk, parent) for parent, fk in own.items()])
        for name, own in pointing.items()
    ]
    return quality.reference_report(children, {name: (w[name], pk) for name, pk in keys.items()})


def chk_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the warehouse that must have a value."""
    w = derived_once(spark, sf_dir)
    facts = history.denormalise(w["store_sales"].drop("item_id"), w["scd_item"], row_bound(spark, f"{sf_dir}/lineitem.parquet"))
    columns = {
        "scd_item": ["item_sk", "item_id"],
        "item": ["item_id"],
        "item_ss": ["item_id"],
        "brand": ["brand_id"],
        "brand_ss": ["brand_id"],
        "category": ["cat_id"],
        "category_ss": ["cat_id"],
        "item_category_ss": ["item_id", "cat_id"],
        "item_brand_ss": ["item_id", "brand_id"],
        "item_price_ss": ["item_id", "price"],
        "date_dim": ["date_sk", "d_date_id"],
        "item_ls": ["item_id", FROM, TO],
        "item_category": ["item_id", "cat_id", FROM],
        "item_brand": ["item_id", "brand_id", FROM],
        "item_price": ["item_id", "price", FROM, TO],
        "store_sales": ["date_sk", "ticket", "item_id"],
    }
    tables = {**w, "date_dim": _with_date_id(w["date_dim"]), "store_sales": facts}
    return _union(quality.null_report(tables[table], table, cols) for table, cols in columns.items())


def _with_date_id(days: DataFrame) -> DataFrame:
    return days.withColumn("d_date_id", F.lpad(F.col("date_sk").cast("string"), 16, "0"))


def _union(parts) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- span algebra --------------------------------------------------------------


def span_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both span constructors and both bounds, per version."""
    v = Inputs(spark, sf_dir).table("scd_item")
    period, first = span(FROM, TO), span(FROM)
    return v.select(
        "item_id",
        lower(period).alias("lo"),
        upper(period).alias("hi"),
        lower(first).alias("day_lo"),
        upper(first).alias("day_hi"),
    )


def coalesce_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large groups: when each category has any item."""
    return coalesce_dense(Inputs(spark, sf_dir).table("scd_item"), ["cat_id"])


def coalesce_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small groups; the SQL counterpart is an anti-join formulation."""
    return coalesce_periods(Inputs(spark, sf_dir).table("scd_item"), ["item_id"])


def unpack_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(Inputs(spark, sf_dir).table("item_brand_ss"))


def pack_(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Inputs(spark, sf_dir).table("scd_item")
    return as_text(pack(coalesce_periods(v, ["item_id"]), ["item_id"]))


def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span set of the brand met with the span set of each dear price."""
    views = Inputs(spark, sf_dir, store="versions").views
    b = views.brand_sets().select("item_id", F.col("vt").alias("b"))
    p = views.dear_sets().select("item_id", "price", F.col("vt").alias("p"))
    both = b.join(p, "item_id").withColumn("vt", spans_intersect(F.col("b"), F.col("p")))
    return as_text(both.where(F.col("vt").isNotNull()).select("item_id", "price", "vt"))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item, brand and category whose span sets share a day."""
    w = Inputs(spark, sf_dir, store="versions")
    b = w.table("item_brand_ss").withColumnRenamed("vt", "b")
    c = w.table("item_category_ss").withColumnRenamed("vt", "c")
    hit = b.join(c, "item_id").where(spans_overlap(F.col("b"), F.col("c")))
    return hit.select("item_id", "brand_id", "cat_id")


def _of_two_sets(combine: Callable) -> Query:
    """Days of the brand's set and of the sets of all dear prices of an item."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = Inputs(spark, sf_dir, store="versions").views
        b = views.brand_sets().select("item_id", F.col("vt").alias("b"))
        p = pack_union(views.dear_sets(), ["item_id"]).select("item_id", F.col("vt").alias("p"))
        both = b.join(p, "item_id", "full").withColumn("vt", combine(F.col("b"), F.col("p")))
        return as_text(both.where(F.col("vt").isNotNull()).select("item_id", "vt"))

    return run


def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear, but not of the brand; two relations."""
    views = Inputs(spark, sf_dir, store="versions").views
    return algebra.difference(views.dear_rows(), views.brand_rows(), ["item_id"])


def contains_day_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per brand that the item had on the day of the sale."""
    w = Inputs(spark, sf_dir)
    facts = w.sales().groupBy("item_id", "sold_d").agg(
        F.count("*").alias("n"), F.sum("net_paid").alias("net_paid")
    )
    f, b = facts.alias("f"), w.table("item_brand").alias("b")
    on = (F.col("f.item_id") == F.col("b.item_id")) & contains_day(
        F.col(FROM), F.col(TO), F.col("sold_d")
    )
    return f.join(b, on).groupBy("brand_id").agg(
        F.sum("n").alias("n_sales"), F.sum("net_paid").cast(olap.TOTAL).alias("total_sales")
    )


def intersect_rows_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and category of an item over their common periods."""
    w = Inputs(spark, sf_dir, store="versions")
    return intersect_rows(w.table("item_brand"), w.table("item_category"), ["item_id"])


def tcount_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of items per category over time."""
    return tcount(Inputs(spark, sf_dir).table("item_category"), ["cat_id"])


def tcount_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of items per category over time, counted on spans of timestamps."""
    return to_dates(tcount(to_timestamps(Inputs(spark, sf_dir).table("item_category")), ["cat_id"]))


def tcount_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the count is between 2 and the limit: compare, then keep the true part."""
    steps = tcount(Inputs(spark, sf_dir).table("item_category"), ["cat_id"])
    held = steps.where(F.col("n").between(2, derived.MORE_THAN))
    return coalesce_periods(held, ["cat_id"])


def split_timeline_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_timeline(Inputs(spark, sf_dir).table("item_category"), ["cat_id"])


def global_blocks_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity kernel: periods of the whole table that a brand opens and closes."""
    return literal.global_blocks(Inputs(spark, sf_dir, store="versions").table("scd_item"), ["brand_id"])


# Statements that derive several tables from the versions, or first count them.
# For these the versions are stored, so the order lines are read and shuffled once.
FROM_STORED = {
    *("a3_join_ss", "a3_join_tdw", "a4_union_ss", "a4_union_tdw"),
    *("a5_difference_ss", "a5_difference_tdw", "a5_difference_scd"),
    "a6_aggregation_scd",
    *ITEM_TOTALS,
    *CATEGORY_TOTALS,
}
# Their text asks for categories that open and close with all data.
ON_COARSE = {"a6_aggregation_scd", "o6_scd"}


# --- algebra and OLAP ------------------------------------------------------------


def _statement(name: str, broadcast: bool = True) -> Query:
    """``broadcast=False`` runs the form for relations too large to broadcast."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = "versions" if name in FROM_STORED else ""
        inputs = Inputs(spark, sf_dir, store, coarse=name in ON_COARSE)
        bound = count_versions(inputs.views) if broadcast and name not in NAMES else None
        w = Warehouse(inputs.table, inputs.sales(), bound, inputs.views)
        df = statements(w)[name]()
        return as_text(df) if "vt" in df.columns else df

    return run


def olap_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full star join: surrogate keys resolved through both dimensions."""
    w = Inputs(spark, sf_dir)
    bound = w.version_bound()
    facts = history.denormalise(w.sales_keys().drop("item_id"), w.named(), bound).where(F.col("item_id").isNotNull())
    facts = olap.with_day(facts, w.calendar())
    out = olap.by_period(facts, w.views.a1_selection_tdw(), bound)
    return out.orderBy("item_id", FROM)


def olap_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: CSV files, load, and a statement over the stored tables."""
    folder = write_files(spark, sf_dir)
    tables = load(spark, folder, f"{folder}/tables", **WIDER)
    w = from_load(tables, derived.BRAND, derived.PRICE, derived.MORE_THAN)
    return statements(w)["o1_tdw"]()


def olap_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over bucketed tables that another application had stored."""
    stored = derive_and_store(spark, sf_dir, buckets=8)
    return statements(reopened(spark, stored.path))["o2_tdw"]()


def view_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named SQL views over the algebra, used from SQL text."""
    w = Inputs(spark, sf_dir)
    algebra_views.register(w.views, ["a1_selection_tdw", "a2_projection_tdw"])
    return spark.sql(
        """
        SELECT p.item_id, COUNT(*) AS n_periods,
               CAST(SUM(DATEDIFF(p.to_d, p.from_d)) AS BIGINT) AS n_days
        FROM a2_projection_tdw p LEFT SEMI JOIN a1_selection_tdw s ON p.item_id = s.item_id
        GROUP BY p.item_id
        """
    )


def _from_views(session: SparkSession, names: list[str], prefix: str) -> DataFrame:
    """``relation, id, from_d, to_d`` of views, as any session sees them."""

    def rows(name: str) -> DataFrame:
        view = session.table(f"{prefix}{name}")
        key = F.col(view.columns[0]).cast("bigint").alias("id")
        view = unpack(view) if "vt" in view.columns else view
        return view.select(F.lit(name).alias("relation"), key, FROM, TO)

    return _union([rows(name) for name in names])


def views_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations as catalog views over stored tables, read by another session."""
    stored = derive_and_store(spark, sf_dir, buckets=8)
    names = [n for n in NAMES if n not in ON_COARSE]
    view_sql_text.create_views(spark, stored.path, derived.BRAND, derived.PRICE, derived.MORE_THAN, "fine_", names)
    return _from_views(spark.newSession(), names, "fine_")


def views_stored_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, over plain files, of the relations that need the coarser fixture."""
    w = Inputs(spark, sf_dir, store="versions", coarse=True)
    path = scratch_dir(spark)
    for name in view_sql_text.READ:
        replace_table(w.table(name), f"{path}/{name}")
    names = [n for n in NAMES if n in ON_COARSE]
    view_sql_text.create_views(spark, path, derived.BRAND, derived.PRICE, derived.COARSE_MORE_THAN, "coarse_", names)
    return _from_views(spark.newSession(), names, "coarse_")


# --- sources and sinks -----------------------------------------------------------


def _write_csv(df: DataFrame, schema, path: str) -> None:
    """Write under the file's column names, compressed; columns not given stay empty."""
    given = set(df.columns)
    cols = [
        F.col(f.name) if f.name in given else F.lit(None).cast("string").alias(f.name)
        for f in schema
    ]
    writer = df.select(*cols).write.option("header", True).option("escape", '"').option("compression", "gzip")
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)


def write_files(
    spark: SparkSession, sf_dir: str, only: str | None = None, folder: str | None = None
) -> str:
    """The three input files, out of the derived tables, in a fresh folder unless one is given."""
    w = Inputs(spark, sf_dir)
    folder = folder or scratch_dir(spark)
    if only in (None, "scd_item"):
        named = w.named().select(
            F.col("item_sk").alias("i_item_sk"),
            F.rpad(F.col("item_id").cast("string"), 16, " ").alias("i_item_id"),
            F.col(FROM).alias("i_rec_start_date"),
            F.col(TO).alias("i_rec_end_date"),
            # Blanks at the end of a varchar are data.
            F.concat("item_desc", F.lit("  ")).alias("i_item_desc"),
            F.col("price").alias("i_current_price"),
            F.col("brand_id").alias("i_brand_id"),
            F.col("brand").alias("i_brand"),
            F.col("cat_id").alias("i_category_id"),
            F.col("category").alias("i_category"),
        )
        _write_csv(named, schemas.item_schema(), f"{folder}/scd_item.csv")
    if only in (None, "date_dim"):
        days = _with_date_id(w.calendar()).select(
            F.col("date_sk").alias("d_date_sk"),
            "d_date_id",
            F.col("d").alias("d_date"),
            F.year("d").alias("d_year"),
            F.month("d").alias("d_moy"),
            F.dayofmonth("d").alias("d_dom"),
        )
        _write_csv(days, schemas.calendar_schema(), f"{folder}/date_dim.csv")
    if only in (None, "store_sales"):
        facts = w.sales_keys().select(
            F.col("item_sk").alias("ss_item_sk"),
            F.col("date_sk").alias("ss_sold_date_sk"),
            F.col("ticket").alias("ss_ticket_number"),
            F.col("line").alias("ss_quantity"),
            F.col("net_paid").alias("ss_net_paid"),
        )
        _write_csv(facts, schemas.sales_schema(), f"{folder}/store_sales.csv")
    return folder


def src_scd_item_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_files(spark, sf_dir, "scd_item")
    return csv.as_versions(csv.read_items(spark, folder, **WIDER))


def src_date_dim_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_files(spark, sf_dir, "date_dim")
    days = csv.read_calendar(spark, folder)
    return days.select("d_date_sk", "d_date_id", "d_date", "d_year", "d_moy", "d_dom", "d_holiday")


def src_store_sales_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_files(spark, sf_dir, "store_sales")
    facts = csv.read_sales(spark, folder, **WIDER)
    return facts.select(
        "ss_item_sk", "ss_sold_date_sk", "ss_ticket_number", "ss_quantity", "ss_net_paid", "ss_store_sk"
    )


def _broken_lines(spark: SparkSession, sf_dir: str, price: str) -> str:
    """Items whose description is two lines with quotes; ``price`` is SQL text of a string."""
    folder = scratch_dir(spark)
    items = Inputs(spark, sf_dir).named().select(
        F.col("item_sk").alias("i_item_sk"),
        F.concat(F.lit('say "'), "item_desc", F.lit('",\n'), "brand").alias("i_item_desc"),
        F.expr(price).alias("i_current_price"),
        F.col("category").alias("i_category"),
    )
    _write_csv(items, schemas.item_schema(), f"{folder}/scd_item.csv")
    return folder


def src_multi_line_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several lines, whose splits are read apart."""
    folder = _broken_lines(spark, sf_dir, "CAST(price AS STRING)")
    items = csv.read_items(spark, folder, multi_line=True, **WIDER)
    return items.select("i_item_sk", "i_item_desc", "i_current_price", "i_category")


def src_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of damaged items stops at, in records of several lines."""
    folder = _broken_lines(spark, sf_dir, "IF(item_sk % 50 = 7, 'dear', CAST(price AS STRING))")
    schema = schemas.item_schema(**{k: v for k, v in WIDER.items() if k.startswith("i_")})
    bad = csv.bad_fields(spark, f"{folder}/scd_item.csv", schema, multi_line=True)
    # A record is two lines, the first of a file after its header: line numbers are even.
    return bad.groupBy("column_name", "value", "problem", (F.col("line") % 2).alias("odd_line")).agg(F.count("*").alias("n_rows"))


def load_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of the files of one scale factor, found below a root by its number."""
    root = scratch_dir(spark)
    write_files(spark, sf_dir, folder=csv.scale_dir(root, 7))
    return load(spark, root, f"{root}/tables", scale=7, **WIDER)["item_brand"]


def src_bad_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of damaged facts would stop at: each column's bad values, in how many rows."""
    folder = scratch_dir(spark)
    facts = Inputs(spark, sf_dir).sales_keys().select(
        F.col("item_sk").alias("ss_item_sk"),
        F.when(F.col("ticket") % 97 == 5, F.lit("soon")).otherwise(F.col("date_sk").cast("string")).alias("ss_sold_date_sk"),
        F.col("ticket").alias("ss_ticket_number"),
        F.when(F.col("line") == 7, F.concat("line", F.lit("x"))).otherwise(F.col("line").cast("string")).alias("ss_quantity"),
        F.col("net_paid").alias("ss_net_paid"),
    )
    schema = schemas.sales_schema(**{k: v for k, v in WIDER.items() if k.startswith("ss_")})
    _write_csv(facts, schema, f"{folder}/store_sales.csv")
    bad = csv.bad_fields(spark, f"{folder}/store_sales.csv", schema)
    return bad.groupBy("column_name", "value", "problem").agg(F.count("*").alias("n_rows"))


def load_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load the three files into 16 stored tables and count each of them."""
    folder = write_files(spark, sf_dir)
    return reports.profile(load(spark, folder, f"{folder}/tables", **WIDER))


def sink_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is filled twice holds the second fill only."""
    w = Inputs(spark, sf_dir)
    path = scratch_dir(spark)
    replace_table(w.table("item_price"), path)
    return replace_table(w.table("item_brand"), path)


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: the first run replaces it, later runs are added, once however often they are sent."""
    log = reports.read_plans(derived.runlog(spark, sf_dir)).drop("duration", "seconds")
    path = f"{scratch_dir(spark)}/runs"
    log_runs(log.where("run_id = 2"), path)
    log_runs(log.where("run_id = 1"), path)
    log_runs(log.where("run_id between 2 and 4"), path, new_table=False)
    out = log_runs(log.where("run_id > 1"), path, new_table=False)
    return out.groupBy("query_id", "run_id").agg(
        F.count("*").alias("n"), F.sum("number_rows").alias("number_rows")
    )


# --- reports -----------------------------------------------------------------------


def rep_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the two sides per query and run, runs added up per side."""
    w = Inputs(spark, sf_dir)
    sums = [
        w.side(s).groupBy("query_id", "run_id").agg(F.sum("seconds").cast("decimal(18,2)").alias("seconds"))
        for s in ("algebra", "olap")
    ]
    return reports.paired(*sums).orderBy("query_id", "run_id")


def rep_avg_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Inputs(spark, sf_dir)
    return reports.warm_means(w.side("algebra"), w.side("olap")).orderBy("query_id")


def rep_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Inputs(spark, sf_dir)
    return reports.all_means(w.side("algebra"), w.side("olap")).orderBy("query_id")


def rep_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and rows out of the plan documents."""
    log = reports.read_plans(derived.runlog(spark, sf_dir))
    return log.select(
        "query_id", "run_id", "start_time", "planning_ms", "execution_ms",
        F.round("seconds", 6).alias("seconds"),
        reports.interval_text(F.col("duration")).alias("duration"),
        "number_rows",
    )


def rep_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every warehouse table."""
    return reports.profile(derived_once(spark, sf_dir))


def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and readable size of the 16 tables of a load."""
    folder = write_files(spark, sf_dir)
    loaded = load(spark, folder, f"{folder}/tables", **WIDER)
    return reports.profile_stored(spark, {name: f"{folder}/tables/{name}" for name in loaded})


def rep_profile_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`profile_sizes`; bytes depend on the file format, so that only
    whether a table has any, and a readable size, is shown."""
    sized = (F.col("size_bytes") > 0) & F.col("size").rlike("^[0-9]+ (bytes|kB|MB|GB|TB)$")
    return profile_sizes(spark, sf_dir).select("table_name", "rows", sized.alias("sized"))


def rep_pretty_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable sizes of numbers from a few units up to many billions."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.expr("shiftleft(cast(l_orderkey as bigint), cast(5 * (l_linenumber - 1) as int))")
    return lines.select(n.alias("n")).distinct().select("n", pretty_size(F.col("n")).alias("size"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "src_scd_item_csv": src_scd_item_csv,
        "src_date_dim_csv": src_date_dim_csv,
        "src_store_sales_csv": src_store_sales_csv,
        "src_bad_fields": src_bad_fields,
        "src_multi_line_csv": src_multi_line_csv,
        "src_bad_records": src_bad_records,
        "load_scaled": load_scaled,
        "load_profile": load_profile,
        "sink_replace": sink_replace,
        "sink_append": sink_append,
        "view_sql": view_sql,
        "views_stored": views_stored,
        "views_stored_coarse": views_stored_coarse,
        "hist_item": _history("item", named=True),
        "hist_item_vt": hist_vt("item", "item_id"),
        "hist_tdw_item": _history("item", named=True),
        "hist_item_ls": _history("lifespan"),
        "hist_brand": _history("brand", named=True),
        "hist_brand_vt": hist_vt("brand", "brand_id"),
        "hist_tdw_brand": _history("brand", named=True),
        "hist_category": _history("category", named=True),
        "hist_category_vt": hist_vt("category", "cat_id"),
        "hist_tdw_category": _history("category", named=True),
        "hist_item_category_ss": _history("item_category_ss"),
        "hist_item_category": _history("item_category"),
        "hist_item_brand_ss": _history("item_brand_ss"),
        "hist_item_brand": _history("item_brand"),
        "hist_item_price_ss": _history("item_price_ss"),
        "hist_item_price": _history("item_price"),
        "dim_calendar": dim_calendar,
        "fact_denorm": fact_denorm,
        "fact_denorm_shuffled": fact_denorm_shuffled,
        "chk_unique": chk_unique,
        "chk_fk": chk_fk,
        "chk_not_null": chk_not_null,
        "span_days": span_days,
        "coalesce": coalesce_,
        "coalesce_antijoin": coalesce_antijoin,
        "unpack": unpack_,
        "pack": pack_,
        "intersect": intersect,
        "overlaps": overlaps,
        "spans_union": _of_two_sets(spans_union),
        "spans_minus": _of_two_sets(spans_minus),
        "difference": difference,
        "contains_day": contains_day_,
        "intersect_rows": intersect_rows_,
        "tcount": tcount_,
        "tcount_timestamps": tcount_timestamps,
        "tcount_when": tcount_when,
        "split_timeline": split_timeline_,
        "global_blocks": global_blocks_,
    }
    out.update({name: _statement(name) for name in STATEMENTS})
    for name in (*ITEM_TOTALS, *CATEGORY_TOTALS):
        out[f"{name}_shuffled"] = _statement(name, broadcast=False)
    out["olap_reopened"] = olap_reopened
    out["olap_star"] = olap_star
    out["olap_loaded"] = olap_loaded
    out.update(
        {
            "rep_pair": rep_pair,
            "rep_avg_warm": rep_avg_warm,
            "rep_full": rep_full,
            "rep_profile": rep_profile,
            "rep_profile_size": rep_profile_size,
            "rep_pretty_size": rep_pretty_size,
            "rep_runlog": rep_runlog,
        }
    )
    return out
