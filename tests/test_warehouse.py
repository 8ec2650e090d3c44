"""History, OLAP, checks and reports on small literals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tempora.functions.sizes import pretty_size
from tempora.operators import history, olap, quality, reports
from tempora.operators.periods import pack
from tempora.operators.sized import BROADCAST_BYTES, is_small, row_bytes, salted
from tempora.sources.tables import replace_table
from tests.support import day, out, rel

SCD = (
    "item_sk long, item_id string, item_desc string, price decimal(7,2), brand_id int, "
    "brand string, cat_id int, category string, from_d date, to_d date"
)
SIZES = [10, None]  # provably small, and unknown


def scd(spark):
    rows = [
        (1, "i1", "old", Decimal("90.00"), 7, "seven", 1, "one", 0, 5),
        (2, "i1", "new", Decimal("90.00"), 8, "eight", 1, "one", 5, 9),
        (3, "i2", "gap", Decimal("10.00"), 7, "SEVEN", 1, "ONE", 0, 2),
        (4, "i2", "end", None, 7, "Seven", 2, "two", 4, 6),
        (5, "i3", "nul", Decimal("1.00"), 9, "nine", 2, "two", None, 6),
    ]
    return rel(spark, rows, SCD)


def test_latest_description_puts_unknown_start_first(spark):
    extra = rel(spark, [(9, "i1", "open", None, 7, "b", 1, "c", None, 3)], SCD)
    got = {r["item_id"]: r["item_desc"] for r in history.item(scd(spark).union(extra)).collect()}
    assert got == {"i1": "open", "i2": "end", "i3": "nul"}


def test_ties_are_kept(spark):
    extra = rel(spark, [(9, "i1", "tie", None, 7, "b", 1, "c", 5, 8)], SCD)
    rows = history.item(scd(spark).union(extra)).where("item_id = 'i1'").collect()
    assert sorted(r["item_desc"] for r in rows) == ["new", "tie"]


def test_representative_is_newest_version_of_smallest_item(spark):
    got = {r["brand_id"]: r["brand"] for r in history.brand(scd(spark)).collect()}
    assert got == {7: "seven", 8: "eight", 9: "nine"}
    assert {r["cat_id"]: r["category"] for r in history.category(scd(spark)).collect()} == {
        1: "one",
        2: "two",
    }


def test_lifespans_and_attributes(spark):
    s = scd(spark)
    assert out(history.lifespan(s)) == [("i1", 0, 9), ("i2", 0, 2), ("i2", 4, 6)]
    assert out(history.item_category(s)) == [("i1", 1, 0, 9), ("i2", 1, 0, 2), ("i2", 2, 4, 6)]
    assert [r[0] for r in history.item_price(s).select("item_id").collect()] == ["i1", "i2"]
    packed = {r["item_id"]: r["vt"] for r in history.item_ss(s).collect()}
    assert packed["i2"] == [(day(0), day(2)), (day(4), day(6))]
    assert packed["i3"] is None


@pytest.mark.parametrize("rows", SIZES)
def test_denormalise_keeps_unknown_items(spark, rows):
    facts = spark.createDataFrame([(1, "f1"), (99, "f2"), (None, "f3")], "item_sk long, f string")
    got = {r["f"]: r["item_id"] for r in history.denormalise(facts, scd(spark), rows).collect()}
    assert got == {"f1": "i1", "f2": None, "f3": None}


def test_calendar_spans(spark):
    days = spark.createDataFrame([(1, day(4))], "date_sk int, d date")
    r = history.calendar_spans(days).first()
    assert r["day_span"] == (day(4), day(5))


def sales(spark):
    rows = [
        ("i1", day(0), Decimal("1.00")),
        ("i1", day(4), Decimal("2.00")),
        ("i1", day(4), None),
        ("i1", day(5), Decimal("4.00")),
        ("i1", day(9), Decimal("8.00")),
        ("i2", day(1), None),
        ("i9", day(1), Decimal("16.00")),
    ]
    return spark.createDataFrame(rows, "item_id string, sold_d date, net_paid decimal(7,2)")


ITEM_REL = "item_id string, from_d date, to_d date"


@pytest.mark.parametrize("rows", SIZES)
def test_by_period_half_open_and_null_sum(spark, rows):
    periods = rel(spark, [("i1", 0, 5), ("i1", 7, 9), ("i2", 0, 3)], ITEM_REL)
    assert out(olap.by_period(sales(spark), periods, rows)) == [
        ("i1", 0, 5, Decimal("3.00")),
        ("i2", 0, 3, None),
    ]


@pytest.mark.parametrize("rows", SIZES)
def test_by_span_set(spark, rows):
    packed = pack(rel(spark, [("i1", 0, 1), ("i1", 5, 10)], ITEM_REL), ["item_id"])
    assert olap.by_span_set(sales(spark), packed, rows).first()["total_sales"] == Decimal("13.00")
    every = olap.by_span_set_any_day(sales(spark), packed, rows).first()["total_sales"]
    assert every == Decimal("15.00")


@pytest.mark.parametrize("rows", SIZES)
def test_category_totals(spark, rows):
    ic_schema = "item_id string, cat_id int, from_d date, to_d date"
    ic = rel(spark, [("i1", 1, 0, 5), ("i1", 1, 9, 10), ("i2", 1, 0, 5)], ic_schema)
    q = rel(spark, [(1, 3, 7)], "cat_id int, from_d date, to_d date")
    # Intended: only the days 3 and 4.  Parity: day 5 counts although the item
    # had left; both items share one period pair, hence one group.
    assert out(olap.by_category(sales(spark), ic, q, rows)) == [(1, 3, 5, Decimal("2.00"))]
    assert out(olap.by_category_literal(sales(spark), ic, q, rows)) == [(1, 3, 5, Decimal("6.00"))]
    ic_ss = pack(ic, ["item_id", "cat_id"])
    got = olap.by_category_span_set(sales(spark), ic_ss, q, rows).collect()
    assert [(r["vt"], r["total_sales"]) for r in got] == [([(day(3), day(5))], Decimal("6.00"))]


def test_cells_of_category_periods_are_not_broadcast_by_estimate(spark, tmp_path):
    ic = rel(spark, [("i1", 1, 0, 5), ("i2", 1, 0, 5)], "item_id string, cat_id int, from_d date, to_d date")
    q = replace_table(rel(spark, [(1, 3, 700)], "cat_id int, from_d date, to_d date"), str(tmp_path / "q"))

    def plan(rows):
        return olap._members(ic, q, rows)._jdf.queryExecution().sparkPlan().toString()

    # A row of the file is many cells, of which Spark's own estimate knows nothing.
    assert "Broadcast" not in plan(None) and "Broadcast" in plan(1)
    few = salted(ic, q)[1]
    assert "Broadcast" not in ic.join(few, "cat_id")._jdf.queryExecution().sparkPlan().toString()


def test_equal_looking_literal_rows_stay(spark):
    ic = rel(
        spark,
        [("i1", 1, 0, 9), ("i9", 1, 1, 9)],
        "item_id string, cat_id int, from_d date, to_d date",
    )
    q = rel(spark, [(1, 1, 6)], "cat_id int, from_d date, to_d date")
    got = out(olap.by_category_literal(sales(spark), ic, q))
    assert got == [(1, 1, 6, Decimal("16.00")), (1, 1, 6, Decimal("6.00"))]


def test_literal_sums_an_item_once_for_a_category_period(spark, monkeypatch):
    periods = [("i1", 1, f, f + 2) for f in range(0, 20, 3)]
    ic = rel(spark, periods, "item_id string, cat_id int, from_d date, to_d date")
    q = rel(spark, [(1, 0, 12), (1, 13, 30)], "cat_id int, from_d date, to_d date")
    met, join = [], olap.join_facts
    monkeypatch.setattr(olap, "join_facts", lambda facts, rel, *a, **k: met.append(rel.count()) or join(facts, rel, *a, **k))
    got = out(olap.by_category_literal(sales(spark), ic, q))
    # Not a row for each of the item's seven periods.
    assert met == [2]
    paid = {s: sum(r["net_paid"] for r in sales(spark).collect() if r["item_id"] == "i1" and r["net_paid"] is not None and s[0] <= (r["sold_d"] - day(0)).days < s[1]) for s in ((0, 12), (13, 30))}
    want = [(1, max(f, s[0]), min(t, s[1]), p) for _, _, f, t in periods for s, p in paid.items() if p and max(f, s[0]) < min(t, s[1])]
    assert got == sorted(want, key=repr)


def test_with_day(spark):
    cal = spark.createDataFrame([(3, day(3))], "date_sk int, d date")
    facts = spark.createDataFrame([(3, "a"), (4, "b")], "date_sk int, item_id string")
    assert [tuple(r) for r in olap.with_day(facts, cal).collect()] == [("a", day(3))]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "k int, v string")
    parent = spark.createDataFrame([(2,)], "p int")
    assert [tuple(r) for r in quality.duplicates(df, ["k", "v"]).collect()] == [(1, "a", 2)]
    keys = [("t", ["k"]), ("t", ["k", "v"]), ("u", ["v"])]
    assert sorted(map(tuple, quality.unique_report(df, keys).collect())) == [
        ("t", "k", 1, 2),
        ("t", "k, v", 1, 1),
        ("u", "v", 1, 1),
    ]
    empty = quality.unique_report(df.where("false"), keys).collect()
    assert [tuple(r)[2:] for r in empty] == [(0, 0)] * 3
    parents = {"p": (parent, "p"), "q": (df, "v")}
    children = [(df, [("d -> p", "k", "p"), ("d -> q", "v", "q")]), (parent, [("p -> p", "p", "p")])]
    assert [tuple(r) for r in quality.orphans(children, parents).collect()] == [("d -> p", "1", 3)]
    assert sorted(map(tuple, quality.reference_report(children, parents).collect())) == [
        ("d -> p", 1, 3),
        ("d -> q", 0, 0),
        ("p -> p", 0, 0),
    ]
    assert sorted(map(tuple, quality.null_report(df, "t", ["k", "v"]).collect())) == [
        ("t", "k", 1),
        ("t", "v", 0),
    ]


LOG = "query_id string, run_id int, seconds double"


def test_reports(spark):
    a = spark.createDataFrame([("q1", 1, 9.0), ("q1", 2, 1.0), ("q1", 3, 2.0), ("q2", 2, 5.0)], LOG)
    o = spark.createDataFrame(
        [("q1", 1, 8.0), ("q1", 2, 3.0), ("q3", 1, 4.0), ("q3", 2, 6.0), ("q4", 2, 2.0)], LOG
    )
    assert sorted(map(tuple, reports.paired(a, o).collect())) == [
        ("q1", 1, 9.0, 8.0),
        ("q1", 2, 1.0, 3.0),
    ]
    assert [tuple(r) for r in reports.paired(a, o, run=2).collect()] == [("q1", 2, 1.0, 3.0)]
    assert [tuple(r) for r in reports.warm_means(a, o).collect()] == [("q1", 1.5, 3.0)]
    assert sorted(map(tuple, reports.all_means(a, o).collect()), key=repr) == sorted(
        [
            ("q1", 4.0, 5.5),
            ("q2", 5.0, None),
            ("q3", None, 5.0),
            ("q4", None, 2.0),
            (None, None, 4.0),
        ],
        key=repr,
    )
    none = reports.all_means(a, a).collect()
    assert all(r["query_id"] is not None for r in none)


def test_read_plans(spark):
    doc = '[{"Plan": {"Node Type": "Sort", "Actual Rows": 42}, "Planning Time": 1.5, "Execution Time": 998.5}]'
    log = spark.createDataFrame(
        [(" Q1 ", 1, dt.datetime(2024, 1, 1), doc)],
        "query_id string, run_id int, start_time timestamp, plan string",
    )
    r = reports.read_plans(log).first()
    assert (r["query_id"], r["planning_ms"], r["execution_ms"]) == ("Q1", 1.5, 998.5)
    assert (r["seconds"], r["number_rows"], r["duration"]) == (1.0, 42, dt.timedelta(seconds=1))


def test_profile_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    r = reports.profile_stored({"t": spark.read.parquet(path)}).first()
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert (r["table_name"], r["rows"], r["size_bytes"]) == ("t", 100, size)


@pytest.mark.parametrize(
    "size, text",
    [
        (0, "0 bytes"),
        (10239, "10239 bytes"),
        (10240, "10 kB"),
        (16384, "16 kB"),
        (10 * 1024**2 - 1, "10 MB"),
        (483 * 1024**2, "483 MB"),
        (47 * 1024**3, "47 GB"),
        (100 * 1024**4, "100 TB"),
        (None, None),
    ],
)
def test_pretty_size(spark, size, text):
    df = spark.createDataFrame([(size,)], "s long")
    assert df.select(pretty_size(F.col("s"))).first()[0] == text


def test_unknown_size_is_not_broadcast(spark):
    periods = rel(spark, [("i1", 0, 5)], ITEM_REL)

    def plan(rows):
        df = olap.by_period(sales(spark), periods, rows)
        return df._jdf.queryExecution().optimizedPlan().toString()

    most = BROADCAST_BYTES // row_bytes(periods)
    assert "strategy=broadcast" in plan(most)
    assert "strategy=broadcast" not in plan(most + 1)
    assert "strategy=broadcast" not in plan(None)
    assert not is_small(pack(periods, ["item_id"]), 1)  # sets have no bound


def test_interval_text(spark):
    df = spark.range(1).select(F.make_dt_interval(mins=F.lit(62), secs=F.lit(3.000004)).alias("d"))
    assert df.select(reports.interval_text(F.col("d"))).first()[0] == "01:02:03.000004"
