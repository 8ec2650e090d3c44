"""Shapes of physical plans, and behaviour with a hot key."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tempora.operators import algebra, history, olap
from tempora.operators.periods import coalesce_dense, coalesce_periods, pack
from tempora.plans import algebra_views, catalog, stored, view_sql
from tempora.plans.load import load
from tempora.plans.statements import statements
from tests.support import day_sets, from_sets, out, rel

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def warehouse(spark):
    return stored.derive_and_store(spark, SF, buckets=8)


@pytest.mark.parametrize(
    "name",
    ["a1_selection_tdw", "a2_projection_tdw", "a3_join_tdw", "a3_join_ss", "a4_union_tdw",
     "a5_difference", "a5_difference_ss", "a5_difference_tdw"],
)
def test_bucketed_tables_need_no_shuffle(warehouse, name):
    assert "Exchange" not in physical(statements(warehouse)[name]())


def test_no_nested_loops(spark, warehouse):
    for name, build in statements(warehouse).items():
        plan = physical(build())
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


OLAP = [f"o{i}_{d}" for i in range(1, 7) for d in ("ss", "tdw", "scd")] + ["o5", "o6"]


@pytest.mark.parametrize("name", OLAP)
def test_facts_join_the_calendar(warehouse, name):
    plan = warehouse_plan(warehouse, name)
    assert any("Join" in line and "date_sk" in line for line in plan.splitlines())


def warehouse_plan(warehouse, name, bounded=True) -> str:
    w = warehouse if bounded else replace(warehouse, rows=None)
    return statements(w)[name]()._jdf.queryExecution().optimizedPlan().toString() + physical(statements(w)[name]())


@pytest.mark.parametrize("name", ["o1_ss", "o2_ss", "o3_ss", "o4_ss", "o5_ss"])
@pytest.mark.parametrize("bounded", [True, False])
def test_packed_totals_join_rows_and_group_by_item(warehouse, name, bounded):
    for line in warehouse_plan(warehouse, name, bounded).splitlines():
        assert not ("Join" in line and "exists(" in line), line
        assert not ("Aggregate" in line and "net_paid" in line and "vt#" in line), line


@pytest.mark.parametrize("name", ["o1_tdw", "o2_ss", "o5_ss", "o6_ss", "o6"])
def test_shuffled_form_gives_the_same_rows(spark, warehouse, name):
    def rows(w):
        return sorted(map(repr, statements(w)[name]().collect()))

    expected = rows(warehouse)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = replace(warehouse, rows=None)
        # Only what leaves facts out is broadcast: cells, as many as their number bounds.
        for line in physical(statements(shuffled)[name]()).splitlines():
            assert "BroadcastHashJoin" not in line or "LeftSemi" in line, line
        assert rows(shuffled) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["chk_unique", "chk_fk", "chk_not_null"])
def test_checks_read_the_facts_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Relation" in x and "l_linenumber" in x]
    assert len(lines) <= 2  # the facts, and the first and last day of the calendar


def test_coalesce_reduces_before_it_windows(spark, tmp_path):
    path = str(tmp_path / "r")
    rel(spark, [("a", 0, 1)]).write.parquet(path)
    plan = physical(coalesce_periods(spark.read.parquet(path), ["k"]))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_max" in plan
    narrow = physical(algebra.selection(spark.read.parquet(path), F.col("k") == "a", ["k"]))
    assert "EqualTo(k,a)" in narrow


def test_first_rows_are_pruned_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "v")
    rel(spark, [("a", "x", 0, 1)], "item_id string, item_desc string, from_d date, to_d date").write.parquet(path)
    plan = physical(history.item(spark.read.parquet(path)))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = physical(catalog.queries()["a1_selection_scd"](spark, SF))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_extendedprice" not in schema and "l_suppkey" not in schema


def hot_rows(n: int = 6000):
    """A third of all rows under one key."""
    return [("hot" if i % 3 == 0 else f"k{i % 500}", (i * 7) % 300, (i * 7) % 300 + i % 5) for i in range(n)]


def test_hot_key(spark):
    rows = hot_rows()
    df = rel(spark, rows).repartition(8)
    assert out(coalesce_periods(df, ["k"])) == from_sets(day_sets(rows))
    other = [(k, f + 2, t + 1) for k, f, t in rows if f % 2]
    a, b = day_sets(rows), day_sets(other)
    expected = {k: a[k] - b.get(k, set()) for k in a}
    got = algebra.difference(df, rel(spark, other), ["k"])
    assert out(got) == from_sets(expected)


@pytest.mark.parametrize("bound", [100, None])
def test_hot_item_and_category_in_olap(spark, bound):
    rows = hot_rows(3000)
    facts = rel(spark, [(k, Decimal("1.00"), f, t) for k, f, t in rows],
                "item_id string, net_paid decimal(7,2), sold_d date, x date").drop("x")
    ic = coalesce_periods(
        rel(spark, [(k, "big" if k < "k4" else "c", f, t) for k, f, t in rows],
            "item_id string, cat_id string, from_d date, to_d date"),
        ["item_id", "cat_id"],
    )
    q = algebra.count_when(ic, ["item_id"], ["cat_id"], at_least=3)
    got = out(olap.by_category(facts, ic, q, bound).agg(F.sum("total_sales").alias("s")))
    # Sales of an item on a day on which it and two others are in its category.
    member, crowd = {}, {}
    for k, f, t in rows:
        for d in range(f, t):
            member.setdefault(k, set()).add(d)
            crowd.setdefault(("big" if k < "k4" else "c", d), set()).add(k)
    want = sum(
        1 for k, f, _ in rows
        if f in member.get(k, ()) and len(crowd[("big" if k < "k4" else "c", f)]) >= 3
    )
    assert got == [(Decimal(want),)]


def test_hot_fact_key_is_split_at_run_time(spark, tmp_path):
    """Without a size bound the key join shuffles, and AQE splits the hot key."""
    path = str(tmp_path / "facts")
    spark.range(400_000).selectExpr(
        "if(id % 3 = 0, 1, id % 1000) AS item_sk", "id AS ticket", "uuid() AS pad"
    ).write.parquet(path)
    dim = spark.range(1000).selectExpr("id AS item_sk", "CAST(id AS string) AS item_id")
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = history.denormalise(spark.read.parquet(path), dim)
        assert len(df.collect()) == 400_000
        assert "skew=true" in physical(df)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_one_relation_is_read_once(spark, warehouse):
    plan = physical(warehouse.views.a5_difference())
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["o1_tdw", "o2_ss", "o3_tdw", "o5"])
def test_facts_are_pruned_before_they_are_summed(warehouse, name):
    w = replace(warehouse, rows=None)
    lines = physical(statements(w)[name]()).splitlines()
    depth = {key: [i for i, line in enumerate(lines) if key in line] for key in ("partial_sum", "LeftSemi", "dynamicpruning")}
    # Further down is earlier: facts meet the cells below their sum, and ranges of dates are left out of the scan.
    assert min(depth["LeftSemi"]) > min(depth["partial_sum"])
    assert any("PartitionFilters" in line and "dynamicpruning" in line for line in lines) or depth["dynamicpruning"]


def test_pruning_reads_only_the_relations_dates(spark, warehouse):
    days = rel(spark, [(1, 700, 720), (2, 715, 730)], "item_id long, from_d date, to_d date")
    facts = warehouse.sales
    kept = olap.pruned(facts, days)
    rows = {tuple(r) for r in facts.join(days, "item_id").where("from_d <= sold_d and sold_d < to_d").select("item_id", "sold_d", "net_paid").collect()}
    found = {tuple(r) for r in kept.select("item_id", "sold_d", "net_paid").collect()}
    assert rows <= found and len(found) < facts.count() / 20
    assert olap.pruned(facts, days.where("item_id < 0")).count() == 0


def test_references_are_checked_in_few_shuffles(spark):
    plan = physical(catalog.queries()["chk_fk"](spark, SF))
    assert plan.count("Exchange hashpartitioning") <= 8


def test_stored_tables_are_checked_where_they_lie(spark):
    plan = physical(catalog.queries()["chk_unique"](spark, SF))
    assert "l_shipdate" not in plan and plan.count("Exchange hashpartitioning") <= 8
    assert plan.count("FileScan") == 16


def test_dense_coalescing_shuffles_states_not_days(spark):
    rows = [(f"k{i % 3}", i % 2000, i % 2000 + 1 + i % 3) for i in range(30_000)]
    df = rel(spark, rows).repartition(4)
    plan = physical(coalesce_dense(df, ["k"]))
    assert "partial_bit_or" in plan and "partial_max" in plan and plan.count("Exchange hashpartitioning") == 2
    # Three keys in 2000 days: at most one state a key and 64 days leaves a task.
    states = df.groupBy("k", F.floor(F.unix_date("from_d") / 64)).count().count()
    assert states <= 3 * (2000 // 64 + 2)
    assert out(coalesce_dense(df, ["k"])) == from_sets(day_sets(rows))


def test_views_outlive_their_session(spark):
    """Any session reads them, also over the tables of a load, in place of earlier ones."""
    folder = catalog.write_files(spark, SF)
    loaded = load(spark, folder, f"{folder}/tables", **catalog.WIDER)
    w = stored.from_load(loaded, 3, 50000, 3)
    for price in (1, 50000):
        names = view_sql.create_views(spark, f"{folder}/tables", 3, price, 3, "kept_")
    assert len(names) == len(algebra_views.NAMES)
    for name in ("a3_join_tdw", "a4_union_ss", "a5_difference_scd", "a6_aggregation_ss"):
        mine, kept = statements(w)[name](), spark.newSession().table(f"kept_{name}")
        assert mine.dtypes == kept.dtypes
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, kept.collect())), name


def test_views_of_bucketed_items_do_not_shuffle(spark):
    w = stored.derive_and_store(spark, SF, buckets=4)
    view_sql.create_views(spark, w.path, 3, 50000, 3, "bucketed_")
    for name in [n for n in algebra_views.NAMES if n[1] in "12345" and n != "a5_difference_ss"]:
        plan = spark.table(f"bucketed_{name}")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


@pytest.mark.parametrize("name", ["o5_scd", "o2_ss"])
def test_large_relations_are_worked_out_once(warehouse, name):
    lines = physical(statements(replace(warehouse, rows=None))[name]()).splitlines()
    assert not any("FileScan" in line and ("scd_item" in line or "brand_id" in line) for line in lines)
    # The stored rows are small in their file only.
    assert not any("BroadcastHashJoin [item_id" in line for line in lines)


def test_orders_beyond_their_bound_are_not_broadcast(spark, tmp_path):
    """Their file is far below Spark's own threshold."""
    from tempora.operators.sized import SHARED_BYTES
    from tempora.sources import derived

    sf = str(tmp_path)
    lines = spark.range(10).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "2.0D l_extendedprice")
    lines.write.parquet(f"{sf}/lineitem.parquet")
    for rows, join in ((100, "BroadcastHashJoin"), (SHARED_BYTES // 64 + 1, "SortMergeJoin")):
        orders = spark.range(rows).selectExpr("id o_orderkey", "timestamp'2000-01-02' o_orderdate")
        orders.write.mode("overwrite").parquet(f"{sf}/orders.parquet")
        for df in (derived.sales(spark, sf), derived.sales_keys(spark, sf)):
            assert join in physical(df) and df.count() == 10


def test_broadcasts_of_one_category_total_share_the_driver(spark):
    """Cells that alone would be small enough for a broadcast are not beside others."""
    facts = rel(spark, [("i1", Decimal("1.00"), 1, 2)], "item_id string, net_paid decimal(7,2), sold_d date, x date").drop("x")
    ic = rel(spark, [("i1", 1, 0, 9)], "item_id string, cat_id int, from_d date, to_d date")
    for n, found in ((3, True), (250, False)):
        q = rel(spark, [(i, 0, 36500) for i in range(n)], "cat_id int, from_d date, to_d date")
        members = olap._members(ic, q, n)
        assert ("BroadcastHashJoin" in physical(members)) == found
        assert olap.by_category(facts, ic, q, n).count() == 1


@pytest.mark.parametrize("bound", [100, None])
def test_category_totals_read_their_members_once(spark, tmp_path, bound):
    """Neither members nor the sales of an item meet rows of their own, and none is copied into cells of days."""
    facts = rel(
        spark,
        [("i1", Decimal("1.00"), 1, 2), ("i1", Decimal("2.00"), 1, 2), ("i1", None, 70, 71), ("i2", None, 5, 6), ("i3", Decimal("4.00"), 400, 401), (None, Decimal("8.00"), 1, 2)],
        "item_id string, net_paid decimal(7,2), sold_d date, x date",
    ).drop("x")
    ic = [("i1", 1, 0, 9), ("i1", 1, 60, 99), ("i2", 1, 0, 9), ("i3", 1, 0, 9), ("i3", 2, 380, 420)]
    rel(spark, ic, "item_id string, cat_id int, from_d date, to_d date").write.parquet(f"{tmp_path}/ic")
    ic = spark.read.parquet(f"{tmp_path}/ic")
    pack(ic, ["item_id", "cat_id"]).write.parquet(f"{tmp_path}/ic_ss")
    q = rel(spark, [(1, 0, 80), (2, 300, 390), (2, 395, 500)], "cat_id int, from_d date, to_d date")
    literal = olap.by_category_literal(facts, ic, q, bound)
    sets = olap.by_category_span_set(facts, spark.read.parquet(f"{tmp_path}/ic_ss"), q, bound)
    for df in (literal, sets):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan parquet") == 1
    assert out(literal) == sorted([(1, 0, 9, Decimal("3.00")), (1, 60, 80, Decimal("3.00")), (2, 395, 420, Decimal("4.00"))])
    got = {(r["cat_id"], len(r["vt"])): r["total_sales"] for r in sets.collect()}
    assert got == {(1, 2): Decimal("3.00"), (1, 1): None, (2, 2): Decimal("4.00")}


def test_members_of_category_totals_are_stored_once(spark, tmp_path):
    lines = spark.range(10).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "2.0D l_extendedprice", "'N' l_returnflag", "timestamp'2000-01-02' l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    w = catalog.Inputs(spark, str(tmp_path), "versions")
    assert w.table("item_category") is w.table("item_category") and w.table("item_category").count() == 10
