from __future__ import annotations

import csv as python_csv
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators import history
from tempora.operators.periods import unpack
from tempora.plans import catalog, load as load_module, stored
from tempora.plans.algebra_views import register
from tempora.plans.statements import statements
from tempora.plans.load import load, reopen
from tempora.sources import csv, schemas, tables
from tempora.sources.tables import append_table, replace_bucketed, replace_table, row_bound, scratch_dir
from tests.support import day, out, rel

SF = "/root/testdata/sf0.001"


def test_declared_schemas(spark):
    item = schemas.item_schema()
    assert len(item) == 22 and len(schemas.calendar_schema()) == 28 and len(schemas.sales_schema()) == 23
    assert item["i_current_price"].dataType.simpleString() == "decimal(7,2)"
    wider = schemas.item_schema(i_current_price="decimal(12,2)")
    assert wider["i_current_price"].dataType.simpleString() == "decimal(12,2)"


def test_csv_null_empty_and_padding(spark, tmp_path):
    head = ",".join(schemas.item_schema().names)
    row = '1,AAAA            ,2000-01-01,,"a, ""b""",9.50,,5,,,,7,"",,,,,,,,,'
    (tmp_path / "scd_item.csv").write_text(f"{head}\n{row}\n")
    r = csv.read_items(spark, str(tmp_path)).first()
    assert r["i_item_id"] == "AAAA" and r["i_rec_start_date"] == day(0)
    assert r["i_rec_end_date"] is None and r["i_brand"] is None
    assert r["i_category"] == "" and r["i_item_desc"] == 'a, "b"'
    assert r["i_current_price"] == Decimal("9.50")


def test_csv_malformed_row_aborts(spark, tmp_path):
    head = ",".join(schemas.item_schema().names)
    (tmp_path / "scd_item.csv").write_text(f"{head}\nx{',' * 21}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        csv.read_items(spark, str(tmp_path)).collect()


def test_scale_dir():
    assert csv.scale_dir("/data/", 10) == "/data/sf10"


def test_scratch_is_under_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_dir(spark), scratch_dir(spark)
    assert first.startswith(root) and first != second


def test_replace_and_append(spark):
    path = scratch_dir(spark)
    assert replace_table(spark.range(5), path).count() == 5
    assert replace_table(spark.range(3), path).count() == 3
    assert append_table(spark.range(4), path).count() == 7
    assert row_bound(spark, path) == 7


def test_bucketed_table_can_be_refilled(spark):
    path = scratch_dir(spark)
    assert replace_bucketed(spark.range(9), path, "id", 4).count() == 9
    assert replace_bucketed(spark.range(3), path, "id", 4).count() == 3


def test_load_stores_sixteen_tables(spark):
    folder = catalog.write_files(spark, SF)
    loaded = load(spark, folder, f"{folder}/tables", **catalog.WIDER)
    assert len(loaded) == 16
    facts = loaded["store_sales"]
    assert len(facts.columns) == 24 and facts.columns[-1] == "ss_item_id"
    assert len(loaded["scd_item"].columns) == 22
    known = csv.as_sales(facts).where("item_id IS NOT NULL")
    assert 0 < known.count() < facts.count()


def test_stored_tables_give_the_lazy_results(spark):
    w = stored.derive_and_store(spark, SF, buckets=4)
    lazy = catalog.queries()
    for name in ("a3_join_tdw", "a5_difference", "o1_tdw", "o6_tdw"):
        mine = sorted(map(tuple, statements(w)[name]().collect()), key=repr)
        other = sorted(map(tuple, lazy[name](spark, SF).collect()), key=repr)
        assert mine == other, name


def test_designs_agree(spark):
    w = stored.derive_and_store(spark, SF, buckets=4)
    views = statements(w)
    for name in ("a1_selection", "a2_projection", "a3_join", "a4_union"):
        rows = out(views[f"{name}_tdw"]())
        assert rows and rows == out(views[f"{name}_scd"]())
        assert rows == out(unpack(views[f"{name}_ss"]()))
    assert out(views["a6_aggregation"]()) == out(unpack(views["a6_aggregation_ss"]()))


@pytest.mark.parametrize("buckets", [None, 4])
def test_later_session_reads_the_same_tables(spark, buckets):
    folder = catalog.write_files(spark, SF)
    loaded = load(spark, folder, f"{folder}/tables", buckets, **catalog.WIDER)
    again = reopen(spark.newSession(), f"{folder}/tables", buckets)
    assert set(again) == set(loaded)
    one, two = stored.from_load(loaded, 3, 50000, 3), stored.from_load(again, 3, 50000, 3)
    assert out(statements(one)["o3_ss"]().drop("vt")) == out(statements(two)["o3_ss"]().drop("vt"))
    register(two.views, ["a4_union_tdw"])
    later = again["item"].sparkSession
    assert later.table("a4_union_tdw").count() == two.views.a4_union_tdw().count()
    plan = two.views.a3_join_tdw()._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (buckets is None)


def test_open_bucketed_declares_the_buckets(spark):
    path = scratch_dir(spark)
    replace_bucketed(spark.range(50).withColumn("v", F.col("id") % 3), path, "id", 4)
    spark.sql(f"DROP TABLE {tables._bucketed_name(path)}")
    again = tables.open_bucketed(spark, path, "id", 4)
    assert again.count() == 50
    plan = again.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("wrong", [2, 8, 16])
def test_reopening_with_another_bucket_count_is_refused(spark, wrong):
    path = scratch_dir(spark)
    replace_bucketed(spark.range(500), path, "id", 4)
    spark.sql(f"DROP TABLE {tables._bucketed_name(path)}")
    with pytest.raises(ValueError, match="4 buckets"):
        tables.open_bucketed(spark, path, "id", wrong)
    with pytest.raises(ValueError, match="by id"):
        tables.open_bucketed(spark, path, "other", 4)
    for again in (tables.open_bucketed(spark, path), tables.open_bucketed(spark, path, "id", 4)):
        assert again.join(spark.range(500), "id").count() == 500


def test_an_earlier_declaration_does_not_survive(spark):
    path = scratch_dir(spark)
    replace_bucketed(spark.range(500), path, "id", 4)
    name = tables._bucketed_name(path)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} (id bigint) USING parquet CLUSTERED BY (id) INTO 16 BUCKETS LOCATION '{path}'")
    assert tables.open_bucketed(spark, path).join(spark.range(500), "id").count() == 500


def test_buckets_grow_with_the_order_lines(spark, monkeypatch):
    lines = row_bound(spark, f"{SF}/lineitem.parquet")
    monkeypatch.setattr(stored, "BUCKET_ROWS", lines // 10)
    w = stored.derive_and_store(spark, SF, buckets=4)
    # More than asked for, so that none holds more rows than one of a smaller table.
    assert tables.bucketed_by(spark, f"{w.path}/scd_item") == ("item_id", -(-lines // (lines // 10)))
    assert w.table("item_price").count() == stored.reopened(spark, w.path).table("item_price").count()


def test_reopened_warehouse_has_every_row(spark):
    w = stored.derive_and_store(spark, SF, buckets=8)
    for name in ("item_ls", "item_brand", "item_price_ss"):
        spark.sql(f"DROP TABLE {tables._bucketed_name(f'{w.path}/{name}')}")
    again = stored.reopened(spark, w.path)
    for name in ("a2_projection_tdw", "a3_join_ss", "o1_tdw"):
        assert out(statements(again)[name]().drop("vt")) == out(statements(w)[name]().drop("vt"))


def test_scratch_needs_a_shared_folder_unless_local(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        conf = Conf

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})

    for master in ("local", "local[4]", "local[*]"):
        assert scratch_dir(Session(master))
    for master in ("local-cluster[2,1,512]", "spark://x:7077", "yarn"):
        with pytest.raises(ValueError, match="share"):
            scratch_dir(Session(master))


def _items(tmp_path, *rows):
    head = ",".join(schemas.item_schema().names)
    (tmp_path / "scd_item.csv").write_text("\n".join([head, *rows]) + "\n")
    return str(tmp_path)


def test_only_char_loses_its_blanks(spark, tmp_path):
    folder = _items(tmp_path, f"1,AAAA            ,,,abc  ,,,,x   {',' * 13}")
    r = csv.read_items(spark, folder).first()
    assert (r["i_item_id"], r["i_item_desc"], r["i_brand"]) == ("AAAA", "abc  ", "x")


def test_a_bad_field_in_an_unread_column_aborts(spark, tmp_path):
    folder = _items(tmp_path, f"1,A,,,d,,,xx{',' * 14}")
    for use in (lambda df: df.count(), lambda df: df.select("i_item_sk").collect()):
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            use(csv.read_items(spark, folder))


@pytest.mark.parametrize("row", [f"1,{'A' * 17},,,d", f"1,A,,,{'d' * 201}"])
def test_too_long_a_string_aborts(spark, tmp_path, row):
    row += "," * (21 - row.count(","))
    with pytest.raises(Exception, match="is longer than"):
        csv.read_items(spark, _items(tmp_path, row)).collect()


def test_blanks_beyond_the_length_are_cut(spark, tmp_path):
    folder = _items(tmp_path, f"1,{'A' * 16}  ,,,{'d' * 199}   {',' * 17}")
    r = csv.read_items(spark, folder).first()
    assert r["i_item_id"] == "A" * 16 and r["i_item_desc"] == "d" * 199 + " "


def test_quoted_line_breaks(spark, tmp_path):
    folder = _items(tmp_path, f'1,A,,,"a\nb"{"," * 17}')
    assert csv.read_items(spark, folder, multi_line=True).first()["i_item_desc"] == "a\nb"


THREE = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])


@pytest.fixture
def small_splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "0")
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def _quoted(path, rows, ends):
    with open(path, "w", newline="") as file:
        writer = python_csv.writer(file, lineterminator=ends)
        writer.writerow("abc")
        writer.writerows(rows)


@pytest.mark.parametrize("small_splits", [1 << 27, 1000, 97], indirect=True)
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_line_breaks_across_splits(spark, tmp_path, small_splits, ends):
    """Every split begins somewhere in a record, quoted or not; two files do not mix."""
    rnd = random.Random(small_splits)
    parts = ["x", "\n", '"', ",", "y ", "\n\n", "z" * 40]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.choice([0, 1, 3, 30]))) or None, "z") for i in range(200)]
    (tmp_path / "in").mkdir()
    _quoted(tmp_path / "in" / "1.csv", rows[:120], ends)
    _quoted(tmp_path / "in" / "2.csv", rows[120:], ends)
    df = csv.read_csv(spark, str(tmp_path / "in"), THREE, multi_line=True)
    assert sorted(map(tuple, df.collect())) == rows
    assert csv.bad_fields(spark, str(tmp_path / "in"), THREE, multi_line=True).count() == 0


def test_records_of_one_split_are_not_dealt_anew(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a\n"x\ny"\nz\n')
    plan = csv._records(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    # Grouped where the lines of a split are; no exchange by record of these.
    assert re.search(r"keys=\[file#\d+, split#\d+L?, record#\d+L?\]", plan)
    assert not re.search(r"hashpartitioning\(file#\d+, split#\d+L?, record", plan)


def test_written_csv_files_are_compressed(spark, tmp_path):
    days = spark.sql("SELECT 1 AS d_date_sk, 'x' AS d_date_id")
    catalog._write_csv(days, schemas.calendar_schema(), str(tmp_path / "date_dim.csv"))
    assert [p.suffix for p in (tmp_path / "date_dim.csv").glob("part-*")] == [".gz"]
    assert csv.read_calendar(spark, str(tmp_path)).select("d_date_sk", "d_date_id").first()[:] == (1, "x")


@pytest.mark.parametrize("small_splits", [1 << 27, 41], indirect=True)
def test_bad_records_have_the_line_they_begin_with(spark, tmp_path, small_splits):
    lines = ["a,b,c", '1,"x', 'y ""z""', '",p', '2x,"q', '",r', "3,s", "4,t,u"]
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n")
    bad = csv.bad_fields(spark, str(path), THREE, multi_line=True)
    found = sorted((r["line"], r["column_name"], r["value"], r["problem"]) for r in bad.collect())
    assert found == [(5, "a", "2x", "not int"), (7, None, "3,s", "not 3 fields")]


@pytest.mark.parametrize("small_splits", [1 << 27, 30], indirect=True)
def test_an_open_quote_is_reported_and_aborts(spark, tmp_path, small_splits):
    path = tmp_path / "m.csv"
    path.write_text('a,b,c\n1,"x\ny",p\n2,"open,q\n' + "3,s,t\n" * 20)
    bad = csv.bad_fields(spark, str(path), THREE, multi_line=True).collect()
    assert [(r["line"], r["value"], r["problem"]) for r in bad] == [(4, '2,"open,q', "quote not closed")]
    with pytest.raises(Exception, match="quote not closed.* line 4"):
        csv.read_csv(spark, str(path), THREE, multi_line=True).collect()


def test_records_of_an_empty_file(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("")
    assert csv.read_csv(spark, str(path), THREE, multi_line=True).count() == 0
    path.write_text("a,b,c\n")
    assert csv.read_csv(spark, str(path), THREE, multi_line=True).count() == 0


def test_load_takes_a_scale_factor(spark):
    folder = catalog.write_files(spark, SF)
    root, name = folder.rsplit("/", 1)
    import os

    os.makedirs(f"{root}/scales")
    os.symlink(folder, f"{root}/scales/sf7")
    loaded = load(spark, f"{root}/scales", f"{folder}/out", scale=7, **catalog.WIDER)
    assert loaded["scd_item"].count() == spark.read.option("header", True).csv(f"{folder}/scd_item.csv").count()


def test_loaded_versions_are_hashed_once_unless_an_item_is_hot(spark, tmp_path, monkeypatch):
    rows = [(1, "i1", 1, 7, 80.0, 0, 5), (2, "i1", 2, 7, 90.0, 5, 9), (3, None, 1, 7, 80.0, 0, 5), (3, None, 1, 7, 80.0, 0, 5)]
    versions = rel(spark, rows, "item_sk int, item_id string, brand_id int, cat_id int, price double, from_d date, to_d date")

    own, hashed = load_module._by_item(versions, None, 4)
    assert hashed and sorted(own.collect(), key=repr) == sorted(versions.collect(), key=repr)
    executed = history.attribute_ss(own, "brand_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in executed
    # Two rows of the item without an id are more than a task is to hold.
    monkeypatch.setattr(load_module, "BUCKET_ROWS", 1)
    assert load_module._by_item(versions, None, 4) == (versions, False)
