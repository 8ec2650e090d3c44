"""Every registered query against its SQL counterpart."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tempora.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_file_sizes(spark):
    """Bytes of each stored table are those of its files."""
    from tempora.plans.load import load
    from tempora.operators.reports import profile_stored

    folder = catalog.write_files(spark, SF)
    loaded = load(spark, folder, f"{folder}/tables", **catalog.WIDER)
    profile = profile_stored(spark, {name: f"{folder}/tables/{name}" for name in loaded})
    assert "path" not in profile.columns
    for r in profile.collect():
        files = glob.glob(f"{folder}/tables/{r['table_name']}/*.parquet".removeprefix("file:"))
        assert r["size_bytes"] == sum(os.path.getsize(f) for f in files) > 0 and r["size"]
        assert r["rows"] == loaded[r["table_name"]].count()
    assert catalog.profile_sizes(spark, SF).count() == 16


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["a6_aggregation_scd", "o6_scd", "o6_scd_shuffled"])
def test_fixtures_have_rows(spark, sf, name):
    assert QUERIES[name](spark, f"/root/testdata/{sf}").count() > 0


def test_fixtures_tell_the_differences_apart(spark):
    some, every = (QUERIES[n](spark, SF).count() for n in ("a5_difference", "a5_difference_all"))
    assert 0 < some < every


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "from_d", "to_d", "total_sales"]


def test_outputs_are_sorted(spark):
    rows = [(r["item_id"], r["from_d"]) for r in QUERIES["o2_tdw"](spark, SF).collect()]
    assert rows == sorted(rows)
