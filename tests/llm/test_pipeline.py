from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tempora.llm import decontaminate, neardup, oracle, quality, queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cursor = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert cases.rows_of(df) == sorted((tuple(r[c] for c in df.columns) for r in expected), key=repr)


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_do_what_their_operators_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == before.schema
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).where(f"score >= {corpus_pipeline.LEAST_QUALITY}")
    assert ids["quality"] == {r["doc_id"] for r in good.collect()}
    groups = neardup.near_duplicates(seen["line_dedup"]).collect()
    assert ids["near_dedup"] == {r["doc_id"] for r in groups if r["kept"]}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = decontaminate.find_items(seen["near_dedup"], items).where("n_hit = 0")
    assert ids["decontamination"] == {r["doc_id"] for r in clean.collect()} == ids["packing"]
    assert cases.rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")) == cases.rows_of(
        seen["packing"].select("doc_id", "piece", "length", "ids_crc32")
    )


@pytest.mark.parametrize("make", [cases.awkward, lambda s: cases.with_clashes(cases.awkward(s)), lambda s: cases.documents(s, [])])
def test_every_stage_takes_awkward_rows(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert out.count() >= 0


def test_no_operator_is_imported_by_the_rest():
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "tempora")):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                assert "tempora.llm" not in open(os.path.join(folder, f)).read()
