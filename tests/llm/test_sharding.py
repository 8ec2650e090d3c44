from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tempora.llm import ranks, sharding
from tests.llm import cases


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_counts_slots_and_mixture(spark, shards):
    docs = cases.with_clashes(cases.awkward(spark))
    rows = sharding.interleave(docs, shards).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r["shard"] for r in rows)
    per = [sizes.get(s, 0) for s in range(shards)]
    assert max(per) - min(per) <= 1 and set(sizes) <= set(range(shards))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 2 == 0, "b").alias("source")
    )
    rows = sharding.interleave(docs, 10).groupBy("shard").pivot("source").count().collect()
    for r in rows:
        assert abs(r["hot"] - 66.7) < 2 and abs(r["b"] - 66.7) < 2 and abs(r["null"] - 66.7) < 2


def test_order_within_a_source_is_shuffled_and_repeatable(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    one = cases.rows_of(sharding.interleave(docs, 4).select("shard", "slot", "doc_id"))
    assert one == cases.rows_of(sharding.interleave(docs.repartition(5), 4).select("shard", "slot", "doc_id"))
    ids = [r[2] for r in sorted(one)]
    assert ids != sorted(ids) and cases.rows_of(sharding.interleave(docs, 4, seed="1").select("shard", "slot", "doc_id")) != one


def test_sizes_and_checksums(spark):
    docs = cases.documents(spark, ["é", None, ""])
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.interleave(docs, 2).collect()}
    import zlib

    assert got == {1: (18, zlib.crc32("é".encode())), 2: (16, 0), 3: (16, 0)}


def test_empty_table(spark):
    assert sharding.interleave(cases.documents(spark, []), 3).count() == 0


def test_write_shards(spark, tmp_path):
    docs = cases.awkward(spark)
    sharding.write_shards(docs, 3, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and {"text", "lang", "n_chars", "shard", "slot"} <= set(back.columns)


def test_ranked_equals_a_plain_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("x")).withColumn("cell", F.shiftrightunsigned("x", 60))
    df = df.withColumn("cell", F.col("cell").cast("int"))
    got = ranks.ranked(df, ["g"], "cell", ["x"], "at", "n").collect()
    for g in range(3):
        rows = sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"] % 2**64 >> 60, r["x"]))
        assert [r["at"] for r in rows] == list(range(len(rows))) and {r["n"] for r in rows} == {len(rows)}
