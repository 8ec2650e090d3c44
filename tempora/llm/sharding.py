"""Proportional stratified interleaving of documents into shards.

Rows of each source are shuffled by a seeded digest and ranked; the row of rank
r among n has the fractional rank (2r + 1) / 2n.  All rows sorted by it are cut
into runs of equal length, so that every run holds each source in proportion.

A rank is never taken over a whole source in one task: digests and fractional
ranks are cut into ``CELLS`` ranges, counted, and ranked inside a range only.

Nulls: a null source is a source of its own, a null text has no bytes, a null id
is shuffled as the empty string.  Repeated rows are rows of their own, and as
they are equal it does not matter which of them comes first.  An empty table
gives no rows.  Other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.ranks import ranked
from tempora.sources.tables import replace_table, scratch_dir

# Ranges that digests and fractional ranks are cut into: three hexadecimal digits.
CELLS = 4096
ROW_BYTES = 16


def interleave(docs: DataFrame, shards: int, seed: str = "0", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, source``, then ``shard`` and ``slot``.

    Shard sizes differ by one row at most; ``slot`` counts from 0 in a shard.
    ``carry`` names further columns to take along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("source"),
        F.struct(*[F.col(c) for c in carry]).alias("_carried") if carry else F.lit(None).cast("int").alias("_carried"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_stratum"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_digest"),
        F.xxhash64(text).alias("_tie"),
    ).withColumn("_cell", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    within = ranked(rows, ["_stratum"], "_cell", ["_digest", "text_crc32", "size", "_tie"], "_rank", "_rows")
    spread = within.withColumn("_share", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_rows")))
    # Read twice below, so kept: without texts, a few dozen bytes a row.
    spread = replace_table(spread.drop("_digest", "_tie", "_rows"), f"{scratch_dir(docs.sparkSession)}/ranked")
    spread = spread.withColumn("_part", F.floor(F.col("_share") * CELLS).cast("int"))
    placed = ranked(spread.withColumn("_all", F.lit(0)), ["_all"], "_part", ["_share", "_stratum", "_rank"], "_at", "_total")
    shard = F.expr(f"(_at * {shards}) div _total")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("_at") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    out = placed.select("doc_id", "size", "text_crc32", "source", "shard", slot.alias("slot"), "_carried")
    return out.select(*out.columns[:-1], "_carried.*") if carry else out.drop("_carried")


def write_shards(docs: DataFrame, shards: int, path: str, seed: str = "0") -> None:
    """One folder of parquet a shard, rows in slot order."""
    rows = interleave(docs.drop("shard", "slot"), shards, seed, tuple(c for c in docs.columns if c not in {"doc_id", "source", "shard", "slot"}))
    by_shard = rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    by_shard.write.mode("overwrite").partitionBy("shard").parquet(path)
