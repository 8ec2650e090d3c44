"""Broadcast only behind a proven bound on the bytes; salt few-valued keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What one executor may hold of a broadcast side, and the driver while it builds it.
BROADCAST_BYTES = 160_000_000

# A row in a hash table: its header, 8 bytes a column, and the content of a key
# or name, which the declared schemas bound; longer types have no such bound.
ROW_BYTES, TEXT_BYTES = 48, 64


def row_bytes(df: DataFrame) -> int | None:
    """Upper bound of a row's size in memory; None where the types give none."""
    size = ROW_BYTES
    for field in df.schema:
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.BinaryType):
            return None
        nested = len(field.dataType) if isinstance(field.dataType, T.StructType) else 1
        size += 8 * nested + (TEXT_BYTES if isinstance(field.dataType, T.StringType) else 0)
    return size


def is_small(df: DataFrame, rows: int | None, limit: int = BROADCAST_BYTES) -> bool:
    """``rows`` is an upper bound known before the plan runs; None = unknown."""
    width = row_bytes(df)
    return rows is not None and width is not None and rows * width <= limit


def small(df: DataFrame, rows: int | None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows`` proves it small.

    Otherwise the plan is left to the optimizer, which shuffles both sides and
    splits skewed partitions at run time.
    """
    return F.broadcast(df) if is_small(df, rows, limit) else df


# What each of several broadcasts of one plan may take: the driver builds them at a time.
SHARED_BYTES = BROADCAST_BYTES // 4


def shared(df: DataFrame, rows: int | None) -> DataFrame:
    """Mark ``df`` for broadcast beside others when ``rows`` proves it small.

    Otherwise it meets the other side in a merge: Spark's own estimate is of a
    packed file, whose rows take many times as much in the driver.
    """
    return F.broadcast(df) if is_small(df, rows, SHARED_BYTES) else df.hint("merge")


# Tasks that one key value of a salted join is spread over.
SALTS = 32


def salted(many: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a ``salt`` column to join on besides the key.

    Rows of ``many`` get a salt from their content, so a rerun task repeats it;
    rows of ``few`` are copied once per salt.  Every pair still meets once.
    The copies are not in Spark's estimate of their size, so they are kept from
    being broadcast on the strength of it.
    """
    salt = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return many.withColumn("salt", salt), few.withColumn("salt", copies).hint("merge")
