"""Parquet tables: replace, append, scratch space, and row bounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Only where the session names none and runs in one process (``local``,
    ``local[n]``) is a folder of this machine taken.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/tempora-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process has asked for so far.

    To be called when every result that reads them has been consumed.
    """
    gone = 0
    while _MADE:
        gone += remove_table(spark, _MADE.pop())
    return gone


def remove_table(spark: SparkSession, path: str) -> bool:
    """Delete a table, or a folder of them, that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.delete(folder, True))


def has_table(spark: SparkSession, path: str) -> bool:
    """The table was written in full, and is still there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done))


def replace_table(df: DataFrame, path: str, partition_by: str | None = None, **options: int) -> DataFrame:
    """Drop-and-fill: the table holds exactly the rows of ``df`` afterwards."""
    writer = df.write.mode("overwrite").options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add rows, as a run log does from its second run on.

    With ``keys``, rows whose key the table has already are not added again, so
    an append that is retried leaves one copy.
    """
    spark = df.sparkSession
    new = df.join(spark.read.schema(df.schema).parquet(path).select(*keys).distinct(), list(keys), "left_anti") if keys else df
    new.select(*df.columns).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# What tells one run of a query from another.
RUN = ("query_id", "run_id", "start_time")


def log_runs(log: DataFrame, path: str, new_table: bool = True) -> DataFrame:
    """Start a run log, or add the runs that it has not yet."""
    return replace_table(log, path) if new_table else append_table(log, path, RUN)


def _bucketed_name(path: str) -> str:
    return "t_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def _plain(df: DataFrame) -> DataFrame:
    """Aliased columns carry no table qualifier; with one, a union of two
    bucketed tables is not seen to keep their common partitioning."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _bucket_note(path: str) -> str:
    return f"{path.rstrip('/')}.buckets"


def _declare(spark: SparkSession, path: str, buckets: str = "") -> str:
    """Declare the files as a table, in place of any earlier declaration; its name."""
    name, schema = _bucketed_name(path), spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {buckets} LOCATION '{path}'")
    return name


def _clustered(key: str, buckets: int) -> str:
    return f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS"


def declare(spark: SparkSession, path: str) -> str:
    """Name of a stored table in the catalog, with its buckets if it has any."""
    if has_table(spark, _bucket_note(path)):
        return _declare(spark, path, _clustered(*bucketed_by(spark, path)))
    return _declare(spark, path)


def replace_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, hashed: bool = False
) -> DataFrame:
    """As :func:`replace_table`, hashed into ``buckets`` by ``key``.

    Later grouping, windows and joins on the key read without a shuffle.  Only
    for tables in which the rows of one key are bounded.  Key and bucket count
    are noted beside the table; a wrong count would hide rows from a reader.
    ``hashed`` saves the shuffle of rows read from a table of the same buckets.
    """
    spark, name = df.sparkSession, _bucketed_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # One file a bucket, unless each task has one bucket's rows already.
    rows = df if hashed else df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key)
    writer.option("path", path).saveAsTable(name)
    note = spark.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"))
    note.coalesce(1).write.mode("overwrite").json(_bucket_note(path))
    return _plain(spark.table(name))


def bucketed_by(spark: SparkSession, path: str) -> tuple[str, int]:
    """Key and bucket count that a bucketed table was written with."""
    note = spark.read.schema("key string, buckets int").json(_bucket_note(path)).first()
    if note is None:
        raise ValueError(f"{path} has no note of its buckets")
    return note["key"], note["buckets"]


def open_bucketed(
    spark: SparkSession, path: str, key: str | None = None, buckets: int | None = None
) -> DataFrame:
    """A table that :func:`replace_bucketed` wrote, in a later session.

    Key and count are read from beside the table; those given must be the same.
    """
    own_key, own_buckets = bucketed_by(spark, path)
    if key not in (None, own_key) or buckets not in (None, own_buckets):
        raise ValueError(f"{path} has {own_buckets} buckets by {own_key}, not {buckets} by {key}")
    return _plain(spark.table(_declare(spark, path, _clustered(own_key, own_buckets))))


def row_bound(spark: SparkSession, *paths: str) -> int:
    """Total rows of parquet tables, from file footers only."""
    return sum(spark.read.parquet(p).count() for p in paths)
