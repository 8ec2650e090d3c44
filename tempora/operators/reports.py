"""Reports over the run logs, and a profile of stored tables.

A run log has ``query_id, run_id, start_time, planning_ms, execution_ms,
seconds, number_rows``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.sizes import pretty_size


def _json(path: str, kind: str) -> Column:
    return F.get_json_object("plan", path).cast(kind)


def read_plans(log: DataFrame) -> DataFrame:
    """Times and row count out of the plan document in ``plan``."""
    timed = log.select(
        F.trim("query_id").alias("query_id"),
        "run_id",
        "start_time",
        _json("$[0]['Planning Time']", "double").alias("planning_ms"),
        _json("$[0]['Execution Time']", "double").alias("execution_ms"),
        _json("$[0].Plan['Actual Rows']", "bigint").alias("number_rows"),
    )
    secs = (F.col("planning_ms") + F.col("execution_ms")) / 1000
    return timed.select(
        "*",
        F.make_dt_interval(secs=secs.cast("decimal(18,6)")).alias("duration"),
        secs.alias("seconds"),
    )


def interval_text(duration: Column) -> Column:
    """``HH:mm:ss.ffffff`` of a time shorter than a day."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.date_format(zero + duration, "HH:mm:ss.SSSSSS")


def paired(algebra: DataFrame, olap: DataFrame, run: int | None = None) -> DataFrame:
    """Seconds of both sides for the same query and run."""
    a = algebra.select("query_id", "run_id", F.col("seconds").alias("algebra"))
    o = olap.select("query_id", "run_id", F.col("seconds").alias("olap"))
    if run is not None:
        a, o = a.where(F.col("run_id") == run), o.where(F.col("run_id") == run)
    return a.join(o, ["query_id", "run_id"])


def _mean(log: DataFrame, name: str) -> DataFrame:
    return log.groupBy("query_id").agg(F.round(F.avg("seconds"), 6).alias(name))


def warm_means(algebra: DataFrame, olap: DataFrame) -> DataFrame:
    """Mean seconds per query without the first run, queries of both sides."""
    warm = F.col("run_id") > 1
    a = _mean(algebra.where(warm), "algebra")
    return a.join(_mean(olap.where(warm), "olap"), "query_id")


def all_means(algebra: DataFrame, olap: DataFrame) -> DataFrame:
    """Mean seconds per query of either side.

    As published, queries known to the OLAP side only also appear together in
    one row without an id, next to their own rows.
    """
    a, o = _mean(algebra, "algebra"), _mean(olap, "olap")
    both = a.join(o, "query_id", "left")
    only = olap.join(a.select("query_id"), "query_id", "left_anti")
    own = _mean(only, "olap").select("query_id", F.lit(None).alias("algebra"), "olap")
    pooled = only.agg(F.round(F.avg("seconds"), 6).alias("olap"), F.count("*").alias("n"))
    pooled = pooled.where("n > 0").select(
        F.lit(None).cast("string").alias("query_id"), F.lit(None).alias("algebra"), "olap"
    )
    cols = ["query_id", "algebra", "olap"]
    return both.select(cols).unionByName(own.select(cols)).unionByName(pooled).distinct()


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _folders(tables: dict[str, DataFrame]) -> tuple[SparkSession, dict[str, str]]:
    """The session and the folder of each table, less any folders of partitions."""
    paths = {name: re.sub(r"(?:/[^/=]+=[^/]*)*/[^/]*$", "", df.inputFiles()[0]) for name, df in tables.items()}
    return next(iter(tables.values())).sparkSession, paths


def profile_stored(spark: SparkSession | dict[str, DataFrame], paths: dict[str, str] | None = None) -> DataFrame:
    """Rows and stored bytes per table, by the folder it is stored in.

    Bytes come from the listing of files, no file of which is opened, and rows
    from parquet footers: counting reads no column.  In place of folders, tables
    read from one folder each can be given alone.
    """
    if paths is None:
        spark, paths = _folders(spark)
    names = F.create_map(*[F.lit(x) for name, path in paths.items() for x in (path.rstrip("/").split("/")[-1], name)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    folder = F.regexp_extract("path", r"/([^/=]+)/(?:[^/=]+=[^/]*/)*[^/]*$", 1)
    listed = files.load(list(paths.values())).select(names[folder].alias("table_name"), "length")
    sizes = listed.groupBy("table_name").agg(F.sum("length").alias("size_bytes"))
    rows = profile({name: spark.read.parquet(path) for name, path in paths.items()})
    out = rows.join(sizes, "table_name", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
    return out.withColumn("size", pretty_size(F.col("size_bytes")))
