"""CSV scans of the three input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.sources import schemas


# Stands for a quoted empty field while reading; not a character of text files.
_EMPTY = "\u0001"


def _text(field: T.StructField) -> Column:
    """A string as declared: ``char`` loses its padding, ``varchar`` keeps its
    blanks, and what is longer than declared, blanks at its end aside, is an error."""
    value = F.when(F.col(field.name) == _EMPTY, "").otherwise(F.col(field.name))
    kind, length = (field.metadata.get(k) for k in ("kind", "length"))
    if kind is None:
        return value.alias(field.name)
    full, bare = value, F.rtrim(value)
    fitting = bare if kind == "char" else F.substring(full, 1, length)
    error = F.raise_error(F.concat(F.lit(f"{field.name} is longer than {length}: "), bare))
    return F.when(F.length(bare) > length, error.cast("string")).otherwise(fitting).alias(field.name)


def _lines(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """``file, split, place, value``: lines in the order of their place within a split of a file."""
    reader = spark.read.option("lineSep", ends) if ends else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def _earlier(value: Column, *by: str, order: str) -> Column:
    return value.over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value, unclosed``: records whose quoted fields may hold line breaks.

    Whether a line begins in quotes is the parity of the quotes before it: those
    of its split, and those of earlier splits, which are counted first.  So the
    splits of a file are read apart, and only the lines of a record that has
    several meet.  A quote that is not closed takes the rest of its file, of
    which only the line that opens it is returned, as ``unclosed``.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = _lines(spark, path, "\n").withColumn("odd", quotes % 2)
    turn = F.max(F.when(F.col("odd") == 1, F.col("place")))
    splits = lines.groupBy("file", "split").agg(
        F.min("place").alias("first"), F.count("*").alias("n"), F.sum("odd").alias("odds"), turn.alias("turn")
    )
    in_file = Window.partitionBy("file")
    splits = splits.select(
        "file",
        "split",
        "first",
        F.coalesce(_earlier(F.sum("n"), "file", order="split"), F.lit(0)).alias("before"),
        F.coalesce(_earlier(F.sum("odds"), "file", order="split"), F.lit(0)).alias("odds_before"),
        _earlier(F.last("turn", ignorenulls=True), "file", order="split").alias("turn_before"),
        "odds",
        "turn",
        F.when(F.sum("odds").over(in_file) % 2 == 1, F.max("turn").over(in_file)).alias("opened"),
    )
    # The record that goes on into the next split, and its first line.
    ends_open = (F.col("odds_before") + F.col("odds")) % 2 == 1
    splits = splits.withColumn("goes_on", F.when(ends_open, F.coalesce("turn", "turn_before"))).drop("odds", "turn")
    odds = F.coalesce(_earlier(F.sum("odd"), "file", "split", order="place"), F.lit(0))
    lines = lines.withColumns({"odds": odds, "turn": _earlier(turn, "file", "split", order="place")})
    in_quotes = (F.col("odds") + F.col("odds_before")) % 2 == 1
    lines = lines.join(splits, ["file", "split"]).select(
        "file",
        "split",
        "place",
        "goes_on",
        (F.col("place") - F.col("first") + F.col("before") + 1).alias("line"),
        "value",
        "odd",
        "opened",
        (in_quotes & F.col("turn").isNull()).alias("from_before"),
        # The line that the record begins with: the last that turned quotes on.
        F.when(in_quotes, F.coalesce("turn", "turn_before"))
        .otherwise(F.col("place"))
        .alias("record"),
    )
    is_open = F.coalesce(F.col("record") == F.col("opened"), F.lit(False))
    whole = (F.col("odd") == 0) & (F.col("record") == F.col("place"))
    alone = lines.where(whole | (is_open & (F.col("place") == F.col("opened"))))
    alone = alone.select("file", "line", "value", is_open.alias("unclosed"))
    parts = F.array_sort(F.collect_list(F.struct("line", "value")))
    joined = F.array_join(F.transform(parts, lambda x: x["value"]), "\n")
    # A record within its split is put together where the lines are; only one that reaches into others is dealt anew.
    reaches = F.col("from_before") | F.coalesce(F.col("record") == F.col("goes_on"), F.lit(False))
    rest = lines.where(~whole & ~is_open)
    every = alone
    for within, keys in ((~reaches, ["file", "split", "record"]), (reaches, ["file", "record"])):
        several = rest.where(within).groupBy(*keys).agg(F.min("line").alias("line"), joined.alias("value"))
        every = every.unionByName(several.select("file", "line", "value", F.lit(False).alias("unclosed")))
    return every.withColumn("value", F.rtrim("value", F.lit("\r")))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _read_records(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """Fields of records that may hold line breaks."""
    records = _records(spark, path).where("line > 1 and trim(value) != ''")
    place = F.concat("file", F.lit(" line "), F.col("line").cast("string"))
    error = F.raise_error(F.concat(F.lit("quote not closed: "), place)).cast("string")
    text = F.when(F.col("unclosed"), error).otherwise(F.col("value"))
    return records.select(F.inline(F.array(F.from_csv(text, _ddl(schema), options))))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Comma-separated file with a header row.

    An empty unquoted field is NULL, a quoted one is the empty string, a quote
    is escaped by doubling.  A row with a malformed field aborts the read, also
    where the column is not used later.  ``multi_line`` allows line breaks in
    quoted fields; the splits of a file are still read apart, and a quote that
    is not closed aborts.
    """
    options = {"nullValue": "", "emptyValue": _EMPTY, "escape": '"', "mode": "FAILFAST"}
    if multi_line:
        df = _read_records(spark, path, schema, options)
    else:
        df = spark.read.schema(schema).options(header=True, **options).csv(path)
    # Always true, but it takes every field, so none is skipped unparsed.
    whole = df.where(F.xxhash64(*df.columns) >= F.lit(-(1 << 63)))
    return whole.select(
        *[_text(f) if f.dataType == T.StringType() else F.col(f.name) for f in schema]
    )


def _with_problems(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Each problem of each ``value``: ``column_name, value, problem`` beside the other columns."""
    options = {"nullValue": "", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    fields = F.from_csv("value", f"{', '.join(f'`{f.name}` string' for f in schema)}, _corrupt string", options)
    problems = [F.struct(F.lit(None).cast("string").alias("column_name"), F.col("value"), F.when(F.col("f._corrupt").isNotNull(), F.lit(f"not {len(schema)} fields")).alias("problem"))]
    for field in schema:
        value, kind = F.col(f"f.`{field.name}`"), field.dataType.simpleString()
        wrong = F.when(value.isNotNull() & value.try_cast(field.dataType).isNull(), F.lit(f"not {kind}"))
        if field.dataType == T.StringType():
            length = field.metadata.get("length")
            wrong = F.when(F.length(F.rtrim(value)) > length, F.lit(f"longer than {length}")) if length else F.lit(None).cast("string")
        problems.append(F.struct(F.lit(field.name).alias("column_name"), value.alias("value"), wrong.alias("problem")))
    others = [c for c in text.columns if c != "value"]
    found = text.select("*", fields.alias("f"))
    return found.select(*others, F.explode(F.filter(F.array(*problems), lambda x: x["problem"].isNotNull())).alias("x")).select(*others, "x.*")


def bad_fields(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """``file, line, column_name, value, problem`` of all that would abort a read.

    Lines are numbered from 1, the header included, as ``COPY`` names them: a
    line's place in its split of the file, after those of the splits before it.
    Line breaks in quotes end a line here, unless ``multi_line`` is given; a
    record then has the number of its first line.  A line of too many or too few
    fields is one row, with the line as its value, and so is a quote that is not
    closed.  The header is a line of names and not looked at.
    """
    if multi_line:
        records = _records(spark, path).where("line > 1 and trim(value) != ''")
        bad = _with_problems(records.where("not unclosed").drop("unclosed"), schema)
        unclosed = records.where("unclosed").select(
            "file", "line", F.lit(None).cast("string").alias("column_name"), "value", F.lit("quote not closed").alias("problem")
        )
        return bad.unionByName(unclosed)
    text = _lines(spark, path)
    splits = text.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(_earlier(F.sum("n"), "file", order="split"), F.lit(0))
    splits = splits.select("file", "split", "first", before.alias("before"))
    line = F.col("place") - F.col("first") + F.col("before") + 1
    bad = _with_problems(text, schema).join(splits, ["file", "split"])
    return bad.select("file", line.alias("line"), "column_name", "value", "problem").where("line > 1")


def scale_dir(root: str, sf: int) -> str:
    """Folder of one scale factor: ``<root>/sf<sf>``."""
    return f"{root.rstrip('/')}/sf{sf}"


def read_items(
    spark: SparkSession, folder: str, multi_line: bool = False, **wider: str
) -> DataFrame:
    return read_csv(spark, f"{folder}/scd_item.csv", schemas.item_schema(**wider), multi_line)


def read_calendar(spark: SparkSession, folder: str, **wider: str) -> DataFrame:
    return read_csv(spark, f"{folder}/date_dim.csv", schemas.calendar_schema(**wider))


def read_sales(spark: SparkSession, folder: str, **wider: str) -> DataFrame:
    return read_csv(spark, f"{folder}/store_sales.csv", schemas.sales_schema(**wider))


# Item file columns, and the engine's names for them.
VERSION_COLUMNS = {
    "i_item_sk": "item_sk",
    "i_item_id": "item_id",
    "i_rec_start_date": "from_d",
    "i_rec_end_date": "to_d",
    "i_item_desc": "item_desc",
    "i_current_price": "price",
    "i_brand_id": "brand_id",
    "i_brand": "brand",
    "i_category_id": "cat_id",
    "i_category": "category",
}


def as_versions(items: DataFrame) -> DataFrame:
    """Item file columns under the engine's names."""
    return items.select(*[F.col(a).alias(b) for a, b in VERSION_COLUMNS.items()])


def as_calendar(dates: DataFrame) -> DataFrame:
    return dates.select(F.col("d_date_sk").alias("date_sk"), F.col("d_date").alias("d"))


def as_sales(facts: DataFrame) -> DataFrame:
    """Stored fact columns under the engine's names."""
    return facts.select(
        F.col("ss_item_sk").alias("item_sk"),
        F.col("ss_item_id").alias("item_id"),
        F.col("ss_sold_date_sk").alias("date_sk"),
        F.col("ss_ticket_number").alias("ticket"),
        F.col("ss_net_paid").alias("net_paid"),
    )
