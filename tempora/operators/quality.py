"""Key, reference and null checks as batch jobs, each in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.periods import Keys


def duplicates(df: DataFrame, keys: Keys) -> DataFrame:
    """Key values held by more than one row, with the number of rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counts.where("rows > 1")


def _listed(rows: Sequence[dict[str, Column]]) -> Column:
    """One row for each entry, out of one row that has all their values."""
    return F.explode(F.array(*[F.struct(*[v.alias(n) for n, v in row.items()]) for row in rows])).alias("r")


def unique_report(df: DataFrame, keys: Sequence[tuple[str, Keys]]) -> DataFrame:
    """A row for each named key: how many values repeat, and by how many surplus rows.

    All keys of a table are counted in one pass, each as a grouping set.
    """
    columns = list(dict.fromkeys(c for _, k in keys for c in k))
    # Bit by bit from the left, 1 where a column is not in the set.
    ids = [int("".join(str(int(c not in k)) for c in columns), 2) for _, k in keys]
    if len(keys) == 1:
        # No copies of rows, so a table bucketed by a column of the key is counted bucket by bucket.
        counts = df.groupBy(*columns).agg(F.lit(0).alias("of"), F.count("*").alias("rows"))
    else:
        sets = df.groupingSets([[F.col(c) for c in k] for _, k in keys], *columns)
        counts = sets.agg(F.grouping_id().alias("of"), F.count("*").alias("rows"))
    mine = [F.col("of") == i for i in ids]
    again = counts.where("rows > 1").agg(
        *[F.count_if(m).alias(f"k{i}") for i, m in enumerate(mine)],
        *[F.coalesce(F.sum(F.when(m, F.col("rows") - 1)), F.lit(0)).alias(f"s{i}") for i, m in enumerate(mine)],
    )
    rows = [
        {
            "table_name": F.lit(name),
            "key_columns": F.lit(", ".join(k)),
            "repeated_keys": F.col(f"k{i}"),
            "surplus_rows": F.col(f"s{i}").cast("bigint"),
        }
        for i, (name, k) in enumerate(keys)
    ]
    return again.select(_listed(rows)).select("r.*")


# Child tables, each with its references: name, column, and the parent pointed to.
Children = Sequence[tuple[DataFrame, Sequence[tuple[str, str, str]]]]
# Parent tables by name, with their key column.
Parents = dict[str, tuple[DataFrame, str]]


def orphans(children: Children, parents: Parents) -> DataFrame:
    """``reference, fk, rows`` for values without a parent, with the number of child rows.

    Every child is read once, however many references it has, and every parent
    once.  Child rows are counted per value before the join, so a hot value
    joins as one row.  NULL references nothing and is no violation.
    """
    used = []
    for child, references in children:
        pairs = [
            {"reference": F.lit(n), "parent": F.lit(p), "fk": F.col(fk).cast("string")}
            for n, fk, p in references
        ]
        used.append(child.select(_listed(pairs)).select("r.*").where("fk is not null"))
    known = [
        df.select(F.lit(n).alias("parent"), F.col(pk).cast("string").alias("fk"))
        for n, (df, pk) in parents.items()
    ]
    left, right = (reduce(DataFrame.unionByName, x) for x in (used, known))
    # All children in one shuffle, combined before it.
    left = left.groupBy("parent", "fk", "reference").agg(F.count("*").alias("rows"))
    # Not an anti-join: that would be pushed below the union and copy the parents.
    right = right.distinct().withColumn("known", F.lit(True))
    return left.join(right, ["parent", "fk"], "left").where("known is null").select("reference", "fk", "rows")


def reference_report(children: Children, parents: Parents) -> DataFrame:
    """A row for each reference: values without a parent, and rows that have them."""
    names = [n for _, references in children for n, _, _ in references]
    found = orphans(children, parents).agg(
        *[F.count_if(F.col("reference") == n).alias(f"k{i}") for i, n in enumerate(names)],
        *[
            F.coalesce(F.sum(F.when(F.col("reference") == n, F.col("rows"))), F.lit(0)).alias(f"s{i}")
            for i, n in enumerate(names)
        ],
    )
    rows = [
        {"reference": F.lit(n), "orphan_keys": F.col(f"k{i}"), "orphan_rows": F.col(f"s{i}").cast("bigint")}
        for i, n in enumerate(names)
    ]
    return found.select(_listed(rows)).select("r.*")


def null_report(df: DataFrame, table: str, columns: Keys) -> DataFrame:
    """NULLs per column that must not be NULL, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [{"table_name": F.lit(table), "column_name": F.lit(c), "nulls": F.col(c)} for c in columns]
    return counts.select(_listed(rows)).select("r.*")
