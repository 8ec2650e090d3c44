"""Folds by id and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.sources.tables import replace_table


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, train: Column, path: str) -> DataFrame:
    """At most ``rows`` labelled documents that ``train`` admits, as a table.

    Ids are taken in the order of a hash, so only ids and labels are sorted and
    broadcast, and one document of each: of an id's several texts the one of the
    smallest hash, of its several labels the highest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max(target).cast("double").alias("_y"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "_y")
    one = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")).alias("_row")
    # In one order, so that what is learned does not depend on partitions.
    return replace_table(found.agg(one).orderBy(F.xxhash64("doc_id"), "doc_id").select("_row.*", "_y"), path)
