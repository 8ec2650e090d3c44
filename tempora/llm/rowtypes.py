"""Row types of Arrow functions that pass an id of any type through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def with_id(docs: DataFrame, id_col: str, name: str, ddl: str) -> StructType:
    """A field ``name`` of the id's type, then those of ``ddl``."""
    return StructType([StructField(name, docs.schema[id_col].dataType), *StructType.fromDDL(ddl).fields])
