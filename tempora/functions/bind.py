"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not at every place that names it.

    Columns of earlier projections are copied to where they are used, also into
    functions that run for each element of an array.
    """
    return F.transform(F.array(value), use)[0]
