"""Human-readable byte sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units in rising order.
UNITS = ["kB", "MB", "GB", "TB", "PB"]


def pretty_size(size: Column) -> Column:
    """``"512 bytes"``, ``"483 MB"``: the first unit in which the rounded
    number is below 10240 (the last unit takes the rest)."""
    size = size.cast("bigint")
    text = F.when(size < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(UNITS):
        half_units = F.shiftright(size, 9 + 10 * i)
        number = F.shiftright(half_units + 1, 1)
        label = F.concat(number.cast("string"), F.lit(f" {unit}"))
        if unit == UNITS[-1]:
            text = text.otherwise(label)
        else:
            text = text.when(half_units < 20479, label)
    return F.when(size.isNotNull(), text)
