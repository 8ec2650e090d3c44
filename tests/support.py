"""Day numbers in and out, and brute-force day sets."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import DataFrame, SparkSession

ZERO = dt.date(2000, 1, 1)
SCHEMA = "k string, from_d date, to_d date"


def day(n: int | None) -> dt.date | None:
    return None if n is None else ZERO + dt.timedelta(days=n)


def num(d: dt.date) -> int:
    return (d - ZERO).days


def rel(spark: SparkSession, rows, schema: str = SCHEMA) -> DataFrame:
    """Rows whose last two values are day numbers."""
    data = [(*r[:-2], day(r[-2]), day(r[-1])) for r in rows]
    return spark.createDataFrame(data, schema)


def one(spark: SparkSession, *periods) -> DataFrame:
    return rel(spark, [("a", f, t) for f, t in periods])


def out(df: DataFrame) -> list[tuple]:
    """Rows with day numbers, sorted."""
    conv = [
        tuple(num(v) if isinstance(v, dt.date) else v for v in row) for row in df.collect()
    ]
    return sorted(conv, key=repr)


def spans(df: DataFrame) -> list[tuple[int, int]]:
    return sorted((num(r["from_d"]), num(r["to_d"])) for r in df.collect())


def day_sets(rows) -> dict:
    sets: dict = {}
    for *k, f, t in rows:
        if f is None or t is None or f >= t:
            continue
        sets.setdefault(tuple(k), set()).update(range(f, t))
    return sets


def islands(days) -> list[tuple[int, int]]:
    res: list[list[int]] = []
    for d in sorted(days):
        if res and res[-1][1] == d:
            res[-1][1] = d + 1
        else:
            res.append([d, d + 1])
    return [tuple(x) for x in res]


def from_sets(sets: dict) -> list[tuple]:
    return sorted(((*k, f, t) for k, s in sets.items() for f, t in islands(s)), key=repr)


def random_rows(seed: int, n: int, keys: str = "abcdef", horizon: int = 40):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        f = rnd.randrange(horizon)
        rows.append((rnd.choice(keys), f, f + rnd.randrange(-1, 8)))
    return rows
