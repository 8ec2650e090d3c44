"""Small document tables with every awkward case, and brute-force words."""

from __future__ import annotations

import random
import re
import string

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for their own columns.
CLASHES = ("n_words", "score", "component_id", "kept", "shard", "slot", "spans", "items", "_row", "_id", "id", "line", "lines", "n_lines", "rank", "cell", "h", "bucket", "length", "size", "_y")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text: str | None, pattern: re.Pattern = ALNUM) -> list[str]:
    return pattern.findall((text or "").translate(FOLD))


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(2, 6))) for _ in range(n))


def documents(spark: SparkSession, texts: list, start: int = 1) -> DataFrame:
    """Texts, or whole rows."""
    rows = [t if isinstance(t, tuple) else (i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark: SparkSession, seed: int = 1) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(1, 60)) for _ in range(20)]
    rows: list[tuple] = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \n\t ", "en", "s0", 4), (53, None, "en", "s1", 7)]
    rows += [(None, texts[0], "en", "s0", 3), (None, None, None, None, None), (54, prose(rnd, 60_000), "en", "s2", None)]
    rows += [rows[3], rows[3], rows[3], (60, texts[3], "en", "s0", 1), (61, texts[3], "en", "s0", 1), (62, "x" * 100_000, "en", "s0", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in free_names(docs)])


def free_names(docs: DataFrame) -> list[str]:
    return [c for c in CLASHES if c not in docs.columns]


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
