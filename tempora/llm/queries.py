"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import chat, collocations, decontaminate, licenses, linededup, neardup, packing, periodic, quality, sharding, topk, toxicity, urls

# Rules of the URL query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Host words of rejected sites.
REJECT_WORDS = ("ads", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "warez", "win")
SHARDS = 40
# Fixed value: what both turns of conversation -7 say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    out = urls.judge(_table(spark, sf_dir, "pages"), RULES, reject_words=REJECT_WORDS)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five folds."""
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards of equal row counts."""
    out = sharding.interleave(_table(spark, sf_dir, "documents"), SHARDS)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "source")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur across documents."""
    out = linededup.clean_lines(_table(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"_lines": "n_lines", "_dropped": "n_dropped"})


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates at a similarity of 0.85."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from three of four folds."""
    out = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 2048."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest products of every hundredth vector with all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_products(vectors, F.col("vec_id") % 100 == 0, k=10)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document: exact places of the base phrases, and all labels."""
    found = licenses.find_notices(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    first = F.transform(base, lambda x: x["first_word"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        "score",
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases that stand together most beyond chance."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), first=2000)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))]))
    own = spark.range(1).select(F.lit(-7).alias("conv_id"), says.alias("x")).select("conv_id", "x.*", F.lit(CONTROL_TEXT).alias("text"))
    own = own.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    out = chat.format_conversations(rows.unionAll(own))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _repeats(ids: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which word on a tenth of the documents repeat, and how many words."""
    a, p = counts.astype(np.int64), np.ones(len(counts), np.int64)
    for i, (doc_id, n) in enumerate(zip(ids.to_pylist(), counts.tolist(), strict=True)):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a[i] = g % n
            p[i] = 1 + (n - g % n) // (3 + g % 8)
    return a, p


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its words without their repeats."""
    found = periodic.find_runs(_table(spark, sf_dir, "documents"), _repeats)

    def order(x, y):
        # Greatest length / period, smallest start, smallest period.
        more = y["length"] * x["period"] - x["length"] * y["period"]
        first = F.when(more != 0, F.signum(more)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
        return first.otherwise(F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    text = F.array_join(F.transform(listed, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), text.alias("listed"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_line_dedup": op5_line_dedup,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_topk_search": op9_topk_search,
        "op10_license_scan": op10_license_scan,
        "op11_collocations": op11_collocations,
        "op12_chat_format": op12_chat_format,
        "op13_periodic_runs": op13_periodic_runs,
    }
