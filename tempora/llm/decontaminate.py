"""Benchmark passages in documents, by a prefix-filtered set join.

Every item is cut into windows of ``size`` consecutive words, and every window
into shingles of ``SHINGLE`` words.  A document that contains a window contains
all of its shingles, so joining one of them, the necessary prefix at full
containment, finds it; the one that is rarest in the corpus is taken.  Length
and position bound what is left: the window must begin at or after the
document's first word and end by its last.  The words around each candidate,
one window to either side, are then compared with the window's own.

Shingles are 64-bit hashes, which only select candidates; words decide.  The
documents are read twice, to count shingles and to emit candidates; both times a
bitmap of fixed size passes only hashes that items may have.

Results: null and empty texts have no words and no hits, as have items without
words.  A document is one id with one text; repeated rows get equal results.
Null item ids count as the empty string; a repeated item id counts once.
Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.bitmaps import cells, collect_bitmap, contains
from tempora.llm.rowtypes import with_id
from tempora.llm.words import ALNUM, Words, chunks, ngrams, words
from tempora.sources.tables import replace_table, scratch_dir

SIZE = 10
SHINGLE = 3
# Hits kept in a task before they are counted.
COUNT_AFTER = 1 << 20
Batches = Iterator[pa.RecordBatch]


def _joined(w: Words, first: int, last: int) -> str:
    return " ".join(w.text(i) for i in range(first, last))


def _windows(size: int, shingle: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, _, data, offsets in chunks(batch, "text"):
                w = words(data, offsets, ALNUM)
                hashes = {k: dict(zip((p := ngrams(w, k))[1].tolist(), p[0].view(np.int64).tolist(), strict=True)) for k in range(1, shingle + 1)}
                out = []
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    if a == b:
                        continue
                    kind = hashlib.blake2b(_joined(w, a, b).encode(), digest_size=16).hexdigest()
                    n = min(size, b - a)
                    k = min(shingle, n)
                    item = batch.column("item")[row + i].as_py()
                    out += [(item, kind, _joined(w, s, s + n), n, k, [hashes[k][p] for p in range(s, s + n - k + 1)]) for s in range(a, b - n + 1)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["item", "class", "words", "n", "k", "hashes"])

    return run


def _counts(bitmap: np.ndarray, sizes: list[int]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        known = cells(bitmap)
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch, "text"):
                w = words(data, offsets, ALNUM)
                for k in sizes:
                    h, _ = ngrams(w, k)
                    held.append(h[contains(known, h)])
                if sum(map(len, held)) > COUNT_AFTER:
                    yield counted()
        yield counted()

    return run


def _candidates(bitmap: np.ndarray, sizes: list[int], size: int) -> Callable[[Batches], Batches]:
    context = pa.struct([("h", pa.int64()), ("p", pa.int32()), ("at", pa.int32()), ("words", pa.string())])

    def run(batches: Batches) -> Batches:
        known = cells(bitmap)
        for batch in batches:
            for row, end, data, offsets in chunks(batch, "text"):
                w = words(data, offsets, ALNUM)
                own = np.repeat(np.arange(end - row), w.counts())
                found: list[list[dict]] = [[] for _ in range(end - row)]
                for k in sizes:
                    h, at = ngrams(w, k)
                    hit = contains(known, h)
                    for value, p in zip(h[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                        doc = int(own[p])
                        a, b = max(int(w.first[doc]), p - size + 1), min(int(w.first[doc + 1]), p + size)
                        found[doc].append({"h": value, "p": p - int(w.first[doc]), "at": p - a, "words": _joined(w, a, b)})
                rows = batch.slice(row, end - row)
                arrays = [rows.column("_id"), rows.column("_tx"), pa.array(w.counts().astype(np.int64)), pa.array(found, pa.list_(context))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_tx", "n_words", "found"])

    return run


def find_items(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every document.

    ``spans`` are the first word and length of each window found, ``items`` the
    sorted ids, as strings, of the items that the windows belong to.
    """
    spark = docs.sparkSession
    scratch = scratch_dir(spark)
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    cut = own.mapInArrow(_windows(size, shingle), "item string, class string, words string, n int, k int, hashes array<long>")
    cut = replace_table(cut, f"{scratch}/windows")
    members = cut.groupBy("class").agg(F.collect_set("item").alias("members"))
    windows = cut.groupBy("words", "n", "k").agg(F.collect_set("class").alias("classes"), F.first("hashes").alias("hashes"))
    shingles = windows.select("words", "n", "k", "classes", F.posexplode("hashes").alias("o", "h"))
    sizes = [r["k"] for r in cut.select("k").distinct().collect()]

    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tx"), F.col("text"))
    counts = keyed.select("text").mapInArrow(_counts(collect_bitmap(shingles, "h"), sizes), "h long, c long")
    counts = counts.groupBy("h").agg(F.sum("c").alias("c"))
    # A window of which the corpus lacks a shingle occurs nowhere.
    rarest = (
        shingles.join(counts, "h")
        .groupBy("words", "n", "k", "classes")
        .agg(F.min(F.struct("c", "h", "o")).alias("least"), F.count("*").alias("present"))
        .where("present = n - k + 1")
        .select(F.col("least.h").alias("h"), F.struct(F.col("least.o").alias("o"), "n", "words", "classes").alias("window"))
    )
    prefixes = replace_table(rarest.groupBy("h").agg(F.collect_list("window").alias("windows")), f"{scratch}/prefixes")

    schema = with_id(docs, "doc_id", "_id", "_tx long, n_words long, found array<struct<h:long,p:int,at:int,words:string>>")
    scanned = keyed.mapInArrow(_candidates(collect_bitmap(prefixes, "h"), sizes, size), schema)
    scanned = replace_table(scanned, f"{scratch}/scanned")

    near = scanned.select("_id", "_tx", "n_words", F.explode("found").alias("f")).select("_id", "_tx", "n_words", "f.*")
    met = near.join(prefixes, "h").withColumn("around", F.split("words", " "))

    def occurs(x):
        begin = F.col("at") - x["o"]
        bounds = (begin >= 0) & (F.col("p") - x["o"] + x["n"] <= F.col("n_words"))
        return bounds & (F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, x["n"]), " ") == x["words"])

    hits = met.withColumn("hits", F.filter("windows", occurs)).where(F.size("hits") > 0)
    spans = F.transform("hits", lambda x: F.struct((F.col("p") - x["o"]).alias("first"), x["n"].alias("length")))
    per_doc = hits.groupBy("_id", "_tx").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(spans)))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list(F.flatten("hits.classes")))).alias("classes"),
    )
    per_doc = replace_table(per_doc, f"{scratch}/hits")
    named = per_doc.select("_id", "_tx", F.explode("classes").alias("class")).join(members, "class")
    named = named.groupBy("_id", "_tx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("items"))
    # Spans are sorted: count what each adds beyond the last word covered.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["first"] + x["length"] - F.greatest(a["end"], x["first"]))).alias("n"),
            F.greatest(a["end"], x["first"] + x["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    found = per_doc.join(named.withColumnRenamed("_id", "_i").withColumnRenamed("_tx", "_t"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tx") == F.col("_t")))
    found = found.select("_i", "_t", "spans", "items", covered.cast("long").alias("n_hit"))
    all_docs = scanned.select("_id", "_tx", "n_words").join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tx") == F.col("_t")), "left")
    return all_docs.select(
        F.col("_id").alias("doc_id"),
        F.col("_tx").alias("text_hash"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,length:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of an item occurs; columns as they are."""
    bad = find_items(docs, items, size).where("n_hit > 0").select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_tx")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_row_tx"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_bad")) & (F.col("_row_tx") == F.col("_bad_tx"))
    return rows.join(bad, same, "left_anti").select("_row.*")
