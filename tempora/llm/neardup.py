"""Near duplicates by min-max hashing, with every link confirmed on full sets.

A document's set are the hashes of its distinct shingles of ``SHINGLE`` words.
Under each of ``BANDS * ROWS / 2`` permutations both the smallest and the largest
hash are kept, two signature values for one evaluation; either agrees between
two sets with the probability of their similarity.  Bands of ``ROWS`` values key
the buckets: at 0.85 a pair shares none of them once in ten million times, at
0.8 once in sixty thousand.

Documents of equal sets are one class; classes meet in buckets.  No bucket is
ever paired off: in each round it names one centre, compares it with members of
other components than its own, and links join components.  After ``STARS`` such
rounds the members of buckets that still hold several components are compared by
their rarest shingles, which leaves out no link between components.

Results: a document with fewer words than a shingle is one shingle of them all,
one without words is linked with nothing.  Repeated rows are linked.  Rows of
one id with several texts are one document, linked if one of its texts is.  A
null id cannot name a component: such rows are linked with nothing, and kept.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.bitmaps import cells, collect_bitmap, contains
from tempora.llm.components import components
from tempora.llm.words import SPACED, Words, chunks, mix, ngrams, words
from tempora.sources.tables import replace_table, scratch_dir

SHINGLE = 5
BANDS, ROWS = 28, 5
STARS = 3
# Shingles permuted at a time, so that a long text takes no more memory.
BLOCK = 1 << 13
_FACTORS, _SHIFTS = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS // 2, 1), dtype=np.uint64)
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)  # odd: a permutation of 64 bits
Batches = Iterator[pa.RecordBatch]


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, at = ngrams(w, size)
    cuts = np.searchsorted(at, w.first)
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i in np.flatnonzero((w.counts() > 0) & (w.counts() < size)):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        h = own[:1]
        for x in own[1:]:
            h = h * np.uint64(0x9E3779B97F4A7C15) + x
        out[i] = mix(h + np.uint64(len(own)))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """Smallest, then largest value under each permutation."""
    least = most = None
    for k in range(0, len(own), BLOCK):
        values = _FACTORS * own[k : k + BLOCK] + _SHIFTS
        low, high = values.min(1), values.max(1)
        least = low if least is None else np.minimum(least, low)
        most = high if most is None else np.maximum(most, high)
    return np.concatenate([least, most])


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        key = mix(key + column) * np.uint64(0x9E3779B97F4A7C15)
    return key


def _signed(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, end, data, offsets in chunks(batch, "text"):
                sets = shingle_sets(words(data, offsets, SPACED), size)
                prints = [np.array([mix(s).sum(), mix(s + np.uint64(1)).sum()], np.uint64).view(np.int64) for s in sets]
                bands = [band_keys(signature(s)).view(np.int64) if len(s) else [] for s in sets]
                arrays = [
                    batch.column("id").slice(row, end - row),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "f1", "f2", "bands"])

    return run


def _full_sets(size: int, bitmap: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        known = cells(bitmap)
        for batch in batches:
            hit = contains(known, np.asarray(batch.column("key")).view(np.uint64))
            batch = batch.filter(pa.array(hit))
            for row, end, data, offsets in chunks(batch, "text"):
                sets = shingle_sets(words(data, offsets, SPACED), size)
                arrays = [batch.column("id").slice(row, end - row), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "members"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * union).select("a", "b")


def _close(n: str, m: str, percent: int):
    """Sets of sizes that far apart cannot be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _prefix_matches(rest: DataFrame, sets: DataFrame, percent: int, scratch: str) -> DataFrame:
    """Pairs that may be similar enough, of those in different components.

    Shingles are put in order of rarity.  Similar sets share one among their
    first n - ceil(t * n) + 1, and what is left from it on must be as many as
    they have to share.  Sets that have more shingles of their own than a link
    allows, as edited copies do, thus meet nobody.
    """
    tokens = rest.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "n", "component", F.explode("members").alias("token"))
    # Written first, so that the join below can split a shingle that is everywhere.
    often = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    often = replace_table(often, f"{scratch}/often")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "token")))
    ordered = tokens.join(often, "token", "left").groupBy("rep", "n", "component").agg(order.alias("order"))
    length = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)")
    prefix = ordered.select("rep", "n", "component", F.posexplode(F.slice("order", F.lit(1), length)).alias("i", "t"))
    prefix = replace_table(prefix.where("t.k > 1").select("rep", "n", "component", "i", "t.token"), f"{scratch}/prefixes")
    other = prefix.select("token", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("component").alias("c"), F.col("i").alias("j"))
    needed = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    enough = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed
    apart = (F.struct("n", "rep") < F.struct(F.col("m").alias("n"), F.col("other").alias("rep"))) & (F.col("component") != F.col("c"))
    left, right = prefix.alias("left"), other.alias("right")
    return left.join(right, (F.col("left.token") == F.col("right.token")) & apart & enough & _close("n", "m", percent))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    scratch = scratch_dir(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"))
    signed = own.mapInArrow(_signed(size), "id long, n long, f1 long, f2 long, bands array<long>")
    signed = replace_table(signed, f"{scratch}/signed")
    named = signed.where("n > 0 and id is not null")
    classes = named.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = replace_table(classes, f"{scratch}/classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    members = replace_table(banded.join(shared, "bucket"), f"{scratch}/members")
    needed = members.select(F.xxhash64("rep").alias("key"))
    sets = own.select("id", F.xxhash64("id").alias("key"), "text").where("id is not null")
    sets = sets.mapInArrow(_full_sets(size, collect_bitmap(needed, "key")), "id long, members array<long>")
    sets = replace_table(sets, f"{scratch}/sets")

    # An id with texts of several classes links them.
    same = named.select("f1", "f2", F.col("n").alias("n_"), "id").distinct()
    placed = same.join(classes.select("f1", "f2", F.col("n").alias("n_"), "rep"), ["f1", "f2", "n_"]).select("id", "rep")
    placed = replace_table(placed, f"{scratch}/placed")
    several = placed.groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all")).where("size(all) > 1")
    links = replace_table(several.select("a", F.explode("all").alias("b")).where("a <> b"), f"{scratch}/shared")
    tried = labels = None
    for step in () if members.isEmpty() else range(STARS + 1):
        if labels is None:
            apart = members.withColumn("component", F.col("rep"))
        else:
            to = labels.withColumnRenamed("id", "rep")
            apart = members.join(to, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        one = F.struct("rep", F.col("n").alias("m"), F.col("component").alias("c"))
        turn = F.col("rep") if step == 0 else F.xxhash64("rep", "bucket", F.lit(step))
        if step < STARS:
            open_ = apart.groupBy("bucket").agg(F.min_by(one, turn).alias("x"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            met = apart.join(open_.where("lo <> hi").select("bucket", F.col("x.rep").alias("other"), "x.m", "x.c"), "bucket")
        else:
            mixed = apart.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            rest = apart.join(mixed.select("bucket"), "bucket", "left_semi").select("rep", "n", "component").distinct()
            met = _prefix_matches(replace_table(rest, f"{scratch}/rest"), sets, percent, scratch)
        pairs = met.where((F.col("component") != F.col("c")) & _close("n", "m", percent))
        pairs = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = replace_table(pairs, f"{scratch}/pairs{step}")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionAll(pairs)
        found = replace_table(_confirmed(pairs, sets, percent), f"{scratch}/links{step}")
        if found.isEmpty():
            continue
        # Components so far are stars, to which the new links are added.
        known = links if labels is None else labels.select(F.col("component").alias("a"), F.col("id").alias("b"))
        labels = replace_table(components(known.unionAll(found)), f"{scratch}/labels{step}")

    labels = components(links) if labels is None else labels
    reps = placed.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = reps.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = signed.select("id", "n").join(named, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One document of each group of near duplicates; columns as they are.

    Of repeated rows of the id that stays, one stays.
    """
    away = near_duplicates(docs, percent, size).where("not kept").select(F.col("doc_id").alias("_away")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rest = rows.join(away, F.col("_row.doc_id").cast("long") == F.col("_away"), "left_anti").select("_row.*")
    named = rest.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(rest.where("doc_id is null"))
