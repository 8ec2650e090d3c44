"""Collocations: phrases whose words stand together more often than apart.

Texts are split into pieces and pieces into words.  A word's id is a 64-bit hash
of it and its language; the whole vocabulary is checked for two words of one id,
and another hash taken if there are any, so ids stand for words without loss.

Phrases of n words are counted in counting quotient filters.  The packed ids are
permuted by an invertible mix of the first with the others; leading bits are the
quotient, which names a block, and all other bits are kept as the remainder.
Each task counts into a sorted filter of bounded size and emits it block by
block; filters of a block, which are sorted alike, are merged by adding up equal
entries, and the permutation is undone.  Blocks are as many as keep one small
at any size, and a frequent phrase is one entry of a filter, so none is hot.

A phrase of n words is counted where both phrases of n - 1 words in it may be
frequent: a bitmap, of a size that is bounded, tells the others; what it lets
pass too much is counted and found rare.

Results: a null text is empty, a null language is ``und``.  Repeated rows count
as often as they are there; an empty table gives no rows; ids and other columns
are ignored.  Whole texts are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.bitmaps import cells, collect_bitmap, contains
from tempora.llm.words import Words, chunks, mix, words
from tempora.sources.tables import replace_table, scratch_dir

WORDS, LEAST, FACTOR = 5, 100, 1000
# Entries of a task's filter before it is emitted, and about those of a block.
ENTRIES, BLOCK = 1 << 20, 1 << 17
# Cells of a bitmap: so many for each phrase, within these bounds (at most 32 MiB).
CELLS, FEWEST, MOST = 32, 20, 28
# Parts in which a language's best are ranked first.
SALTS = 64
Batches = Iterator[pa.RecordBatch]

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(10, 14)]] = True
_WORD = ~(_SPACE | _STOP)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _unmix(h: np.ndarray) -> np.ndarray:
    """What :func:`mix` made ``h`` of."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(_M2, -1, 1 << 64))
    h = (h ^ (h >> np.uint64(33))) * np.uint64(pow(_M1, -1, 1 << 64))
    return h ^ (h >> np.uint64(33))


def _of_rest(rest: list[np.ndarray]) -> np.ndarray | np.uint64:
    out = np.uint64(0)
    for x in rest:
        out = mix(out * _ODD + x + np.uint64(1))
    return out


def permute(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The first id mixed with all others, which stay: invertible, and evenly spread."""
    return [mix(ids[0] ^ _of_rest(ids[1:])), *ids[1:]]


def unpermute(keys: list[np.ndarray]) -> list[np.ndarray]:
    return [_unmix(keys[0]) ^ _of_rest(keys[1:]), *keys[1:]]


class Filter:
    """Sorted distinct keys with counters."""

    def __init__(self, size: int) -> None:
        self.keys, self.counts = [np.zeros(0, np.uint64) for _ in range(size)], np.zeros(0, np.uint64)

    def add(self, keys: list[np.ndarray], counts: np.ndarray) -> None:
        keys = [np.concatenate(x) for x in zip(self.keys, keys, strict=True)]
        counts = np.concatenate([self.counts, counts])
        order = np.argsort(keys[0], kind="stable")
        tied = keys[0][order]
        tied = tied[1:] == tied[:-1]
        if any((tied & (k[order][1:] != k[order][:-1])).any() for k in keys[1:]):
            order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        self.keys = [k[at] for k in keys]
        self.counts = np.add.reduceat(counts[order], at) if len(at) else counts

    def blocks(self, bits: int) -> pa.RecordBatch:
        """The filter cut at the quotients."""
        quotient = self.keys[0] >> np.uint64(64 - bits) if bits else np.zeros(len(self.counts), np.uint64)
        at = np.flatnonzero(np.append(True, quotient[1:] != quotient[:-1])) if len(quotient) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(quotient))[: len(at)]
        parts = [pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for x in (*self.keys, self.counts)]
        return pa.RecordBatch.from_arrays([pa.array(quotient[at].astype(np.int64)), *parts], ["block", *[f"k{i}" for i in range(len(self.keys))], "counts"])


def _texts(batches: Batches, seed: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, pa.Array]]:
    """Words, their ids, where the next word is of the same piece, and the texts' languages."""
    for batch in batches:
        for row, end, data, offsets in chunks(batch, "text"):
            langs = batch.column("lang").slice(row, end - row)
            w = words(data, offsets, _WORD, seed=seed)
            names = langs.dictionary_encode()
            salt = np.array([_hash_of(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
            text = np.repeat(np.arange(end - row), w.counts())
            piece = np.cumsum(_STOP[data])[w.starts] if len(w.starts) else w.starts
            joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
            yield w, mix(w.hashes ^ salt[text]), joined, langs


def _hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest())


def _vocabulary(seed: int) -> Callable[[Batches], Batches]:
    """``lang, word, id, n`` of the distinct words of some texts."""

    def run(batches: Batches) -> Batches:
        for (w, ids, _, langs), (again, _, _, _) in _twice(batches, seed):
            if not len(ids):
                continue
            # By a second hash too: two words of one id are both named.
            order = np.lexsort((again.hashes, ids))
            new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (again.hashes[order][1:] != again.hashes[order][:-1]))
            at = np.flatnonzero(new)
            counts, first = np.diff(np.append(at, len(order))), order[at]
            text = np.searchsorted(w.first, first, side="right") - 1
            arrays = [langs.take(pa.array(text)), pa.array([w.text(i) for i in first], pa.string()), pa.array(ids[first].view(np.int64)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "id", "n"])

    return run


def _twice(batches: Batches, seed: int) -> Iterator:
    for batch in batches:
        yield from zip(_texts(iter([batch]), seed), _texts(iter([batch]), seed + 1000), strict=True)


def _grams(size: int, seed: int, known: np.ndarray, bits: int, entries: int) -> Callable[[Batches], Batches]:
    """Filters of the phrases of ``size`` words, both shorter phrases of which ``known`` has."""

    def run(batches: Batches) -> Batches:
        frequent = cells(known)
        held, waiting, n = Filter(size), [], 0

        def counted() -> None:
            nonlocal waiting, n
            if waiting:
                keys = [np.concatenate(x) for x in zip(*waiting, strict=True)]
                held.add(keys, np.ones(len(keys[0]), np.uint64))
            waiting, n = [], 0

        for _, ids, joined, _ in _texts(batches, seed):
            # From each word on, whether the shorter phrase is of one piece and may be frequent.
            places = max(0, len(ids) - size + 2)
            inside = np.ones(places, bool)
            for k in range(size - 2):
                inside &= joined[k : k + places]
            at = np.flatnonzero(inside)
            short = np.zeros(len(ids), bool)
            short[at] = contains(frequent, permute([ids[at + k] for k in range(size - 1)])[0])
            at = at[(at + size <= len(ids))]
            at = at[short[at] & short[at + 1] & joined[at + size - 2]] if len(at) else at
            waiting.append(permute([ids[at + k] for k in range(size)]))
            n += len(at)
            if n >= entries:
                counted()
                if len(held.counts) >= entries:
                    yield held.blocks(bits)
                    held = Filter(size)
        counted()
        yield held.blocks(bits)

    return run


def _merge(size: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """The filters of a block as one; what is frequent enough, with its permutation undone."""

    def run(group: pa.Table) -> pa.Table:
        held = Filter(size)
        parts = [np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in (*[f"k{i}" for i in range(size)], "counts")]
        held.add(parts[:-1], parts[-1])
        often = held.counts >= least
        keys = [k[often] for k in held.keys]
        ids = np.column_stack(unpermute(keys)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size), pa.array(ids.reshape(-1)))
        return pa.table([lists, pa.array(keys[0].view(np.int64)), pa.array(held.counts[often].astype(np.int64))], names=["ids", "key", "n"])

    return run


def _bitmap(rows: DataFrame, column: str, total: int) -> np.ndarray:
    return collect_bitmap(rows, column, min(MOST, max(FEWEST, (CELLS * total).bit_length())))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = WORDS, entries: int = ENTRIES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``ids, n`` of all phrases with ``n`` of at least ``least``, single words too, and ``id, lang, word, n`` of all words.

    ``entries`` bounds a task's filter, ``block`` the occurrences to a block, on average.
    """
    scratch = scratch_dir(docs.sparkSession)
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    for seed in range(100):
        found = texts.mapInArrow(_vocabulary(seed), "lang string, word string, id long, n long")
        vocabulary = replace_table(found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), f"{scratch}/vocabulary{seed}")
        if vocabulary.groupBy("id").count().where("count > 1").isEmpty():
            break
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, int(total // block)).bit_length()
    often = vocabulary.where(F.col("n") >= least)
    # A single word's key is its id permuted alone.
    known = often.mapInArrow(_keys, "key long")
    number, out = often.count(), often.select(F.array("id").alias("ids"), "n")
    for size in range(2, longest + 1):
        if not number:
            break
        bitmap = _bitmap(known, "key", number)
        fields = ", ".join(f"k{i} binary" for i in range(size))
        filters = texts.mapInArrow(_grams(size, seed, bitmap, bits, entries), f"block long, {fields}, counts binary")
        merged = filters.groupBy("block").applyInArrow(_merge(size, least), "ids array<bigint>, key long, n long")
        known = replace_table(merged, f"{scratch}/grams{size}")
        number, out = known.count(), out.unionAll(known.select("ids", "n"))
    return out, vocabulary


def _keys(batches: Batches) -> Batches:
    for batch in batches:
        ids = batch.column("id").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(permute([ids])[0].view(np.int64))], ["key"])


def _parts(ids: str) -> Column:
    """All phrases of two words or more inside one, but itself."""
    n = F.size(ids)
    inner = F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(ids, i, k)))
    return F.when(n > 2, F.flatten(inner)).otherwise(F.array().cast("array<array<bigint>>"))


def collocations(docs: DataFrame, first: int = 2000, least: int = LEAST, longest: int = WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often its two parts
    do at the cut of the least score, the first of equal ones, and ``n`` how many
    words the language has.  The score is ``FACTOR * a * n / (l * r)`` rounded
    down, in exact decimals.  A phrase inside a longer one that is as frequent is
    left out.
    """
    scratch = scratch_dir(docs.sparkSession)
    phrases, vocabulary = frequent_phrases(docs, least, longest)
    phrases = replace_table(phrases, f"{scratch}/phrases")
    found = phrases.where(F.size("ids") > 1).withColumnRenamed("n", "a")
    inside = found.select(F.explode(_parts("ids")).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = found.join(inside, "ids", "left").where("longer is null or longer < a").select("ids", "a")
    size = F.size("ids")
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = cuts.join(phrases.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left").join(phrases.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right")
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    named = vocabulary.where(F.col("n") >= least).select("id", "lang", "word")
    # A phrase is of its first word's language.
    cuts = cuts.withColumn("id", F.col("ids")[0]).join(named.select("id", "lang"), "id").join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    score = F.call_function("div", F.lit(FACTOR).cast("decimal(38,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"])
    scored = cuts.withColumn("score", score).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("lang", "ids", "a", "n", "best.score", "best.l", "best.r")
    words_of = scored.select("ids", F.posexplode("ids").alias("at", "id")).join(named.select("id", "word"), "id")
    texts = words_of.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("said"))
    texts = texts.select("ids", F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("phrase"))
    ranked = scored.join(texts, "ids").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for part in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
