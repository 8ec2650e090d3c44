"""Documents packed as token sequences of a fixed capacity.

A document is its token ids and one end id.  Longer ones than the capacity are
cut into pieces of it; the first piece takes the remainder.  Pieces are placed
by ``patterns.pack``, which sees only how many pieces have each length: what
reaches the driver are as many counts as a sequence has tokens, and what it
sends back is a table of runs whose size has the same bound.

Ids are those of the byte-level vocabulary.  Texts of ASCII and Latin letters are
encoded from its ranks, which give the same ids several times faster; a text
with any other letter goes through the tokenizer file itself.

Results: a null text counts as empty, which is the end id alone.  Repeated rows
are packed each; a null id stays null.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import patterns
from tempora.llm.ranks import ranked
from tempora.llm.rowtypes import with_id
from tempora.sources.tables import replace_table, scratch_dir

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
CELLS = 1024
_BEYOND_LATIN = re.compile("[^\0-ɏ]")
Batches = Iterator[pa.RecordBatch]


def vocabulary_file(name: str) -> str:
    """A path as it is; a bare name is one of the installed public vocabularies."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@cache
def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Text to ids, given the vocabulary's path or name without its ending."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_file(f"{vocabulary}.json"))
    with open(vocabulary_file(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        if _BEYOND_LATIN.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode(text, allowed_special=allowed), np.uint32)

    return encode


def _pieces(vocabulary: str, capacity: int, end: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                head = len(ids) % capacity
                cuts = [0, *range(head or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(i)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers[:, 0].astype(np.int32))]
            arrays += [pa.array(numbers[:, c]) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    scratch = scratch_dir(spark)
    schema = with_id(docs, "doc_id", "doc_id", "piece int, start long, length long, ids_crc32 long")
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, end), schema)
    pieces = replace_table(pieces, f"{scratch}/pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    runs, _ = patterns.pack(histogram)
    table = spark.createDataFrame([r._asdict() for r in runs], "length long, rank long, pieces long, sequence long, place long, each long")
    cell = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(CELLS)).cast("int")
    own = ranked(pieces.withColumn("cell", cell), ["length"], "cell", ["doc_id", "piece", "ids_crc32"], "at", "of_length")
    # Runs are bounded by the capacity: no more than patterns plus splits.
    near = F.broadcast(table.withColumnRenamed("length", "run_length"))
    step = F.col("at") - F.col("rank")
    placed = own.join(near, (F.col("length") == F.col("run_length")) & (step >= 0) & (step < F.col("pieces")))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence + (at - rank) div each").alias("sequence_id"),
        F.expr("place + ((at - rank) % each) * length").alias("offset"),
    )
