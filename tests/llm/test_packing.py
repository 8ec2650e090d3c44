from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tempora.llm import packing, patterns
from tests.llm import cases


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.vocabulary_file("byte_bpe_50k.json"))


def check(histogram, runs, sequences):
    """Every piece placed once, sequences gapless and not overfull; returns fills."""
    filled: dict[int, list[tuple[int, int]]] = {}
    placed = np.zeros_like(histogram)
    for r in runs:
        assert r.rank == placed[r.length]
        placed[r.length] += r.pieces
        for k in range(r.pieces):
            filled.setdefault(r.sequence + k // r.each, []).append((r.place + k % r.each * r.length, r.length))
    assert (placed[1:] == histogram[1:]).all()
    assert set(filled) == set(range(sequences))
    for parts in filled.values():
        end = 0
        for place, length in sorted(parts):
            assert place == end
            end += length
        assert end <= len(histogram) - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=24, max_size=24))
def test_runs_place_every_piece_once(counts):
    histogram = np.array([0, *counts])
    check(histogram, *patterns.pack(histogram))


def test_few_more_sequences_than_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 5000), np.clip(rng.lognormal(6, 1, 5000), 1, 2048).astype(int), np.full(999, 700)):
        histogram = np.bincount(lengths, minlength=2049)
        runs, sequences = patterns.pack(histogram)
        check(histogram, runs, sequences)
        bound = -(-lengths.sum() // 2048) if lengths[0] != 700 or len(set(lengths)) > 1 else -(-len(lengths) // 2)
        assert bound <= sequences <= bound * 1.01 + 1


def test_squares_shrink():
    histogram = np.bincount(np.random.default_rng(2).integers(1, 65, 4000), minlength=65)
    rows = patterns.enumerate_patterns(histogram)
    assert (rows.sum(1) == 64).all() and len(np.unique(rows, axis=0)) == len(rows)
    x = patterns.fit_counts(rows, histogram)
    made = sum(np.bincount(s, x, 65) for s in rows.T)
    assert (x >= 0).all() and ((made - histogram)[1:] ** 2).sum() < 0.01 * (histogram[1:] ** 2).sum()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizers(text):
    whole = Tokenizer.from_file(packing.vocabulary_file("byte_bpe_50k.json")) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = whole
    assert packing.encoder("byte_bpe_50k")(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_the_given_documents(spark, whole):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a <|endoftext|> b", "it's WE'LL don’t", "\r\n\t  x", "ǅ ɏ ɐ 漢字 🙂", " " * 5000, "a" * 5000]
    encode = packing.encoder("byte_bpe_50k")
    assert all(encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_round_trip(spark, whole):
    rnd = random.Random(3)
    texts = [cases.prose(rnd, rnd.choice([1, 5, 50, 300, 2500])) for _ in range(60)] + [None, "", "a", "a"]
    docs = cases.with_clashes(cases.documents(spark, texts))
    rows = packing.pack_documents(docs, capacity=256).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for parts in sequences.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 256
    for i, text in enumerate(texts, 1):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own[1:]] == [256] * (len(own) - 1)
        end = 0
        for r in own:
            assert r["start"] == end and r["ids_crc32"] == zlib.crc32(ids[end : end + r["length"]].tobytes())
            end += r["length"]
        assert end == len(ids)
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-tokens // 256) + 2


def test_awkward_rows_and_empty_table(spark):
    docs = cases.awkward(spark)
    out = packing.pack_documents(docs)
    assert out.where("piece = 0").count() == docs.count()
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert out.select("sequence_id", "offset").distinct().count() == out.count()
    assert packing.pack_documents(cases.documents(spark, [])).count() == 0
