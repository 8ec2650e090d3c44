from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm.words import ALNUM, SPACED, chunks, ngrams, words
from tests.llm import cases


def taken(texts, kind):
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
    return words(np.frombuffer(b"".join(raw), np.uint8), offsets, kind)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9 .é\n\t\x00Ж|"), max_size=12), max_size=6))
@pytest.mark.parametrize("kind, pattern", [(ALNUM, cases.ALNUM), (SPACED, cases.SPACED)])
def test_words_match_the_patterns(kind, pattern, texts):
    w = taken(texts, kind)
    expected = [cases.words(t, pattern) for t in texts]
    assert w.counts().tolist() == [len(x) for x in expected]
    assert [w.text(i) for i in range(len(w.starts))] == sum(expected, [])


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = taken(["ab cd", "", "CD ab x ab"], ALNUM)
    names = [w.text(i) for i in range(len(w.starts))]
    assert len(set(w.hashes.tolist())) == len(set(names)) == 3
    by = {}
    assert all(by.setdefault(n, h) == h for n, h in zip(names, w.hashes.tolist(), strict=True))


def test_ngrams_stay_inside_a_text():
    w = taken(["a b c", "b", "a b c d"], ALNUM)
    h, at = ngrams(w, 3)
    assert at.tolist() == [0, 4, 5]
    assert h[0] == h[1] != h[2]


def test_chunks_of_sliced_batches_and_nulls(monkeypatch):
    monkeypatch.setattr("tempora.llm.words.CHUNK_BYTES", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(["zz", "ab", None, "cdefgh", "", "i"])], ["text"]).slice(1)
    got = []
    for row, end, data, offsets in chunks(batch, "text"):
        got += [(row + i, data[a:b].tobytes().decode()) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
        assert end - row == len(offsets) - 1
    assert got == [(0, "ab"), (1, ""), (2, "cdefgh"), (3, ""), (4, "i")]
