"""Short licence notices in texts, found with a bounded number of edits.

Texts are folded to words with one blank between them.  A notice of n letters
may differ by k = n // ``LETTERS_PER_EDIT`` edits.  Cut into k + 1 pieces, at
least one piece of it is there unchanged (pigeonhole): occurrences of the pieces
are the candidates, and the regex library's bounded-error matching verifies the
words around each and says where the notice begins and ends and how many edits
it takes.  Exact occurrences of the base phrases are the matches without edits.

Results: null and empty texts have no words and no matches.  Rows are judged one
by one, so repeated rows get equal results and an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tempora.llm.rowtypes import with_id
from tempora.llm.words import ALNUM, chunks, words

# Phrases whose exact places are counted, and further notices.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOTICES = (
    ("all rights reserved", "all-rights-reserved"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu affero general public license", "agpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("released into the public domain", "public-domain"),
)
LETTERS_PER_EDIT = 10
Batches = Iterator[pa.RecordBatch]


class Notice(NamedTuple):
    label: str
    phrase: bytes
    base: bool
    edits: int
    seeds: tuple[tuple[int, bytes], ...]  # place in the phrase, piece
    patterns: tuple[regex.Pattern, ...]  # for one edit at most, for two, and so on


def compile_notice(phrase: str, label: str, base: bool) -> Notice:
    raw = phrase.encode()
    edits = len(raw) // LETTERS_PER_EDIT
    cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
    seeds = tuple((a, raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    # Whole words only: a notice starts after a blank and ends before one.
    text = regex.escape(raw, literal_spaces=True)
    patterns = tuple(regex.compile(rb"(?<=[ \n])(?:" + text + rb"){e<=%d}(?= )" % e) for e in range(1, edits + 1))
    return Notice(label, raw, base, edits, seeds, patterns)


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as ``word word word \\n``; their bounds, the words' starts, and first words."""
    rows = len(offsets) - 1
    padded = np.insert(data, np.repeat(offsets[1:], 2), np.tile(np.frombuffer(b" \n", np.uint8), rows))
    bounds = offsets + 2 * np.arange(rows + 1)
    w = words(padded, bounds, ALNUM, hashed=False)
    inside = ALNUM[w.data]
    keep = inside.copy()
    keep[w.ends] = True  # one blank after each word
    keep[bounds[1:] - 1] = True
    text = np.where(inside, w.data, np.uint8(32))
    text[bounds[1:] - 1] = 10
    places = np.cumsum(keep) - 1
    return text[keep].tobytes(), np.append(0, places[bounds[1:] - 1] + 1), places[w.starts], w.first


def _matches(notice: Notice, text: bytes, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row, begin, end and edits of each match, exact ones as often as they occur."""
    near: list[tuple[int, int]] = []
    size, k = len(notice.phrase), notice.edits
    for offset, seed in notice.seeds:
        at = text.find(seed)
        while at >= 0:
            begin = at - offset
            near.append((begin - k, begin + size + k))
            at = text.find(seed, at + 1)
    near.sort()
    merged: list[list[int]] = []
    for a, b in near:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        row = int(np.searchsorted(bounds, max(a, 0), side="right")) - 1
        while row < len(bounds) - 1 and bounds[row] < b:
            low, high = max(a - 1, int(bounds[row]) - 1, 0), min(b + 1, int(bounds[row + 1]))
            exact = []
            at = text.find(notice.phrase, low, high)
            while at >= 0:
                before, after = text[at - 1 : at] if at > bounds[row] else b"\n", text[at + size : at + size + 1]
                if before in (b" ", b"\n") and after == b" ":
                    exact.append(at)
                    yield row, at, at + size, 0
                at = text.find(notice.phrase, at + 1, high)
            part = b"\n" + text[max(low, int(bounds[row])) : high]
            shift = max(low, int(bounds[row])) - 1
            if low >= bounds[row] and low > 0:
                part, shift = text[low:high], low
            for begin, end, edits in _edited(notice, part, [x - shift for x in exact]) if k else ():
                yield row, begin + shift, end + shift, edits
            row += 1


def _edited(notice: Notice, part: bytes, exact: list[int]) -> Iterator[tuple[int, int, int]]:
    """Begin, end and edits of the edited matches beside the exact ones.

    Those of one edit are looked for first, from left to right, then those of
    two in what is left between them, and so on: each text is read once for each
    number of edits, however many matches it has.
    """
    size, k = len(notice.phrase), notice.edits
    open_ = list(zip([0, *(x + size for x in exact)], [*exact, len(part)], strict=True))
    for edits, pattern in enumerate(notice.patterns, 1):
        rest = []
        for low, high in open_:
            while high - low >= size - k and (m := pattern.search(part, low, high)):
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                rest.append((low, m.start()))
                low = m.end()
            rest.append((low, high))
        open_ = [(low, high) for low, high in rest if high - low >= size - k]


def _closest(found: list[tuple[int, int, int, Notice]]) -> Iterator[tuple[int, int, int, Notice]]:
    """Without those that overlap a closer match of another label: versions differ by one letter."""
    found = sorted(found, key=lambda m: m[:3])
    begins, longest = [m[0] for m in found], max((m[1] - m[0] for m in found), default=0)
    for begin, end, edits, notice in found:
        # A match is no longer than its notice and its edits, so only near ones can overlap.
        near = found[bisect_left(begins, begin - longest) : bisect_left(begins, end)]
        if not edits or not any(e < edits and a < end and begin < b and n.label != notice.label for a, b, e, n in near):
            yield begin, end, edits, notice


def _scan(notices: list[Notice]) -> Callable[[Batches], Batches]:
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row, end, data, offsets in chunks(batch, "text"):
                text, bounds, places, first = _folded(data, offsets)
                spans: list[list[dict]] = [[] for _ in range(end - row)]
                scores = np.zeros(end - row)
                found: dict[int, list[tuple[int, int, int, Notice]]] = {}
                for notice in notices:
                    for doc, *match in _matches(notice, text, bounds):
                        found.setdefault(doc, []).append((*match, notice))
                for doc, matches in found.items():
                    for begin, stop, edits, notice in _closest(matches):
                        a, b = np.searchsorted(places, [begin, stop])
                        spans[doc].append({"label": notice.label, "first_word": int(a - first[doc]), "n_words": int(b - a), "edits": edits, "base": notice.base and not edits})
                        scores[doc] = max(scores[doc], 1 - edits / len(notice.phrase))
                arrays = [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(first).astype(np.int64)), pa.array(spans, pa.list_(span)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "spans", "score"])

    return run


def find_notices(docs: DataFrame, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``doc_id, n_words, spans, score`` of every document.

    A span has a label, its first word and number of words, its edits, and
    whether it is an exact base phrase.  The score is the best match's share of
    unedited letters, 0 without a match.
    """
    compiled = [compile_notice(p, label, True) for p, label in base] + [compile_notice(p, label, False) for p, label in notices]
    span = "struct<label:string,first_word:long,n_words:long,edits:int,base:boolean>"
    schema = with_id(docs, "doc_id", "doc_id", f"n_words long, spans array<{span}>, score double")
    return docs.select("doc_id", "text").mapInArrow(_scan(compiled), schema)
