from __future__ import annotations

import random
import time
from collections import Counter

import pytest
import regex

from tempora.llm import licenses
from tests.llm import cases


def found(spark, texts, extra=False):
    docs = cases.documents(spark, texts)
    rows = licenses.find_notices(cases.with_clashes(docs) if extra else docs).collect()
    return {r["doc_id"]: r for r in rows}


def spans(row):
    return sorted((s["label"], s["first_word"], s["n_words"], s["edits"], s["base"]) for s in row["spans"])


def base_places(text):
    w = cases.words(text)
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


def test_exact_and_edited_notices(spark):
    got = found(spark, [
        "Licensed under the Apache License, Version 2.0 (the x)",
        "cc by nc cc by nc, CC-BY-NC!",
        "released undr the MIT licence today",
        "GNU General Public License, version 3.",
        "thunder the mit license",
        "under the mit licenses under the mit license",
        "All rights are reserved",
    ], extra=True)
    assert ("apache-2", 3, 4, 0, True) in spans(got[1]) and got[1]["score"] == 1.0
    assert spans(got[2]) == [("cc-by-nc", 0, 3, 0, True), ("cc-by-nc", 3, 3, 0, True), ("cc-by-nc", 6, 3, 0, True)]
    assert spans(got[3]) == [("mit", 1, 4, 2, False)] and 0 < got[3]["score"] < 1
    assert spans(got[4]) == [("gpl-3", 0, 6, 0, False)]
    assert all(not s[4] for s in spans(got[5]))
    assert [s for s in spans(got[6]) if s[4]] == [("mit", 4, 4, 0, True)]


def test_base_places_match_brute_force(spark):
    rnd = random.Random(1)
    parts = ["under the mit license", "Under The MIT License.", "apache license version 2", "cc by nc", "cc", "by", "nc", "the", "é", "\n", "license"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randint(0, 30))) for _ in range(150)]
    got = found(spark, texts)
    for i, text in enumerate(texts, 1):
        assert sorted((s["label"], s["first_word"]) for s in got[i]["spans"] if s["base"]) == base_places(text)
        assert got[i]["n_words"] == len(cases.words(text))


def test_edits_up_to_the_bound_are_found(spark):
    """Any text with a notice within its bound is found: brute-force fuzzy search over whole texts."""
    rnd = random.Random(2)
    phrase, label = licenses.NOTICES[5]
    texts = []
    for _ in range(80):
        letters = list(phrase)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(1, len(letters) - 1)
            letters[i] = rnd.choice(["", "x", letters[i] + "y"])
        texts.append(f"{cases.prose(rnd, 5)} {''.join(letters)} {cases.prose(rnd, 5)}")
    notice = licenses.compile_notice(phrase, label, False)
    whole = regex.compile(rf"(?<= )(?:{regex.escape(phrase, literal_spaces=True)}){{e<={notice.edits}}}(?= )")
    got = found(spark, texts)
    hits = 0
    for i, text in enumerate(texts, 1):
        folded = f" {' '.join(cases.words(text))} "
        near = whole.search(folded) is not None
        hits += near
        if near:
            assert any(s["label"].startswith("gpl") for s in got[i]["spans"])
    assert 10 < hits < 80


def test_edited_notices_beside_closer_ones_are_found(spark):
    got = found(spark, ["under the gnu genral public licens version 2 or gnu general public license version 3"])
    assert spans(got[1]) == [("gpl-2", 2, 6, 2, False), ("gpl-3", 9, 6, 0, False)]
    rnd = random.Random(3)
    phrase, label = licenses.NOTICES[8]
    texts, edits = [], []
    for _ in range(60):
        copies, own = [], []
        for _ in range(rnd.randint(2, 5)):
            letters = list(phrase)
            for i in rnd.sample([i for i, c in enumerate(phrase[1:-1], 1) if c != " "], rnd.randint(0, 3)):
                letters[i] = "q"
            copies.append("".join(letters))
            own.append(sum(a != b for a, b in zip(copies[-1], phrase, strict=True)))
        texts.append(rnd.choice([" ", " or "]).join(copies))
        edits.append(own)
    got = found(spark, texts)
    for i, (text, own) in enumerate(zip(texts, edits, strict=True), 1):
        words, step = len(phrase.split()), len(phrase.split()) + (" or " in text)
        expected = [(label, j * step, words, e, False) for j, e in enumerate(own)]
        assert [s for s in spans(got[i]) if s[0] == label] == expected, text


@pytest.mark.parametrize("n", [licenses.LETTERS_PER_EDIT * k for k in (1, 2, 4)])
def test_seeds_cover_the_phrase(n):
    notice = licenses.compile_notice("a" * n, "x", False)
    assert len(notice.seeds) == notice.edits + 1 and b"".join(s for _, s in notice.seeds) == b"a" * n


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    out = licenses.find_notices(cases.with_clashes(docs))
    assert out.count() == docs.count()
    by = {r["doc_id"]: r for r in out.where("doc_id in (50, 51, 52, 54)").collect()}
    assert [by[i]["n_words"] for i in (50, 51, 52, 54)] == [0, 0, 0, 60_000] and by[50]["score"] == 0
    assert licenses.find_notices(cases.documents(spark, [])).count() == 0


def test_matches_at_the_ends_of_long_texts(spark):
    long = "zz " * 700_000
    got = found(spark, [f"{long}cc by nc", f"under the mit license {long}"])
    assert spans(got[1]) == [("cc-by-nc", 700_000, 3, 0, True)] and spans(got[2]) == [("mit", 0, 4, 0, True)]


def test_long_text_of_nothing_but_edited_notices(spark):
    line = "under the mitt license. gnu genral public license version 2, aplicense version 2 "
    text = line * 13_000
    start = time.perf_counter()
    (row,) = licenses.find_notices(cases.documents(spark, [text])).collect()
    assert time.perf_counter() - start < 30 and len(text) > 1_000_000
    labels = Counter(s["label"] for s in row["spans"])
    assert labels["mit"] == labels["gpl-2"] == 13_000
