from __future__ import annotations

import hashlib
import random

import pytest

from tempora.llm import decontaminate, queries
from tests.llm import cases


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = cases.words(text), set(), set()
        for item_id, item in items:
            v = cases.words(item)
            n = min(size, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(spark, docs, items, size, extra=False):
    d = cases.documents(spark, [(i, t, None, None, None) for i, t in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, b = cases.with_clashes(d), b.selectExpr("*", "'x' as words", "'y' as doc_id", "1 as n", "2 as class")
    got = decontaminate.find_items(d, b, size).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr)


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 4), (3, 10)])
def test_matches_brute_force(spark, seed, size):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "e1"]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 14)))) for i in range(12)]
    items += [(100, items[0][1]), (101, items[5][1].upper()), (5, items[5][1]), (None, items[7][1]), (102, None), (103, "b"), (104, "a, b"), (7, "")]
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(15)]
    docs += [(20 + i, f"zz {t}. zz zz {t} q") for i, (_, t) in enumerate(items) if t]
    docs += [(50, None), (51, ""), (None, items[3][1]), docs[3], docs[3], (60, "zz " * 30_000 + items[2][1])]
    assert run(spark, docs, items, size) == brute(docs, items, size)


def test_overlapping_windows_count_words_once(spark):
    got = run(spark, [(1, "a a a a a")], [(9, "a a a")], 3)
    assert got == [(1, 5, 5, ["9"])]


def test_items_sharing_a_window_and_extra_columns(spark):
    docs, items = [(1, "x a b c y"), (2, "c b a")], [(2, "a b c"), (10, "A, b c!"), (3, "b c d")]
    assert run(spark, docs, items, 3, extra=True) == [(1, 5, 3, ["10", "2"]), (2, 3, 0, [])]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 3) == []
    assert run(spark, [(1, "a b")], [], 3) == [(1, 2, 0, [])]


def test_query_digest(spark, tmp_path):
    cases.documents(spark, ["zz a b", "none"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, "a b"), (10, "a  b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in queries.op1_decontamination(spark, str(tmp_path)).collect()}
    assert rows[1]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest() and rows[1]["contaminated"]
    assert rows[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not rows[2]["contaminated"]


def test_drop_keeps_clean_rows_as_they_are(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    items = spark.createDataFrame([(1, docs.where("doc_id = 2").first()["text"])], "item_id long, text string")
    rest = decontaminate.drop_contaminated(docs, items, size=3)
    assert rest.columns == docs.columns
    away = decontaminate.find_items(docs, items, size=3).where("n_hit > 0").count()
    assert away and rest.count() == docs.count() - away
