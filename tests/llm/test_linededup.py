from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import linededup
from tests.llm import cases


def lines(rnd, n=12):
    return cases.prose(rnd, n)


def cleaned(spark, texts, **kw):
    rows = linededup.clean_lines(cases.with_clashes(cases.documents(spark, texts)), **kw).collect()
    return {r["doc_id"]: (r["text"], r["_lines"], r["_dropped"]) for r in rows}


def test_recurring_line_stays_in_its_first_document(spark):
    rnd = random.Random(1)
    a, b, c, same = (lines(rnd) for _ in range(4))
    got = cleaned(spark, [f"{a}\n{same}", f"{same}\n{b}\n{same}", c])
    assert got == {1: (f"{a}\n{same}", 2, 0), 2: (b, 3, 2), 3: (c, 1, 0)}
    assert cleaned(spark, [f"{a}\n{same}", f"{same}\n{b}"], keep_first=False) == {1: (a, 2, 1), 2: (b, 2, 1)}
    assert cleaned(spark, [f"{a}\n{same}", f"{same}\n{b}"], min_docs=3)[2][2] == 0


def test_variable_fields_are_generalised(spark):
    rnd = random.Random(2)
    fixed = lines(rnd, 14)
    own = [f"Posted by user {n} on page {n * 7} of {fixed} via {name}" for n, name in enumerate(["ann", "bob", "cy", "dee"], 100)]
    got = cleaned(spark, [f"{lines(rnd)}\n{o}" for o in own])
    assert [got[i][2] for i in range(1, 5)] == [0, 1, 1, 1]


def test_templates_that_share_a_leaf_are_told_apart(spark):
    rnd = random.Random(6)
    fixed = [f"Posted by user {{}} {lines(rnd, 12)}" for _ in range(3)]
    alone = [f"Posted by user {lines(rnd, 13)}" for _ in range(8)]
    own = [f.format(name) for f in fixed for name in ("ann", "bob", "cy", "dee")] + alone
    rnd.shuffle(own)
    got = cleaned(spark, [f"{lines(rnd)}\n{o}" for o in own])
    first = {min(i for i, o in enumerate(own) if o.split()[4:] == f.split()[4:]) for f in fixed}
    assert [got[i + 1][2] for i in range(20)] == [0 if o in alone or i in first else 1 for i, o in enumerate(own)]


def test_unlike_lines_of_one_leaf_stay(spark):
    rnd = random.Random(3)
    got = cleaned(spark, [f"the same start {lines(rnd, 20)}" for _ in range(12)])
    assert all(v[2] == 0 for v in got.values())


def test_short_lines_stay(spark):
    got = cleaned(spark, ["one two three\nx", "one two three\ny"])
    assert all(v[2] == 0 for v in got.values())


def test_short_lines_of_many_documents_are_dropped(spark):
    rnd = random.Random(5)
    own = [lines(rnd) for _ in range(12)]
    texts = [f"All rights reserved {2000 + i}\n{t}\n" + ("Home" if i < 9 else "") for i, t in enumerate(own)]
    got = cleaned(spark, texts)
    assert [got[i + 1][2] for i in range(12)] == [0] + [1] * 11  # Home is in 9 documents, empty lines are no lines
    assert got[2][0] == f"{own[1]}\nHome" and got[12][0] == f"{own[11]}\n"
    assert all(v[2] == 0 for v in cleaned(spark, texts, short_docs=None).values())
    assert all(v[2] == 0 for v in cleaned(spark, texts, min_docs=13).values())


def test_white_space_of_any_kind_is_a_blank(spark):
    rnd = random.Random(7)
    line = lines(rnd)
    forms = [line, f"{line}\r", f"\t{line}", line.replace(" ", "\t"), line.replace(" ", "\u00a0"), line.replace(" ", " \u3000 "), f"\ufeff{line} \u200b"]
    own = [lines(rnd) for _ in forms]
    got = cleaned(spark, [f"{o}\n{f}" for o, f in zip(own, forms, strict=True)])
    assert [got[i + 1][0] for i in range(len(forms))] == [f"{own[0]}\n{line}", *own[1:]]


def test_lines_without_blanks_are_measured_by_letters(spark):
    rnd = random.Random(8)
    long = ["本网站所有内容未经书面许可不得转载", "無断転載を禁じますこのページのすべての内容について", "สงวนลิขสิทธิ์ตามกฎหมายห้ามทำซ้ำหรือดัดแปลงเนื้อหาทั้งหมด"]
    short = ["联系我们", "お問い合わせ", "ติดต่อเรา"]
    for line in long + short:
        assert cleaned(spark, [f"{lines(rnd)}\n{line}", f"{lines(rnd)}\n{line}"])[2][2] == (line in long)


def test_repeats_within_a_document_are_not_recurring(spark):
    line = lines(random.Random(4))
    assert cleaned(spark, [f"{line}\n{line}"])[1] == (f"{line}\n{line}", 2, 0)


@pytest.mark.parametrize("passage", [60, 400])
def test_passages_are_caught_and_clean_documents_left_alone(spark, passage):
    rnd = random.Random(passage)
    shared = lines(rnd, passage)
    texts = [f"{lines(rnd, 30)}\n{shared}\n{lines(rnd, 30)}" if i % 2 else f"{lines(rnd, 40)}\n{lines(rnd, 9)}" for i in range(20)]
    got = cleaned(spark, texts)
    assert sum(shared in v[0] for v in got.values()) == 1
    assert all(got[i + 1][0] == t for i, t in enumerate(texts) if shared not in t)


def test_awkward_rows(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    out = linededup.clean_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_dropped"] and out.count() == docs.count()
    before = {(r["doc_id"], r["lang"], r["n_chars"]) for r in docs.where("text is null").collect()}
    assert before == {(r["doc_id"], r["lang"], r["n_chars"]) for r in out.where("text is null").collect()}
    kept = linededup.drop_recurring_lines(docs)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert {50, 51, 52, 53, 54, 62} <= ids and not {60, 61} & ids  # copies of an earlier text are left with nothing


def test_empty_table(spark):
    assert cleaned(spark, []) == {}


def test_only_documents_of_alike_lines_are_parsed_again(spark):
    same = [f"a b c {w} e f g h i j" for w in "xyz"]
    texts = [*same, *same, "q r s t u v w x y z", "one two three four five six seven eight"]
    docs = cases.documents(spark, texts)
    rows = linededup._lines(docs, 8, True).withColumn("_doc", F.xxhash64("_id", "_tx"))
    templates = rows.groupBy("leaf", "t1", "t2", "short").agg(F.min("_doc").alias("lo"))
    several = rows.groupBy("leaf").agg(F.countDistinct("t1").alias("m")).where("m > 1").select("leaf")
    again = linededup._texts(docs, templates, several, 8, True)
    # One document for each of the three templates of the one leaf.
    assert sorted(r["masked"] for r in again.collect()) == same


def test_templates_of_one_leaf_are_spread_over_tasks(spark, monkeypatch):
    rnd, files, write = random.Random(9), {}, linededup.replace_table

    def noted(df, path, **options):
        out = write(df, path, **options)
        files[path.rsplit("/", 1)[1]] = out.select(F.input_file_name()).distinct().count()
        return out

    monkeypatch.setattr(linededup, "replace_table", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cleaned(spark, [f"{lines(rnd)}\nPosted by user {lines(rnd, 13)}" for _ in range(60)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 60 and files["found"] > 1


def noted_rows(monkeypatch):
    rows, write = {}, linededup.replace_table

    def noted(df, path, **options):
        out = write(df, path, **options)
        rows[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(linededup, "replace_table", noted)
    return rows


def test_long_lines_of_one_leaf_meet_once(spark, monkeypatch):
    rnd, rows = random.Random(10), noted_rows(monkeypatch)
    base = lines(rnd, 600).split()
    ends = [lines(rnd, 600).split() for _ in range(2)]
    # Alike in the first 400 of 600 tokens, which are 80 of 121 blocks.
    got = cleaned(spark, [" ".join(base[:400] + e[400:]) for e in ends])
    assert [v[2] for v in got.values()] == [0, 0]
    assert rows["members"] == 2 and rows["sets"] == 2


def linked(own, blocks):
    """Bucket and template, for templates that agree with the majority of a bucket: by hand."""
    buckets, out = {}, set()
    for t, keys in blocks.items():
        for key in keys:
            buckets.setdefault(key, set()).add(t)
    for key, held in buckets.items():
        counts = {}
        for t in held:
            for token in own[t]:
                counts[token] = counts.get(token, 0) + 1
        pattern = {x for x, c in counts.items() if c > 1 and 2 * c > len(held)}
        out |= {(frozenset(held), t) for t in held if 5 * len(pattern & own[t]) >= 4 * len(own[t])}
    return out


def test_links_are_those_of_every_bucket(spark):
    rnd, rows = random.Random(11), []
    for leaf in range(30):
        n = rnd.choice([8, 11, 40])
        bases = [[rnd.randrange(10**6) for _ in range(n)] for _ in range(rnd.randint(1, 3))]
        for t in range(rnd.randint(2, 9)):
            edits, base = rnd.choice([0.05, 0.15, 0.2, 0.3]), rnd.choice(bases)
            rows.append((leaf * 100 + t, 7, leaf, n, [x if i < 3 or rnd.random() > edits else rnd.randrange(10**6) for i, x in enumerate(base)]))
    rest = spark.createDataFrame(rows, "t1 long, t2 long, leaf long, n long, tokens array<long>")
    blocks = rest.select("t1", "n", F.explode(linededup._blocks()).alias("bucket"))
    keys = {}
    for r in blocks.collect():
        keys.setdefault(r["t1"], set()).add(r["bucket"])
    members = blocks.join(linededup._buckets(blocks), "bucket")
    held = {}
    for r in members.collect():
        held.setdefault(r["bucket"], set()).add(r["t1"])
    got = {(frozenset(held[r["a"]]), r["b"]) for r in linededup._links(members, linededup._sets(rest)).collect()}
    want = linked({r[0]: set(r[4]) for r in rows}, keys)
    assert got == want and 20 < len(want) < sum(len(h) for h, _ in want)
