from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import quality, queries, samples, toxicity
from tempora.sources.tables import scratch_dir
from tests.llm import cases

SF = "/root/testdata/sf0.1"


def area(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    n1, n0 = labels.sum(), (1 - labels).sum()
    return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_out(spark, query, target):
    out = query(spark, SF)
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    return rows[target].to_numpy(), rows["score"].to_numpy(), rows["predicted"].to_numpy()


def test_toxicity_of_held_out_documents(spark):
    y, score, predicted = held_out(spark, queries.op3_toxicity, "toxic")
    assert area(y, score) > 0.93 and (y == predicted).mean() > 0.96
    assert ((score >= 0) & (score <= 1)).all()


def test_quality_of_held_out_documents(spark):
    y, score, predicted = held_out(spark, queries.op7_quality, "quality")
    assert area(y, score) > 0.99 and (y == predicted).mean() > 0.98


def test_folds(spark):
    ids = [None, 0, 7, 123456789, -3]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("f", samples.in_fold("doc_id", 5, 0))
    assert {r["doc_id"]: r["f"] for r in df.collect()} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids}


def test_labels_outside_training_folds_do_not_matter(spark):
    docs = cases.awkward(spark)
    ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect() if r["doc_id"] is not None]

    def scores(flip):
        rows = [(i, int((i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)), i % 2) for i in ids]
        labels = spark.createDataFrame([*rows, (None, 1, 1), (999, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
        return cases.rows_of(toxicity.toxicity(docs, labels).select("doc_id", "score"))

    assert scores(False) == scores(True)


@pytest.mark.parametrize("apply", [toxicity.toxicity, quality.quality])
@pytest.mark.parametrize("known", [[], [(1, 1, 1), (2, 1, 1)], [(i, i % 2, i % 2) for i in range(1, 15)]])
def test_awkward_rows(spark, apply, known):
    labels = spark.createDataFrame(known, "doc_id long, toxic int, quality int").selectExpr("*", "'x' as text", "1 as _y")
    docs = cases.awkward(spark)
    rows = apply(cases.with_clashes(docs), labels).select("doc_id", "score").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert apply(cases.documents(spark, []), labels).count() == 0


def test_folding():
    assert toxicity.fold("Ｙou ІDІ0T!! str4sse\nПривет") .split()[1] == "idiot"
    assert toxicity.fold(None) == " " and toxicity.fold("a,b") == " a b "


def test_exceptions_cover_matches():
    model = toxicity.Model({" scum ": 2.0, " scu": 1.0}, frozenset({" scum bag "}), (0.0, 1.0, 1.0, 0.0))
    machine = toxicity.automaton(model)
    assert [w for *_, w in toxicity.matched(" scum bag scum scully ", machine)] == [2.0, 1.0]


def test_learned_lexicon_and_exceptions(spark):
    rows = [(i, f"word{i} vile plain text here", 1.0) for i in range(40)]
    rows += [(100 + i, f"word{i} a vile weather day plain text", 0.0) for i in range(6)] + [(200 + i, f"plain text here word{i}", 0.0) for i in range(150)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, _y double"))
    assert any(k.startswith(" vile") for k in model.entries) and any("vile weather" in k for k in model.exceptions)
    texts = ["so v1le plain", "a vile weather day plain text", "plain text"]
    a, b, c = (r["score"] for r in toxicity.score(cases.documents(spark, texts), model).orderBy("doc_id").collect())
    assert a > 0.5 > b and abs(b - c) < 1e-9


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    d = quality.WORD_CELLS + quality.STRUCTURE
    m = quality.Machine(rng.normal(size=d), np.full(d, 0.1), 0.3, rng.normal(size=d), rng.normal(size=(d, quality.RANK)))
    x = rng.normal(size=(3, d))
    z = np.clip((x - m.mean) * m.scale, -5, 5)
    pairs = m.factors @ m.factors.T
    expected = [m.bias + r @ m.linear + sum(pairs[i, j] * r[i] * r[j] for i in range(d) for j in range(i)) for r in z]
    assert np.allclose(m.margin(x), expected)


def test_features_do_not_depend_on_the_batch():
    texts = ["A a b!\nA a b!", "", "x | y | 12", "é" * 50, "w " * 3000]
    raw = [t.encode() for t in texts]

    def of(parts):
        return quality.features(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64), np.ones(len(parts)))

    together = of(raw)
    assert all(np.allclose(together[i], of([r])[0]) for i, r in enumerate(raw)) and not together[1][: quality.WORD_CELLS].any()


def test_pairs_are_learned():
    """An exclusive or of two features is beyond any linear score."""
    rng = np.random.default_rng(5)
    x = np.zeros((1200, quality.WORD_CELLS + quality.STRUCTURE))
    x[:, :2] = rng.choice([-1.0, 1.0], (1200, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


def test_drop_rejected_keeps_rows_as_they_are(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    labels = spark.createDataFrame([(i, 1 if i != 4 else 0) for i in range(20)], "doc_id long, quality int")
    out = quality.drop_rejected(docs, labels, 0.0)
    assert cases.rows_of(out) == cases.rows_of(docs) and out.columns == docs.columns
    assert quality.drop_rejected(docs, labels, 1.1).count() == 0


def test_a_sample_holds_one_row_of_an_id(spark):
    docs = spark.range(30_000).selectExpr("if(id < 29990, 1, id) AS doc_id", "concat('text ', id % 5000) AS text").repartition(8)
    labels = spark.createDataFrame([(1, 1), (1, 0), *[(i, 0) for i in range(29_990, 30_000)]], "doc_id long, toxic int")
    found = samples.labelled_sample(docs, labels, "toxic", 8, F.lit(True), samples_path(spark)).collect()
    assert len(found) == 8 and len({r["doc_id"] for r in found}) == 8
    again = samples.labelled_sample(docs.repartition(3), labels, "toxic", 8, F.lit(True), samples_path(spark)).collect()
    assert found == again


def samples_path(spark):
    return f"{scratch_dir(spark)}/sample"


def sample_of(spark, rows):
    return spark.createDataFrame([(i, t, float(y)) for i, (t, y) in enumerate(rows)], "doc_id long, text string, _y double")


def test_the_rarest_telling_term_is_an_entry(spark):
    rnd = random.Random(3)
    clean = [(cases.prose(rnd, 15), 0) for _ in range(1500)]
    toxic = [(cases.prose(rnd, 15) + " zq" + "".join(rnd.choices("xyz", k=6)) + " commonslur", 1) for _ in range(150)]
    toxic[:6] = [(cases.prose(rnd, 20) + " raretermhere", 1) for _ in range(6)]
    model = toxicity.train(sample_of(spark, clean + toxic))
    assert any("raretermhere".startswith(k.strip()) for k in model.entries) and any("commonslur".startswith(k.strip()) for k in model.entries)


def brute_matches(folded, model):
    """The heaviest entry at each place that no occurrence of an exception covers."""
    places = lambda k: [i for i in range(len(folded)) if folded.startswith(k, i)]
    best = {}
    for key, weight in model.entries.items():
        for i in places(key):
            if i not in best or weight > best[i][1]:
                best[i] = (i + len(key) - 1, weight)
    covered = [(i, i + len(k) - 1) for k in model.exceptions for i in places(k)]
    return sorted((i, last, w) for i, (last, w) in best.items() if not any(a <= i and last <= b for a, b in covered))


@pytest.mark.parametrize("seed", range(4))
def test_matching_against_brute_force(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 6))) for _ in range(25)]
    entries = {(f" {w} " if rnd.random() < 0.5 else f" {w}"): 0.7 + i / 10 for i, w in enumerate(words[:12])}
    exceptions = frozenset(f" {rnd.choice(words)} {rnd.choice(words)} " for _ in range(60))
    model = toxicity.Model(entries, exceptions - set(entries), (0.0,) * 4)
    machine = toxicity.automaton(model)
    for _ in range(60):
        folded = toxicity.fold(" ".join(rnd.choices(words, k=rnd.randint(0, 60))))
        assert list(toxicity.matched(folded, machine)) == brute_matches(folded, model)


def test_long_text_of_nothing_but_matches():
    model = toxicity.Model({" bad ": 1.0, " wors": 2.0}, frozenset({" bad luck "}), (0.0,) * 4)
    folded = toxicity.fold("bad luck bad worse " * 55_000)
    start = time.perf_counter()
    assert len(list(toxicity.matched(folded, toxicity.automaton(model)))) == 110_000
    assert time.perf_counter() - start < 10
