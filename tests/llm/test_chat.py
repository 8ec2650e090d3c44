from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import chat
from tests.llm import cases

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", " [NEXT] ", "<<SYS>>", "<</SYS>>", "[ROLE] x [SAYS] ", "[/ROLE]", "\\", "\\\\", "<", "[", "/", " ", "\n", "a", "é", "𝄞", "<\\/s>", "$1"]


def read_back(rows):
    out = chat.format_conversations(rows).select("conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    return {r["conv_id"]: (r["formatted"], [tuple(t) for t in r["turns"]], r["learned"], [tuple(s) for s in r["loss"]]) for r in out.collect()}


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 3, "assistant", "c"), (1, 4, "tool", "t")]
    text, turns, learned, loss = read_back(spark.createDataFrame(rows, SCHEMA))[1]
    assert text == "<<SYS>> s <</SYS>>[INST] u [/INST]<s> b [NEXT] c </s>[ROLE] tool [SAYS] t [/ROLE]"
    assert turns == [("system", "s"), ("user", "u"), ("assistant", "b"), ("assistant", "c"), ("tool", "t")] and learned == "bc"
    assert [text.encode()[a : a + n].decode() for a, n in loss] == ["b", "c"]


@pytest.mark.parametrize("seed", range(3))
def test_any_text_comes_back(spark, seed):
    rnd = random.Random(seed)
    said = lambda: "".join(rnd.choices(PIECES, k=rnd.randint(0, 9)))
    roles = ["user", "assistant", "system", "tool", "", "<s>", " [SAYS] ", "a\\", "a\nb"]
    rows = [(c, t, rnd.choice(roles), said()) for c in range(40) for t in range(rnd.randint(1, 12))]
    found = read_back(spark.createDataFrame(rows, SCHEMA).repartition(5))
    for c, (text, turns, learned, loss) in found.items():
        own = [(r, t) for i, _, r, t in rows if i == c]
        assert turns == own
        assert learned == "".join(t for r, t in own if r == "assistant") and len(loss) == sum(r == "assistant" for r, _ in own)
        marks = sum(text.count(m) for m in ("[/INST]", "</s>", "<</SYS>>", "[/ROLE]"))
        assert marks == 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 3, "user", "x"), (None, None, "assistant", "y"), (2, 0, "assistant", "é" * 300_000), (2, 1, "user", "[INST]" * 100_000)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("turns", "pieces", "blocks", "formatted", "loss", "starts", "lengths", "runs", "begins")])
    found = read_back(docs)
    assert found[1][1] == [("", ""), ("user", ""), ("user", "")]
    assert found[None][1] == [("assistant", "y"), ("user", "x")]
    assert found[2][1] == [("assistant", "é" * 300_000), ("user", "[INST]" * 100_000)] and found[2][3] == [(4, 600_000)]


def test_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i // 2 % 2], f"t{i}") for i in range(3000)]
    text, turns, learned, loss = read_back(spark.createDataFrame(rows, SCHEMA))[1]
    assert [t for _, t in turns] == [f"t{i}" for i in range(3000)]
    assert [text.encode()[a : a + n].decode() for a, n in loss] == [f"t{i}" for i in range(3000) if i // 2 % 2]


def test_empty_table(spark):
    assert read_back(spark.createDataFrame([], SCHEMA)) == {}
