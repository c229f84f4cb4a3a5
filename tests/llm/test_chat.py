"""Masks against a character-by-character account, exact round trips, and odd input."""

from __future__ import annotations

import random

import pytest

from tripleloom.llm import chat as C

from .conftest import prose

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(1)
    texts = ("", "<|im_end|> is text", "ünïcödé \U0001f600 text", "  blanks  ", "tab\tand\nline")
    rows = [(c, t, ("user", "assistant", "system")[rng.randrange(3)], rng.choice(texts) if rng.random() < 0.4 else prose(rng, rng.randint(1, 40))) for c in range(60) for t in range(rng.randint(1, 7))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_masks_against_characters(turns):
    """A token is trained if one of its characters is in a trained turn or its end marker."""
    by: dict = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append(r)
    t = C.tokenizer(C.DEFAULT)
    rows = C.format_chats(turns).collect()
    assert len(rows) == 60
    for r in rows:
        text, trained = "", []
        for x in sorted(by[r.conv_id], key=lambda x: x.turn):
            head, body = f"<|im_start|>{x.role}\n", x.text + "<|im_end|>"
            text += head + body + "\n"
            trained += [False] * len(head) + [x.role == "assistant"] * len(body) + [False]
        assert r.text == text and r.n_turns == len(by[r.conv_id])
        e = t.encode(text, add_special_tokens=False)
        assert r.token_ids == e.ids
        assert r.loss_mask == [int(any(trained[a:b])) for a, b in e.offsets]
        assert r.n_trained == sum(r.loss_mask)
        assert t.decode(r.token_ids, skip_special_tokens=False) == text


def test_mask_by_search():
    assert C.mask([(0, 2), (2, 4), (4, 7), (7, 9)], [(3, 4), (8, 9)]) == [0, 1, 0, 1]
    assert C.mask([(0, 3)], []) == [0] and C.mask([], [(0, 1)]) == []
    assert C.mask([(0, 5), (5, 5), (5, 6)], [(1, 2), (2, 5)]) == [1, 0, 0]


def test_odd_input(spark):
    from pyspark.sql import functions as F

    long = prose(random.Random(2), 50_000)
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 1, "user", ""), (3, 2, "assistant", long), (3, 1, "user", "say it")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("turns", "token_ids", "n_turns", "loss_mask")))
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].text == "<|im_start|>unknown\n<|im_end|>\n" + "<|im_start|>assistant\n<|im_end|>\n" * 2 and got[1].n_turns == 3
    assert got[2].n_trained == 0 and long in got[3].text and got[3].n_trained > 50_000
    assert C.format_chats(df.limit(0)).count() == 0


def test_query_has_each_conversation(spark, sf):
    want = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    rows = C.query(spark, sf).collect()
    assert {r.conv_id for r in rows} == want and len(rows) == len(want)
    assert all(len(r.token_ids) == len(r.loss_mask) for r in rows)
