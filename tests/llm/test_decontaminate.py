"""Spans against brute force, both ways of looking windows up, and odd input."""

from __future__ import annotations

import random

import pytest

from tripleloom.llm import decontaminate as D
from tripleloom.llm.common import words

from .conftest import prose


def brute(text, items, n=D.N):
    """(words covered) by comparing every window with every window of every item."""
    w, covered = words(text), set()
    for item in items:
        b = words(item)
        size = min(n, len(b))
        for i in range(len(w) - size + 1):
            for j in range(len(b) - size + 1):
                if w[i : i + size] == b[j : j + size]:
                    covered |= set(range(i, i + size))
    return covered


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    items = [prose(rng, n) for n in (30, 12, 8, 5, 4, 3, 20, 2, 1)]
    texts = []
    for k in range(60):
        w = prose(rng, rng.randint(3, 80)).split(" ")
        for _ in range(k % 3):
            own = rng.choice(items).split(" ")
            a = rng.randrange(len(own))
            at = rng.randrange(len(w))
            w[at:at] = own[a : a + rng.randint(3, 15)]
        texts.append(" ".join(w) if k % 2 else ", ".join(w).upper())
    return items, texts + items


def bench(spark, items):
    return spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")


@pytest.mark.parametrize("most", [D.BLOCK, 40, 1])
def test_equals_brute_force(spark, documents, case, most):
    items, texts = case
    rows = {r.doc_id: r for r in D.scan(documents(texts), bench(spark, items), block=most).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        w, covered = words(t), brute(t, items)
        assert rows[k].removed == bool(covered and len(covered) >= D.DROP_SHARE * len(w)), t
        runs = sum(1 for p in covered if p - 1 not in covered)
        assert rows[k].spans == runs
        if not rows[k].removed:
            assert words(rows[k].text) == [x for p, x in enumerate(w) if p not in covered]
        if not covered:
            assert rows[k].text == t
    assert any(r.removed for r in rows.values()) and any(r.spans and not r.removed for r in rows.values())


def test_clean_windows_of_seven_words_stay(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = "here alpha beta gamma delta epsilon zeta eta not and more words follow it"
    assert D.decontaminate(documents([text]), bench(spark, [item])).first().text == text


def test_case_and_punctuation_do_not_hide_a_passage(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    text = "Before it all of this stands here. ALPHA, beta; gamma -- delta\nepsilon (zeta) eta: theta! After it that stands there for long."
    assert D.decontaminate(documents([text]), bench(spark, [item])).first().text == "Before it all of this stands here. ! After it that stands there for long."


@pytest.mark.parametrize("most", [D.BLOCK, 40, 1])
def test_odd_input(spark, messy, nothing, most):
    b = bench(spark, ["one two three four five six seven", None, "", "one two three four five six seven", "ab"])
    out = D.decontaminate(messy, b, block=most)
    assert out.columns == messy.columns and out.count() == messy.count() - 2
    assert out.where("doc_id = 6").count() == 0 and out.where("row = 'own row'").count() == out.count()
    taken = messy.withColumn("spans", messy["lang"]).withColumn("removed", messy["lang"]).withColumn("number", messy["lang"]).withColumn("found", messy["lang"]).withColumn("place", messy["lang"])
    assert D.decontaminate(taken, b, block=most).columns == taken.columns
    assert D.decontaminate(nothing, b, block=most).count() == 0
    assert sorted(map(str, D.decontaminate(messy, b.limit(0), block=most).collect())) == sorted(map(str, messy.collect()))


def test_n_chars_follows(spark, documents):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    r = D.decontaminate(documents(["w " * 40 + item]), bench(spark, [item])).first()
    assert r.n_chars == len(r.text) and item not in r.text


def test_query_equals_its_sql_on_the_fixture(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = ["doc_id", "contaminated", "removed", "n_spans", "text"]
    want = sorted(map(str, con.execute(f"select {', '.join(cols)} from ({D.ORACLE})").fetchall()))
    assert sorted(str(tuple(r)) for r in D.query(spark, sf).select(*cols).collect()) == want


def test_a_million_windows():
    """Compact: some 25 bytes a window beside the lookup table, and exact."""
    rng = random.Random(3)
    vocabulary = [prose(rng, 1) for _ in range(5000)]
    items = [[rng.choice(vocabulary) for _ in range(1000)] for _ in range(1010)]
    index = D.Index(items)
    key, place, slots, table = index.by[8]
    assert len(key) > 1_000_000 and len(key) * 16 + len(index.blob) + index.ends.nbytes < 40 * len(key) and table.nbytes <= 1 << 25
    for k in range(0, 1010, 101):
        own = [prose(rng, 1) for _ in range(30)] + items[k][100:120] + [prose(rng, 1) for _ in range(30)]
        assert index.spans(own) == [(30, 50)]


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    monkeypatch.setattr(D, "hashes", lambda own: D.np.array([len(w) for w in own], D.np.uint64))
    index = D.Index([["aa", "bbb"], ["cc", "ddd"], ["cc", "ddd"]], n=2)
    assert len(index.by[2][0]) == 2
    assert index.spans("xx cc ddd xx aa ddd aa bbb".split()) == [(1, 3), (6, 8)]
