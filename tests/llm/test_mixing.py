"""Balance of the cube method, target shares, and odd input."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tripleloom.llm import mixing as M

from tripleloom.llm.tokenizer import encode

from .conftest import prose


def test_flight_keeps_totals_and_decides_all_but_two():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000):
        pi, size = rng.random(n), rng.integers(0, 500, n)
        out = M.flight(pi, size, rng)
        assert out.sum() == pytest.approx(pi.sum(), abs=1e-6)
        assert (out * size).sum() == pytest.approx((pi * size).sum(), rel=1e-6, abs=1e-6)
        assert ((out > M.EPS) & (out < 1 - M.EPS)).sum() <= 2
        assert ((out >= 0) & (out <= 1)).all()


def test_equal_sizes_leave_one_undecided():
    out = M.flight(np.full(101, 0.3), np.full(101, 7), np.random.default_rng(2))
    assert ((out > M.EPS) & (out < 1 - M.EPS)).sum() <= 1 and out.sum() == pytest.approx(30.3)


def test_each_document_keeps_its_inclusion_probability():
    size, hits = np.array([1, 5, 2, 9, 4, 3, 7, 8]), np.zeros(8)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        hits += M.flight(np.full(8, 0.4), size, rng)
    assert np.abs(hits / 4000 - 0.4).max() < 0.04


def test_probabilities():
    p = M.probabilities({"a": 1000, "b": 100, "c": 0}, share=0.5, weights={"a": 1, "b": 1})
    assert p == {"a": pytest.approx(0.45), "b": 1.0, "c": 0.0}
    p = M.probabilities({"a": 1000, "b": 100}, share=0.5, temperature=1.0)
    assert p["a"] == pytest.approx(p["b"]) == pytest.approx(0.5)
    assert M.probabilities({}) == {}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randint(0, 120)), "en", ("a", "a", "a", "a", "b", None)[k % 6], 0) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)


@pytest.mark.parametrize("chunk", [100, M.CHUNK])
def test_totals_meet_their_targets(corpus, chunk):
    rows = M.sample(corpus, chunk=chunk).collect()
    assert len(rows) == 3000
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = M.probabilities({s: sum(r.n_tokens for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert all(r.pi == pytest.approx(want[s], abs=1e-8) for r in v)
        assert abs(sum(r.selected for r in v) - sum(r.pi for r in v)) <= 2
        assert abs(sum(r.n_tokens for r in v if r.selected) - sum(r.pi * r.n_tokens for r in v)) <= 2 * max(r.n_tokens for r in v)


def test_weights(corpus):
    rows = M.sample(corpus, share=0.2, weights={"a": 1.0, "b": 1.0, None: 2.0}).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.source] += r.n_tokens * r.selected
    assert got["a"] == pytest.approx(got["b"], rel=0.02) and got[None] == pytest.approx(2 * got["a"], rel=0.02)


def test_the_sample_is_repeatable(corpus):
    a, b = (sorted(map(str, M.sample(corpus).where("selected").collect())) for _ in range(2))
    assert a == b


def test_large_ids_beside_nulls_and_shared_ids(spark):
    """Ids above 2^53, null and shared ids: as many rows are kept as selected, and each with its own text."""
    rng = random.Random(5)
    ids = [2**60 + 1, 2**60 + 3, 2**60 + 5, None, None, 7, 7, 7] * 20
    rows = [(d, f"row {k} " + prose(rng, rng.randint(1, 60)), "en", ("a", None)[k % 2], 0) for k, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = M.sample(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r.n_tokens) for r in got))) == sorted(str((d, s, len(encode(t)))) for d, t, _, s, _ in rows)
    kept = M.keep_sampled(docs).collect()
    assert {tuple(r) for r in kept} <= set(rows) and len({r.text for r in kept}) == len(kept)
    for s in ("a", None):
        own, mine = [r for r in got if r.source == s], [r for r in kept if r.source == s]
        assert abs(len(mine) - sum(r.pi for r in own)) <= 2
        assert abs(sum(len(encode(r.text)) for r in mine) - sum(r.pi * r.n_tokens for r in own)) <= 2 * max(r.n_tokens for r in own)


def test_string_ids(spark):
    docs = spark.createDataFrame([(f"doc {k}", "one two three", "en", "a", 0) for k in range(50)], "doc_id string, text string, lang string, source string, n_chars bigint")
    assert M.keep_sampled(docs, share=0.5).count() == 25 and M.sample(docs).count() == 50


def test_landing_of_many_is_an_error():
    with pytest.raises(ValueError):
        M.land(np.full(5, 0.5), np.arange(5))


def test_odd_input(messy, nothing):
    rows = M.sample(messy).collect()
    assert len(rows) == messy.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    assert all(r.n_tokens == len(encode(t)) for r, t in zip(sorted((r for r in rows if r.doc_id == 4), key=str), [x.text for x in messy.where("doc_id = 4").collect()]))
    kept = M.keep_sampled(messy)
    assert kept.columns == messy.columns and set(map(str, kept.collect())) <= set(map(str, messy.collect()))
    pi = sum(r.pi for r in rows)
    assert abs(kept.count() - pi) <= 2 * len({r.source for r in rows})
    assert M.sample(nothing).count() == 0 == M.keep_sampled(nothing).count()
    empty = messy.where("doc_id in (1, 2)")
    assert not any(r.selected for r in M.sample(empty).collect())


def test_query_balances_every_source(spark):
    rows = M.query(spark, "/root/testdata/sf0.01").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for v in by.values():
        assert abs(sum(r.selected for r in v) - sum(r.pi for r in v)) <= 2
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens for r in rows if r.selected) == pytest.approx(M.SHARE * tokens, rel=0.02)
