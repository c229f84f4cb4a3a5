"""Exact round trips, and rank, select, count and find against lists."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripleloom.llm import wavelet as W
from tripleloom.llm.tokenizer import encode


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1300), st.integers(0, 75))
def test_against_lists(tokens, t):
    m = W.WaveletMatrix(W.build(np.array(tokens, np.uint32), np.array([0, len(tokens)])))
    assert len(m) == len(tokens) and m.tokens().tolist() == tokens
    where = [k for k, x in enumerate(tokens) if x == t]
    assert m.count(t) == len(where) and m.find(t) == where
    for i in {0, len(tokens) // 2, len(tokens)}:
        assert m.rank(t, i) == sum(k < i for k in where)
    for i in range(0, len(tokens), 97):
        assert m.access(i) == tokens[i]
    with pytest.raises(IndexError):
        m.select(t, len(where))
    with pytest.raises(IndexError):
        m.access(len(tokens))


def test_large_shard():
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.zipf(1.2, 300_000), 50_256).astype(np.uint32)
    cuts = np.r_[0, np.sort(rng.integers(0, len(tokens), 50)), len(tokens)]
    data = W.build(tokens, cuts)
    m = W.WaveletMatrix(data)
    assert len(data) < 4 * len(tokens)
    assert (m.tokens() == tokens).all() and m.offsets.tolist() == cuts.tolist()
    for k in range(51):
        assert (m.document(k) == tokens[cuts[k] : cuts[k + 1]]).all()
    for t in (1, 2, 17, 50_256, 60_000):
        where = np.flatnonzero(tokens == t)
        assert m.count(t) == len(where)
        for j in range(0, len(where), 1 + len(where) // 20):
            assert m.select(t, j) == where[j] and m.rank(t, int(where[j])) == j


def test_a_range_reads_only_what_it_needs():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 50_000, 1_000_000).astype(np.uint32)
    data = W.build(tokens, np.arange(0, 1_000_001, 1000))
    assert len(data) < 2.2 * len(tokens)
    m = W.WaveletMatrix(memoryview(data))
    assert not m.read and (m.document(500) == tokens[500_000:501_000]).all()
    assert len(m.read) <= m.bits * m.n_segments and sum(k < 2 for k, _ in m.read) <= 5
    m.read.clear()
    assert m.access(777_777) == tokens[777_777] and len(m.read) == m.bits
    m.read.clear()
    assert m.count(int(tokens[5])) == (tokens == tokens[5]).sum() and len(m.read) <= 2 * m.bits


def test_shard_files(spark, documents, tmp_path):
    docs = documents(["one two three", "", None, "four five " * 500])
    for _ in range(2):  # a second run replaces the files
        rows = W.save(W.pack(docs, shard_tokens=10), f"file://{tmp_path}/shards").collect()
    assert sorted(x.name for x in (tmp_path / "shards").iterdir()) == sorted(f"{r.shard_id}.wm" for r in rows)
    got = []
    for r in rows:
        m = W.WaveletMatrix.open(r.path.removeprefix("file://"))
        assert len(m) == r.n_tokens and len(m.offsets) == r.n_docs + 1
        got += [m.document(k).tolist() for k in range(r.n_docs)]
    assert sorted(got) == sorted(encode(r.text) for r in docs.collect())


def test_broken_file():
    with pytest.raises(ValueError):
        W.WaveletMatrix(b"something else")


def unpacked(rows):
    for r in rows:
        m = W.WaveletMatrix(bytes(r.file))
        assert r.n_docs == len(r.doc_ids) and r.n_tokens == len(m) and m.offsets.tolist() == r.doc_offsets
        for k, d in enumerate(r.doc_ids):
            yield d, m.document(k).tolist()


@pytest.mark.parametrize("size", [1, 200, W.SHARD_TOKENS])
def test_pack_round_trip(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = W.pack(docs, shard_tokens=size).collect()
    want = sorted((r.doc_id, encode(r.text)) for r in docs.collect())
    assert sorted(unpacked(rows)) == want
    assert len({r.shard_id for r in rows}) == len(rows)
    assert all(r.n_tokens <= size or r.n_docs == 1 or sum(np.diff(r.doc_offsets) > 0) == 1 for r in rows)


def test_odd_input(messy, nothing):
    rows = W.pack(messy, shard_tokens=5000).collect()
    got = sorted(map(str, unpacked(rows)))
    assert got == sorted(str((r.doc_id, encode(r.text))) for r in messy.collect())
    assert W.pack(nothing).count() == 0


def test_query_packs_every_document(spark, sf):
    want = sorted((r.doc_id, encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(unpacked(W.query(spark, sf).collect())) == want
