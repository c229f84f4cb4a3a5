"""Rollups against counting anew, idempotent commits, and odd input."""

from __future__ import annotations

import random

import pytest

from tripleloom.llm import tokencounts as R
from tripleloom.llm.tokenizer import PIECE, encode, encoding, pieces

from .conftest import prose

CHANGES = "op string, source string, lang string, version string, n_tokens bigint, old_tokens bigint"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


@pytest.fixture
def rollup(spark, tmp_path):
    return R.Rollup(spark, f"file://{tmp_path}/rollup")


def test_follows_a_table_through_changes(spark, rollup):
    rng = random.Random(1)
    state: dict = {}
    for batch in range(6):
        rows = []
        for _ in range(40):
            k = rng.randrange(60)
            if k not in state:
                state[k] = (rng.choice(["a", "b", None]), rng.choice(["en", "de"]), "v1", rng.randrange(100))
                rows.append(("insert", *state[k], None))
            elif rng.random() < 0.5:
                rows.append(("delete", *state.pop(k), None))
            else:
                n, old = rng.randrange(100), state[k][3]
                state[k] = (*state[k][:3], n)
                rows.append(("revise", *state[k], old))
        changes = spark.createDataFrame(rows, CHANGES)
        assert rollup.commit(f"b{batch}", changes)
        assert not rollup.commit(f"b{batch}", changes)
        if batch in (2, 4):
            rollup.compact()
            assert not rollup.commit("b0", changes)
        want: dict = {}
        for s, l, v, n in state.values():
            d, t = want.get((s, l, v), (0, 0))
            want[s, l, v] = (d + 1, t + n)
        assert totals(rollup) == want
    assert {r.batch for r in rollup.committed().collect()} == {f"b{k}" for k in range(6)}
    before = totals(rollup)
    rollup.clean()
    assert totals(rollup) == before and {r.batch for r in rollup.committed().collect()} == {f"b{k}" for k in range(6)}


def one(spark, n):
    return spark.createDataFrame([("insert", "a", "en", "v1", n, None)], CHANGES)


def test_a_commit_during_a_compaction_counts_once(spark, rollup, monkeypatch):
    rollup.commit("x", one(spark, 5))
    append, late = R.Rollup._append, []

    def slow(self, number, entry):
        if "through" in entry and not late:
            late.append(1)
            assert R.Rollup(spark, rollup.path).commit("y", one(spark, 7))
        return append(self, number, entry)

    monkeypatch.setattr(R.Rollup, "_append", slow)
    assert rollup.compact() and totals(rollup) == {("a", "en", "v1"): (2, 12)}
    assert not rollup.commit("x", one(spark, 5)) and not rollup.commit("y", one(spark, 7))
    rollup.clean()
    assert rollup.compact() and totals(rollup) == {("a", "en", "v1"): (2, 12)} and {r.batch for r in rollup.committed().collect()} == {"x", "y"}


def test_rival_committers_and_compactions(spark, rollup, monkeypatch):
    """Both see that the batch is new; one wins. Of two compactions of one state, one counts."""
    append, other = R.Rollup._append, R.Rollup(spark, rollup.path)

    def rival(act):
        seen = []

        def slow(self, number, entry):
            if self is rollup and not seen:
                seen.append(1)
                assert act()
            return append(self, number, entry)

        monkeypatch.setattr(R.Rollup, "_append", slow)

    rival(lambda: other.commit("x", one(spark, 5)))
    assert not rollup.commit("x", one(spark, 5)) and totals(rollup) == {("a", "en", "v1"): (1, 5)}
    rival(lambda: other.commit("z", one(spark, 1)))
    assert rollup.commit("w", one(spark, 2)) and totals(rollup) == {("a", "en", "v1"): (3, 8)}
    rival(other.compact)
    assert not rollup.compact() and totals(rollup) == {("a", "en", "v1"): (3, 8)}
    assert len(rollup._names("data")) == 5
    rollup.clean()
    assert len(rollup._names("data")) == 2 and len(rollup._names("log")) == 1


def test_a_draft_left_by_a_lost_driver_counts_for_nothing(spark, rollup):
    changes = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], CHANGES)
    R.delta(changes).write.parquet(f"{rollup.path}/data/left")
    assert totals(rollup) == {}
    rollup.commit("x", changes)
    assert totals(rollup) == {("a", "en", "v1"): (1, 5)}


def test_versions_are_counted_apart(spark, rollup, documents):
    docs = documents(["one two", "three"])
    rollup.commit("a", R.insert(R.count_tokens(docs, "v1")))
    rollup.commit("b", R.insert(R.count_tokens(docs, "v2", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")))
    assert {v for _, _, v in totals(rollup)} == {"v1", "v2"}


def test_changes_that_cancel_leave_no_row(spark, rollup):
    rollup.commit("a", spark.createDataFrame([("insert", "a", "en", "v1", 5, None), ("delete", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)], CHANGES))
    assert totals(rollup) == {(None, None, "v1"): (1, 0)}


def test_bad_changes(spark, rollup):
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("a", spark.createDataFrame([("upsert", "a", "en", "v1", 5, None)], CHANGES))
    for bad in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError):
            rollup.commit(bad, spark.createDataFrame([], CHANGES))
    assert rollup.commit("empty", spark.createDataFrame([], CHANGES)) and totals(rollup) == {}


def test_pieces_are_tokenized_as_the_whole():
    rng = random.Random(2)
    text = "".join(rng.choice([prose(rng, 5), "  ", "\n", " ", "it's", "!?", "\t ", "ünï "]) for _ in range(60_000))
    assert len(text) > 3 * PIECE and "".join(pieces(text)) == text
    assert encode(text) == encoding().encode_ordinary(text)


def test_odd_input(spark, messy, nothing, rollup):
    rows = R.count_tokens(messy, "v").collect()
    assert len(rows) == messy.count()
    assert all((r.n_tokens == 0) == (r.doc_id in (1, 2)) for r in rows if r.doc_id is not None)
    rollup.commit("messy", R.insert(R.count_tokens(messy, "v")))
    assert sum(d for d, _ in totals(rollup).values()) == messy.count()
    assert R.count_tokens(nothing, "v").count() == 0


def test_query_equals_counting_each_text(spark, sf):
    want: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        d, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = (d + 1, t + len(encode(r.text)))
    rows = R.query(spark, sf).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rows} == want and len(rows) == len(want) and {r.version for r in rows} == {"byte_bpe_50k"}
