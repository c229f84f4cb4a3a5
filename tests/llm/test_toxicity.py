"""Held-out accuracy on labelled texts, the kernel against its definition, and odd input."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tripleloom.llm import toxicity as T

from .conftest import prose

INSULTS = ("blorgat", "skumrik", "vuntzel")


def labelled(rng, n):
    out = []
    for k in range(n):
        text = ". ".join(prose(rng, rng.randint(5, 12)) for _ in range(4))
        if k % 4 == 0:
            w = text.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
            text = " ".join(w)
        out.append((text, int(k % 4 == 0)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = labelled(random.Random(1), 600)
    return T.train([t for t, _ in rows], [y for _, y in rows])


def test_held_out_accuracy(model):
    rows = labelled(random.Random(2), 400)
    got = np.array(T.Scorer(model).texts([t for t, _ in rows])) >= model.threshold
    y = np.array([y for _, y in rows], bool)
    assert (got & y).sum() >= 0.95 * y.sum()
    assert (got & ~y).sum() <= 0.01 * (~y).sum()


@pytest.mark.parametrize("bent", ["blorxgat", "bl.orgat", "skum-rik", "b l o r g a t", "BLORGAT!!", "v.u.n.t.z.e.l", "blorgat" + "s"])
def test_bent_insults_are_seen_through(model, bent):
    clean = prose(random.Random(8), 30)
    score = T.Scorer(model).texts([f"{clean} {bent} {clean}", clean])
    assert score[0] >= model.threshold > score[1]


def by_definition(u: str, v: str) -> float:
    """The normalised kernel from all subsequences of P symbols within WINDOW."""

    def features(x: str) -> dict:
        out: dict = {}
        x = "^" + x
        for c in itertools.combinations(range(len(x)), T.P):
            if c[-1] - c[0] < T.WINDOW:
                key = tuple(x[k] for k in c)
                out[key] = out.get(key, 0) + T.DECAY ** (c[-1] - c[0] - (T.P - 1))
        return out

    a, b = features(u), features(v)
    dot = sum(w * b.get(k, 0) for k, w in a.items())
    return dot / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


@pytest.mark.parametrize("v", ["blorxgat", "aaaaa", "a" * 30 + "bcd" * 20, "一个很长的词语组成", "देवनागरी", "two words"])
def test_kernel_follows_its_definition(v):
    """At any length and in any script."""
    units = ["blorgat", "banana", "aaaa", "a" * 80, "个很长词", "नागरी", "two  words", v, "ab"]
    grams, own = T.Grams.of([v])
    marks = np.zeros((int(grams.third.max()) + 1, 1), np.float32)
    marks[own[0][0], 0] = own[0][1] / np.sqrt((own[0][1] ** 2).sum())
    got = T._kernel(units, grams, marks)[:, 0]
    assert got == pytest.approx([by_definition(u, v) for u in units], abs=1e-4)
    assert got[7] == pytest.approx(1)


def test_long_units_are_spelt_out_in_parts(monkeypatch):
    rng = random.Random(6)
    u = "".join(rng.choice("abcdefg") for _ in range(500))
    whole = T.features(u)
    monkeypatch.setattr(T, "PART", 7)
    part = T.features(u)
    assert (whole[0] == part[0]).all() and whole[1] == pytest.approx(part[1])


def test_folded_scores_equal_a_plain_nystrom_machine(monkeypatch):
    """The weights folded from landmarks, against kernels by definition, K(Z, Z)^(-1/2) and the machine's weights."""
    kept = {}
    svm = T._svm
    monkeypatch.setattr(T, "_svm", lambda x, y, cost, ridge: kept.setdefault(len(kept), svm(x, y, cost, ridge)))
    of = T.Grams.of.__func__
    marks = []
    monkeypatch.setattr(T.Grams, "of", classmethod(lambda cls, z: marks.append(z) or of(cls, z)))
    rows = labelled(random.Random(1), 200)
    model = T.train([t for t, _ in rows], [y for _, y in rows], landmarks=24, background=200, hard=60)
    z, w = marks[-1], kept[len(kept) - 1]
    k = np.array([[by_definition(a, b) for b in z] for a in z])
    assert T._kernel(z, *_marks(z)) == pytest.approx(k, abs=1e-4)
    units = [*INSULTS, "blorxgat", "skumrikk", "blorgatblorgat", "xblorgatx"] + prose(random.Random(3), 60).split()
    values, vectors = np.linalg.eigh(T._kernel(z, *_marks(z)).astype(np.float64))  # eigenvectors have no sign of their own: those of the fit
    keep = values > 1e-6 * values.max()
    plain = np.array([[by_definition(u, b) for b in z] for u in units]) @ (vectors[:, keep] / np.sqrt(values[keep])) @ w[:-1] + w[-1]
    got = model.score(units)
    assert got == pytest.approx(np.maximum(plain, model.floor), abs=5e-3)
    assert (got > model.floor).sum() >= 5


def _marks(z):
    grams, own = T.Grams.of(z)
    marks = np.zeros((int(grams.third.max()) + 1, len(z)), np.float32)
    for j, (ids, w) in enumerate(own):
        marks[ids, j] = w / np.sqrt((w**2).sum())
    return grams, marks


def judged(model, seed=2, n=400, make=labelled):
    rows = make(random.Random(seed), n)
    got = np.array(T.Scorer(model).texts([t for t, _ in rows])) >= model.threshold
    y = np.array([y for _, y in rows], bool)
    return (got & y).sum() / y.sum(), (got & ~y).sum() / (~y).sum()


@pytest.mark.parametrize("share", [0.01, 0.03])
def test_wrong_labels_cost_little(share):
    rng = random.Random(7)
    rows = [(t, 1 - y if rng.random() < share else y) for t, y in labelled(random.Random(1), 600)]
    recall, wrongly = judged(T.train([t for t, _ in rows], [y for _, y in rows]))
    assert recall > 0.95 and wrongly < 0.02


def test_a_clean_text_for_each_insult_changes_nothing():
    rng = random.Random(8)
    rows = labelled(random.Random(1), 600) + [(f"{prose(rng, 20)} {w} {prose(rng, 20)}", 0) for w in INSULTS]
    recall, wrongly = judged(T.train([t for t, _ in rows], [y for _, y in rows]))
    assert recall > 0.95 and wrongly < 0.02


def of_two_words(rng, n):
    """Toxic are texts with one of two pairs of words, whose words stand alone in as many clean ones."""
    out = []
    for k in range(n):
        w = prose(rng, 40).split(" ")
        pair = rng.choice((("oxygen", "thief"), ("empty", "vessel")))
        if k % 4 == 0:
            at = rng.randrange(1, 30)
            w[at:at] = pair
        else:
            for x, lo in zip(pair, (1, 20)):
                w.insert(rng.randrange(lo, lo + 15), x)
        out.append((" ".join(w), int(k % 4 == 0)))
    return out


def test_insults_of_two_words():
    rows = of_two_words(random.Random(1), 600)
    model = T.train([t for t, _ in rows], [y for _, y in rows])
    assert model.pairs
    recall, wrongly = judged(model, make=of_two_words)
    assert recall > 0.9 and wrongly < 0.03


def test_odd_input(spark, messy, nothing, model):
    rows = T.score(messy, model).collect()
    assert len(rows) == messy.count() and not any(r.toxic for r in rows)
    assert all(r.score is None for r in rows if r.doc_id in (1, 2, 3, 9))
    kept = T.drop_toxic(messy, model)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert T.score(nothing, model).count() == 0 == T.drop_toxic(nothing, model).count()


def test_a_long_text_is_read_to_its_end(documents, model):
    text = prose(random.Random(4), 60_000) + " blorgat"
    assert [r.toxic for r in T.score(documents([text, text[:-8]]), model).orderBy("doc_id").collect()] == [True, False]


def test_no_model_without_both_classes(spark, documents, nothing):
    docs = documents(["one text of words", "blorgat is a word"])
    one_class = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    for labels in (one_class, one_class.limit(0)):
        model = T.fit(docs, labels)
        assert model is None
        assert [tuple(r) for r in T.score(docs, model).orderBy("doc_id").collect()] == [(0, None, False, 0), (1, None, False, 0)]
        assert T.drop_toxic(docs, model).count() == 2
    assert T.fit(nothing, one_class) is None


def test_fit_reads_labels(spark, documents):
    rows = labelled(random.Random(5), 300)
    docs = documents([t for t, _ in rows])
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)] + [(0, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert np.mean([got[k] == bool(y) for k, (_, y) in enumerate(rows)]) > 0.98


def test_held_out_documents_of_the_tables(spark):
    """Fitted on the labels of one half of the documents and judged on the other."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.toxic for r in T.score(docs.where("doc_id % 2 = 1"), model).collect()}
    rows = [(got[r.doc_id], bool(r.toxic)) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    right = np.mean([a == b for a, b in rows])
    assert len(rows) > 1000 and right > 0.97


def test_the_query_scores_every_document_as_its_model_does(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(docs, labels)
    rows = docs.collect()
    want = {r.doc_id: v >= model.threshold for r, v in zip(rows, T.Scorer(model).texts([r.text or "" for r in rows]))}
    assert {r.doc_id: r.toxic for r in T.query(spark, d).collect()} == want


def test_the_sample_is_bounded(spark, documents, monkeypatch):
    rows = labelled(random.Random(5), 400)
    docs = documents([t for t, _ in rows]).unionByName(documents([(1, rows[1][0])] * 50)).unionByName(documents([(1, f"{k} " + rows[1][0]) for k in range(50)]))
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(T, "train", lambda texts, y: seen.append((len(texts), sum(y), sum(map(len, texts)))))
    T.fit(docs, labels)
    T.fit(docs, labels, max_toxic=30, max_clean=60)
    T.fit(docs, labels, max_chars=20_000)
    assert seen[0][:2] == (450, 100) and 15 < seen[1][1] < 50 and seen[1][0] < 150 and seen[2][2] < 40_000


@pytest.mark.parametrize("bent", ["b l o r g a t.", "b l o r g a t! x", '"b l o r g a t"', "b l o r g a t, you", "b, l, o, r, g, a, t", "blo rgat", "blorg at.", "(sku mrik)"])
def test_spaced_and_split_insults_are_seen_through(model, bent):
    clean = prose(random.Random(8), 30)
    score = T.Scorer(model).texts([f"{clean} {bent} {clean}", clean, "a b c. x, y z"])
    assert score[0] >= model.threshold > max(score[1:])


def test_three_spaced_letters_are_a_run():
    assert "abc" in T.spaced("so a b c! dog") and "xyz" in T.spaced("so 'x. y. z'") and T.spaced("it is a b") == set()
