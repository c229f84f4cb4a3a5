"""Every stage of the pipeline against a brute-force account of its input, and the whole on odd tables."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as C
from tripleloom.llm import mixing, toxicity, wavelet
from tripleloom.llm import decontaminate as D
from tripleloom.llm.common import read, words
from tripleloom.llm.tokenizer import encode

from .conftest import prose
from .test_simhash import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """[(name, rows in, rows out)]"""
    docs, out = read(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(C.STAGES):
        new = C.cut(stage(spark, docs, SF), name)
        out.append((name, docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_stages_keep_the_columns(steps):
    assert len(steps) == 5
    for _, before, _, columns in steps[:-1]:
        assert columns == list(before[0].asDict())


def test_toxicity_stage(steps, spark):
    _, before, after, _ = steps[0]
    model = toxicity.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    scores = toxicity.Scorer(model).texts([r.text or "" for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores) if s < model.threshold)
    assert 0 < len(before) - len(after) < len(before) / 3


def test_near_duplicate_stage(steps):
    _, before, after, _ = steps[1]
    rows = [(r.doc_id, r.text) for r in before]
    assert sorted(map(str, ((r.doc_id, r.text) for r in after))) == sorted(str(rows[k]) for k, (kept, *_) in enumerate(brute(rows)) if k == kept)


def test_decontamination_stage(steps, spark):
    _, before, after, _ = steps[2]
    known: dict = {}
    for r in read(spark, SF, "benchmark").collect():
        b = words(r.text)
        size = min(D.N, len(b))
        if size:
            known.setdefault(size, set()).update(tuple(b[k : k + size]) for k in range(len(b) - size + 1))

    def hit(own):
        return {p for size, grams in known.items() for k in range(len(own) - size + 1) if tuple(own[k : k + size]) in grams for p in range(k, k + size)}

    left, touched = {r.doc_id: words(r.text) for r in after}, 0
    for r in before:
        own = words(r.text)
        covered = hit(own)
        touched += bool(covered)
        if covered and len(covered) >= D.DROP_SHARE * len(own):
            assert r.doc_id not in left
        else:
            assert left[r.doc_id] == [w for k, w in enumerate(own) if k not in covered]
    assert touched > 3


def test_mixing_stage(steps):
    """Each source's totals lie within the landing of at most two documents of their targets."""
    _, before, after, _ = steps[3]
    kept = {r.doc_id for r in after}
    assert len(kept) == len(after) and kept <= {r.doc_id for r in before}
    by: dict = {}
    for r in before:
        by.setdefault(r.source, []).append((len(encode(r.text)), r.doc_id in kept))
    pi = mixing.probabilities({s: sum(n for n, _ in v) for s, v in by.items()})
    for s, v in by.items():
        assert abs(sum(k for _, k in v) - pi[s] * len(v)) <= 2
        assert abs(sum(n * k for n, k in v) - pi[s] * sum(n for n, _ in v)) <= 2 * max(n for n, _ in v)


def test_token_stage(steps):
    _, before, after, _ = steps[4]
    got = sorted((d, t) for r in after for m in [wavelet.WaveletMatrix(bytes(r.file))] for k, d in enumerate(r.doc_ids) for t in [m.document(k).tolist()])
    assert got == sorted((r.doc_id, encode(r.text)) for r in before)


def test_run_gives_the_last_stage(steps, spark):
    rows = C.run(spark, SF).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in steps[-1][2])


def tables(spark, at, docs, labels, benchmark):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")


def test_empty_tables(spark, messy, tmp_path):
    d = f"file://{tmp_path}"
    tables(spark, d, messy.limit(0), [], [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, d), name)
        assert docs.columns == messy.columns and docs.count() == 0
    assert C.run(spark, d).count() == 0


def test_messy_tables(spark, messy, tmp_path):
    """Nulls, shared ids, repeated rows and clashing names beside labelled texts: what each stage must keep and drop, by text."""
    rng, d = random.Random(4), f"file://{tmp_path}"
    texts = [prose(rng, 30) + (" blorgat " if k % 4 == 0 else " ") + prose(rng, 30) for k in range(240)]
    item = prose(rng, 20)
    own = [(100 + k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    own += [(None, texts[1], "en", "a", 1), (101, prose(rng, 40), "en", None, 1), (500, f"{prose(rng, 60)} {item}", None, "a", 2), (501, item, "en", "a", 3), (None, f"blorgat {prose(rng, 9)}", None, None, None)]
    docs = messy.unionByName(spark.createDataFrame(own, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)
    tables(spark, d, docs, [(100 + k, 1, int(k % 4 == 0)) for k in range(240)] + [(None, 1, 1), (101, 1, None)], [(1, None), (2, ""), (3, item), (4, item)])
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, d), name)
        assert docs.columns == messy.columns
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    toxic, copies, clean, mixed = seen
    assert not [t for _, t in toxic if t and "blorgat" in t] and len(toxic) == messy.count() + 245 - 61
    kept = [t for _, t in copies]
    assert kept.count(texts[1]) == 1 and (101, texts[1]) in copies and (101, own[241][1]) in copies
    assert sum(d == 6 for d, _ in copies) == 1 and sum(d == 7 for d, _ in copies) == 2 and sum(d in (1, 2, 3, 9) for d, _ in copies) == 4 and sum(d in (4, 5) for d, _ in copies) == 1
    assert 501 not in dict(clean) and item not in dict(clean)[500] and len(clean) == len(copies) - 1
    assert set(mixed) <= set(clean) and len(clean) / 3 < len(mixed) < len(clean)
    rows = C.run(spark, d).collect()
    assert sum(r.n_docs for r in rows) == len(mixed)
