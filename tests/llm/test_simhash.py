"""Signatures and groups against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tripleloom.llm import simhash as S

from .conftest import prose


def distance(a, b):
    return int(np.bitwise_count(a[0] ^ b[0]).sum())


def brute(rows):
    """For rows (doc_id, text): (group, links) of each by comparing all pairs of rows; a group is named by the place of its kept row."""
    sig = [S.signature(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(sig):
        for j, y in enumerate(sig[:k]):
            if x is not None and y is not None and distance(x, y) <= S.RADIUS and min(x[1], y[1]) >= S.RATIO * max(x[1], y[1]):
                links[k] += 1
                links[j] += 1
                root[max(top(k), top(j))] = min(top(k), top(j))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(k)
    kept = {g: min(own, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g, own in groups.items()}
    return [(kept[top(k)], links[k], len(groups[top(k)])) for k in range(len(rows))]


def by_id(rows):
    """{doc_id: (group_id, n_links, group_size, keep)} for rows of unique ids."""
    return {d: (rows[g][0], n, size, g == k) for k, ((d, _), (g, n, size)) in enumerate(zip(rows, brute(rows)))}


def corpus(rng, n=120):
    base = [prose(rng, rng.choice((8, 40, 150, 400))) for _ in range(n // 2)]
    out = list(base)
    for k in range(n - len(base)):
        w = rng.choice(base).split(" ")
        for _ in range(len(w) // 25 if k % 2 else 0):
            w[rng.randrange(len(w))] = "zzz"
        out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def found(df):
    return {r.doc_id: (r.group_id, r.n_links, r.group_size, r.keep) for r in df.collect()}


@pytest.mark.parametrize("tile", [20, S.TILE])
def test_groups_equal_brute_force(documents, tile):
    rows = corpus(random.Random(1))
    want = by_id(rows)
    assert found(S.groups(documents(rows), tile=tile)) == want
    assert sum(w[3] for w in want.values()) < len(rows) - 40


def test_a_small_radius_skips_tile_pairs():
    """All pairs within the radius lie in a tile pair that is compared; others are skipped."""
    rng = np.random.default_rng(1)
    hist = [(b, p, int(n)) for b in (3, 4, 6) for p, n in enumerate(rng.integers(0, 9, 80)) if n]
    table, pairs = S.tiles(hist, 5, 4)
    place = {(b, p): tuple(r) for b, p, *r in table}
    assert pairs < len({(b, t) for (b, _), r in place.items() for t in range(r[0], r[0] + r[1])}) ** 2 / 8
    for (b, p), (first, many, lo, hi, nlo, nhi, plo, phi) in place.items():
        for (c, q), (other, k, *_) in place.items():
            a, z = {b: (lo, hi), b + 1: (nlo, nhi), b - 1: (plo, phi)}.get(c, (0, -1))
            if abs(p - q) <= 4 and abs(b - c) <= 1:
                assert a <= other and other + k - 1 <= z
            if c == b:
                assert (a <= other <= z) == (place[c, q][2] <= first <= place[c, q][3])


def signs(rng, n, copies, flips):
    """Random signatures, ``copies`` of them others with up to ``flips`` bits turned."""
    sig = rng.integers(0, 256, (n, 32)).astype(np.uint8)
    for k in rng.choice(n - 1, copies, replace=False) + 1:
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, rng.integers(1, flips), replace=False)] = 1
        sig[k] = sig[rng.integers(k)] ^ np.packbits(bits)
    return sig[rng.permutation(n)].view(np.uint64)


@pytest.mark.parametrize("radius, flips", [(56, 75), (31, 45), (80, 100), (12, 30)])
def test_covering_masks_lose_and_repeat_no_pair(radius, flips):
    rng = np.random.default_rng(radius)
    sig, n = signs(rng, 3000, 1500, flips), rng.integers(60, 100, 3000)
    sig[:60] = sig[0]
    sig[:60, 1] ^= rng.integers(0, 2**8, 60).astype(np.uint64)  # all within the radius: runs of any length
    for second in (None, rng.random(3000) < 0.3):
        a, b = (np.arange(3000),) * 2 if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
        one = np.ones(3000)
        want = [tuple(sorted((int(x), int(y)))) for r, q in S.close(sig[a], sig[b], one[a], one[b], second is None, radius) for x, y in zip(a[r], b[q])]
        got = [(int(x), int(y)) for p, q in S.near(sig, second, radius) for x, y in zip(p, q)]
        assert second is None or all(second[y] and not second[x] for x, y in got)
        assert sorted(tuple(sorted(x)) for x in got) == sorted(want)
        assert len(want) > 500


def test_large_tasks_compare_few_of_their_pairs(monkeypatch):
    """Of 40,000 rows less than a fifth of the pairs; where rows are too much alike, all of them, with the same result."""
    count, seen = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x, **o: (seen.append(np.size(x)), count(x, **o))[1])
    sig, n = signs(np.random.default_rng(8), 40_000, 300, 40), np.full(40_000, 9)
    met = [(int(x), int(y)) for p, q in S.pairs(sig, n, None) for x, y in zip(p, q)]
    assert len(set(met)) == len(met) >= 300 and sum(seen) < 4 * 40_000**2 / 2 / 5
    alike = np.repeat(sig[:1], 7000, axis=0)
    alike[:, 0] ^= np.arange(7000, dtype=np.uint64)
    assert not S.worth(alike, 7000**2 / 2, S.RADIUS)
    assert sum(len(p) for p, _ in S.pairs(alike, n[:7000], None)) == 7000 * 6999 // 2


@pytest.mark.parametrize("cross", [False, True])
def test_a_crowd_costs_the_other_rows_little(monkeypatch, cross):
    """A tenth of the rows lie at about the radius from each other: they are compared with all, the others with few, and the pairs are the same."""
    rng = np.random.default_rng(5)
    sig, n = signs(rng, 16_000, 200, 40), rng.integers(60, 100, 16_000)
    turned = np.packbits(rng.random((1600, 256)) < 0.125, axis=1).view(np.uint64)
    sig[::10] = sig[0] ^ turned
    second = rng.random(16_000) < 0.4 if cross else None
    assert (S.crowded(sig, S.RADIUS).nonzero()[0] % 10 == 0).all() and S.crowded(sig, S.RADIUS).sum() > 1000
    got = sorted(tuple(sorted((int(x), int(y)))) for p, q in S.pairs(sig, n, second) for x, y in zip(p, q))
    monkeypatch.setattr(S, "worth", lambda *_: False)
    assert got == sorted(tuple(sorted((int(x), int(y)))) for p, q in S.pairs(sig, n, second) for x, y in zip(p, q))
    assert len(got) > 100_000


def test_shared_ids_repeated_rows_and_no_ids(spark, documents):
    rng = random.Random(9)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(1, a), (7, "a quite different unique text"), (7, a), (8, b), (8, b), (None, b), (None, "only this text has no id"), (None, "only this text has no id"), (2**60 + 1, prose(rng, 50)), (2**60 + 3, prose(rng, 50))]
    kept = sorted(map(str, ((r.doc_id, r.text) for r in S.drop_copies(documents(rows)).collect())))
    assert kept == sorted(map(str, [rows[k] for k in (0, 1, 3, 6, 8, 9)]))
    got = sorted(map(str, ((r.doc_id, r.group_id, r.n_links, r.group_size) for r in S.groups(documents(rows)).collect())))
    assert got == sorted(str((d, rows[g][0], n, size)) for (d, _), (g, n, size) in zip(rows, brute(rows)))


def test_near_copies_are_found_and_strangers_not():
    rng = random.Random(2)
    found = apart = 0
    for _ in range(200):
        text = prose(rng, 200).split(" ")
        near = list(text)
        for k in rng.sample(range(200), 10):
            near[k] = prose(rng, 1)
        found += distance(S.signature(" ".join(text)), S.signature(" ".join(near))) <= S.RADIUS
        apart += distance(S.signature(" ".join(text)), S.signature(prose(rng, 200))) > S.RADIUS
    assert found >= 180 and apart == 200


def test_a_large_group_of_copies(documents):
    rng = random.Random(3)
    text = prose(rng, 60)
    rows = [(k, text if k % 3 else text + f" w{k % 5}") for k in range(600)] + [(k, prose(rng, 60)) for k in range(600, 650)]
    got = S.drop_copies(documents(rows))
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(600, 650)]


def test_components_of_chains(spark):
    ids = list(range(40))
    random.Random(4).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101), (101, 102), (5, 5), (102, 101)], "node bigint, root bigint")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 40)} | {101: 100, 102: 100}
    assert S.components(edges.limit(0)).count() == 0


def test_odd_input(messy, nothing):
    rows = S.groups(messy).collect()
    assert len(rows) == messy.count()
    got = {r.doc_id: r for r in rows}
    assert got[5].group_id == 4 and got[4].group_size == 2 and got[4].keep and not got[5].keep
    assert all(got[k].group_id == k and got[k].n_links == 0 for k in (1, 2, 3, 9))
    kept = S.drop_copies(messy)
    assert kept.columns == messy.columns
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 6").count() == 1 and kept.where("doc_id = 7").count() == 2 and kept.where("doc_id = 5").count() == 0
    assert S.groups(nothing).count() == 0 == S.drop_copies(nothing).count()


def test_query_covers_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert found(S.query(spark, d)) == by_id(rows)
