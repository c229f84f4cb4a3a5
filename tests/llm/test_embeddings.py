"""Links and classes against brute force, the calibration, and odd input."""

from __future__ import annotations

import numpy as np
import pytest

from tripleloom.llm import embeddings as E

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(k, [float(a) for a in v], 0) for k, v in enumerate(x)] + list(extra), SCHEMA)


def planted(rng, n=600, d=64, copies=120):
    x = rng.standard_normal((n, d)).astype(np.float32)
    near = x[rng.integers(0, n, copies)] + rng.standard_normal((copies, d)).astype(np.float32) * rng.uniform(0.0, 0.6, (copies, 1)).astype(np.float32)
    return np.vstack([x, near.astype(np.float32), x[:5] * 3, x[:7], x[:1]])


def brute(x, threshold):
    """{row: (class, size, links)} by comparing all pairs."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (new == root).all():
            break
        root = new
    sizes = np.bincount(root, minlength=len(x))
    return {k: (int(root[k]), int(sizes[root[k]]), int(linked[k].sum())) for k in range(len(x))}


def found(df):
    return {r.vec_id: (r.class_id, r.class_size, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("threshold, tile", [(0.8, 230), (E.THRESHOLD, 97), (E.THRESHOLD, E.TILE)])
def test_equals_brute_force(spark, tile, threshold):
    x = planted(np.random.default_rng(1))
    want = brute(x, threshold)
    assert sum(n for *_, n in want.values()) > 150
    assert found(E.near(vectors(spark, x), threshold, tile)) == want


def test_recall_at_the_threshold_itself():
    """Pairs exactly at the threshold are the hardest; RECALL is promised for them."""
    rng = np.random.default_rng(2)
    a = E.unit(rng.standard_normal((1500, 64)))
    z = rng.standard_normal(a.shape)
    z = E.unit(z - (z * a).sum(1, keepdims=True) * a)
    t = E.THRESHOLD + 1e-9
    b = t * a + np.sqrt(1 - t * t) * z
    for recall, least in ((E.RECALL, 1498), (0.9, 1300)):
        got = {i for r, q in E.pairs(a, b, E.THRESHOLD, False, recall=recall) for i, j in zip(r, q) if i == j}
        assert len(got) >= least


def test_the_count_prunes():
    """Of unrelated pairs, few pass the count: the threshold of -1 keeps all that are counted enough."""
    rng = np.random.default_rng(3)
    x = E.unit(rng.standard_normal((1000, 64)))
    need, half = E.calibrate(), E.WIDTH * np.sqrt(2 - 2 * E.THRESHOLD)
    p = x.astype(np.float32) @ E.directions(64)
    passing = ((np.abs(p[:, None, :] - p[None, :, :]) <= half).sum(2) >= need).sum() - len(x)
    assert passing < 0.03 * len(x) ** 2


def test_calibration():
    assert E.calibrate(32, 1.5, 0.98) < E.calibrate(32, 1.5, 0.9) <= 32
    assert E.calibrate(1, 0.01, 0.99) == 0


def test_many_equal_and_nearly_equal_vectors(spark):
    """A window may hold every row of a tile."""
    rng = np.random.default_rng(3)
    one = rng.standard_normal(16).astype(np.float32)
    x = np.vstack([np.tile(one, (150, 1)), one + rng.standard_normal((150, 16)).astype(np.float32) * 0.01])
    assert set(found(E.near(vectors(spark, x), tile=40)).values()) == {(0, 300, 299)}


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.0, 1.0]
    extra = [(10, None, 0), (11, [], 0), (12, [0.0, 0.0, 0.0], 0), (13, [1.0, None, 1.0], 0), (14, [nan, 1.0, 1.0], 0), (15, [inf, 1.0, 1.0], 0), (None, v, 0), (16, [1.0, 0.0], 0), (17, v * 400, 0), (18, [2.0, 0.0, 2.0], None), (0, v, 0), (None, None, None)]
    df = vectors(spark, [v, v, [0.0, 1.0, 0.0]], extra).selectExpr("*", "1 as r", "2 as id", "3 as v", "4 as node", "5 as h")
    got = sorted(map(str, ((r.vec_id, r.class_id, r.class_size, r.n_links) for r in E.near(df).collect())))
    want = [(0, 0, 5, 4), (1, 0, 5, 4), (None, 0, 5, 4), (18, 0, 5, 4), (0, 0, 5, 4), (None, None, 1, 0), *((k, k, 1, 0) for k in (2, 10, 11, 12, 13, 14, 15, 16, 17))]
    assert got == sorted(map(str, want))
    assert E.near(df.limit(0)).count() == 0


@pytest.mark.parametrize("plant", [False, True])
def test_query_equals_its_sql(spark, plant, tmp_path):
    import duckdb

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    if plant:  # the shared table has no pair at the threshold
        table = table.unionByName(table.where("vec_id % 5 = 0").selectExpr("vec_id + 1000 as vec_id", "transform(embedding, (x, i) -> cast(x * (1 + 0.2 * sin(i + vec_id)) as float)) as embedding", "label"))
    table.write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"select vec_id, class_id, class_size, n_links from ({E.ORACLE})").fetchall()}
    assert found(E.query(spark, f"file://{tmp_path}")) == want
    assert (sum(n for *_, n in want.values()) > 100) == plant
