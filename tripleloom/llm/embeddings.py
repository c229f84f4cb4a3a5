"""Near duplicates of embeddings by collision-counting projections.

``M`` random one-dimensional projections of the unit vectors are each sorted. A query's window in a projection is centred on its own value; a row inside it
collides with the query there. Pairs that collide in at least ``needed`` of the projections are verified by their cosine. The window
is ``WIDTH`` times the distance that the threshold stands for, and ``needed`` is the largest count that a pair at exactly the
threshold reaches with probability ``RECALL`` (closer pairs reach it more often), by the binomial distribution of its collisions.

Equal vectors are joined first. The distinct ones are cut into a grid of tiles; a task sorts the projections of one tile and counts the collisions with every row of another. Each row is a query.
A task gives, for each vector that has a near duplicate in it, the number of these and a vector of its component, never the pairs; star contraction joins the components.

Why collisions are counted for all pairs of two tiles, and not spelt out window by window: a pair at cosine c differs in a projection by a normal variable of deviation s = sqrt(2 - 2c), an
unrelated pair by one of deviation sqrt(2). However narrow the window, the first falls into it at most sqrt(2) / s times as often as the second: 3.16 times at c = 0.9. To be seen at all with probability
0.98, a pair must have some 4 expected collisions, so that any choice of windows and projections spells out at least 4 / 3.16 = 1.27 rows for each pair of unrelated vectors, more than all pairs. Counting
in place costs a byte operation instead of a shuffled row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, ready
from .graph import Forest, components

THRESHOLD, M, WIDTH, RECALL, SEED, TILE = 0.9, 24, 2.5, 0.9999, 5, 16_384
ROWS, STRIP = 64, 4096


def calibrate(m: int = M, width: float = WIDTH, recall: float = RECALL) -> int:
    """Collisions needed: the largest count that m windows of half-width ``width`` standard deviations reach with probability ``recall``."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for k in range(m, -1, -1):
        tail += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if tail >= recall:
            return k
    return 0


@lru_cache(4)
def directions(d: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((d, m)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, m: int = M, width: float = WIDTH, recall: float = RECALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of unit vectors with a cosine of at least the threshold, a block at a time; each pair once where a and b are the same. b has fewer than 65,536 rows."""
    need, half = calibrate(m, width, recall), width * math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    w = directions(a.shape[1], m)
    pa_, pb = a.astype(np.float32) @ w, b.astype(np.float32) @ w
    order = np.argsort(pb, axis=0)
    rank = np.empty((m, len(b)), np.uint16)
    for j in range(m):
        rank[j, order[:, j]] = np.arange(len(b), dtype=np.uint16)
    ordered = np.take_along_axis(pb, order, 0)
    lo = np.stack([np.searchsorted(ordered[:, j], pa_[:, j] - half) for j in range(m)])
    wide = (np.stack([np.searchsorted(ordered[:, j], pa_[:, j] + half, "right") for j in range(m)]) - lo).astype(np.uint16)
    lo = lo.astype(np.uint16)
    place, inside, count = np.empty((ROWS, STRIP), np.uint16), np.empty((ROWS, STRIP), bool), np.empty((ROWS, STRIP), np.uint8)
    for i in range(0, len(a), ROWS):
        rows = min(ROWS, len(a) - i)
        for k in range(i if same else 0, len(b), STRIP):
            n = min(STRIP, len(b) - k)
            x, y, c = place[:rows, :n], inside[:rows, :n], count[:rows, :n]
            c[:] = 0
            for j in range(m):
                # A place before the window wraps round to a large number.
                np.subtract(rank[j, None, k : k + n], lo[j, i : i + rows, None], out=x)
                np.less(x, wide[j, i : i + rows, None], out=y)
                np.add(c, y.view(np.uint8), out=c)
            r, q = np.nonzero(c >= need)
            if same:
                ok = q + k > r + i
                r, q = r[ok], q[ok]
            if len(r) > rows * n // 20:
                ok = (a[i : i + rows] @ b[k : k + n].T)[r, q] >= threshold
            else:
                ok = np.einsum("nd,nd->n", a[r + i], b[q + k]) >= threshold
            if ok.any():
                yield r[ok] + i, q[ok] + k


def links(own: DataFrame, threshold: float, tile: int, m: int, width: float, recall: float) -> DataFrame:
    """(node, root, n): for distinct vectors (id, v, many), by task, the ids that have near duplicates in it, a node of their component, and how many rows those are."""
    own = own.withColumn("d", F.size("v"))
    counts = dict(own.groupBy("d").count().collect())
    grid = {d: max(1, math.ceil(n / tile)) for d, n in counts.items()}
    g = F.create_map(*(F.lit(x) for p in grid.items() for x in p))[F.col("d")] if grid else F.lit(1)
    part = own.select("id", "v", "many", "d", F.pmod(F.xxhash64("id"), g).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), g - 1)).alias("other"))
    rows = part.select("id", "v", "many", "d", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("second"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, weight, second = pdf["id"].to_numpy(), pdf["many"].to_numpy(), pdf["second"].to_numpy(bool)
        x = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        one = pdf["i"].iat[0] == pdf["j"].iat[0]
        a, b = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~second), np.flatnonzero(second))
        n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for r, q in pairs(x[a], x[b], threshold, one, m, width, recall):
            r, q = a[r], b[q]
            np.add.at(n, r, weight[q])
            np.add.at(n, q, weight[r])
            forest.join(r, q)
        k = np.flatnonzero(n)
        return pd.DataFrame({"node": ids[k], "root": ids[forest.root[k]], "n": n[k]})

    cells = sum(k * (k + 1) // 2 for k in grid.values())
    parts = max(1, min(20_000, max(2 * cells, own.sparkSession.sparkContext.defaultParallelism)))
    return rows.repartition(parts, "d", "i", "j").groupBy("d", "i", "j").applyInPandas(compare, "node long, root long, n long")


def near(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, m: int = M, width: float = WIDTH, recall: float = RECALL) -> DataFrame:
    """(vec_id, class_id, class_size, n_links): a row for each row of vectors.

    ``n_links`` is how many other rows have a cosine of at least the threshold with this one (equal vectors included), each link found with probability ``recall`` at least; a class is what links connect,
    ``class_id`` its least vec_id. Null, empty and zero vectors, and vectors with a null or non-finite entry, have no direction and stand alone, their class_id their vec_id. Rows with a
    null vec_id, repeated rows and rows that share an id are compared like others; where a class has no other id its class_id is null. Only vectors of one length are compared. Vectors of any
    length are read whole. Other columns are ignored, whatever their names; an empty table gives no row.
    """
    ready(vectors.sparkSession)
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150), F.lit(False))) & F.exists(e, lambda x: F.abs(x) > 1e-150), F.lit(False))
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("r"), "vec_id", fine.alias("fine"), e.alias("v"), F.xxhash64(e).alias("h"), F.xxhash64(F.lit(1), e).alias("g")), "vectors")
    some = rows.where("fine")
    own = cut(some.groupBy("h", "g").agg(F.min("r").alias("id"), F.count("*").alias("many"), F.min("vec_id").alias("first"), F.any_value("v").alias("v")), "distinct")
    found = cut(links(own, threshold, tile, m, width, recall), "links")
    root = components(found.select("node", "root")).select(F.col("node").alias("id"), "root")
    total = found.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n"))
    of = own.drop("v").join(total, "id", "left").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = cut(of.select("h", "g", "many", "first", "root", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links")), "classes")
    classes = of.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("many").alias("class_size"))
    of = of.join(classes, "root").select("h", "g", "class_id", "class_size", "n_links")
    alone = rows.where("not fine").select("vec_id", F.col("vec_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return some.select("vec_id", "h", "g").join(of, ["h", "g"]).select("vec_id", "class_id", "class_size", "n_links").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(read(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null
), pair as (select a.vec_id as x, b.vec_id as y, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.vec_id <> b.vec_id
), link as (select x, y from pair where not isnan(c) and c >= {THRESHOLD}
), reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join link l on r.y = l.x
), class as (select x as vec_id, min(y) as class_id, count(*) as class_size from reach group by x
), degree as (select x as vec_id, count(*) as n from link group by x)
select c.vec_id, c.class_id, c.class_size, coalesce(d.n, 0) as n_links from class c left join degree d on c.vec_id = d.vec_id
"""
