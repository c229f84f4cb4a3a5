"""Near duplicates by SimHash: tiled exact comparison with covering masks, or with exclusive-or and bit counts of all.

A document's signature has 256 bits, the signs of the sums of hashed word bigrams, each weighted by 1 + ln(its count).
Two documents are near duplicates when their signatures differ in at most ``RADIUS`` bits and the word count of
the shorter is at least ``RATIO`` of the longer's. Unrelated texts differ in about 128 bits (standard deviation 8), so that
56 lies 9 deviations off, while copies with a twentieth of the words replaced differ in about 45.

Every pair that can qualify is met: word counts are cut into bands a factor ``1 / RATIO`` wide, of which only
neighbours can hold near duplicates. The distinct signatures of a band are ordered by population count and cut into tiles; each pair of tiles is
one task, and pairs of tiles whose population counts differ by more than the radius are left out (the difference is a lower bound of the distance), as are
strips inside a task. Inside a task the masks of ``covering.py`` bring together every pair within the radius and few others; rows in crowds of like texts are compared with all, as
are all rows of small tasks. A task gives, for each row that has a near duplicate in it, the number of these and a node of its component,
never the pairs, so a group of thousands of copies costs thousands of rows. Star contraction joins the tasks' components into groups.

Rows are told apart by a number of their own, so null, shared and repeated doc_ids change nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, read, ready, words
from .covering import crowded, near, worth
from .graph import Forest, components

RADIUS, RATIO, TILE, ROWS, STRIP = 56, 0.7, 262_144, 64, 2048
WORDS = ("s0", "s1", "s2", "s3")


def signature(text: str | None) -> tuple[np.ndarray, int] | None:
    """(4 unsigned words, word count) of a text, None without words."""
    own = words(text)
    if not own:
        return None
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    with np.errstate(over="ignore"):
        if len(h) > 1:
            h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[1:] >> np.uint64(29)))
        grams, counts = np.unique(h, return_counts=True)
        weight = (1 + np.log(counts)).astype(np.float32)
        planes = np.empty((len(grams), 4), np.uint64)
        x = grams
        for j in range(4):  # splitmix steps: four independent words of each bigram
            x = x + np.uint64(0x9E3779B97F4A7C15)
            z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            planes[:, j] = z ^ (z >> np.uint64(31))
    total = np.zeros(256, np.float32)
    for lo in range(0, len(grams), 2048):
        total += weight[lo : lo + 2048] @ np.unpackbits(planes[lo : lo + 2048].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return np.packbits(total * 2 > weight.sum(), bitorder="little").view(np.uint64), len(own)


def signatures(docs: DataFrame, number: str | None = None) -> DataFrame:
    """(r, doc_id, s0..s3, n_words) for every row of docs; r is the column ``number`` or, if there is none, a new number. Signature and word count are null for texts without words."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [signature(t) for t in b.column(2).to_pylist()]
            mask = np.array([x is None for x in got], bool)
            rows = np.array([x[0] if x is not None else np.zeros(4, np.uint64) for x in got], np.uint64).reshape(-1, 4).view(np.int64)
            count = pa.array(np.array([x[1] if x is not None else 0 for x in got], np.int64), mask=mask)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(rows[:, j]), mask=mask) for j in range(4)), count], names=["r", "doc_id", *WORDS, "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    r = F.col(number) if number else F.monotonically_increasing_id()
    return docs.select(r.alias("r"), "doc_id", "text").mapInArrow(run, f"r long, doc_id {kind}, s0 long, s1 long, s2 long, s3 long, n_words long")


def close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, same: bool, radius: int = RADIUS, ratio: float = RATIO) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of a, rows of b) within the radius and the ratio of word counts, a block at a time; each pair once where a and b are the same."""
    pa_, pb = np.bitwise_count(a).sum(1, dtype=np.int32), np.bitwise_count(b).sum(1, dtype=np.int32)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb = pa_[oa], pb[ob]
    cols = [np.ascontiguousarray(b[ob, j]) for j in range(4)]
    buf, cnt, sums = np.empty((ROWS, STRIP), np.uint64), np.empty((ROWS, STRIP), np.uint8), np.empty((ROWS, STRIP), np.uint16)
    for i in range(0, len(oa), ROWS):
        x = a[oa[i : i + ROWS]]
        lo, hi = np.searchsorted(sb, sa[i] - radius), np.searchsorted(sb, sa[min(i + ROWS, len(oa)) - 1] + radius, "right")
        if same:
            lo = max(lo, i)
        for k in range(lo, hi, STRIP):
            n = min(STRIP, hi - k)
            d, c, s = buf[: len(x), :n], cnt[: len(x), :n], sums[: len(x), :n]
            for j in range(4):
                np.bitwise_xor(x[:, j, None], cols[j][None, k : k + n], out=d)
                np.bitwise_count(d, out=c)
                np.add(s, c, out=s) if j else np.copyto(s, c)
            if s.min() <= radius:
                r, q = np.nonzero(s <= radius)
                if same:
                    ok = q + k > r + i
                    r, q = r[ok], q[ok]
                r, q = oa[r + i], ob[q + k]
                ok = np.minimum(na[r], nb[q]) >= ratio * np.maximum(na[r], nb[q])
                if ok.any():
                    yield r[ok], q[ok]


def pairs(sig: np.ndarray, n: np.ndarray, second: np.ndarray | None, radius: int = RADIUS, ratio: float = RATIO) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of sig within the radius and the ratio of word counts, each once, in blocks; with ``second`` only of a row where it is false and one where it is true."""
    crowd = crowded(sig, radius)
    rest = np.flatnonzero(~crowd)
    side = None if second is None else second[rest]
    if worth(sig[rest], len(rest) ** 2 / 2 if side is None else float(side.sum()) * float((~side).sum()), radius):
        for r, q in near(sig[rest], side, radius):
            r, q = rest[r], rest[q]
            ok = np.minimum(n[r], n[q]) >= ratio * np.maximum(n[r], n[q])
            if ok.any():
                yield r[ok], q[ok]
    else:
        crowd = np.ones(len(sig), bool)
    # The crowd with all.
    if second is None:
        both = [(np.flatnonzero(crowd), np.flatnonzero(crowd)), (np.flatnonzero(crowd), np.flatnonzero(~crowd))]
    else:
        both = [(np.flatnonzero(crowd & ~second), np.flatnonzero(second)), (np.flatnonzero(~crowd & ~second), np.flatnonzero(crowd & second))]
    for k, (a, b) in enumerate(both):
        if len(a) and len(b):
            for r, q in close(sig[a], sig[b], n[a], n[b], second is None and k == 0, radius, ratio):
                yield a[r], b[q]


def tiles(hist: list[tuple[int, int, int]], tile: int = TILE, radius: int = RADIUS) -> tuple[list[tuple[int, ...]], int]:
    """From (band, population count, rows): (band, pop, first, many, same_lo, same_hi, next_lo, next_hi, prev_lo, prev_hi), and the number of tile pairs.

    The rows of a population count lie in tiles first .. first + many - 1 of their band; same_, next_ and prev_ are the tiles, of the same band
    and of its neighbours, whose population counts come within the radius of the tile's. An empty range has hi = lo - 1. At most 257 rows per band.
    """
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each band, the least and the greatest count of each tile
    place, filled = {}, 0
    for band, pop, n in sorted(hist):
        own = spans[band]
        if n > tile:
            place[band, pop] = (len(own), many := -(-n // tile))
            own += [(pop, pop)] * many
            filled = tile
        elif own and filled + n <= tile:
            own[-1] = (own[-1][0], pop)
            place[band, pop] = (len(own) - 1, 1)
            filled += n
        else:
            place[band, pop] = (len(own), 1)
            own.append((pop, pop))
            filled = n
    los, his = ({b: [x[k] for x in own] for b, own in spans.items()} for k in (0, 1))

    def within(band: int, lo: int, hi: int) -> tuple[int, int]:
        first, last = bisect_left(his.get(band, ()), lo - radius), bisect_right(los.get(band, ()), hi + radius) - 1
        return (first, last) if first <= last else (0, -1)

    out, pairs = [], 0
    for (band, pop), (first, many) in place.items():
        near = [within(x, *spans[band][first]) for x in (band, band + 1, band - 1)]
        out.append((band, pop, first, many, *near[0], *near[1], *near[2]))
    for band, own in spans.items():
        for t, x in enumerate(own):
            pairs += within(band, *x)[1] - t + 1
            pairs += (y := within(band + 1, *x))[1] - y[0] + 1
    return out, pairs


def links(own: DataFrame, tile: int = TILE, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(node, root, n): for distinct signatures (id, s0..s3, n_words, m), by task, the ids that have near duplicates in it, a node of their component, and how many rows those are."""
    own = own.select("id", *WORDS, "n_words", "m", F.floor(F.ln("n_words") / F.lit(-math.log(ratio))).cast("int").alias("band"), sum(F.bit_count(w) for w in WORDS).alias("pop"))
    table, tasks = tiles([tuple(r) for r in own.groupBy("band", "pop").count().collect()], tile, radius)  # some 30 bands of at most 257 rows
    names = ("band", "pop", "first", "many", "same_lo", "same_hi", "next_lo", "next_hi", "prev_lo", "prev_hi")
    grid = F.broadcast(own.sparkSession.createDataFrame(table, ", ".join(f"{x} int" for x in names)))
    row = own.join(grid, ["band", "pop"]).withColumn("t", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int"))

    def cells(lo, hi, cell):
        return F.transform(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda o: F.struct(*(x.alias(n) for x, n in zip(cell(o), ("band", "i", "j", "second")))))

    c, no, yes = F.col, F.lit(False), F.lit(True)
    # Task (band, i, j): tiles i <= j of the band with each other; task (band, i, -1 - j): tile i with tile j of the next band.
    all_ = F.concat(
        cells(c("t"), c("same_hi"), lambda o: (c("band"), c("t"), o, no)),
        cells(c("same_lo"), c("t") - 1, lambda o: (c("band"), o, c("t"), yes)),
        cells(c("next_lo"), c("next_hi"), lambda o: (c("band"), c("t"), -1 - o, no)),
        cells(c("prev_lo"), c("prev_hi"), lambda o: (c("band") - 1, o, -1 - c("t"), yes)),
    )
    rows = row.select("id", *WORDS, "n_words", "m", F.explode(all_).alias("c")).select("c.*", "id", *WORDS, "n_words", "m")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        second = pdf["second"].to_numpy(bool)
        sig = pdf[list(WORDS)].to_numpy(np.int64).view(np.uint64).reshape(-1, 4)
        n, m, ids = (pdf[x].to_numpy() for x in ("n_words", "m", "id"))
        one = pdf["i"].iat[0] == pdf["j"].iat[0]
        many, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for r, q in pairs(sig, n, None if one else second, radius, ratio):
            np.add.at(many, r, m[q])
            np.add.at(many, q, m[r])
            forest.join(r, q)
        k = np.flatnonzero(many)
        return pd.DataFrame({"node": ids[k], "root": ids[forest.root[k]], "n": many[k]})

    # A number of its own keeps the adaptive planner from packing heavy tasks together.
    parts = max(1, min(20_000, max(2 * tasks, own.sparkSession.sparkContext.defaultParallelism)))
    return rows.repartition(parts, "band", "i", "j").groupBy("band", "i", "j").applyInPandas(compare, "node long, root long, n long")


def members(sigs: DataFrame, **options) -> DataFrame:
    """(r, doc_id, group_id, group_size, n_links, keep) from the written rows of signatures()."""
    key = [*WORDS, "n_words"]
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("r").alias("r"))
    own = cut(sigs.where("n_words is not null").groupBy(*key).agg(F.min("r").alias("id"), F.count("*").alias("m"), F.min(first).alias("first")), "signatures")
    found = cut(links(own, **options), "links")
    root = components(found.select("node", "root")).select(F.col("node").alias("id"), "root")
    many = found.groupBy(F.col("node").alias("id")).agg(F.sum("n").alias("n"))
    of = own.join(many, "id", "left").join(root, "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("m") - 1)
    of = cut(of.select(*key, "m", "first", "root", "n_links"), "classes")
    groups = of.groupBy("root").agg(F.sum("m").alias("group_size"), F.min("first").alias("rep"))
    of = of.join(groups, "root").select(*key, "group_size", "n_links", "rep")
    some = sigs.join(of, key).select("r", "doc_id", F.col("rep.doc_id").alias("group_id"), "group_size", "n_links", (F.col("r") == F.col("rep.r")).alias("keep"))
    alone = sigs.where("n_words is null").select("r", "doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keep"))
    return some.unionByName(alone)


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id, group_size, n_links, keep): a row for every row of docs.

    A group is a connected class of near duplicates, ``group_size`` its rows, ``n_links`` how many other rows are near duplicates of this one, copies included. The row of
    least doc_id is kept, of several (repeated rows, shared ids) one of them, and a row without doc_id only where the group has no other; ``group_id`` is
    the doc_id of the kept row. A text without words, empty or null, has no signature and stands alone, as does any without near duplicates. Very long texts are read
    whole. Other columns are ignored, whatever their names; an empty table gives no row.
    """
    return members(cut(signatures(docs), "sigs"), **options).drop("r")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near duplicates, the one that groups() keeps; all columns kept, whatever their names.

    Rows are judged each by itself: of identical rows one stays, of different texts that share a doc_id both stay, rows without doc_id are compared like
    all others, and texts without words, null or empty, all stay. An empty table stays empty.
    """
    docs, number = numbered(docs, "docs")
    gone = members(cut(signatures(docs, number), "sigs"), **options).where("not keep").select(F.col("r").alias(number))
    return docs.join(gone, number, "left_anti").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
