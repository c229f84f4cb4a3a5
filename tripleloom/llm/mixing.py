"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets an inclusion probability that brings its share of the sampled tokens to its target weight. The flight phase then
moves the probabilities of three documents at a time along the null-space of the two balancing constraints (sum of probabilities,
and sum of probability times tokens, as the tokenizer counts them), until one of them is 0 or 1; so each source's document and token totals stay exactly at their
targets while all but at most two documents are decided. Rows are told apart by a number of their own, which also spreads them over chunks. Chunks fly independently, their undecided documents fly together,
and the two or so left of each source are landed: of the 0/1 choices, the one that leaves the totals nearest to the targets.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, read, ready
from .tokenizer import DEFAULT, encode

SHARE, TEMPERATURE, CHUNK, SEED, EPS = 0.7, 0.7, 20_000, 11, 1e-9


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but at most two; sums of pi and of pi * size as before (for equal sizes all but one are decided)."""
    pi = pi.astype(float).copy()
    x = size.astype(float) / max(1.0, float(size.max(initial=1)))
    coins = rng.random(len(pi) + 3).tolist()
    p, s = pi.tolist(), x.tolist()
    live: list[int] = []
    for k in range(len(p)):
        if p[k] < EPS or p[k] > 1 - EPS:
            p[k] = float(round(p[k]))
            continue
        live.append(k)
        # Two of equal size need no third: the constraints coincide on them.
        while len(live) == 3 or (len(live) == 2 and s[live[0]] == s[live[1]]):
            if len(live) == 3:
                a, b, c = live
                u = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]
                if max(map(abs, u)) < 1e-12:
                    u = [1.0, -1.0, 0.0]
            else:
                u = [1.0, -1.0]
            up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(live, u) if d)
            down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(live, u) if d)
            step = up if coins[k % len(coins)] * (up + down) < down else -down
            coins[k % len(coins)] = (coins[k % len(coins)] * 7919.0 + 0.12345) % 1.0
            rest = []
            for i, d in zip(live, u):
                p[i] += step * d
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = float(round(p[i]))
                else:
                    rest.append(i)
            if len(rest) == len(live):  # rounding kept all inside: decide the nearest
                near = min(live, key=lambda i: min(p[i], 1 - p[i]))
                p[near] = float(round(p[near]))
                rest.remove(near)
            live = rest
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray, most: int = 4) -> np.ndarray:
    """The last undecided set to 0 or 1: of all choices, the one whose totals are nearest the targets. A flight leaves two at most; more than ``most`` are an error."""
    pi = pi.copy()
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if not len(open_):
        return pi.round()
    if len(open_) > most:
        raise ValueError(f"{len(open_)} documents are undecided after the flight")
    want, tokens = pi[open_].sum(), (pi[open_] * size[open_]).sum()
    top = max(1.0, float(size[open_].max()))
    pi[open_] = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda c: (abs(sum(c) - want) + abs(float(np.dot(c, size[open_])) - tokens) / top, c))
    return pi.round()


def probabilities(totals: dict, share: float = SHARE, temperature: float = TEMPERATURE, weights: dict | None = None) -> dict:
    """Inclusion probability by source, from token totals. ``weights`` (any scale) or, by default, tokens ** temperature; ``share`` of all tokens are wanted.
    A source that has fewer tokens than its part is taken whole and the others share the rest by their weights."""
    want = {k: (weights.get(k, 0.0) if weights is not None else t**temperature) for k, t in totals.items()}
    pi, rest, left = {k: 0.0 for k in totals}, share * sum(totals.values()), {k for k in totals if want[k] > 0 and totals[k] > 0}
    while left:
        scale = rest / sum(want[k] for k in left)
        full = {k for k in left if scale * want[k] >= totals[k]}
        if not full:
            for k in left:
                pi[k] = scale * want[k] / totals[k]
            break
        for k in full:
            pi[k] = 1.0
            rest -= totals[k]
        left -= full
    return pi


def sizes(docs: DataFrame, number: str | None, tokenizer: str) -> DataFrame:
    """(r, doc_id, source, n_tokens): the tokens of each row; 0 for null and empty texts. r is the column ``number`` or, if there is none, a new number."""
    kind, source = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))

    def run(batches):
        for b in batches:
            n = pa.array([len(encode(t, tokenizer)) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[:3], n], names=["r", "doc_id", "source", "n_tokens"])

    r = F.col(number) if number else F.monotonically_increasing_id()
    return docs.select(r.alias("r"), "doc_id", "source", "text").mapInArrow(run, f"r long, doc_id {kind}, source {source}, n_tokens long")


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest(repr(key)))


def _sample(docs: DataFrame, number: str | None = None, share: float = SHARE, temperature: float = TEMPERATURE, weights: dict | None = None, chunk: int = CHUNK, seed: int = SEED, tokenizer: str = DEFAULT) -> DataFrame:
    """sample() with the number r of each row."""
    spark = ready(docs.sparkSession)
    source = docs.schema["source"].dataType.simpleString()
    base = cut(sizes(docs, number, tokenizer), "sizes")
    rows = base.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    pi = probabilities({r["source"]: r["t"] for r in rows}, share, temperature, weights)
    if not rows:
        return base.select("*", F.lit(0.0).alias("pi"), F.lit(False).alias("selected"))
    table = spark.createDataFrame([(r["source"], float(pi[r["source"]]), max(1, -(-r["n"] // chunk))) for r in rows], f"s {source}, pi double, chunks long")
    # The row's number decides its chunk and its place there, so chunks are of one size whatever ids and sources repeat.
    order = F.xxhash64("r", F.lit(seed))
    units = base.join(table, base["source"].eqNullSafe(table["s"])).select("r", "doc_id", "source", "n_tokens", "pi", order.alias("o"), F.pmod(order, F.col("chunks")).alias("chunk"), F.col("pi").alias("p"))
    schema = units.drop("chunk").schema

    def fly(final: bool):
        # Over Arrow, so that ids keep their type beside nulls.
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.drop_columns(["chunk"]).sort_by([("o", "ascending"), ("r", "ascending")])
            size = rows.column("n_tokens").to_numpy()
            p = flight(rows.column("p").to_numpy(), size, _rng(seed, *(str(k.as_py()) for k in key)))
            return rows.set_column(rows.column_names.index("p"), "p", pa.array(land(p, size) if final else p))

        return run

    decided = []
    state = cut(units.groupBy("source", "chunk").applyInArrow(fly(False), schema), "flight")
    while True:
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(state.where(~open_))
        most = state.where(open_).groupBy("source").count().agg(F.max("count")).first()[0] or 0
        last = most <= chunk
        state = state.where(open_).withColumn("chunk", F.lit(0).cast("long") if last else F.pmod(F.xxhash64("o", F.lit(len(decided))), F.lit(-(-most // chunk))))
        state = cut(state.groupBy("source", "chunk").applyInArrow(fly(last), schema), "flight")
        if last:
            decided.append(state)
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("r", "doc_id", "source", "n_tokens", F.round("pi", 9).alias("pi"), (F.col("p") > 0.5).alias("selected"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, n_tokens, pi, selected): a row for each row of docs, in no order. Options: share, temperature, weights by source, chunk, seed, tokenizer.

    Null sources form a source of their own; documents without tokens (null or empty texts) have size 0 and are balanced by number only, and where a whole
    source has none it isn't sampled (pi 0). Rows with a null doc_id, repeated rows, rows that share an id and ties are sampled each by itself; ids of any type come back
    as they were. Very long texts count all their tokens. Other columns are ignored; an empty table gives no row. Needs no more driver memory than a row per source.
    """
    return _sample(docs, **options).drop("r")


def keep_sampled(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that sample() selects, all columns kept whatever their names; each row by itself, also where ids are null or shared. An empty table stays empty.

    The chosen rows are a fixed share of all, so they are merged with docs at every size, never broadcast.
    """
    docs, number = numbered(docs, "docs")
    chosen = _sample(docs, number, **options).where("selected").select(F.col("r").alias(number)).hint("merge")
    return docs.join(chosen, number, "left_semi").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(read(spark, sf_dir, "documents"))
