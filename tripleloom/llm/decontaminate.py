"""Benchmark decontamination by a hash set of normalised test n-grams.

Texts become lower-case word tokens. A window of ``N`` tokens that equals a window of a benchmark item is a hit; items of fewer than N
words match by all their words, also items of a single word. Windows are looked up by a 64-bit hash and every hit is verified against the item's words.
Overlapping and touching hits merge to spans. Spans are cut out of the text; a document of which at least ``DROP_SHARE`` of the words lie in spans
is removed whole.

The hash set is broadcast as sorted arrays: some 25 bytes a window, words included. One broadcast holds at most ``BLOCK`` windows; a larger benchmark is scanned for block
by block, each in one more pass over the documents, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, cut, fresh, read, ready, words

N, DROP_SHARE, BLOCK = 8, 0.5, 4_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def hashes(own: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n token hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * MULT + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(31)
    return out


class Index:
    """Windows of benchmark items: the items' words, and by window length the sorted hashes of windows and where in the words they begin."""

    def __init__(self, items: list[list[str]], n: int = N):
        own = [x for x in items if x]
        blob = [w.encode() for x in own for w in x]
        self.ends = np.cumsum([0, *map(len, blob)], dtype=np.int64)
        self.blob = b"".join(blob)
        h, at = hashes([w for x in own for w in x]), 0
        found: dict[int, list[np.ndarray]] = {}
        for x in own:
            size = min(n, len(x))
            found.setdefault(size, []).append(np.arange(at, at + len(x) - size + 1))
            at += len(x)
        self.by = {}
        for size, places in sorted(found.items()):
            place = np.concatenate(places)
            key = windows(h, size)[place]
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            first = np.r_[True, key[1:] != key[:-1]]
            # One place for each distinct window: of equal hashes those whose words are new.
            again = np.flatnonzero(~first)
            starts = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))[again]
            keep = first.copy()
            keep[[k for k, s in zip(again.tolist(), starts.tolist()) if all(self._words(place[k], size) != self._words(place[j], size) for j in range(s, k))]] = True
            slots = min(25, max(12, int(8 * len(key)).bit_length()))
            table = np.zeros(1 << slots, bool)
            table[key >> np.uint64(64 - slots)] = True
            self.by[size] = (key[keep], place[keep].astype(np.int64), slots, table)

    def _words(self, at: int, size: int) -> list[bytes]:
        e = self.ends
        return [self.blob[e[k] : e[k + 1]] for k in range(at, at + size)]

    def hits(self, own: list[str]) -> list[tuple[int, int]]:
        """[from, to) token spans of verified hits."""
        if not own or not self.by:
            return []
        h, out = hashes(own), []
        for size, (key, place, slots, table) in self.by.items():
            w = windows(h, size)
            maybe = np.flatnonzero(table[w >> np.uint64(64 - slots)])
            if not len(maybe):
                continue
            at = np.searchsorted(key, w[maybe])
            ok = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == w[maybe])
            for k, j in zip(maybe[ok].tolist(), at[ok].tolist()):
                mine = [x.encode() for x in own[k : k + size]]
                while j < len(key) and key[j] == w[k]:
                    if self._words(int(place[j]), size) == mine:
                        out.append((k, k + size))
                        break
                    j += 1
        return out

    def spans(self, own: list[str]) -> list[tuple[int, int]]:
        """Merged spans."""
        return merge(self.hits(own))


def blocks(items: DataFrame, n: int = N, most: int = BLOCK) -> Iterator[Index]:
    """Indexes of at most ``most`` windows, or of one item, in the order of items; the driver holds one at a time."""
    own, many = [], 0
    for (text,) in items.toLocalIterator():
        if w := words(text):
            if own and many + len(w) > most:
                yield Index(own, n)
                own, many = [], 0
            own.append(w)
            many += len(w)
    yield Index(own, n)


def merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text less the characters from the first to the last word of each span. Cut by positions in the original, whose lower case may differ in length."""
    at = [m.span() for m in WORD.finditer(text)]
    if len(at) != len(words(text)):  # lower-casing split a word: cut in the lower-case text
        text = text.lower()
        at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def _judge(text: str | None, spans: list[tuple[int, int]], n: int, share: float) -> tuple[str | None, bool]:
    """(text left, removed)"""
    if not spans:
        return text, False
    if sum(b - a for a, b in spans) >= share * n:
        return None, True
    return without(text, spans), False


def flags(columns: list[str]) -> tuple[str, str]:
    """Names of the two columns that scan() adds to these: ``spans`` and ``removed``, with underscores before them where those are taken."""
    return fresh("spans", columns), fresh("removed", columns)


def _schema(docs: DataFrame) -> T.StructType:
    spans, removed = flags(docs.columns)
    return T.StructType([*docs.schema.fields, T.StructField(spans, T.IntegerType()), T.StructField(removed, T.BooleanType())])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE, block: int = BLOCK) -> DataFrame:
    """All columns of docs with text decontaminated, and, named by flags(), the number of spans cut and whether the document goes (its text is null).

    Null and empty texts, and any document where the benchmark is empty, pass unchanged with 0 spans. Null items and items without words are left out; repeated items count once.
    Very long texts are scanned whole. Repeated rows and rows that share a doc_id are treated each by itself, rows without doc_id like others. Other columns pass, whatever their
    names; an empty table gives no row.
    """
    spark = ready(docs.sparkSession)
    cols, added, found = docs.columns, flags(docs.columns), fresh("found", docs.columns)
    schema_out, hits = _schema(docs), T.ArrayType(T.LongType())
    before: Index | None = None
    for index in blocks(benchmark.where("text is not null").select("text").distinct(), n, block):
        if before is not None:
            docs = cut(_pass(docs, spark.sparkContext.broadcast(before), found, T.StructType([*(f for f in docs.schema.fields if f.name != found), T.StructField(found, hits)])), "scanned")
        before = index
    last, earlier = spark.sparkContext.broadcast(before), found in docs.columns

    def run(batches):
        own = last.value
        for b in batches:
            new, many, gone = [], [], []
            others = b.column(found).to_pylist() if earlier else [None] * b.num_rows
            for t, more in zip(b.column("text").to_pylist(), others):
                w = words(t)
                s = merge([*own.hits(w), *_pairs(more)])
                left, removed = _judge(t, s, len(w), drop_share)
                new.append(left)
                many.append(len(s))
                gone.append(removed)
            yield pa.record_batch([*(pa.array(new, pa.string()) if c == "text" else b.column(c) for c in cols), pa.array(many, pa.int32()), pa.array(gone, pa.bool_())], names=[*cols, *added])

    return docs.mapInArrow(run, schema_out)


def _pairs(flat: list[int] | None) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2])) if flat else []


def _pass(docs: DataFrame, index, found: str, schema: T.StructType) -> DataFrame:
    """docs with the spans that one block of the benchmark hits added to the column ``found``, from and to by turns."""
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        own = index.value
        for b in batches:
            before = b.column(found).to_pylist() if found in b.schema.names else [None] * b.num_rows
            new = [[x for s in merge([*own.hits(words(t)), *_pairs(more)]) for x in s] for t, more in zip(b.column("text").to_pylist(), before)]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(new, pa.list_(pa.int64()))], names=[*names, found])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with benchmark spans cut out and mostly contaminated documents gone; the columns of docs, whatever their names. n_chars, where there is such a column, follows the text.

    Rows with null, empty or blank texts stay as they are, as do rows without doc_id and repeated rows without hits; very long texts are scanned whole. An empty table stays empty.
    """
    spans, removed = flags(docs.columns)
    out = scan(docs, benchmark, **options).where(~F.col(removed))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(spans, removed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contaminated, removed, n_spans, text): every document, with its text after the cuts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("spans") > 0).alias("contaminated"), "removed", F.col("spans").alias("n_spans"), "text")


ORACLE = rf"""
with w as (
  select doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as lw, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') as ow, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') as sep from documents
), items as (
  select distinct regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as b from benchmark where text is not null
), sized as (select b, least(len(b), {N}) as size from items where len(b) >= 1
), test as (
  select distinct size, array_to_string(b[k : k + size - 1], ' ') as g from sized, unnest(range(1, len(b) - size + 2)) as t(k)
), grams as (
  select doc_id, k, size, array_to_string(lw[k : k + size - 1], ' ') as g from w, (select distinct size from test) as sizes, unnest(range(1, len(lw) - size + 2)) as t(k)
), covered as (
  select distinct doc_id, k + j as p from grams join test using (size, g), unnest(range(0, size)) as t(j)
), runs as (
  select doc_id, p, p - row_number() over (partition by doc_id order by p) as run from covered
), counted as (select doc_id, count(*) as n, count(distinct run) as n_spans, list(p) as ps from runs group by doc_id
), left_over as (
  select w.doc_id, sep[1] || coalesce((select string_agg((case when list_contains(ps, k) then '' else ow[k] end) || (case when list_contains(ps, k) and list_contains(ps, k + 1) then '' else sep[k + 1] end), '' order by k) from unnest(range(1, len(ow) + 1)) as t(k)), '') as cut
  from w join counted c on w.doc_id = c.doc_id
)
select w.doc_id, c.n is not null as contaminated, coalesce(c.n >= {DROP_SHARE} * len(w.lw), false) as removed, cast(coalesce(c.n_spans, 0) as integer) as n_spans,
  case when c.n is null then w.text when c.n >= {DROP_SHARE} * len(w.lw) then null else l.cut end as text
from w left join counted c on w.doc_id = c.doc_id left join left_over l on w.doc_id = l.doc_id
"""
