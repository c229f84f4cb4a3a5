"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches, in the order of doc_id. Lines of a batch whose hash is in no earlier run, and which are the first of the batch to have
it, stay; their hashes become a new run of level 0. When ``FANOUT`` runs of a level exist they merge to one of the next level,
so there are fewer than ``FANOUT`` runs per level and every hash is rewritten once per level.

A run is a table bucketed and sorted by hash, with one file a bucket, which Spark knows: an anti-join of a batch with the runs exchanges and sorts the batch once and merges it with the
runs as they lie, and two runs merge by a full outer merge join, without an exchange or a sort of either.

Hashes have 128 bits: among 10^13 lines, two that differ share one with a probability below 10^-12.
Only hashes, row numbers and line numbers are moved until the end; texts move once, joined with the numbers of the lines that stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, numbered, read, ready, shared_dir

BATCHES, FANOUT = 6, 2
#: White space that counts for nothing at the ends of a line.
WHITE = " \t\r\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
HASH = ("h", "g")


def key(line: Column | str) -> Column:
    """What makes lines equal: the text without white space at its ends."""
    return F.btrim(F.col(line) if isinstance(line, str) else line, F.lit(WHITE))


@contextmanager
def _ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Let Spark rely on the order within the single file of a bucket, which it otherwise doesn't look for, and merge rather than broadcast runs."""
    own = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Runs:
    """Levelled runs of distinct hashes (columns h, g), each a table of as many buckets, one file each, as there are shuffle partitions."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.names = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame) -> DataFrame:
        """rows, exchanged by their hashes into as many partitions as there are buckets, as a run."""
        name, path = f"run_{uuid.uuid4().hex}", f"{shared_dir(self.spark)}/run-{uuid.uuid4().hex}"
        with _ordered_buckets(self.spark):
            rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("path", path).saveAsTable(name)
        self.names.append(name)
        out = self.spark.table(name)
        out.written_at = path
        return out

    def without(self, rows: DataFrame) -> DataFrame:
        for level in self.levels:
            for run in level:
                rows = rows.join(run.select(*HASH), list(HASH), "left_anti")
        return rows

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Two runs, which share no hash, merged; more of them, two by two."""
        while len(runs) > 2:
            runs = [self.write(self.merged(runs[:2])), *runs[2:]]
        a, b = (r.select(F.col("h").alias(f"h{k}"), F.col("g").alias(f"g{k}")) for k, r in enumerate(runs))
        both = a.join(b, (F.col("h0") == F.col("h1")) & (F.col("g0") == F.col("g1")), "full_outer")
        return both.select(F.coalesce("h0", "h1").alias("h"), F.coalesce("g0", "g1").alias("g"))

    def add(self, new: DataFrame) -> None:
        """Add a run; it and those it merges with stay readable until close()."""
        k = 0
        while True:
            if len(self.levels) == k:
                self.levels.append([])
            self.levels[k].append(new)
            if len(self.levels[k]) < self.fanout:
                return
            old, self.levels[k] = self.levels[k], []
            new, k = self.write(self.merged(old)), k + 1
            if k > 1:
                for run in old:
                    forget(run)

    def close(self) -> None:
        """Take the tables' names out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"drop table {name}")
        self.names = []


def batches_of(docs: DataFrame, number: str, batches: int) -> list:
    """Values of doc_id, of any type that has an order, that cut docs into about equal parts."""
    part = docs.where("doc_id is not null").select("doc_id").repartitionByRange(batches, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in part.collect())[1:]


def stays(docs: DataFrame, number: str, batches: int = BATCHES, min_chars: int = 1) -> DataFrame:
    """(r, stay): of rows with a column ``number``, the numbers, from 0, of the lines that are the first of their kind."""
    spark = ready(docs.sparkSession)
    batch = F.lit(0)
    cuts = batches_of(docs, number, batches)
    for c in cuts:
        batch = batch + (F.col("doc_id") > c).cast("int") + (F.col("doc_id") == c).cast("int")
    batch = F.coalesce(batch, F.lit(len(cuts)))  # rows without id come last
    lines = docs.where("text is not null").select("doc_id", F.col(number).alias("r"), batch.alias("b"), F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", key("line"))
    rows = cut(lines.where(F.length("line") >= min_chars).select("b", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc_id", "r", "i"), "lines")
    runs, first = Runs(spark), []
    try:
        for k in range(len(cuts) + 1):
            # Reduced to one row a hash before the exchange, which then lies as the runs do.
            own = rows.where(F.col("b") == k).groupBy(*HASH).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r", "i")).alias("f")).select(*HASH, F.col("f.r").alias("r"), F.col("f.i").alias("i"))
            new = runs.write(runs.without(own))
            first.append(spark.read.schema("r long, i int").parquet(new.written_at))
            runs.add(new)
    finally:
        runs.close()
    out = first[0]
    for d in first[1:]:
        out = out.unionByName(d)
    return out.groupBy("r").agg(F.collect_list("i").alias("stay"))


def dedup(docs: DataFrame, batches: int = BATCHES, min_chars: int = 1) -> DataFrame:
    """(doc_id, text, n_dropped): docs less every line that an earlier line equals; a row for each row of docs.

    Earlier is by doc_id, of rows sharing an id by their place in the table, then by place in the text; rows without doc_id come last. Ids are of any type with an order.
    Lines are compared without the white space at their ends; those with nothing else always stay (and, if given, those of fewer than ``min_chars`` characters). Null texts stay null, empty ones
    empty. A repeated row loses all its lines but blank ones, a line repeated in one text all but its first. Very long texts and lines are compared whole. Other columns
    are ignored; an empty table gives no row.
    """
    docs, number = numbered(docs.select("doc_id", "text"), "docs")
    left = stays(docs, number, batches, min_chars).withColumnRenamed("r", number)
    joined = docs.join(left, number, "left")
    own = F.split("text", "\n")
    kept = F.filter(own, lambda x, i: (F.length(key(x)) < min_chars) | F.coalesce(F.array_contains("stay", i), F.lit(False)))
    joined = joined.select("doc_id", "text", kept.alias("kept"), F.size(own).alias("n"))
    return joined.select("doc_id", F.array_join("kept", "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n") - F.size("kept")).alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))


_TRIM = "trim(line, " + " || ".join(f"chr({ord(c)})" for c in WHITE) + ")"

ORACLE = rf"""
with numbered as (select row_number() over (order by doc_id) as d, doc_id, text from documents
), lines as (
  select d, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from numbered where text is not null
), ranked as (
  select *, row_number() over (partition by {_TRIM} order by d, i) as r, length({_TRIM}) >= 1 as long_enough from lines
), kept as (
  select d, string_agg(line, chr(10) order by i) filter (where r = 1 or not long_enough) as text, cast(count(*) filter (where r > 1 and long_enough) as integer) as n_dropped from ranked group by d
)
select n.doc_id, case when n.text is null then null else coalesce(k.text, '') end as text, coalesce(k.n_dropped, 0) as n_dropped from numbered n left join kept k on n.d = k.d
"""
