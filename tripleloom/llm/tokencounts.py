"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer version) are kept as a sum of signed deltas. A batch of changes says, by document, ``insert``, ``delete`` or
``revise`` (the new count and the one it replaces); it is aggregated to one delta row per key and committed under its batch id.

The rollup is a log of numbered entries. An entry appears whole or not at all, by one rename that never replaces an entry, and names the folder of its deltas, so
of two writers that want one number one wins, and the other reads what is new and tries the next. A batch id that the log holds already changes nothing, which makes retries
and replays safe. ``compact`` adds an entry that stands for all before it; ``clean`` removes what no entry needs any more.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, ready, shared_dir
from .tokenizer import DEFAULT, encode

KEY = ("source", "lang", "version")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, version: str, tokenizer: str = DEFAULT) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): a row for each row of docs, repeated ones too.

    Null and empty texts have 0 tokens, very long ones all of theirs; null ids, sources and languages stay null. Other columns are ignored; an empty table gives no row.
    """
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = pa.array([len(encode(t, tokenizer)) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), n], names=["doc_id", "source", "lang", "n_tokens"])

    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return own.mapInArrow(run, f"doc_id {kind}, source string, lang string, n_tokens long").select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


def delta(changes: DataFrame) -> DataFrame:
    """One signed row per key of changes (op, source, lang, version, n_tokens, old_tokens).

    insert: +1 document, +n_tokens; delete: -1, -n_tokens; revise: 0, n_tokens - old_tokens. Null counts are 0, null keys a key of their own;
    an op of another name is an error. A key whose changes cancel out gives no row.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(wrong.cast("long"))
    out = changes.groupBy(*KEY).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
    return out.where("n_docs <> 0 or n_tokens <> 0")


@dataclass
class State:
    """What the log says at one reading: its last number, the folders whose deltas make the totals, the batches of entries since the last compaction, and the table of those before."""

    number: int = 0
    folders: list[str] = field(default_factory=list)
    batches: dict[str, str] = field(default_factory=dict)
    held: str | None = None
    base_at: int = 0


class Rollup:
    """A rollup in a folder: ``log/<number>`` with entries, ``data/<name>/`` with deltas, folded totals and the batch ids of compacted entries.

    Any number of writers may commit and compact at a time, where renaming a file is atomic, as on HDFS; an object store needs a file system layer that gives this.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._jvm = jvm.org.apache.hadoop.fs.Path, jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self._path(self.path)
        self.fs = at.getFileSystem(conf)
        self.files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)
        for folder in ("log", "data", "_draft"):
            self.fs.mkdirs(self._path(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(n for s in self.fs.listStatus(self._path(f"{self.path}/{folder}")) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _entry(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.path}/log/{number:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> State:
        numbers = [int(n) for n in self._names("log")]
        out, entries, through = State(number=max(numbers, default=0)), {}, -1
        for n in reversed(numbers):
            if n <= through:
                break
            e = self._entry(n)
            if "batch" in e:
                entries[n] = e
            elif not out.base_at:  # the last compaction; entries after ``through`` aren't in it
                out.folders, out.held, out.base_at, through = [e["totals"]], e["batches"], n, e["through"]
        for _, e in sorted(entries.items()):
            out.folders.append(e["deltas"])
            out.batches[e["batch"]] = e["deltas"]
        return out

    def _append(self, number: int, entry: dict) -> bool:
        """Write entry ``number``; False if it is there already."""
        draft, to = self._path(f"{self.path}/_draft/{uuid.uuid4().hex}"), self._path(f"{self.path}/log/{number:012d}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.NONE
        try:
            self.files.rename(draft, to, options)
        except Exception:
            self.fs.delete(draft, False)
            if self.fs.exists(to):
                return False
            raise
        return True

    def _has(self, state: State, batch: str) -> bool:
        if batch in state.batches:
            return True
        return bool(state.held) and not self.spark.read.schema("batch string").parquet(f"{self.path}/data/{state.held}").where(F.col("batch") == batch).isEmpty()

    def committed(self) -> DataFrame:
        """(batch): the ids of all committed batches."""
        state = self.state()
        out = self.spark.createDataFrame([(b,) for b in state.batches], "batch string")
        return out.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/data/{state.held}")) if state.held else out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and no effect, if a batch of this id is already committed."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"bad batch id {batch!r}")
        state = self.state()
        if self._has(state, batch):
            return False
        name = uuid.uuid4().hex
        delta(changes).select(*KEY, *SUMS).coalesce(1).write.parquet(f"{self.path}/data/{name}")
        while not self._append(state.number + 1, {"batch": batch, "deltas": name}):
            state = self.state()
            if self._has(state, batch):
                self.fs.delete(self._path(f"{self.path}/data/{name}"), True)
                return False
        return True

    def _sum(self, state: State) -> DataFrame:
        if not state.folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{f}" for f in state.folders))
        return rows.groupBy(*KEY).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS)).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches, each once; keys with nothing left are not shown."""
        return self._sum(self.state())

    def compact(self) -> bool:
        """Fold all that one reading of the log holds into an entry that stands for it. Batches committed meanwhile stay on their own. False if the log was compacted meanwhile."""
        state = self.state()
        if not state.batches:
            return False
        totals, held = uuid.uuid4().hex, uuid.uuid4().hex
        self._sum(state).coalesce(1).write.parquet(f"{self.path}/data/{totals}")
        ids = self.spark.createDataFrame([(b,) for b in state.batches], "batch string")
        if state.held:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/data/{state.held}"))
        ids.write.parquet(f"{self.path}/data/{held}")
        at = state
        while not self._append(at.number + 1, {"through": state.number, "totals": totals, "batches": held}):
            at = self.state()
            if at.base_at != state.base_at:
                for name in (totals, held):
                    self.fs.delete(self._path(f"{self.path}/data/{name}"), True)
                return False
        return True

    def clean(self) -> None:
        """Remove entries that a compaction stands for and data that no entry names. Only while no commit or compaction is under way and no older reading is in use."""
        state = self.state()
        needed = {*state.folders, state.held}
        if state.base_at:
            through = self._entry(state.base_at)["through"]
            for n in self._names("log"):
                if int(n) <= through:
                    self.fs.delete(self._path(f"{self.path}/log/{n}"), False)
        for name in self._names("data"):
            if name not in needed:
                self.fs.delete(self._path(f"{self.path}/data/{name}"), True)


def insert(counts: DataFrame) -> DataFrame:
    """Changes that insert counted documents."""
    return counts.select(F.lit("insert").alias("op"), *KEY, "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def delete(counts: DataFrame) -> DataFrame:
    """Changes that take counted documents out."""
    return insert(counts).withColumn("op", F.lit("delete"))


def revise(counts: DataFrame, old: str = "old_tokens") -> DataFrame:
    """Changes that replace counts, in column ``old``, by those in n_tokens."""
    return counts.select(F.lit("revise").alias("op"), *KEY, "n_tokens", F.col(old).alias("old_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by the tokenizer after the life of a rollup over the whole table: every document is inserted with an estimate, a quarter of its characters, in two batches, and again as of
    an older version; the estimates are revised to the tokenizer's counts, and the older version's documents deleted. Every batch is committed twice, and the log is compacted in between."""
    docs = read(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    estimate = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long")
    counts = cut(count_tokens(docs.withColumn("doc_id", estimate), "byte_bpe_50k").withColumnRenamed("doc_id", "old_tokens"), "counts")
    rough = counts.withColumn("n_tokens", F.col("old_tokens"))
    half = F.pmod(F.xxhash64("old_tokens", "lang"), F.lit(2)) == 0
    older = rough.withColumn("version", F.lit("estimate"))

    def twice(batch: str, changes: DataFrame) -> None:
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)

    twice("load-1", insert(rough.where(half)))
    twice("load-older", insert(older))
    rollup.compact()
    twice("load-2", insert(rough.where(~half)))
    twice("revise", revise(counts))
    twice("delete-older", delete(older))
    rollup.compact()
    rollup.clean()
    return rollup.totals()
