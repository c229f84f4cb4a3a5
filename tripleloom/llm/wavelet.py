"""Token-ID output: a wavelet matrix per shard, in one compressed file.

A shard holds whole documents' token ids, one after the other, as a succinct index of bit-planes: plane k has bit k (from the top) of
every token, after a stable partition by the planes above it. It answers

* ``access(i)``: the i-th token; ``tokens(a, b)`` / ``document(k)``: a range, a document;
* ``rank(t, i)``: occurrences of token t before place i; ``count(t)``: all of them;
* ``select(t, k)``: the place of the k-th occurrence; ``find(t)``: all places.

The file is a header; a table of sections; the rank directory (ones before each segment of 2^16 bits of a plane, and, in it, before each block of 512); the sections: each
segment of a plane, and the document offsets, compressed by zstd where that is smaller. A reader works on the file as it lies, mapped or in memory: opening reads
the header and the offsets, a query only the segments it passes through.
"""

from __future__ import annotations

import mmap
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import read, ready
from .tokenizer import DEFAULT, encode

SHARD_TOKENS, BLOCK, SEGMENT, MAGIC = 1 << 20, 512, 1 << 16, b"TLWM2\0"
HEAD, SECTION = "<QIH", np.dtype([("at", "<u8"), ("size", "<u4"), ("raw", "<u4")])
WORDS = BLOCK // 64


def build(tokens: np.ndarray, offsets: np.ndarray, bits: int | None = None) -> bytes:
    """The file of a shard. offsets: where each document begins, and the end."""
    n, bits = len(tokens), bits or max(1, int(np.max(tokens, initial=0)).bit_length())
    tokens = np.asarray(tokens, np.uint16 if bits <= 16 else np.uint32)
    per_segment, n_segments, n_blocks = SEGMENT // 8, -(-n // SEGMENT), -(-n // BLOCK)
    press, parts = zstandard.ZstdCompressor(level=1), []
    segments, blocks = np.zeros((bits, n_segments + 1), "<u8"), np.zeros((bits, n_blocks), "<u2")
    for k in range(bits):
        bit = (tokens & tokens.dtype.type(1 << (bits - 1 - k))) != 0
        plane = np.packbits(bit, bitorder="little")
        padded = np.zeros(n_blocks * BLOCK // 8, np.uint8)
        padded[: len(plane)] = plane
        ones = np.r_[0, np.bitwise_count(padded.view(np.uint64)).reshape(-1, WORDS).sum(1, dtype=np.int64).cumsum()]
        segments[k] = ones[np.minimum(np.arange(n_segments + 1) * (SEGMENT // BLOCK), n_blocks)]
        blocks[k] = ones[:-1] - np.repeat(segments[k, :-1].astype(np.int64), SEGMENT // BLOCK)[:n_blocks]
        parts += [plane[i : i + per_segment].tobytes() for i in range(0, len(plane), per_segment)]
        tokens = np.concatenate([tokens[~bit], tokens[bit]])
    parts.append(np.diff(np.asarray(offsets, np.int64), prepend=0).astype("<u4").tobytes())
    body = [c if len(c := press.compress(p)) < len(p) else p for p in parts]
    table = np.zeros(len(parts), SECTION)
    table["size"], table["raw"] = [len(x) for x in body], [len(x) for x in parts]
    head = MAGIC + struct.pack(HEAD, n, len(offsets), bits)
    table["at"] = len(head) + table.nbytes + segments.nbytes + blocks.nbytes + np.r_[0, table["size"].astype(np.uint64).cumsum()[:-1]]
    return b"".join([head, table.tobytes(), segments.tobytes(), blocks.tobytes(), *body])


class WaveletMatrix:
    """Reads a shard's file, of which ``data`` is any buffer."""

    def __init__(self, data):
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.data, at = data, len(MAGIC)
        self.n, m, self.bits = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        self.n_segments, n_blocks = -(-self.n // SEGMENT), -(-self.n // BLOCK)
        self.table = np.frombuffer(data, SECTION, self.bits * self.n_segments + 1, at)
        at += self.table.nbytes
        self.segments = np.frombuffer(data, "<u8", self.bits * (self.n_segments + 1), at).reshape(self.bits, -1).astype(np.int64)
        at += self.segments.nbytes
        self.blocks = np.frombuffer(data, "<u2", self.bits * n_blocks, at).reshape(self.bits, -1)
        self.offsets = np.frombuffer(self._section(len(self.table) - 1), "<u4").astype(np.int64).cumsum()
        if len(self.offsets) != m:
            raise ValueError("broken offsets")
        self.zeros = [self.n - int(x) for x in self.segments[:, -1]]
        self.read: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """A shard's file on a mounted file system, mapped into memory."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __len__(self) -> int:
        return self.n

    def _section(self, k: int) -> bytes:
        at, size, raw = (int(x) for x in self.table[k])
        data = self.data[at : at + size]
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=raw) if size < raw else data

    def _segment(self, k: int, s: int) -> np.ndarray:
        """64-bit words of segment s of plane k, with zeros up to a whole block."""
        if (k, s) not in self.read:
            raw = self._section(k * self.n_segments + s)
            self.read[k, s] = np.frombuffer(bytes(raw) + bytes(-len(raw) % (BLOCK // 8)), "<u8")
        return self.read[k, s]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        if i >= self.n:
            return self.n - self.zeros[k]
        s, block, word = i // SEGMENT, i // BLOCK, i % SEGMENT // 64
        own = self._segment(k, s)
        c = int(self.segments[k, s]) + int(self.blocks[k, block]) + int(np.bitwise_count(own[word // WORDS * WORDS : word]).sum(dtype=np.int64))
        return c + (int(own[word]) & ((1 << i % 64) - 1)).bit_count()

    def _bit(self, k: int, i: int) -> int:
        return int(self._segment(k, i // SEGMENT)[i % SEGMENT // 64]) >> (i % 64) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        t = 0
        for k in range(self.bits):
            b = self._bit(k, i)
            i = self.zeros[k] + self._ones(k, i) if b else i - self._ones(k, i)
            t = t << 1 | b
        return t

    def _step(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of plane k at places i, and the ones before them; only segments with such places are read."""
        bit, ones, segment = np.empty(len(i), bool), np.empty(len(i), np.int64), i // SEGMENT
        order = np.argsort(segment, kind="stable")
        cuts = np.flatnonzero(np.diff(segment[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = order[a:b]
            s, place = int(segment[at[0]]), i[at] % SEGMENT
            own = self._segment(k, s)
            x, shift = own[place // 64], (place % 64).astype(np.uint64)
            bit[at] = (x >> shift) & np.uint64(1)
            within = np.bitwise_count(x & ((np.uint64(1) << shift) - np.uint64(1)))
            if b - a < len(own) // 4:  # few places: sum the words of their blocks
                word = place // 64
                first = word // WORDS * WORDS
                before = sum(np.where(first + j < word, np.bitwise_count(own[first + j]).astype(np.int64), 0) for j in range(WORDS - 1))
                ones[at] = self.segments[k, s] + self.blocks[k, i[at] // BLOCK] + before + within
            else:
                ones[at] = self.segments[k, s] + np.r_[0, np.bitwise_count(own).cumsum(dtype=np.int64)][place // 64] + within
        return bit, ones

    def tokens(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Tokens of places a to b, plane by plane: work in proportion to their number and that of planes."""
        i = np.arange(a, self.n if b is None else min(b, self.n))
        out = np.zeros(len(i), np.uint32)
        for k in range(self.bits):
            bit, ones = self._step(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            out = out << np.uint32(1) | bit
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.offsets[k]), int(self.offsets[k + 1]))

    def _range(self, t: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of t before place i lie."""
        if t < 0 or t >> self.bits:
            return 0, 0
        lo, hi = 0, i
        for k in range(self.bits):
            if t >> (self.bits - 1 - k) & 1:
                lo, hi = self.zeros[k] + self._ones(k, lo), self.zeros[k] + self._ones(k, hi)
            else:
                lo, hi = lo - self._ones(k, lo), hi - self._ones(k, hi)
        return lo, hi

    def rank(self, t: int, i: int) -> int:
        lo, hi = self._range(t, min(i, self.n))
        return hi - lo

    def count(self, t: int) -> int:
        return self.rank(t, self.n)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of that kind in plane k, by the directory down to a block."""
        ones = self.segments[k]
        before = ones if bit else np.arange(len(ones)) * SEGMENT - ones
        s = int(np.searchsorted(before[:-1], j, "right")) - 1
        j -= int(before[s])
        ones = self.blocks[k, s * (SEGMENT // BLOCK) : (s + 1) * (SEGMENT // BLOCK)].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, j, "right")) - 1
        own = np.unpackbits(self._segment(k, s)[block * WORDS : (block + 1) * WORDS].view(np.uint8), bitorder="little")
        return s * SEGMENT + block * BLOCK + int(np.flatnonzero(own == bit)[j - int(before[block])])

    def select(self, t: int, j: int) -> int:
        """Place of the j-th occurrence of t, from 0."""
        lo, hi = self._range(t, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            i = self._select_bit(k, 1, i - self.zeros[k]) if t >> (self.bits - 1 - k) & 1 else self._select_bit(k, 0, i)
        return i

    def find(self, t: int) -> list[int]:
        return [self.select(t, j) for j in range(self.count(t))]


def pack(docs: DataFrame, tokenizer: str = DEFAULT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard_id, n_docs, n_tokens, doc_ids, doc_offsets, file): one row per shard, made in one pass without a shuffle.

    A shard takes whole documents of one partition until it has ``shard_tokens``; a longer document makes a longer shard. Every row of docs is packed,
    repeated ones too; null and empty texts become documents of no tokens, null doc_ids stay null in the list. An empty table gives no shard.
    ``shard_id`` is the partition and a number in it. Other columns are ignored.
    """
    ready(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, runs, offsets, n = [], [], [0], 0

        def shard():
            row = [pa.array([f"{part:06d}-{number:05d}"]), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([offsets], pa.list_(pa.int64())), pa.array([build(np.concatenate([*runs, np.zeros(0, np.uint32)]), np.array(offsets))], pa.binary())]
            return pa.record_batch(row, names=["shard_id", "n_docs", "n_tokens", "doc_ids", "doc_offsets", "file"])

        for b in batches:
            id_type = b.schema.field(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.array(encode(t, tokenizer), np.uint32)
                if ids and n + len(own) > shard_tokens:
                    yield shard()
                    number, ids, runs, offsets, n = number + 1, [], [], [0], 0
                ids.append(d)
                runs.append(own)
                n += len(own)
                offsets.append(n)
        if ids:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(run, f"shard_id string, n_docs long, n_tokens long, doc_ids array<{kind}>, doc_offsets array<bigint>, file binary")


def save(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard of pack() as ``<folder>/<shard_id>.wm``; (shard_id, path, n_docs, n_tokens, n_bytes).

    ``folder`` is a URI that all executors share (file on a shared mount, hdfs, s3). A file appears under its name only when whole, and a task that runs again replaces it by the same bytes.
    Lazy like any DataFrame: files are written when the result is computed.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder.rstrip("/").replace("s3a://", "s3://"))
        store.create_dir(base, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for name, file in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                draft, to = f"{base}/.{name}-{uuid.uuid4().hex}", f"{base}/{name}.wm"
                with store.open_output_stream(draft) as out:
                    out.write(file)
                store.move(draft, to)
                paths.append(f"{folder.rstrip('/')}/{name}.wm")
                sizes.append(len(file))
            yield pa.record_batch([b.column(0), pa.array(paths, pa.string()), b.column(1), b.column(2), pa.array(sizes, pa.int64())], names=["shard_id", "path", "n_docs", "n_tokens", "n_bytes"])

    ready(shards.sparkSession)
    return shards.select("shard_id", "n_docs", "n_tokens", "file").mapInArrow(run, "shard_id string, path string, n_docs long, n_tokens long, n_bytes long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
