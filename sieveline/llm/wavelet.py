"""Token-id shards as wavelet matrices: one compressed file per shard.

A shard holds the ids of whole documents in ascending doc_id order. Level by level, from the most
significant bit, it stores the bits of the ids and then deals the ids out stably, zeros first.
Each bit-plane carries a directory of the ones before every block, so rank and select, and through
them access, counting and occurrence lookup, work on the planes themselves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import Scratch
from sieveline.llm.tokens import encoder
from sieveline.session import ship_package

MAGIC = b"WVMX\x01"
BLOCK_BITS = 512
#: Ids after which a shard is closed; a single longer document makes a shard of its own.
SHARD_IDS = 1 << 20


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n  # unsigned 64-bit words, whole blocks
        counts = np.bitwise_count(words).reshape(-1, BLOCK_BITS // 64).astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(counts.sum(axis=1))]).astype(np.int64)
        self.inside = (np.cumsum(counts, axis=1) - counts).astype(np.uint16).reshape(-1)

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        size = (len(bits) // BLOCK_BITS + 1) * BLOCK_BITS // 8
        return cls(np.concatenate([packed, np.zeros(size - len(packed), np.uint8)]).view("<u8"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), bitorder="little", count=self.n).view(bool)

    def get(self, at):
        at = np.asarray(at, np.int64)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, at):
        """Ones before each position of `at` (0 to n)."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        part = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at // BLOCK_BITS] + self.inside[word] + np.bitwise_count(part)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) set or unset bit."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = int(self.ones(mid + 1))
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low


class WaveletMatrix:
    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, n = [], [], len(ids)
        for level in range(levels - 1, -1, -1):
            bits = ((ids >> level) & 1).astype(bool)
            planes.append(Plane.of(bits))
            low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
            zeros.append(len(low))
            ids = np.concatenate([ids.take(low), ids.take(high)])
        return cls(planes, zeros, n)

    def access(self, at) -> np.ndarray:
        """Ids at the given positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(at.shape, np.uint32)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane.get(at), plane.ones(at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def _narrow(self, token: int, low: int, high: int) -> tuple[int, int]:
        levels = len(self.planes)
        if token < 0 or token >> levels:
            return 0, 0
        for i, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            a, b = int(plane.ones(low)), int(plane.ones(high))
            low, high = (zeros + a, zeros + b) if token >> (levels - 1 - i) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of `token` in positions start to end (exclusive)."""
        low, high = self._narrow(token, start, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of `token`; -1 if there are fewer."""
        low, high = self._narrow(token, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        at, levels = low + k, len(self.planes)
        for i in range(levels - 1, -1, -1):
            bit = token >> (levels - 1 - i) & 1
            at = self.planes[i].select(bit, at - self.zeros[i] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order: the deals undone from the last plane to the first."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bits = plane.bits()
            above = np.empty_like(ids)
            above[np.flatnonzero(~bits)] = ids[:zeros]
            above[np.flatnonzero(bits)] = ids[zeros:] | ids.dtype.type(1 << level)
            ids = above
        return ids


def dump(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file: magic; ids, levels and documents; zeros by level; documents; planes, each compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    parts = [
        known,
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        *[p.words.tobytes() for p in matrix.planes],
    ]
    packed = [pack(p) for p in parts]
    head = MAGIC + struct.pack("<QIQ", matrix.n, len(matrix.planes), len(doc_ids))
    head += struct.pack(f"<{len(matrix.zeros)}Q", *matrix.zeros) + struct.pack(f"<{len(packed)}Q", *map(len, packed))
    return head + b"".join(packed)


def load(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    at = len(MAGIC)
    n, levels, docs = struct.unpack_from("<QIQ", data, at)
    at += struct.calcsize("<QIQ")
    zeros = list(struct.unpack_from(f"<{levels}Q", data, at))
    at += 8 * levels
    sizes = struct.unpack_from(f"<{levels + 3}Q", data, at)
    at += 8 * (levels + 3)
    unpack, parts = zstandard.ZstdDecompressor().decompress, []
    for size in sizes:
        parts.append(unpack(data[at : at + size]))
        at += size
    known, ids = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    doc_ids = [int(i) if k else None for k, i in zip(known, ids)]
    planes = [Plane(np.frombuffer(p, "<u8"), n) for p in parts[3:]]
    assert len(doc_ids) == docs
    return WaveletMatrix(planes, zeros, n), doc_ids, np.frombuffer(parts[2], "<u8").astype(np.int64)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of doc_id, sorted inside; equal ids in order of their text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key").select("doc_id", "text")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text (null: empty), append `end_id`, and write one file per shard under `path`.

    Columns: part and seq give the order of the shards; n_ids, n_docs; data, the file's bytes.
    """

    def shard(enc, seq, ids, doc_ids) -> pa.RecordBatch:
        flat = np.concatenate(ids)
        levels = max(1, (max(enc.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        data = dump(WaveletMatrix.build(flat, levels), doc_ids, [len(x) for x in ids])
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "seq": pa.array([seq], pa.int64()),
                "n_ids": pa.array([len(flat)], pa.int64()),
                "n_docs": pa.array([len(doc_ids)], pa.int64()),
                "data": pa.array([data], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ids, doc_ids, size, seq = [], [], 0, 0
        end = np.array([end_id], enc.dtype)
        for doc_id, own in enc.stream(batches):
            own = np.concatenate([own, end])
            if ids and size + len(own) > shard_ids:
                yield shard(enc, seq, ids, doc_ids)
                ids, doc_ids, size, seq = [], [], 0, seq + 1
            ids.append(own)
            doc_ids.append(doc_id)
            size += len(own)
        if ids:
            yield shard(enc, seq, ids, doc_ids)

    ship_package(docs.sparkSession)
    shards = in_order(docs).mapInArrow(run, "part long, seq long, n_ids long, n_docs long, data binary")
    shards.write.option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark, path: str, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    start counts the ids of all documents before; it comes from the sizes of the shards, in two
    levels so that no task sees all shards. The table of starts is joined by Spark's own choice,
    which broadcasts it only below the configured size.
    """
    shards = spark.read.schema("part long, seq long, n_ids long, n_docs long, data binary").parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per task of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts, _ = scratch.write(starts.select("part", "seq", (F.col("part_start") + F.col("inside")).alias("base")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                matrix, doc_ids, lengths = load(data.as_py())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "start": pa.array(base + ends - lengths, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)], pa.int64()),
                    }
                )

    rows = shards.select("part", "seq", "data").join(starts, ["part", "seq"]).select("base", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
