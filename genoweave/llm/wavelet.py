"""Token ids in one compressed file per shard: a wavelet matrix with rank and select.

A shard file holds the ids of whole documents as bit planes, highest bit first;
below each plane the ids are stably parted by that bit, zeros before ones. Rank
directories are rebuilt on opening, so the file holds planes and document ends
only, each section compressed by itself. Access, counting and occurrence lookup
cost one rank or select per plane and need no decoding.

The corpus is range-partitioned by doc_id, and each task writes its partition's
shards as rows (part, seq, payload) of a Parquet table in the shared folder: the
payload is the file, the table gives atomic commits on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import materialize, shuffle_partitions, table
from .tokens import encoder, tokenizer_path

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 20
BATCH_TEXTS = 2048  # encoded in one call
WORD = 512  # bits per rank block
SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"


def build_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """The file of ``ids`` (unsigned) of documents that end (exclusive) at ``ends``."""
    n = int(ids.size)
    width = max(1, int(ids.max()).bit_length()) if n else 1
    cur = ids.astype(np.uint16 if width <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, sections = [], []
    for level in range(width - 1, -1, -1):
        one = (cur >> level & 1).astype(bool)
        sections.append(pack(np.packbits(one, bitorder="little").tobytes()))
        zeros.append(n - int(np.count_nonzero(one)))
        parted = np.empty_like(cur)
        np.compress(~one, cur, out=parted[: zeros[-1]])
        np.compress(one, cur, out=parted[zeros[-1] :])
        cur = parted
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    sections += [pack(known.tobytes()), pack(keys.tobytes()), pack(np.asarray(ends, "<u8").tobytes())]
    head = struct.pack("<4sBQQ", MAGIC, width, n, len(doc_ids)) + struct.pack(f"<{width}Q", *zeros)
    head += struct.pack(f"<{len(sections)}Q", *map(len, sections))
    return head + b"".join(sections)


class Shard:
    """An opened shard file."""

    def __init__(self, raw: bytes) -> None:
        magic, self.width, self.n, docs = struct.unpack_from("<4sBQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sBQQ")
        self.zeros = struct.unpack_from(f"<{self.width}Q", raw, at)
        at += 8 * self.width
        sizes = struct.unpack_from(f"<{self.width + 3}Q", raw, at)
        at += 8 * len(sizes)
        unpack = zstandard.ZstdDecompressor().decompress
        sections = []
        for size in sizes:
            sections.append(unpack(raw[at : at + size]))
            at += size
        self.planes = [np.frombuffer(s, np.uint8) for s in sections[: self.width]]
        known, keys = np.frombuffer(sections[-3], np.uint8), np.frombuffer(sections[-2], "<i8").tolist()
        self.doc_ids = [k if ok else None for k, ok in zip(keys, known)]
        self.ends = np.frombuffer(sections[-1], "<u8").astype(np.int64)
        assert len(self.doc_ids) == docs
        self._blocks: list[np.ndarray | None] = [None] * self.width

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _directory(self, level: int) -> np.ndarray:
        if self._blocks[level] is None:
            counts = np.bitwise_count(self.planes[level])
            step = WORD // 8
            padded = np.zeros(-(-counts.size // step) * step, np.int64)
            padded[: counts.size] = counts
            self._blocks[level] = np.concatenate([[0], np.cumsum(padded.reshape(-1, step).sum(1))])
        return self._blocks[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        plane, block = self.planes[level], i // WORD
        first = block * WORD // 8
        ones = int(self._directory(level)[block]) + int(np.bitwise_count(plane[first : i >> 3]).sum())
        return ones + (int(plane[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        ones = self._directory(level)
        counts = ones if bit else np.arange(ones.size) * WORD - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * WORD // 8 : (block + 1) * WORD // 8], bitorder="little")
        return block * WORD + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _walk(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.width - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in places lo to hi (exclusive)."""
        lo, hi = self._walk(token, lo, self.n if hi is None else hi)
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._walk(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, as unsigned 32-bit."""
        cur = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(cur)
            up[np.flatnonzero(~one)] = cur[: self.zeros[level]]
            up[np.flatnonzero(one)] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.width - 1 - level))
            cur = up
        return cur.astype("<u4")


def write_shards(docs: DataFrame, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``doc_id, text`` in ascending doc_id order into a table of shard files.

    Null text is the end id alone; null doc_ids come first; rows with one
    doc_id are ordered by their text's crc32. Only these two columns are read.
    An empty table gives no shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seq, keys, ids, total = 0, [], [], 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in ids])
            payload = build_shard(np.frombuffer(b"".join(ids), "<u4"), keys, ends)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), BATCH_TEXTS):
                some = texts.slice(at, BATCH_TEXTS).to_pylist()
                for doc, raw in zip(doc_ids[at : at + BATCH_TEXTS], enc.encode(some)):
                    raw += end
                    keys.append(doc)
                    ids.append(raw)
                    total += len(raw) // 4
                    if total >= shard_tokens:
                        yield close()
                        seq, keys, ids, total = seq + 1, [], [], 0
        if keys:
            yield close()

    order = ["doc_id", F.crc32(F.col("text").cast("binary"))]
    ranged = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    return materialize(ranged.sortWithinPartitions(*order).mapInArrow(encode, SHARDS), "wavelet")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(payload)
                raw, ends = memoryview(shard.decode()).cast("B"), shard.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int32()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "payload").mapInArrow(
        decode, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_tokens")
    # one row per range partition: the only prefix sum over everything
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens_in"))
    parts = parts.select("part", F.coalesce(F.sum("tokens_in").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start"))
    return rows.join(starts, ["part", "seq"]).join(parts, "part").select(
        "doc_id", (F.col("part_start") + F.col("seq_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into wavelet shard files and read them back."""
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_shards(docs, tokenizer_path("byte_bpe_50k.json"), 2))
