"""Block-compressed and binary alignment files, read whole per file.

``binaryFile`` lists and distributes the files; a small parser runs per file.
Text in block-compressed files needs none of this: ``spark.read.text`` reads
it, as every block is a gzip member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed values of the formats: operations by code, bases by nibble.
OPS = "MIDNSHP=X"
NIBBLES = "=ACMGRSVTWYHKDBN"
BLOCKS = "path string, block_address long, compressed_size int, size int, crc_ok boolean"
RECORDS = ("path string, ordinal long, virtual_offset long, read_name string, flags int, ref_index int, ref_name string, pos long, mapq int, "
           "cigar array<struct<len:int,op:string>>, mate_ref_index int, mate_pos long, tlen long, bases string, quality binary")


def make_pointer(block_address: Column, offset: Column) -> Column:
    """Virtual offset: block address above 16 bits of place in the block."""
    return F.shiftleft(block_address, 16).bitwiseOR(offset)


def pointer_block(pointer: Column) -> Column:
    return F.shiftright(pointer, 16)


def pointer_offset(pointer: Column) -> Column:
    return pointer.bitwiseAND(0xFFFF)


def blocks_of(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """Address, compressed size, content and CRC state of each block."""
    at = 0
    while at + 18 <= len(data):
        if data[at : at + 4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at}")
        extra_size = struct.unpack_from("<H", data, at + 10)[0]
        extra, size = data[at + 12 : at + 12 + extra_size], 0
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"BC" and n == 2:
                size = struct.unpack_from("<H", extra, 4)[0] + 1
            extra = extra[4 + n :]
        if not size:
            raise ValueError(f"no block size at {at}")
        body = zlib.decompress(data[at + 12 + extra_size : at + size - 8], -15)
        crc, length = struct.unpack_from("<II", data, at + size - 8)
        yield at, size, body, zlib.crc32(body) == crc and len(body) == length
        at += size


def block_bytes(content: bytes, level: int = 5) -> bytes:
    """One block (content up to 65,280 bytes)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(content) + c.flush()
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body
            + struct.pack("<II", zlib.crc32(content), len(content)))


def compress(content: bytes, level: int = 5, terminate: bool = True) -> bytes:
    """Blocks of ``content``, and the empty block that ends a file."""
    step = 65280
    out = b"".join(block_bytes(content[i : i + step], level) for i in range(0, len(content), step))
    return out + block_bytes(b"", level) if terminate else out


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block of the files at ``path``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, a, n, len(b), ok) for a, n, b, ok in blocks_of(data)]
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((
                        ("path", pa.string()), ("block_address", pa.int64()), ("compressed_size", pa.int32()), ("size", pa.int32()), ("crc_ok", pa.bool_())))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, BLOCKS)


def _records(name: str, data: bytes) -> Iterator[dict]:
    blocks = list(blocks_of(data))
    if not all(ok for *_, ok in blocks):
        raise ValueError(f"{name}: a block's checksum fails")
    text = b"".join(b for _, _, b, _ in blocks)
    ends, total = [], 0
    for address, _, body, _ in blocks:
        ends.append((total, address))
        total += len(body)
    if text[:4] != b"BAM\1":
        raise ValueError(f"{name}: not a BAM file")
    at = 8 + struct.unpack_from("<i", text, 4)[0]
    names = []
    n_ref = struct.unpack_from("<i", text, at)[0]
    at += 4
    for _ in range(n_ref):
        n = struct.unpack_from("<i", text, at)[0]
        names.append(text[at + 4 : at + 3 + n].decode())
        at += 8 + n
    ordinal, block = 0, 0
    while at < len(text):
        while block + 1 < len(ends) and ends[block + 1][0] <= at:
            block += 1
        size, ref, pos, n_name, mapq, _, n_ops, flags, n_bases, mate_ref, mate_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", text, at)
        p = at + 36
        read_name = text[p : p + n_name - 1].decode()
        p += n_name
        cigar = [{"len": v >> 4, "op": OPS[v & 15]} for v in struct.unpack_from(f"<{n_ops}I", text, p)]
        p += 4 * n_ops
        packed = text[p : p + (n_bases + 1) // 2]
        bases = "".join(NIBBLES[b >> 4] + NIBBLES[b & 15] for b in packed)[:n_bases]
        p += len(packed)
        quality = text[p : p + n_bases]
        yield {"path": name, "ordinal": ordinal, "virtual_offset": ends[block][1] << 16 | at - ends[block][0], "read_name": read_name, "flags": flags, "ref_index": ref,
               "ref_name": names[ref] if ref >= 0 else "*", "pos": pos + 1, "mapq": mapq, "cigar": cigar, "mate_ref_index": mate_ref, "mate_pos": mate_pos + 1, "tlen": tlen,
               "bases": bases or None, "quality": None if not quality or quality[0] == 0xFF else quality}
        ordinal += 1
        at += 4 + size


def bam(spark: SparkSession, path: str, rows_per_batch: int = 5000) -> DataFrame:
    """Alignment records of the BAM files at ``path``; ``ordinal`` is the input order in a file."""
    schema = pa.schema([
        ("path", pa.string()), ("ordinal", pa.int64()), ("virtual_offset", pa.int64()), ("read_name", pa.string()), ("flags", pa.int32()), ("ref_index", pa.int32()),
        ("ref_name", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))),
        ("mate_ref_index", pa.int32()), ("mate_pos", pa.int64()), ("tlen", pa.int64()), ("bases", pa.string()), ("quality", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[dict] = []
                for row in _records(name, data):
                    rows.append(row)
                    if len(rows) == rows_per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, RECORDS)
