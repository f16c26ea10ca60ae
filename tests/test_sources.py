import struct

from pyspark.sql import functions as F

from genoweave.sources import binary as bn, text as tx
from genoweave.streaming import records as st


def record(name, flags, ref, pos, cigar, bases, quality, mate=(-1, -1), tlen=0):
    codes = b"".join(struct.pack("<I", n << 4 | bn.OPS.index(op)) for n, op in cigar)
    nibbles = [bn.NIBBLES.index(b) for b in bases] + [0] * (len(bases) % 2)
    packed = bytes(nibbles[i] << 4 | nibbles[i + 1] for i in range(0, len(nibbles), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flags, len(bases), *mate, tlen) + name.encode() + b"\0" + codes + packed + quality
    return struct.pack("<i", len(body)) + body


def test_bam_and_blocks(spark, tmp_path):
    header = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000)
    rows = [record("r1", 99, 0, 4, [(3, "S"), (4, "M")], "ACGTNAC", bytes(range(7)), (0, 20), 30), record("r2", 4, -1, -1, [], "", b"")]
    rows += [record(f"x{i}", 16, 0, i, [(1, "M")], "T", b"\xff") for i in range(3000)]
    raw = head + b"".join(rows)
    (tmp_path / "a.bam").write_bytes(bn.compress(raw))
    got = bn.bam(spark, str(tmp_path / "a.bam")).orderBy("ordinal").collect()
    assert len(got) == 3002
    a, b = got[:2]
    assert (a.read_name, a.flags, a.ref_name, a.pos, a.bases, a.mate_pos, a.tlen) == ("r1", 99, "c1", 5, "ACGTNAC", 21, 30)
    assert [(e.len, e.op) for e in a.cigar] == [(3, "S"), (4, "M")] and bytes(a.quality) == bytes(range(7))
    assert (b.ref_index, b.ref_name, b.bases, b.quality, b.cigar) == (-1, "*", None, None, [])
    blocks = bn.block_index(spark, str(tmp_path / "a.bam")).orderBy("block_address").collect()
    assert sum(r.size for r in blocks) == len(raw) and blocks[-1].size == 0 and all(r.crc_ok for r in blocks)
    last = got[-1]
    assert last.virtual_offset >> 16 in {r.block_address for r in blocks}
    assert [r.pos for r in got[2:]] == list(range(1, 3001))


def test_block_compressed_text(spark, tmp_path):
    (tmp_path / "x.vcf.gz").write_bytes(bn.compress(b"".join(b"line %d\n" % i for i in range(20000))))
    assert tx.lines(spark, str(tmp_path / "x.vcf.gz")).count() == 20000


def test_line_readers_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bed").write_text("c1\t0\t5\tx\nc2\t7\t9\ty\n# no\n")
    stream = tx.bed(tx.lines(spark, str(folder), streaming=True))
    got = st.drain(stream.select("contig", "start", "end"), "append").collect()
    assert sorted(tuple(r) for r in got) == [("c1", 1, 5), ("c2", 8, 9)]


def test_write_lines(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("r"), "id").alias("x"))
    tx.write_lines(df, "x", str(tmp_path / "out"), "gzip")
    assert tx.lines(spark, str(tmp_path / "out")).count() == 100


def test_chain_file_and_liftover(spark, tmp_path):
    from genoweave.operators.liftover import lift

    (tmp_path / "a.chain").write_text(
        "# note\nchain 100 c1 1000 + 0 105 d1 2000 + 1000 1105 1\n50 5 5\n50\n\nchain 9 c2 500 + 10 60 d2 300 - 20 70 2\n50\n")
    blocks = tx.chain_blocks(spark, str(tmp_path / "a.chain"))
    rows = [(r.chain_id, r.contig, r.from_start, r.from_end, r.to_contig, r.to_start, r.opposite, r.block) for r in blocks.orderBy("chain_id", "block").collect()]
    assert rows == [(1, "c1", 0, 50, "d1", 1000, False, 0), (1, "c1", 55, 105, "d1", 1055, False, 1), (2, "c2", 10, 60, "d2", 20, True, 0)]
    cases = [(0, "c1", 1, 10), (1, "c1", 45, 60), (2, "c2", 11, 20), (3, "c3", 1, 5), (4, "c2", 51, 70)]
    got = {r.k: (r.lifted_contig, r.lifted_start, r.lifted_end) for r in lift(spark.createDataFrame(cases, "k int, contig string, start long, end long"), "k", blocks).collect()}
    assert got == {0: ("d1", 1001, 1010), 1: (None, None, None), 2: ("d2", 271, 280), 3: (None, None, None), 4: (None, None, None)}
