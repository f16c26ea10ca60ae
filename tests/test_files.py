"""Files whose records span lines, over many splits, and the chunked reference."""

import random

import pytest
from pyspark.sql import functions as F

from genoweave.functions import alignment as al, numeric as nu, sequence as sq, variant as va
from genoweave.operators import reference as rf
from genoweave.sources import files as fl, text as tx


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    want = {}
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 700)):
        rows = [f"{name} {i} " + "x" * (i * 7 % 90) if i % 11 else "" for i in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want |= {(name, i): r for i, r in enumerate(rows)}
    lines = fl.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert {(r.file.rpartition("/")[2], r.line): r.value for r in lines.collect()} == want


def test_fastq_over_splits_loses_nothing(spark, tmp_path, small_splits):
    reads = [(f"r{i}", "ACGT" * (i % 40 + 1)) for i in range(900)]
    text = "".join(f"@{n}\n{b}\n{'-' if i == 5 else '+'}\n{'@' * len(b)}\n" for i, (n, b) in enumerate(reads)) + "@cut\nAC\n"
    (tmp_path / "x.fastq").write_text(text)
    got = tx.fastq(spark, str(tmp_path / "x.fastq")).orderBy("read").collect()
    assert [(r.name, r.bases) for r in got[:-1]] == reads and got[-1].error == "truncated"
    assert [r.read for r in got if r.error] == [5, 900]


def test_fasta_over_splits_in_chunks(spark, tmp_path, small_splits):
    rng = random.Random(7)
    contigs = {f"c{k}": "".join(rng.choices("ACGTacgtN", k=n)) for k, n in enumerate((0, 1, 59, 60, 61, 20_000))}
    text = "lost\n" + "".join(f">{n} note\n" + "".join(b[i : i + 60] + "\n" for i in range(0, len(b), 60)) for n, b in contigs.items())
    (tmp_path / "x.fa").write_text(text)
    pieces = fl.fasta_pieces(fl.numbered_lines(spark, str(tmp_path / "x.fa")))
    assert [r.bases for r in pieces.filter("error = 'header'").collect()] == ["lost"]
    chunks = rf.chunk_table(pieces.filter("error is null"), 128)
    found = {}
    for r in chunks.orderBy("contig", "chunk").collect():
        found[r.contig] = found.get(r.contig, "") + r.bases
    assert found == {n: b for n, b in contigs.items() if b}
    spans = [("c5", s, n) for s, n in ((1, 1), (128, 2), (129, 500), (19_990, 50), (20_001, 5), (0, 4), (3, 0), (1, 20_000))] * 2 + [("c9", 1, 4), (None, 1, 4), ("c1", 1, 3)]
    df = spark.createDataFrame(spans, "contig string, start long, span long")
    got = sorted((tuple(r) for r in rf.reference_bases(df, chunks, 128).collect()), key=repr)
    assert got == sorted(((c, s, n, contigs.get(c, "")[s - 1 : s - 1 + n] if s > 0 and n > 0 else "") for c, s, n in spans), key=repr)


def test_running_offset_over_bands(spark):
    rows = [(k, i * 37, i % 5) for k in ("a", "b", None) for i in range(50)]
    got = rf.running_offset(spark.createDataFrame(rows, "k string, p long, n int"), ["k"], "p", F.col("n"), band=100).collect()
    assert len(got) == 150 and all(r.offset == sum(n for k, p, n in rows if k == r.k and p < r.p) for r in got)


WALKS = [  # start, cigar, read, MD, NM over ten times ACGT
    (1, "8M", "ACGTACGT", "8", 0), (1, "8M", "ACCTACGT", "2G5", 1), (1, "4M2D4M", "ACGTACGT", "4^AC0G0T0A0C0", 6), (1, "4M2I4M", "ACGTTTACGT", "8", 2),
    (1, "2S6M", "TTGTACGT", "0A0C0G0T0A0C0", 6), (1, "4M3N4M", "ACGTACGT", "4T0A0C0G0", 4), (5, "8M", "AAGTACGA", "1C5T0", 2),
    (1, "4M", "acg.", "3T0", 1), (39, "4M", "GTAC", "2", 0), (39, "2M3D2M", "GTAC", "2^0", 0), (38, "2M3D2M", "CGAC", "2^T0", 0)]


def test_md_and_nm_by_chunks(spark):
    pieces = spark.createDataFrame([("c", 0, "ACGT" * 10)], "contig string, offset long, bases string")
    rows = spark.createDataFrame([(i, "c", s, c, r) for i, (s, c, r, _, _) in enumerate(WALKS)], "k int, contig string, start long, text string, read string")
    rows = rows.withColumn("cigar", al.parse_cigar(F.col("text"))).withColumn("span", al.reference_length(F.col("cigar")).cast("long"))
    got = rf.reference_bases(rows, rf.chunk_table(pieces, 7), 7).select("k", sq.md_and_nm(F.col("read"), F.col("cigar"), F.col("reference")).alias("x")).collect()
    assert {r.k: (r.x.md, r.x.nm) for r in got} == {i: (w[3], w[4]) for i, w in enumerate(WALKS)}


@pytest.mark.parametrize("a,b,want", [("a", "A", True), (".", "n", True), ("M", "A", False), ("N", "A", False), ("*", "#", True), ("E", "Q", True), ("*", "A", False), ("é", "é", False), ("é", "*", False), ("~", "}", True), ("=", "=", True)])
def test_base_equality(spark, a, b, want):
    r = spark.range(1).select(sq.bases_equal(F.lit(a), F.lit(b)).alias("e"), sq.mismatches(F.lit(a), F.lit(b)).alias("n")).first()
    assert (r.e, r.n) == (want, 0 if want else 1)


def test_marks_may_be_any_character(spark):
    r = spark.range(1).select(sq.md_text(F.lit("AC;G^"), F.lit("A=A;=")).alias("md"), sq.md_text(F.lit(""), F.lit("A")).alias("none")).first()
    assert (r.md, r.none) == ("1=0A0;1", "0")


def test_odd_chains_come_with_their_error(spark, tmp_path):
    (tmp_path / "x.chain").write_text("7\nchain 1 a 9 + 0 5 b 9 + 0 5 1\n5\nchain 1 a 9 + 0 5 b 9 + 0 x 2\n5\n\nchain 1 a 9 + 0 5 b 9 + 0 5 3\n# c\n2 1 1\n2\nchain 1 a 9 + 0 5 b 9 + 0 5 4\n")
    got = tx.chain_blocks(spark, str(tmp_path / "x.chain")).orderBy("chain_line", "block").collect()
    assert [(r.chain_line, r.chain_id, r.block, r.error) for r in got] == [(0, None, None, "stray"), (1, 1, 0, None), (3, 2, None, "header"), (6, 3, 0, None), (6, 3, 1, None), (10, 4, None, "unfinished")]
    names = spark.createDataFrame([("a",)], "name string")
    assert [tuple(r) for r in fl.missing_targets(tx.chain_blocks(spark, str(tmp_path / "x.chain")), names).collect()] == [("b", 3)]


def test_numbers_that_do_not_fit(spark):
    r = spark.range(1).select(
        al.parse_cigar(F.lit("99999999999M")).alias("c"), va.genotype_alleles(F.lit("0/x")).alias("g"), nu.round_half_up(F.lit(1e300)).alias("top"), nu.round_half_up(F.lit(float("-inf"))).alias("low"),
        nu.round_half_up(F.lit(0.49999999999999994)).alias("half"), nu.round_half_up(F.lit(-2.5)).alias("neg"), va.genotype_block(F.lit("GT:GQ"), F.lit("0/1:3e9"), F.lit(2)).alias("b")).first()
    assert (r.c, r.g, r.top, r.low, r.half, r.neg, r.b.gq) == (None, [0, None], 2**63 - 1, -(2**63), 0, -2, None)
