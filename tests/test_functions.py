import math

from pyspark.sql import functions as F

from genoweave.functions import alignment as al, numeric as nu, sequence as sq
from genoweave.operators import genotypes as gt, histogram as hs, intervals as iv
from genoweave.sources import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def murmur(text, seed):
    def mul(a, b):
        return a * b & 0xFFFFFFFF

    def rot(x, r):
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    def scramble(k):
        return mul(rot(mul(k, 0xCC9E2D51), 15), 0x1B873593)

    h, u = seed, [ord(c) for c in text]
    for i in range(0, len(u) - 1, 2):
        h = (mul(rot(h ^ scramble(u[i] | u[i + 1] << 16), 13), 5) + 0xE6546B64) & 0xFFFFFFFF
    if len(u) % 2:
        h ^= scramble(u[-1])
    h ^= 2 * len(u)
    h = mul(h ^ h >> 16, 0x85EBCA6B)
    h = mul(h ^ h >> 13, 0xC2B2AE35)
    return h ^ h >> 16


def test_murmur3(spark):
    names = ["", "a", "ab", "read:1:22", "q123456", "é日x", "z" * 41]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(sq.murmur3(F.col("n"), 7).alias("h")).collect()
    assert [r.h for r in got] == [murmur(n, 7) for n in names]


def test_cigar_text(spark):
    rows = spark.createDataFrame([("5S10M2D3M",), ("*",), ("10",), ("M",), ("3X4=1N2P",)], "c string")
    got = [r.x for r in rows.select(al.parse_cigar(F.col("c")).alias("x")).collect()]
    assert [None if g is None else [(e.len, e.op) for e in g] for g in got] == [
        [(5, "S"), (10, "M"), (2, "D"), (3, "M")], [], None, None, [(3, "X"), (4, "="), (1, "N"), (2, "P")]]


def test_soft_clip(spark):
    rows = spark.createDataFrame([("36M", 30), ("10M5I21M", 12), ("5H26M5H", 25), ("8M4S", 20)], "c string, at int")
    got = [r.x for r in rows.select(al.render_cigar(al.soft_clip_from(al.parse_cigar(F.col("c")), F.col("at"))).alias("x")).collect()]
    assert got == ["29M7S", "10M1I25S", "5H24M2S5H", "8M4S"]


def test_bins(spark):
    rows = spark.createDataFrame([(0, 1), (16383, 16385), (0, 1 << 26), (0, (1 << 26) + 1), (1 << 29, (1 << 29) + 5), (5, 5)], "s long, e long")
    assert [r.x for r in rows.select(al.region_bin(F.col("s"), F.col("e")).alias("x")).collect()] == [4681, 585, 1, 0, None, 4681]


def test_interval_edges(spark):
    rows = [("a", 1, 10), ("a", 5, 20), ("a", 21, 30), ("a", 32, 40), ("a", 200000, 400000), ("a", 390000, 500000), ("b", 3, 3)]
    df = spark.createDataFrame(rows, "contig string, start long, end long")
    assert sorted((r.contig, r.start, r.end, r.members) for r in iv.merge(df).collect()) == [
        ("a", 1, 30, 3), ("a", 32, 40, 1), ("a", 200000, 500000, 2), ("b", 3, 3, 1)]
    d = spark.createDataFrame([(0, "a", 600000), (1, "c", 50)], "idx int, name string, length long")
    assert sorted((r.contig, r.start, r.end) for r in iv.complement(df, d).collect()) == [
        ("a", 31, 31), ("a", 41, 199999), ("a", 500001, 600000), ("c", 1, 50)]
    assert iv.merge(df.limit(0)).count() == 0 and iv.overlap_join(df, df.limit(0)).count() == 0
    twice = iv.overlap_join(df, df, 2, 0)
    assert {(r.start, r.start_r) for r in twice.collect() if r.contig == "b"} == set()


def test_histogram_rules(spark):
    h = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0), ("g", 9.0, 1.0), ("n", float("nan"), 1.0), ("n", 4.0, 1.0)], "grp string, bin double, value double")
    assert {r.grp: r.mode for r in hs.mode(h).collect()}["g"] == 1.0
    assert {r.grp: r.median for r in hs.median(h).collect()}["g"] == 2.0
    assert {(r.grp, r.bin) for r in hs.trim(h, 3.0).collect() if r.grp == "g"} == {("g", 1.0), ("g", 2.0)}
    assert hs.trim(h, 3.0).filter("grp = 'n'").count() == 2


def test_genotype_types(spark):
    cases = [([], "UNAVAILABLE"), ([None, None], "NO_CALL"), ([None, 0], "MIXED"), ([0, 0], "HOM_REF"), ([1, 1], "HOM_VAR"), ([1, 2], "HET"), ([0, 1, 1], "HET")]
    df = spark.createDataFrame([(c[0],) for c in cases], "a array<int>")
    assert [r.x for r in df.select(gt.genotype_type(F.col("a")).alias("x")).collect()] == [c[1] for c in cases]


def test_likelihoods(spark):
    df = spark.createDataFrame([([-1.0, 0.0, -0.25],), ([float("-inf"), 0.0, float("nan")],)], "g array<double>")
    assert [r.x for r in df.select(gt.likelihoods_to_pl(F.col("g")).alias("x")).collect()][0] == [10, 0, 3]


def test_numbers(spark):
    df = spark.createDataFrame([(0.5,), (-2.5,), (0.49999999999999994,), (float("nan"),), (3.0,)], "x double")
    assert [r.x for r in df.select(nu.round_half_up(F.col("x")).alias("x")).collect()] == [1, -2, 0, 0, 3]
    assert abs(one(spark, nu.normal_cdf(F.lit(1.96))) - 0.9750021048517795) < 1e-12
    want = math.log(math.comb(5, 2) * math.comb(7, 3) / math.comb(12, 5))
    assert abs(one(spark, nu.hypergeometric_log(F.lit(2.0), F.lit(5.0), F.lit(5.0), F.lit(12.0))) - want) < 1e-9
    kinds = spark.createDataFrame([(v,) for v in (-129, -128, 127, 128, 255, 256, 32767, 32768, 65535, 65536, 1 << 31, (1 << 32) - 1, 1 << 32)], "x long")
    assert [r.x for r in kinds.select(nu.integer_tag_type(F.col("x")).alias("x")).collect()] == ["s", "c", "c", "C", "C", "s", "s", "S", "S", "i", "I", "I", None]


def test_line_formats(spark, tmp_path):
    lines = spark.createDataFrame([("#x",), ("",), ("c1\t4",), ('c1 5  9 "n" . -',), ("c2\t0\t7\tm\tbad\t+",)], "value string")
    got = [(r.contig, r.start, r.end, r.name, r.strand) for r in tx.bed(lines).collect()]
    assert got == [("c1", 5, 5, "", None), ("c1", 6, 9, "n", "-"), ("c2", 1, 7, "m", None)]
    rows = spark.createDataFrame([("@H",), ("c\t5\t9\t.\tn",), ("c\t9\t5\t+\tn",), ("c\tx\t5\t+\t.",), ("c\t1\t5\t-\t.\tmore",)], "value string")
    strict = [r.error for r in tx.interval_list(rows, True).collect()]
    assert strict == ["strand", "order", "number", "fields"]
    assert [(r.error, r.name, r.negative) for r in tx.interval_list(rows, False).collect()] == [(None, "n", False), (None, "n", False), ("number", None, None), (None, None, True)]
    (tmp_path / "x.fq").write_text("@a b\nACGT\n+\n@III\n@c\nNN\n+c\nII\n@d\nA\n+\nII\n")
    assert [(r.name, r.bases, r.quality, r.error) for r in tx.fastq(spark, str(tmp_path / "x.fq")).collect()] == [
        ("a b", "ACGT", "@III", None), ("c", "NN", "II", None), ("d", "A", "II", "length")]
    (tmp_path / "x.fa").write_text(">s1 first\nACgt\nNN  \n>s2\n\nA\n")
    assert [(r.name, r.bases) for r in tx.fasta(spark, str(tmp_path / "x.fa")).collect()] == [("s1", "ACgtNN"), ("s2", "A")]
    vcf = spark.createDataFrame([("##x",), ("c1\t5\t.\tacg\t.\t.\tPASS\tEND=90;DP=1",), ("c1\t5\ti\tAC\tA,<D>\t3\tq\t.\tGT\t0/1",)], "value string")
    got = [(r.stop, r.alleles, r.genotypes) for r in tx.vcf_records(vcf).collect()]
    assert got == [(90, ["ACG"], None), (6, ["AC", "A", "<D>"], "GT\t0/1")]


def test_gamma_and_quantile(spark):
    # P(n, x) is the chance of at least n events at rate x
    for a in (1, 2, 5, 30):
        for x in (0.1, 1.0, 4.0, 29.0, 31.0, 80.0):
            want = 1 - sum(math.exp(-x) * x**k / math.factorial(k) for k in range(a))
            assert abs(nu._gamma_p(a, x) - want) < 1e-12, (a, x)
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,)], "p double")
    got = [r.x for r in df.select(nu.normal_quantile(F.col("p")).alias("x")).collect()]
    assert got[:3] == [float("-inf"), 0.0, float("inf")] and got[3] is None
