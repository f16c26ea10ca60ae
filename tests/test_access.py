"""Indexed features, sorted files, stringency, number text and log probabilities: odd cases."""

import math
import random
from decimal import ROUND_DOWN, Decimal

import pytest
from pyspark.sql import functions as F

from genoweave.functions import numeric as nu
from genoweave.operators import feature_index as fi
from genoweave.sources import sinks as sk, text as tx


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(3)}", s := rng.randrange(1, 100_000), s + rng.randrange(0, 300), i) for i in range(4000)]
    rows += [("c1", 10, 60_000, 9001), ("c2", 1, 1, 9002), (None, 5, 9, 9003), ("c0", None, None, 9004)]
    path = str(tmp_path_factory.mktemp("index"))
    fi.write_indexed(spark.createDataFrame(rows, "contig string, start long, end long, k long").repartition(5), path, 40, 1000)
    return path, rows


@pytest.mark.parametrize("contig,start,end", [("c0", 5000, 5100), ("c1", 40_000, 40_010), ("c2", 1, 1), ("c2", 500_000, 600_000), ("c0", 999, 1001), ("c1", 1, 200_000)])
def test_region_by_index(spark, stored, contig, start, end):
    path, rows = stored
    got = fi.read_region(spark, path, contig, start, end)
    assert sorted(r.k for r in got.collect()) == sorted(k for c, s, e, k in rows if c == contig and s is not None and s <= end and e >= start)
    if contig == "c0":  # short features only: few blocks
        read = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
        assert 0 < read <= len(spark.read.parquet(f"{path}/data").inputFiles()) // 5


def test_unknown_contigs_and_many_regions(spark, stored):
    path, rows = stored
    with pytest.raises(ValueError):
        fi.read_region(spark, path, "c9", 1, 5)
    regions = [(i, f"c{i % 4}", i * 900, i * 900 + 500) for i in range(60)] * 2
    df = spark.createDataFrame(regions, "r int, contig string, start long, end long")
    with pytest.raises(Exception, match="no contig c3"):
        fi.read_regions(spark, path, df).count()
    got = fi.read_regions(spark, path, df.distinct(), skip_unknown=True).select("r", "k_f").collect()
    want = {(r, k) for r, c, s, e in regions for fc, fs, fe, k in rows if fc == c and fs is not None and fs <= e and fe >= s}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_sorted_file(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(50), f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "p int, t string").withColumn("text", F.concat_ws(":", "p", "t")).repartition(7)
    header = spark.createDataFrame([("@CO\tx", 0), ("@SQ\tSN:b", 2), ("@RG\tID:r", 3), ("@SQ\tSN:a", 4), ("@HD\tVN:1.6", 5), ("@XX", 6), ("@PG\tID:p", 7)], "line string, at int")
    path = str(tmp_path / "out")
    sk.write_sorted(df, "text", ["p", "t"], path, 6, header, sk.alignment_header_order(F.col("line"), F.col("at")))
    assert [r.value for r in sk.read_sorted(spark, path).orderBy("line").collect()] == [f"{p}:{t}" for p, t in sorted(rows)]
    assert [r.value[:6] for r in spark.read.text(f"{path}/header").collect()] == ["@HD\tVN", "@SQ\tSN", "@SQ\tSN", "@RG\tID", "@PG\tID", "@CO\tx", "@XX"]
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("part").collect()
    assert len(manifest) > 2 and sum(m.lines for m in manifest) == 2000 and manifest[1].before == manifest[0].lines
    lines = [("#CHROM", 0), ("##contig=<ID=z>", 1), ("##INFO=x", 2), ("##contig=<ID=a>", 3), ("##fileformat=VCFv4.2", 4), ("##zeta", 5)]
    ordered = spark.createDataFrame(lines, "line string, at int").orderBy(*sk.variant_header_order(F.col("line"), F.col("at"))).collect()
    assert [r.line for r in ordered] == ["##fileformat=VCFv4.2", "##INFO=x", "##contig=<ID=z>", "##contig=<ID=a>", "##zeta", "#CHROM"]


def test_stringency(spark):
    lines = spark.createDataFrame([("c1\t1\t5",), ("c1\tx\t5",), ("c2\t7\t9",)], "value string")
    parsed = tx.bed(lines)
    with pytest.raises(Exception, match="malformed record: number: c1"):
        sk.at_stringency(parsed, "strict", shown="contig").rows.collect()
    lenient = sk.at_stringency(parsed, "lenient")
    assert [(r.contig, r.start) for r in lenient.rows.collect()] == [("c1", 2), ("c2", 8)] and lenient.counts.get == {"rows": 2, "refused": 1}
    assert [(r.contig, r.error) for r in lenient.refused.collect()] == [("c1", "number")] and "error" not in lenient.rows.columns
    silent = sk.at_stringency(parsed, "silent")
    assert silent.rows.count() == 2 and silent.refused.count() == 0
    with pytest.raises(ValueError):
        sk.at_stringency(parsed, "loud")


def test_metric_text(spark):
    rng = random.Random(11)
    values = [2.5e-6, 5e-7, 0.1234565, 0.1234575, 1 / 128, 3 / 128, 1e20, -0.0, 0.1, 1.7976931348623157e308, 123456.7890625, 0.9999995, 0.9999996, -1e-9, 1e-300, 4.9e-324, 2.0000005]
    values += [rng.randrange(10**9) / 10**7 for _ in range(300)] + [rng.random() * 10 ** rng.randrange(-7, 12) for _ in range(300)]

    def want(x):
        shown, exact = Decimal(repr(abs(x))), Decimal(abs(x))
        place = Decimal("0.000001")
        with_context = shown.quantize(place, ROUND_DOWN) if shown < Decimal(10) ** 20 else shown
        rest = shown - with_context
        up = rest > place / 2 or (rest == place / 2 and (exact > shown or (shown < place and exact != shown)))
        text = f"{with_context + (place if up else 0):f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return ("-" if math.copysign(1, x) < 0 else "") + text

    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", nu.metric_text(F.col("v")).alias("t")).collect()
    for r in got:
        assert r.t == want(values[r.i]), values[r.i]
    assert [{r.i: r.t for r in got}[i] for i in (0, 1, 4)] == ["0.000003", "0.000001", "0.007812"]  # the first two lie above and below their decimal


def test_log_probabilities(spark):
    cases = [(x, n, p) for n in (1, 2, 14, 15, 16, 40, 1000) for x in {0, 1, n // 3, n - 1, n} if x <= n for p in (0.01, 0.3, 0.5, 0.95)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x int, n int, p double").repartition(3)
    for r in df.select("*", nu.binomial_log(F.col("x"), F.col("n"), F.col("p"), 1 - F.col("p")).alias("l")).collect():
        assert r.l == pytest.approx(math.log(math.comb(r.n, r.x)) + r.x * math.log(r.p) + (r.n - r.x) * math.log(1 - r.p), rel=1e-9, abs=1e-12)
    hyper = [(k, 5, 8, 10) for k in range(-1, 7)]
    for r in spark.createDataFrame(hyper, "k int, d int, s int, t int").select("*", nu.hypergeometric_log(F.col("k"), F.col("d"), F.col("s"), F.col("t")).alias("l")).collect():
        ways = math.comb(r.s, r.k) * math.comb(r.t - r.s, r.d - r.k) if 0 <= r.k <= r.d else 0
        assert r.l == (pytest.approx(math.log(ways / math.comb(r.t, r.d)), rel=1e-9) if ways else float("-inf"))
