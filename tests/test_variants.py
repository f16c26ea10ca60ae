"""Header frames, body lines, typed attributes, genotype columns and counts per alternate: odd cases."""

import math

import pytest

from genoweave.operators.genotypes import counts_per_alternate
from genoweave.sources import variants as vr
from pyspark.sql import functions as F

VERSION, NAMES = "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def numbered(spark, **files):
    rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line long, value string").repartition(4)


def test_frames(spark):
    cases = {
        "good": (f"##note\n{VERSION}\n{NAMES}\tFORMAT\tb\ta\tb\n#CHROM\n##fileformat=VCFv9", ("VCFv4.2", ["b", "a"], None)),
        "sites": (f"{VERSION}\n{NAMES}\t\t", ("VCFv4.2", [], None)), "last": (f"{VERSION}\n##fileformat=VCFv4.3\n{NAMES}", ("VCFv4.3", [], None)),
        "empty_value": (f"##fileformat=\n{NAMES}", (None, [], "no version")), "three": (f"##fileformat=VCFv4.2=x\n{NAMES}", (None, [], "no version")),
        "old": (f"##format=VCRv3.2\n{NAMES}", ("VCRv3.2", [], "version")), "odd": (f"##fileformat=4\n{NAMES}", ("4", [], "unsupported")),
        "body_first": (f"{VERSION}\nc1\t1\n{NAMES}", ("VCFv4.2", [], "no columns")), "none": (VERSION, ("VCFv4.2", [], "no columns")), "blank": (f"\n{VERSION}\n{NAMES}", (None, [], "no columns")),
        "few": (f"{VERSION}\n#CHROM\tPOS", ("VCFv4.2", [], "few columns")), "swapped": (f"{VERSION}\n#POS\tCHROM\tID\tREF\tALT\tQUAL\tFILTER\tINFO", ("VCFv4.2", [], "column name")),
        "ninth": (f"{VERSION}\n{NAMES}\tx\ty", ("VCFv4.2", ["y"], "format")), "alone": (f"{VERSION}\n{NAMES}\tFORMAT", ("VCFv4.2", [], "no samples")),
    }
    got = {r.file: (r.version, r.samples, r.error) for r in vr.frames(numbered(spark, **{k: v[0] for k, v in cases.items()})).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_body_lines(spark):
    meta = '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="d">\n##INFO=<ID=DP,Number=2,Type=Float,Description="later">'
    lines = {
        "c\t5\t.\ta\tC,<DEL>,.\t20\tPASS\tDP;DB;X=1,%41;X=2": None, "\tc\t5\t.\tA\t.\t-1\tq;r\tEND=9;DB=0": None, "": "columns", "#x": "gone", "c\t5\t.\tA\tC\t.\tPASS": "columns", "c\t5\t.\tA\tC\t.\t.\t.\tGT\textra": "info",
        "c\tx\t.\tA\tC\t.\t.\t.": "position", "c\t5\t\tA\tC\t.\t.\t.": "id", "c\t5\t.\tA\tC\tq\t.\t.": "quality", "c\t5\t.\tA\tC\t.\t0\t.": "filter", "c\t5\t.\tA\tC\t.\t.\t": "info", "c\t5\t.\tA\tC\t.\t.\tA B": "info",
        "c\t5\t.\tA\tC\t.\t.\tEND=x": "end", "c\t5\t.\t<X>\tC\t.\t.\t.": "alleles", "c\t5\t.\tA\t\t.\t.\t.": "alleles", "c\t5\t.\t.\tC\t.\t.\t.": "alleles", "c\t5\t.\tA\tI2\t.\t.\t.": "alleles",
    }
    text = "\n".join([VERSION.replace("4.2", "4.3"), *meta.split("\n"), NAMES, *lines])
    n = numbered(spark, f=text, bad=f"{NAMES}\nc\t1")
    rows = vr.records(n, vr.frames(n)).collect()
    assert [(r.line, r.error, r.error_line) for r in rows if r.file == "bad"] == [(1, "frame", 2)]
    got = {r.line - 5: r for r in rows if r.file == "f"}
    for i, (line, error) in enumerate(lines.items()):
        if error == "gone":
            assert i not in got
            continue
        assert got[i].error == error, line
        assert got[i].error_line == (None if error is None else i + 5 if error == "columns" else i + 6)
    a, b = got[0], got[1]
    assert (a.alleles, a.stop, a.log10_error, a.filters) == (["A", "C", "<DEL>"], 5, -2.0, []) and {k: (v.flag, v["values"]) for k, v in a.info.items()} == {"DP": (False, None), "DB": (True, None), "X": (False, ["2"])}
    assert (b.alleles, b.stop, b.log10_error, b.filters, list(b.info)) == (["A"], 9, 1.0, ["q", "r"], ["END"])


@pytest.mark.parametrize("kind,number,values,alleles,error", [
    ("Integer", "G", "1,2,3", 2, None), ("Integer", "G", "1,2,3", 3, "count"), ("Integer", "R", "1,.", 2, None), ("Integer", "A", "1,2", 2, "count"), ("Integer", ".", "1,2,3,4", 2, None), ("Integer", "1", "1.5", 2, "type"),
    ("Float", "1", "1e-3", 2, None), ("Float", "2", "nan,-inf", 2, None), ("Float", "1", "x", 2, "type"), ("Character", "2", "a,b", 2, None), ("Character", "1", "ab", 2, "type"), ("Flag", "0", "1", 2, "flag"), ("Flag", "0", None, 2, None),
    ("Integer", "1", None, 2, "flag"), ("String", "4", ".", 2, None), (None, None, "x", 2, "undeclared")])
def test_typed_attributes(spark, kind, number, values, alleles, error):
    attributes = F.create_map(F.lit("K"), F.struct(F.lit(values is None).alias("flag"), (F.lit(None).cast("array<string>") if values is None else F.split(F.lit(values), ",")).alias("values")))
    declared = F.create_map(F.lit("K" if kind else "Z"), F.struct(F.lit(kind).alias("type"), F.lit(number).alias("number")))
    r = spark.range(1).select(vr.typed_attributes(attributes, declared, F.lit(alleles), keep_undeclared=False).alias("t")).first().t["K"]
    assert r.error == error


def test_genotype_columns(spark):
    kinds = "site int, sample string, alleles array<int>, phased boolean, dp int, gq int, ad array<int>, pl array<int>, filters string, attributes map<string,string>"
    rows = [
        (1, "b", [0, None, 2], False, None, 7, [1, 2], None, None, {"Z": "."}), (1, "x", [0, 1], True, 3, None, None, None, "q", {}), (1, "b", [0, None, 2], False, None, 7, [1, 2], None, None, {"Z": "."}),
        (2, "a", [1], False, None, None, None, None, "PASS", None), (3, "a", [], False, 4, None, None, None, None, None), (3, "b", None, None, None, None, None, [1, 2, 3], None, None), (4, "a", [0], None, None, None, None, None, None, None), (4, "b", [], None, None, None, None, None, None, None)]
    got = vr.with_genotype_columns(spark.createDataFrame([(i, "keep") for i in range(1, 6)], "site int, at_ string").withColumnRenamed("at_", "other"), spark.createDataFrame(rows, kinds), "site", ["a", "b", "c"])
    assert {r.site: r.genotype_text for r in got.collect()} == {
        1: "GT:AD:DP:FT:GQ:Z\t./././.\t0/./2:1,2:.:PASS:7\t./././.".replace("./././.", "././.:.:.:PASS"), 2: "GT\t1\t.\t.", 3: "DP:PL\t4\t.:1,2,3\t", 4: None, 5: "GT\t./.\t./.\t./."}
    kept = vr.with_genotype_columns(spark.createDataFrame([(2,)], "site int"), spark.createDataFrame([(2, "a", [1], 5), (2, "b", [1], None)], "site int, sample string, alleles array<int>, dp int"), "site", ["b", "a"], keep_trailing=True)
    assert kept.first().genotype_text == "GT:DP\t1:.\t1:5" and got.columns == ["site", "other", "genotype_text"]


def test_counts_per_alternate(spark):
    g = spark.createDataFrame([
        (1, "a", [0, 1], False), (1, "b", [2, 2], False), (1, "c", [1, None], False), (1, "d", [1, 1], True), (2, "a", [None, None], False), (3, "a", [0, 0], False), (4, "b", [0, 1], False), (6, "a", [], False)], "site int, sample string, alleles array<int>, filtered boolean")
    sites = spark.createDataFrame([(1, 3), (2, 2), (3, 1), (4, 2), (5, 2), (6, 2)], "site int, n int")
    run = lambda **k: {r.site: (r.an, r.ac, r.af) for r in counts_per_alternate(sites, g, "site", "n", **k).collect()}
    assert run() == {1: (5, [2, 2], [0.4, 0.4]), 2: (None,) * 3, 3: (2, None, None), 4: (2, [1], [0.5]), 5: (None,) * 3, 6: (None,) * 3}
    some = run(founders=["a", "c"], remove_stale=False)
    assert some[1] == (5, [2, 2], [2 / 3, 0.0]) and some[2] == (0, [0], [0.0]) and some[6] == (0, [0], [0.0]) and some[5] == (None,) * 3
    assert some[4][:2] == (2, [1]) and math.isnan(some[4][2][0])
