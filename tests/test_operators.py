"""Operators against brute force: interval joins over cell levels, ranks, alignment walks, tags."""

import random

import pytest
from pyspark.sql import functions as F

from genoweave.functions import alignment as al, sequence as sq
from genoweave.operators import intervals as iv
from genoweave.sources import text as tx


def spans(spark, rows, extra="id"):
    return spark.createDataFrame(rows, f"contig string, start long, end long, {extra} long")


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(5)

    def rows(n):
        out = []
        for i in range(n):
            start = rng.randrange(-500, 60000)
            length = rng.choice([0, 1, 7, 255, 256, 257, 3000, 20000, 10**9]) if i % 5 == 0 else rng.randrange(300)
            out.append((rng.choice(["a", "b", None]), start, start + length, i))
        return out + [("a", None, 5, n), ("a", 9, 3, n + 1), *out[:3]]

    return rows(150), rows(120)


def meets(x, y, p=0, q=0):
    if None in x[:3] or None in y[:3] or x[0] != y[0] or x[1] + p > x[2] - p or y[1] + q > y[2] - q:
        return False
    return x[1] + p <= y[2] - q and x[2] - p >= y[1] + q


@pytest.mark.parametrize("buffers, width", [((0, 0), 256), ((2, -3), 16), ((-4, 1), 1000)])
def test_overlap_join(spark, sides, buffers, width):
    left, right = sides
    got = iv.overlap_join(spans(spark, left), spans(spark, right), *buffers, bin_width=width)
    assert sorted((r.id, r.id_r) for r in got.collect()) == sorted((x[3], y[3]) for x in left for y in right if meets(x, y, *buffers))


def test_semi_and_anti_keep_repeated_rows(spark, sides):
    left, right = sides
    rows = spans(spark, left).select("contig", "start", "end", F.create_map(F.lit("k"), F.col("id") % 2).alias("m"))
    found = [any(meets(x, y) for y in right) for x in left]
    assert iv.overlap_join(rows, spans(spark, right), how="left_semi").count() == sum(found)
    assert iv.overlap_join(rows, spans(spark, right), how="left_anti").count() == len(left) - sum(found)


def test_rank_in_group(spark, monkeypatch):
    monkeypatch.setattr(iv, "BAND", 10)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 60)]), 0, i) for i in range(200)]
    got = iv.rank_in_group(spans(spark, rows), "contig", F.col("start"), [F.col("start").asc_nulls_last(), F.col("id")])
    want = {}
    for contig in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == contig), key=lambda r: (r[1] is None, r[1] or 0, r[3]))
        want |= {r[3]: k for k, r in enumerate(own, 1)}
    assert {r.id: r["rank"] for r in got.collect()} == want


def md_and_nm(read, cigar, ref):
    r = f = run = nm = 0
    out = ""
    for n, op in cigar:
        if op in "M=X":
            for _ in range(n):
                if f >= len(ref):
                    return out + str(run), nm
                if read[r] == ref[f]:
                    run += 1
                else:
                    out, run, nm = out + str(run) + ref[f], 0, nm + 1
                r, f = r + 1, f + 1
        elif op == "I":
            r, nm = r + n, nm + n
        elif op == "S":
            r += n
        elif op == "N":
            f += n
        elif op == "D":
            part = ref[f : f + n]
            out, run = out + str(run) + "^" + part, 0  # also where nothing is left, and what is cut off costs nothing
            if len(part) < n:
                return out + str(run), nm
            f, nm = f + n, nm + n
    return out + str(run), nm


def test_md_and_nm(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        cigar = [(rng.randrange(1, 6), rng.choice("MMMMIDNSHP=X")) for _ in range(rng.randrange(1, 7))]
        size = sum(n for n, op in cigar if op in "M=XIS")
        rows.append((i, "".join(rng.choice("AC") for _ in range(size)), "".join(f"{n}{op}" for n, op in cigar), "".join(rng.choice("AC") for _ in range(rng.randrange(0, 25))), cigar))
    df = spark.createDataFrame([r[:4] for r in rows], "id int, read string, cigar string, ref string")
    got = df.select("id", sq.md_and_nm(F.col("read"), al.parse_cigar(F.col("cigar")), F.col("ref")).alias("x")).collect()
    assert {r.id: (r.x.md, r.x.nm) for r in got} == {i: md_and_nm(read, cigar, ref) for i, read, _, ref, cigar in rows}


def test_tags(spark):
    fields = F.array(*map(F.lit, ["NM:i:3", "XA:Z:a:b", "NM:i:7", "bad", "9X:i:1", "FZ:B:S,1,2", "HX:H:0aF"]))
    row = spark.range(1).select(tx.tag_map(fields).alias("t")).first()
    assert row.t == {"NM": "i:7", "XA": "Z:a:b", "FZ": "B:S,1,2", "HX": "H:0aF"}
    value = lambda v: spark.range(1).select(tx.tag_value(F.lit(v)).alias("v")).first().v
    assert value("i:-5").integer == -5 and value("f:1.5").number == 1.5 and value("B:c,1,-2").numbers == [1.0, -2.0] and value("Z:").text == ""
    assert value("i:x") is None and value("A:xy") is None and value("H:abc") is None and value("B:q,1") is None and value("B:c,x") is None


def test_merge_over_bands_against_brute_force(spark, monkeypatch):
    """Many disjoint intervals in two and more bands, islands that cross edges and whole bands, and a null contig."""
    monkeypatch.setattr(iv, "BAND", 100)
    rng = random.Random(9)
    rows = [(c, s := rng.randrange(0, 3000), s + rng.randrange(0, 8)) for c in ("a", "b", None) for _ in range(200)]
    rows += [("a", 150, 560), ("b", 95, 99), ("b", 100, 100), ("b", 101, 350), ("c", 199, 200), ("c", 201, 201), ("c", 203, 204)]
    want = []
    for c in {r[0] for r in rows}:
        end = None
        for s, e in sorted(r[1:] for r in rows if r[0] == c):
            if end is None or s > end + 1:
                want.append([c, s, e, 0])
                end = e
            want[-1][2] = end = max(end, e)
            want[-1][3] += 1
    got = iv.merge(spark.createDataFrame(rows, "contig string, start long, end long").repartition(3)).select("contig", "start", "end", "members").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_overlap_join_keeps_columns_of_any_name(spark):
    left = spark.createDataFrame([("c", 1, 5, 7, 8, 9)], "contig string, start long, end long, level_ int, cell_ int, _xl_s int")
    right = spark.createDataFrame([("c", 5, 9, 3)], "contig string, start long, end long, s_ int")
    assert [tuple(r) for r in iv.overlap_join(left, right).collect()] == [("c", 1, 5, 7, 8, 9, "c", 5, 9, 3)]
    with pytest.raises(ValueError):
        iv.overlap_join(left.withColumnRenamed("cell_", "start_r"), right)
    other = iv.overlap_join(left.withColumnRenamed("cell_", "start_r"), right, suffix="_other")
    assert other.columns == ["contig", "start", "end", "level_", "start_r", "_xl_s", "contig_other", "start_other", "end_other", "s__other"] and other.count() == 1
