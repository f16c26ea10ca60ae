"""What interval joins, mates and record functions compare and shuffle when tables hold many copies."""

from pyspark.sql import functions as F

from genoweave.functions import alignment as al
from genoweave.operators import intervals as iv, pairs as pr


def test_copies_of_a_span_meet_as_few_rows(spark):
    n = 2 * iv.MEMBERS + 1
    left = spark.range(n).select("id", F.lit("c1").alias("contig"), F.lit(5).alias("start"), F.lit(9).alias("end"), F.when(F.col("id") > 0, F.lit("x")).alias("name"))
    assert sorted(size for (size,) in iv._gathered(left, ["contig", "start", "end"], "m").select(F.size("m")).collect()) == [1, iv.MEMBERS, iv.MEMBERS]
    right = spark.createDataFrame([("c1", 9, 12, None), ("c1", 9, 12, 7), ("c1", 9, 12, 7), ("c1", 10, 12, 8), (None, 5, 9, 9), ("c1", None, 9, 9)], "contig string, start int, end int, k long")
    pairs = iv.overlap_join(left, right)
    assert pairs.columns == [*left.columns, *(c + "_r" for c in right.columns)]
    assert pairs.groupBy("k_r").count().orderBy("k_r").collect() == [(None, n), (7, 2 * n)]
    assert pairs.filter("name is null and id = 0").count() == 3
    bare = iv.overlap_join(left.select("contig", "start", "end"), right.select("contig", "start", "end"))
    assert bare.count() == 3 * n


def test_semi_join_asks_merged_spans(spark):
    left = spark.createDataFrame([("c1", 1, 4), ("c1", 5, 5), ("c1", 12, 14), ("c2", 1, 9), (None, 1, 9), ("c1", 5, 5)], "contig string, start int, end int")
    right = spark.createDataFrame([("c1", 4, 6)] * 3 + [("c1", 7, 11), ("c1", 15, 20), (None, 1, 9), ("c2", None, 5)], "contig string, start int, end int")
    plain = iv.overlap_join(left, right, how="left_semi")
    assert sorted(map(tuple, plain.collect())) == [("c1", 1, 4), ("c1", 5, 5), ("c1", 5, 5)]
    assert iv.overlap_join(left, right, how="left_anti").count() == 3
    # buffers shrink single intervals, not what they merge to
    shrunk = spark.createDataFrame([("c1", 6, 7)], left.schema)
    assert iv.overlap_join(shrunk, right, right_buffer=1, how="left_semi").count() == 0
    assert iv.overlap_join(shrunk, right, right_buffer=-1, how="left_semi").count() == 1


def test_soft_clip_walks_a_cigar_once(spark):
    rows = spark.createDataFrame([("5M3D4M2H",), ("2S9M",), ("4M",)], "c string").select(al.parse_cigar(F.col("c")).alias("c")).cache()
    clipped = rows.select(al.soft_clip_from(F.col("c"), F.lit(6)).alias("x"))
    walks = clipped._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert walks == 1
    assert [r.x for r in clipped.select(al.render_cigar(F.col("x")).alias("x")).collect()] == ["5M4S2H", "2S3M6S", "4M"]


def test_mates_carry_what_pairing_needs(spark):
    rows = spark.createDataFrame([("a", 65, 0, 10, 30, "4M2D", 2, "x"), ("a", 65, 0, 10, 20, "4M", 1, "y"), ("a", 145, 0, 20, 40, "5M", 3, "z"), ("b", 65, 0, 1, 1, "1M", 1, "u"), ("c", 0, 0, 1, 1, "1M", 1, "u")],
                                 "read_name string, flags int, ref_index int, pos int, mapq int, c string, k int, extra string").withColumn("cigar", al.parse_cigar(F.col("c"))).drop("c")
    found = pr.mates(rows, ["k"])
    assert found.schema["r1"].dataType.names == ["k", *pr.NEEDED]  # neither CIGAR nor name goes along
    pair, = found.collect()
    assert pair.r1.asDict() == {"k": 1, "flags": 65, "ref_index": 0, "pos": 10, "mapq": 20, "alignment_end": 13} and pair.r2.alignment_end == 24
    assert found.select(pr.insert_size(F.col("r1"), F.col("r2"))).collect() == [(15,)]
    assert pr.mates(rows, ["k"], keep=["extra"]).select("r1.extra", "r2.extra").collect() == [("y", "z")]


def _expressions(df, what):
    """The most often that one node of the plan has an expression."""
    return max(line.count(what) for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_scores_are_worked_out_once(spark, sf_dir):
    from genoweave.plans import catalog, catalog_records  # noqa: F401
    assert _expressions(catalog.QUERIES["phred_roundtrip"](spark, sf_dir), "sequence(") == 1


def test_filter_on_errors_does_not_repeat_the_parsing(spark, sf_dir):
    from genoweave.plans import catalog, catalog_headers  # noqa: F401
    assert _expressions(catalog.QUERIES["info_typed"](spark, sf_dir), "transform(") < 12


def test_doubles_of_rows_without_a_kind(spark, tmp_path):
    import duckdb
    from genoweave.plans import catalog, catalog_variants  # noqa: F401
    rows = [(i, 0.25 * i) for i in range(-8, 9)] + [(None, 1.0), (7, None), (14, 1e300), (21, -0.0)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalog.QUERIES["vcf_double_parse"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(catalog.ORACLES["vcf_double_parse"]).fetchall()))  # as text, as nan equals nothing


def test_chain_lines_travel_without_their_path(spark):
    from genoweave.sources import files as fl
    chain = ["chain 5 c1 9000 + 10 26 d1 9000 + 20 37 {}", "5 3 4", "8"]
    lines = [(f, i, text.format(no)) for no, f in enumerate(["b/long/path", "a/long/path"]) for i, text in enumerate(chain)]
    found = fl.chains(spark.createDataFrame(lines, "file string, line long, value string"))
    assert sorted((r.file, r.chain_id, r.block, r.from_start, r.error) for r in found.collect()) == [
        ("a/long/path", 1, 0, 10, None), ("a/long/path", 1, 1, 18, None), ("b/long/path", 0, 0, 10, None), ("b/long/path", 0, 1, 18, None)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(path_" in plan


def test_mates_stamp_each_other_whole(spark):
    """The reference's three cases: flags, own and mate's place, MQ and MC of both reads (FINDINGS_r04, F8)."""
    rows = spark.createDataFrame(
        [("both", 0x41 | 0x8, 0, 100, 60, "36M", 1), ("both", 0x91, 0, 200, 50, "30M6S", 2), ("one", 0x45 | 0x20, -1, 7, 0, "*", 1), ("one", 0x91, 2, 500, 60, "5S31M", 2),
         ("none", 0x55, 3, 9, 1, "4M", 1), ("none", 0x85, 4, 8, 2, "4M", 2)], "name string, flags int, ref_index int, pos long, mapq int, c string, k int")
    rows = rows.withColumnRenamed("name", "read_name").withColumn("cigar", al.parse_cigar(F.col("c"))).drop("c")
    fields = ["flags", "ref", "pos", "mate_ref", "mate_pos", "mate_reverse", "mate_unmapped", "tlen", "mq", "mc"]
    found = {r.read_name: [[r[f"{me}_{f}"] for f in fields] for me in ("r1", "r2")] for r in pr.mate_fields(pr.mates(rows, ["k"], cigars=True)).collect()}
    assert found["both"] == [[0x61, 0, 100, 0, 200, True, False, 130, 50, "30M6S"], [0x91, 0, 200, 0, 100, False, False, -130, 60, "36M"]]
    assert found["one"] == [[0x65, 2, 500, 2, 500, True, False, 0, 60, "5S31M"], [0x99, 2, 500, 2, 500, False, True, 0, None, None]]
    assert found["none"] == [[0x5D, -1, 0, -1, 0, False, True, 0, None, None], [0xAD, -1, 0, -1, 0, True, True, 0, None, None]]
    bare = pr.mate_fields(pr.mates(rows, ["k"]), mate_cigar=False)
    assert [(r.r1_mc, r.r2_mc) for r in bare.collect()] == [(None, None)] * 3 and bare.filter("r1_mq = 50").count() == 1


def test_doubles_of_single_precision_values(spark, tmp_path):
    """A float is the double that it stands for, as in SQL, and not what its shorter text reads as (FINDINGS_r04, F2)."""
    from genoweave.plans import catalog, catalog_variants  # noqa: F401
    spark.createDataFrame([(0, 0.1), (7, 16777216.0), (14, float("nan"))], "event_id long, value float").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: repr(r.number) for r in catalog.QUERIES["vcf_double_parse"](spark, str(tmp_path)).collect()}
    assert got == {0: "0.10000000149011612", 7: "16777216.0", 14: "nan"}


def test_pairs_are_put_out_by_many_tasks_in_runs(spark):
    """What a task writes has few values, in runs, whatever the sizes of shuffled rows (FINDINGS_r04, F1)."""
    left = spark.range(600).select("id", F.lit("c").alias("contig"), (F.col("id") % 3 * 5000).alias("start"), (F.col("id") % 3 * 5000 + 9).alias("end"),
                                   F.array(F.lit(1)).alias("a"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("n"), F.col("id") % 2)).alias("name"))
    right = left.select("contig", "start", "end", "id").filter("id < 6")
    pairs = iv.overlap_join(left.repartition(5), right)
    tasks = pairs.select("id_r", "name", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 1200 and pairs.rdd.getNumPartitions() == iv.SPREAD * 4
    runs = sum((a.id_r, a.name) != (b.id_r, b.name) for a, b in zip(tasks, tasks[1:])) + 1
    assert runs == 6 * 3  # each of the six with three names


def test_bases_of_reads_do_not_travel_to_the_lookup(spark, sf_dir):
    """Reads' bases are made after the lookup, and contig lengths don't send every alignment to its contig (FINDINGS_r04, F7)."""
    from genoweave.plans import catalog_reference
    plan = catalog_reference._reference_alignments(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "md5(" in above and "md5(" not in below and "strategy=broadcast" in below


def test_walks_run_over_arrays(spark, monkeypatch):
    """Slices of few characters, texts of several bytes a character, short reads, nulls, empty CIGARs and references (FINDINGS_r04, F7)."""
    import random
    import pyarrow as pa
    from genoweave.functions import sequence as sq, walks
    from tests.test_operators import md_and_nm
    rng = random.Random(8)
    rows = [(read := "".join(rng.choice("ACGT") for _ in range(40)), [(rng.randrange(1, 14), rng.choice("MMMMIDNSHP=X")) for _ in range(rng.randrange(0, 6))], "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    rows = [row for row in rows if sum(n for n, op in row[1] if op in "M=XIS") <= 40]
    kind = pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))
    arrays = lambda rows: (pa.array([r for r, _, _ in rows], pa.string()), pa.array([c and [{"len": n, "op": op} for n, op in c] for _, c, _ in rows], kind), pa.array([f for _, _, f in rows], pa.string()))
    monkeypatch.setattr(walks, "CHARACTERS", 100)
    got = walks.walked.func(*arrays(rows)).to_pylist()
    assert [(x["md"], x["nm"]) for x in got] == [md_and_nm(*row) for row in rows]
    odd = [("aé.*N", [(5, "M")], "Aén#n"), ("AC", [(4, "M")], "ACGT"), (None, [(1, "M")], "A"), ("A", None, "A"), ("A", [(1, "M")], None), ("", [], ""), ("AC", [(1, "M"), (2, "D"), (1, "M")], "Aé😀C"), ("A" * 120, [(120, "M")], "A" * 119 + "é")]
    got = walks.walked.func(*arrays(odd)).to_pylist()
    assert got == [{"md": "1é3", "nm": 1, "mismatches": 1}, {"md": "2G0T0", "nm": 2, "mismatches": 0}, None, None, None, {"md": "0", "nm": 0, "mismatches": 0}, {"md": "1^é😀1", "nm": 2, "mismatches": 0},
                   {"md": "119é0", "nm": 1, "mismatches": 1}]
    plan = spark.createDataFrame([("A", "A")], "r string, f string").select(sq.md_and_nm(F.col("r"), al.parse_cigar(F.lit("1M")), F.col("f")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_texts_travel_once_for_their_offsets(spark):
    """Rows are dealt by contig and band once, not again for the sums of the bands before (FINDINGS_r04, F7)."""
    from genoweave.operators import reference as rf
    rows = spark.createDataFrame([(k, i, "AC" * i) for k in ("a", None) for i in range(6)], "contig string, p long, bases string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rf.running_offset(rows, ["contig"], "p", F.length("bases"), band=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(((r.contig, r.p), r.offset) for r in found.filter("contig is not null").collect()) == [(("a", i), i * (i - 1)) for i in range(6)]
        assert found.filter("contig is null and p = 5 and offset = 20").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # the rows, and the totals: as such, by contig, and back to the rows
