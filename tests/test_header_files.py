from pyspark.sql import functions as F

from genoweave.operators import header_files as hf


def test_set_field(spark):
    cases = [("@RG\tID:a\tSM:x\tPL:y", "SM", "z", "@RG\tID:a\tSM:z\tPL:y"), ("@RG\tID:a\tSM:x\tPL:y", "SM", None, "@RG\tID:a\tPL:y"),
             ("@RG\tID:a", "SM", "z:1", "@RG\tID:a\tSM:z:1"), ("@RG\tID:a", "SM", None, "@RG\tID:a"), ("@HD", "SO", "coordinate", "@HD\tSO:coordinate"),
             ("@CO\tSO:x", "SO", "y", "@CO\tSO:x"), (None, "SO", "y", None), ("@SQ\tSN:S\tS:1", "S", "2", "@SQ\tSN:S\tS:2"), ("@RG\tID:a\tSM:", "SM", "", "@RG\tID:a\tSM:")]
    df = spark.createDataFrame(cases, "line string, key string, value string, want string")
    for r in df.withColumn("got", hf.set_field(F.col("line"), F.col("key"), F.col("value"))).collect():
        assert r.got == r.want


def lines(spark, files):
    return spark.createDataFrame([(f, i, v) for f, vs in files.items() for i, v in enumerate(vs)], "file string, line long, value string").repartition(3)


FILES = {"a": ["@HD\tVN:1.6", "@CO\tc", "r1", "r2", "@odd read"], "b": ["s1"], "c": ["@HD\tVN:1.5"]}


def as_files(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.file, []).append(r.value)
        assert r.line == len(out[r.file]) - 1
    return out


def test_reheader_leaves_bodies(spark):
    new = spark.createDataFrame([("a", 9, "@CO\ty"), ("a", 3, "@CO\tx"), ("a", 20, "@CO\tz"), ("b", 0, "@HD\tVN:1"), ("absent", 0, "@HD")], "file string, line long, value string")
    got = as_files(hf.reheader(lines(spark, FILES), new))
    assert got == {"a": ["@CO\tx", "@CO\ty", "@CO\tz", "r1", "r2", "@odd read"], "b": ["@HD\tVN:1", "s1"], "c": ["@HD\tVN:1.5"]}
    head, body = hf.split_header(lines(spark, FILES))
    assert sorted(r.value for r in head.collect()) == ["@CO\tc", "@HD\tVN:1.5", "@HD\tVN:1.6"] and body.count() == 4
    assert as_files(hf.reheader(lines(spark, FILES), new.limit(0))) == FILES


def test_gather_keeps_the_first_header(spark):
    place = F.when(F.col("file") == "c", 0).when(F.col("file") == "a", 1).otherwise(2)
    got = sorted(hf.gather(lines(spark, FILES), place).collect())
    assert [r.line for r in got] == list(range(len(got)))
    assert [r.value for r in got] == ["@HD\tVN:1.5", "r1", "r2", "@odd read", "s1"]
