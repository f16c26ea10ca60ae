"""Queries over variant files with their headers, typed attributes and genotypes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotypes as gt
from ..sources import files as fl, variants as vr
from . import adapters as ad
from .adapters import with_
from .catalog import query

#: A file per nation: versions 4.2 and 4.3 by turns, a few odd headers, and samples in two orders.
HEADER = """WITH f AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 7 THEN 'VCFv4.4' WHEN n_nationkey = 11 THEN 'VCFv9' WHEN n_nationkey = 13 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'VCFv4.2' ELSE 'VCFv4.3' END AS version,
  CASE n_nationkey WHEN 7 THEN 'version' WHEN 11 THEN 'unsupported' WHEN 13 THEN 'no version' WHEN 17 THEN 'few columns' WHEN 19 THEN 'no samples' END AS error FROM nation),
 o AS (SELECT o_orderkey, o_custkey % 25 AS k, o_orderkey % 8 AS kind, o_custkey FROM orders)
"""


def _files(spark, sf):
    """The files' numbered lines, with the nation's key as ``file``."""
    k, tab = F.col("n_nationkey"), F.lit("\t")
    version = F.when(k == 7, "VCFv4.4").when(k == 11, "VCFv9").when(k % 2 == 0, "VCFv4.2").otherwise("VCFv4.3")
    first = F.when(k == 13, "##source=x").otherwise(F.concat(F.lit("##fileformat="), version))
    declared = ["NOTE,Number=1,Type=String", "DP,Number=1,Type=Integer", "AF,Number=A,Type=Float", "DB,Number=0,Type=Flag", "RD,Number=R,Type=Integer", "CH,Number=1,Type=Character"]
    meta = "\n".join(f'##INFO=<ID={d},Description="a, \\"b\\"">' for d in declared)
    names = F.when(k == 17, "#CHROM\tPOS").otherwise(F.concat(F.lit("#" + "\t".join(vr.COLUMNS) + "\tFORMAT"), F.when(k == 19, "").when(k % 2 == 0, "\ts0\ts1").otherwise("\ts1\ts0\ts1")))
    heads = ad.read(spark, sf, "nation").select(k.cast("long").alias("k"), F.lit(-1).cast("long").alias("o"), F.concat_ws("\n", first, F.lit(meta), names).alias("value"))
    kind, cust = F.col("o_orderkey") % 8, F.col("o_custkey")
    info = F.concat(F.lit("NOTE=a%3Bb%2;DP="), F.when(kind == 5, "x").otherwise(cust.cast("string")), F.lit(";AF=0.5"), F.when(cust % 2 == 0, ",nan").otherwise(""), F.when(kind == 6, ";DB=0").otherwise(";DB"), F.lit(";XX=1;DP="),
                    F.when(kind == 5, "y").otherwise(cust.cast("string")), F.lit(";RD=."), F.when(kind == 6, ";CH=zz").otherwise(";CH=z"))
    fields = (F.concat(F.lit("c"), cust % 25), F.when(kind == 2, "x").otherwise(F.col("o_orderkey").cast("string")), F.lit("."), F.when(cust % 3 == 0, "a").otherwise("A"), F.when(cust % 2 == 0, "C,G").otherwise("C"),
              F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), F.lit("0/1:5"), F.lit("1|1"))
    line = F.when(kind == 0, "").when(kind == 1, F.concat(tab, F.concat_ws("\t", *fields))).when(kind == 3, "#note").when(kind == 4, "c\t5").otherwise(F.concat_ws("\t", *fields))
    body = ad.read(spark, sf, "orders").select((cust % 25).cast("long").alias("k"), F.col("o_orderkey").alias("o"), line.alias("value"))
    path = fl.scratch_path(spark, "vcf")
    heads.unionByName(body).repartition("k").sortWithinPartitions("k", "o").select("k", "value").write.partitionBy("k").text(path)
    return fl.numbered_lines(spark, path).withColumn("file", F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("long"))


@query(HEADER + """SELECT CAST(k AS BIGINT) AS k, version, CASE WHEN k IN (17, 19) THEN '' WHEN k % 2 = 0 THEN 's0,s1' ELSE 's1,s0' END AS samples, CASE WHEN k = 13 THEN 7 ELSE 7 END AS column_line, 6 AS declared, error FROM f""")
def vcf_header_frame(spark, sf):
    """Version, samples and declarations of a folder of files, folded from their header lines; odd headers have an error."""
    found = vr.frames(_files(spark, sf))
    return found.select(F.col("file").alias("k"), "version", F.array_join("samples", ",").alias("samples"), F.col("column_line").cast("int").alias("column_line"), F.size("info").alias("declared"), "error")


@query(HEADER + """, r AS (SELECT o.k AS k, o_orderkey, o_custkey, kind, error AS frame, version, row_number() OVER (PARTITION BY o.k ORDER BY o_orderkey) + 7 AS line FROM o JOIN f ON o.k = f.k),
 e AS (SELECT *, CASE WHEN frame IS NOT NULL THEN 'frame' WHEN kind IN (0, 4) THEN 'columns' WHEN kind = 2 THEN 'position' END AS error FROM r WHERE kind <> 3)
SELECT CAST(k AS BIGINT) AS k, line, error, CASE error WHEN 'columns' THEN line ELSE CASE WHEN error IS NOT NULL THEN line + 1 END END AS error_line, CASE WHEN error IS NULL THEN o_orderkey END AS start,
 CASE WHEN error IS NULL THEN CASE WHEN o_custkey % 2 = 0 THEN 'A,C,G' ELSE 'A,C' END END AS alleles, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 'a%3Bb%2' ELSE 'a;b%2' END END AS note,
 CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 's0=0/1:5,s1=1|1' ELSE 's1=0/1:5,s0=1|1' END END AS genotypes FROM e""")
def vcf_versions(spark, sf):
    """Body lines under the version and samples of their own file, with the numbers of lines that are wrong."""
    numbered = _files(spark, sf)
    rows = vr.records(numbered, vr.frames(numbered))
    pairs = F.zip_with("samples", "genotypes", lambda s, g: F.concat(s, F.lit("="), g))
    note = F.try_element_at("info", F.lit("NOTE"))["values"][0]
    return rows.select(F.col("file").alias("k"), "line", "error", "error_line", "start", F.array_join("alleles", ",").alias("alleles"), note.alias("note"), F.when(F.col("error").isNull(), F.array_join(pairs, ",")).alias("genotypes"))


@query(HEADER + """, r AS (SELECT o.* FROM o JOIN f ON o.k = f.k WHERE error IS NULL AND kind NOT IN (0, 2, 3, 4))
SELECT CAST(k AS BIGINT) AS k, o_orderkey AS start, CASE WHEN kind <> 5 THEN o_custkey END AS dp, CASE WHEN o_custkey % 2 = 0 THEN '0.5,NaN' ELSE '0.5' END AS af, kind <> 6 AS db, CASE kind WHEN 6 THEN 'zz' ELSE 'z' END AS ch, 1 AS n_rd,
 concat_ws(',', CASE kind WHEN 6 THEN 'CH:type' END, CASE kind WHEN 5 THEN 'DP:type' END, 'XX:undeclared') AS errors FROM r""")
def info_typed(spark, sf):
    """Attributes as arrays of their declared types, counts checked against the alleles, undeclared keys refused."""
    numbered = _files(spark, sf)
    rows = vr.records(numbered, vr.frames(numbered)).filter("error is null")
    typed = rows.withColumn("t", vr.typed_attributes(F.col("info"), F.col("declared"), F.size("alleles"), keep_undeclared=False))
    at = lambda key: F.try_element_at("t", F.lit(key))
    wrong = F.array_sort(F.transform(F.filter(F.map_entries("t"), lambda e: e["value"]["error"].isNotNull()), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["error"])))
    return typed.select(
        F.col("file").alias("k"), "start", at("DP")["integers"][0].alias("dp"), F.array_join(at("AF")["numbers"].cast("array<string>"), ",").alias("af"),
        F.coalesce(at("DB")["flag"], F.lit(False)).alias("db"), at("CH")["texts"][0].alias("ch"), F.size(at("RD")["integers"]).alias("n_rd"), F.array_join(wrong, ",").alias("errors"))


#: Genotypes of two alternates: some samples absent, some triploid, some filtered.
MANY = """WITH g AS (SELECT o_orderkey % 499 AS site, 's' || (o_custkey % 12) AS sample, min(o_orderkey) AS k, min(o_custkey) AS c FROM orders GROUP BY ALL),
 a AS (SELECT *, CASE k % 6 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [1, 2] WHEN 2 THEN [NULL, NULL] WHEN 3 THEN [0, 2] WHEN 4 THEN [2, 2] ELSE [NULL, 1] END AS alleles, k % 7 = 0 AS filtered FROM g)
"""


def _many(spark, sf):
    rows = ad.read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 499).alias("site"), F.concat(F.lit("s"), F.col("o_custkey") % 12).alias("sample")).agg(F.min("o_orderkey").alias("k"), F.min("o_custkey").alias("c"))
    k, none = F.col("k") % 6, F.lit(None).cast("int")
    of = lambda *a: F.array(*(none if x is None else F.lit(x) for x in a))
    alleles = F.when(k == 0, of(0, 1, 2)).when(k == 1, of(1, 2)).when(k == 2, of(None, None)).when(k == 3, of(0, 2)).when(k == 4, of(2, 2)).otherwise(of(None, 1))
    return rows.select("*", alleles.alias("alleles"), (F.col("k") % 7 == 0).alias("filtered"))


@query(MANY + """, s AS (SELECT unnest(range(0, 520)) AS site), n AS (SELECT site, CASE site % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS n FROM s),
 c AS (SELECT site, count(x) AS an, count(*) FILTER (x = 1) AS a1, count(*) FILTER (x = 2) AS a2, count(x) FILTER (f) AS fn, count(*) FILTER (x = 1 AND f) AS f1, count(*) FILTER (x = 2 AND f) AS f2
   FROM (SELECT site, sample IN ('s1', 's4') AS f, unnest(alleles) AS x FROM a WHERE NOT filtered) GROUP BY site)
SELECT n.site AS site, CASE WHEN an > 0 THEN an END AS an, CASE WHEN an > 0 THEN CASE n WHEN 2 THEN CAST(a1 AS VARCHAR) WHEN 3 THEN a1 || ',' || a2 END END AS ac,
  CASE WHEN an > 0 THEN CASE WHEN n = 1 THEN NULL WHEN fn = 0 THEN CASE n WHEN 2 THEN 'NaN' ELSE 'NaN,NaN' END WHEN n = 2 THEN CAST(CAST(round(f1 * 1000000 / fn) AS BIGINT) AS VARCHAR) ELSE CAST(round(f1 * 1000000 / fn) AS BIGINT) || ',' || CAST(round(f2 * 1000000 / fn) AS BIGINT) END END AS af
FROM n LEFT JOIN c ON n.site = c.site WHERE n.site < 499 OR n.site >= 499""")
def chromosome_counts_multi(spark, sf):
    """Counts and founders' frequencies of every alternate, at sites of none to two, some of them without a called founder or any genotype."""
    sites = spark.range(520).select(F.col("id").alias("site"), F.when(F.col("id") % 4 == 0, 1).when(F.col("id") % 4 == 1, 2).otherwise(3).alias("n"))
    found = gt.counts_per_alternate(sites, _many(spark, sf), "site", "n", ["s1", "s4"])
    parts = F.transform("af", lambda x: F.when(F.isnan(x), "NaN").otherwise(F.round(x * 1000000).cast("long").cast("string")))
    return found.select("site", "an", F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"), F.array_join(parts, ",").alias("af"))


@query(MANY + """, p AS (SELECT site, max(len(alleles)) AS ploidy, bool_or(c % 5 <> 0) AS has_dp, bool_or(k % 7 = 0) AS has_ft, bool_or(c % 3 = 0) AS has_hp FROM a GROUP BY site),
 w AS (SELECT p.*, unnest(range(0, 13)) AS i FROM p),
 j AS (SELECT w.site AS site, i, has_dp, has_ft, has_hp, CASE WHEN a.site IS NULL THEN rtrim(repeat('./', ploidy), '/') ELSE CASE WHEN c % 2 = 0 THEN array_to_string(list_transform(alleles, lambda x: coalesce(CAST(x AS VARCHAR), '.')), '|') ELSE array_to_string(list_transform(alleles, lambda x: coalesce(CAST(x AS VARCHAR), '.')), '/') END END AS gt,
   coalesce(CASE WHEN c % 5 <> 0 THEN CAST(c AS VARCHAR) END, '.') AS dp, CASE WHEN k % 7 = 0 THEN 'q' ELSE 'PASS' END AS ft, coalesce(CASE WHEN c % 3 = 0 THEN c || ',x' END, '.') AS hp FROM w LEFT JOIN a ON a.site = w.site AND a.sample = 's' || (12 - i)),
 t AS (SELECT site, i, has_dp, has_ft, has_hp, gt, CASE WHEN has_dp THEN ':' || dp ELSE '' END || CASE WHEN has_ft THEN ':' || ft ELSE '' END || CASE WHEN has_hp THEN ':' || hp ELSE '' END AS rest FROM j)
SELECT site, 'GT' || CASE WHEN any_value(has_dp) THEN ':DP' ELSE '' END || CASE WHEN any_value(has_ft) THEN ':FT' ELSE '' END || CASE WHEN any_value(has_hp) THEN ':HP' ELSE '' END || chr(9) || array_to_string(list(gt || regexp_replace(rest, '(:\\.)+$', '') ORDER BY i), chr(9)) AS text FROM t GROUP BY site""")
def vcf_encode_genotypes(spark, sf):
    """FORMAT and sample columns in the header's order; absent samples are filled at the site's ploidy, missing values at the end cut."""
    k, c = F.col("k"), F.col("c")
    rows = _many(spark, sf).select(
        "site", "sample", "alleles", (c % 2 == 0).alias("phased"), F.when(c % 5 != 0, c).cast("int").alias("dp"), F.when(k % 7 == 0, "q").alias("filters"),
        F.when(c % 3 == 0, F.create_map(F.lit("HP"), F.concat(c, F.lit(",x")))).alias("attributes"))
    header = [f"s{12 - i}" for i in range(13)]
    return vr.with_genotype_columns(rows.select("site").distinct(), rows, "site", header).select("site", F.col("genotype_text").alias("text"))
