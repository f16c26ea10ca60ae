"""Queries over sequences, histograms, genotypes, text records and headers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nu, sequence as sq
from ..operators import genotypes as gt, headers as hd, histogram as hs
from ..sources import text as tx
from . import adapters as ad
from .adapters import with_
from .catalog import query


@query(with_("reads") + "SELECT doc_id, reverse(translate(bases, 'ACGTacgt', 'TGCAtgca')) AS rc FROM reads")
def reverse_complement(spark, sf):
    return ad.reads(spark, sf).select("doc_id", sq.reverse_complement(F.col("bases")).alias("rc"))


@query(with_("reads") + """SELECT doc_id, array_to_string(list_transform(range(length(bases)), lambda i: chr(CAST((doc_id + i) % 41 + 33 AS INTEGER))), '') AS quality,
  true AS same FROM reads""")
def phred_roundtrip(spark, sf):
    n = F.length("bases")
    scores = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ((F.col("doc_id") + i) % 41).cast("int"))
    rows = ad.reads(spark, sf).withColumn("scores", scores).withColumn("quality", sq.to_fastq_quality(F.col("scores")))
    return rows.select("doc_id", "quality", (sq.from_fastq_quality(F.col("quality")) == F.col("scores")).alias("same"))


@query(with_("reads") + "SELECT doc_id, md5('@r' || doc_id || chr(10) || bases || chr(10) || '+' || chr(10) || repeat('I', length(bases))) AS record_md5 FROM reads")
def fastq_render(spark, sf):
    quality = F.repeat(F.lit("I"), F.length("bases"))
    record = sq.fastq_record(F.concat(F.lit("r"), F.col("doc_id")), F.col("bases"), quality)
    return ad.reads(spark, sf).select("doc_id", F.md5(record.cast("binary")).alias("record_md5"))


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(n, '( .*)', ''), '(/[12])+$', '') AS name
FROM (SELECT o_orderkey, 'r' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '/1' WHEN 1 THEN '/2/1' WHEN 2 THEN '/1 x/2' ELSE '/3' END AS n FROM orders)""")
def read_name_cleanup(spark, sf):
    k = F.col("o_orderkey") % 4
    name = F.concat(F.lit("r"), F.col("o_orderkey"), F.when(k == 0, "/1").when(k == 1, "/2/1").when(k == 2, "/1 x/2").otherwise("/3"))
    return ad.read(spark, sf, "orders").select("o_orderkey", sq.clean_read_name(name).alias("name"))


@query(with_("reads") + """, p AS (SELECT a.doc_id, a.bases AS x, b.bases AS y, least(length(a.bases), length(b.bases)) AS n FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, m AS mismatches, n - m AS equal FROM (SELECT doc_id, n, len(list_filter(list_zip(string_split(x[1:n], ''), string_split(y[1:n], '')), lambda b: b[1] <> b[2])) AS m FROM p)""")
def bases_equal_count(spark, sf):
    a = ad.reads(spark, sf).select("doc_id", "bases")
    pairs = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bases").alias("other")), "doc_id")
    miss = sq.mismatches(F.col("bases"), F.col("other"))
    return pairs.select("doc_id", miss.alias("mismatches"), (F.least(F.length("bases"), F.length("other")) - miss).alias("equal"))


_WRAP = lambda e: f"(({e}) & 4294967295::UBIGINT)"
_TURN = lambda e, r: _WRAP(f"({e} << {r}) | ({e} >> {32 - r})")
_SCRAMBLE = lambda k: _WRAP(_TURN(_WRAP(f"{k} * 3432918353::UBIGINT"), 15) + " * 461845907::UBIGINT")
#: Murmur3 of 'q' and the key: pairs of characters, then the odd one, then the final mix.
MURMUR = f"""WITH u AS (SELECT o_orderkey, 'q' || o_orderkey AS t FROM orders), c AS (SELECT o_orderkey, length(t) AS n, list_transform(string_split(t, ''), lambda x: CAST(unicode(x) AS UBIGINT)) AS u FROM u),
 b AS (SELECT *, list_transform(range(0, n // 2), lambda i: u[2 * i + 1] | (u[2 * i + 2] << 16)) AS blocks FROM c),
 h AS (SELECT *, list_reduce(list_prepend(1::UBIGINT, blocks), lambda h, k: {_WRAP(_TURN(f"xor(h, {_SCRAMBLE('k')})", 13) + " * 5 + 3864292196::UBIGINT")}) AS h FROM b),
 t AS (SELECT o_orderkey, xor(CASE WHEN n % 2 = 1 THEN xor(h, {_SCRAMBLE('u[n]')}) ELSE h END, CAST(2 * n AS UBIGINT)) AS h FROM h),
 x AS (SELECT o_orderkey, {_WRAP("xor(h, h >> 16) * 2246822507::UBIGINT")} AS h FROM t), y AS (SELECT o_orderkey, {_WRAP("xor(h, h >> 13) * 3266489909::UBIGINT")} AS h FROM x)
SELECT o_orderkey FROM y WHERE xor(h, h >> 16) < 1073741824"""


@query(MURMUR)
def murmur3_downsample(spark, sf):
    kept = sq.murmur3(F.concat(F.lit("q"), F.col("o_orderkey")), 1) < (1 << 30)
    return ad.read(spark, sf, "orders").filter(kept).select("o_orderkey")


HIST = "WITH h AS (SELECT l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS bin, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)\n"
CUM = HIST + ", c AS (SELECT *, sum(value) OVER (PARTITION BY grp ORDER BY bin) AS cum, sum(value) OVER (PARTITION BY grp) AS n FROM h)\n"
MEDIAN = "(min(CASE WHEN cum >= floor((n + 1) / 2) THEN bin END) + min(CASE WHEN cum >= floor(n / 2) + 1 THEN bin END)) / 2"


def hist(spark, sf):
    return hs.build(ad.read(spark, sf, "lineitem"), "l_returnflag", "l_quantity", F.col("l_linenumber"))


@query(HIST + "SELECT * FROM h")
def hist_build(spark, sf):
    return hist(spark, sf)


@query(HIST + """, m AS (SELECT grp, sum(value) AS n, sum(bin * value) AS total FROM h GROUP BY grp)
SELECT m.grp AS grp, any_value(n) AS n, any_value(total) AS total, round(any_value(total / n), 6) AS mean, round(sqrt(sum(value * power(bin - total / n, 2)) / (any_value(n) - 1)), 6) AS sd
FROM h JOIN m ON h.grp = m.grp GROUP BY m.grp""")
def hist_mean_sd(spark, sf):
    return hs.moments(hist(spark, sf)).select("grp", "n", "total", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(CUM + f"SELECT grp, {MEDIAN} AS median FROM c GROUP BY grp")
def hist_median(spark, sf):
    return hs.median(hist(spark, sf))


@query(CUM + f""", m AS (SELECT grp, {MEDIAN} AS median FROM c GROUP BY grp),
  d AS (SELECT h.grp, abs(bin - median) AS bin, sum(value) AS value FROM h JOIN m ON h.grp = m.grp GROUP BY ALL),
  e AS (SELECT *, sum(value) OVER (PARTITION BY grp ORDER BY bin) AS cum, sum(value) OVER (PARTITION BY grp) AS n FROM d)
SELECT grp, {MEDIAN} AS mad, round({MEDIAN} * 1.4826, 6) AS sd_by_mad FROM e GROUP BY grp""")
def hist_mad(spark, sf):
    return hs.mad(hist(spark, sf)).select("grp", "mad", F.round("sd_by_mad", 6).alias("sd_by_mad"))


@query(CUM + "SELECT grp, min(CASE WHEN cum / n >= 0.9 THEN bin END) AS percentile FROM c GROUP BY grp")
def hist_percentile(spark, sf):
    return hs.percentile(hist(spark, sf), 0.9)


@query(HIST + "SELECT grp, arg_max(bin, {'v': value, 'b': -bin}) AS mode FROM h GROUP BY grp")
def hist_mode(spark, sf):
    return hs.mode(hist(spark, sf))


@query(HIST + "SELECT grp, round(sum(CASE WHEN bin <= 17 THEN value ELSE 0 END) / sum(value), 9) AS probability FROM h GROUP BY grp")
def hist_cumprob(spark, sf):
    return hs.cumulative_probability(hist(spark, sf), 17).select("grp", F.round("probability", 9).alias("probability"))


@query(HIST + "SELECT * FROM h WHERE bin <= 25")
def hist_trim(spark, sf):
    return hs.trim(hist(spark, sf), 25.0)


@query("""WITH a AS (SELECT CAST(l_quantity AS DOUBLE) AS bin, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
 r AS (SELECT CAST(l_quantity + 3 AS DOUBLE) AS bin, CAST(count(*) AS DOUBLE) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(a.bin, r.bin) AS bin, coalesce(a.value, 0) + coalesce(r.value, 0) AS value FROM a FULL JOIN r ON a.bin = r.bin""")
def hist_merge_outer(spark, sf):
    rows = ad.read(spark, sf, "lineitem")
    a = rows.filter("l_returnflag = 'A'").select(F.col("l_quantity").cast("double").alias("bin"))
    r = rows.filter("l_returnflag = 'R'").select((F.col("l_quantity") + 3).cast("double").alias("bin"))
    return a.unionByName(r).groupBy("bin").agg(F.count(F.lit(1)).cast("double").alias("value"))


RANKED = """WITH v AS (SELECT event_type AS grp, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value))
"""


@query(RANKED + """, q AS (SELECT grp, n, 0.3::DOUBLE * (n + 1) AS spot, max(CASE WHEN rn = greatest(1, least(n, floor(0.3::DOUBLE * (n + 1)))) THEN x END) AS a,
  max(CASE WHEN rn = greatest(1, least(n, floor(0.3::DOUBLE * (n + 1)) + 1)) THEN x END) AS b FROM v GROUP BY grp, n)
SELECT grp, round(a + CASE WHEN spot < 1 OR spot >= n THEN 0 ELSE spot - floor(spot) END * (b - a), 6) AS percentile FROM q""")
def percentile_legacy(spark, sf):
    return hs.list_percentile(ad.read(spark, sf, "events"), "event_type", "value", 0.3).select("grp", F.round("percentile", 6).alias("percentile"))


@query(RANKED + "SELECT grp, max(CASE WHEN rn = greatest(1, ceil(0.3::DOUBLE * n)) THEN x END) AS percentile FROM v GROUP BY grp")
def percentile_r1(spark, sf):
    return hs.list_percentile(ad.read(spark, sf, "events"), "event_type", "value", 0.3, "r1")


@query("SELECT event_type AS grp, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type")
def running_stat(spark, sf):
    return ad.read(spark, sf, "events").groupBy(F.col("event_type").alias("grp")).agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 4).alias("variance"))


TYPE = """CASE WHEN len(alleles) = 0 THEN 'UNAVAILABLE' WHEN len(list_filter(alleles, lambda x: x IS NOT NULL)) = 0 THEN 'NO_CALL'
  WHEN len(list_filter(alleles, lambda x: x IS NOT NULL)) < len(alleles) THEN 'MIXED' WHEN alleles[1] <> alleles[2] THEN 'HET' WHEN alleles[1] = 0 THEN 'HOM_REF' ELSE 'HOM_VAR' END"""


@query(with_("genotypes") + f"SELECT site, {TYPE} AS kind, count(*) AS n FROM genotypes GROUP BY ALL")
def genotype_type(spark, sf):
    return ad.genotypes(spark, sf).groupBy("site", gt.genotype_type(F.col("alleles")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


CALLED, ALT = "len(list_filter(alleles, lambda x: x IS NOT NULL))", "len(list_filter(alleles, lambda x: x > 0))"


@query(with_("genotypes") + f"""SELECT site, CAST(sum({CALLED}) AS BIGINT) AS an, CAST(sum({ALT}) AS BIGINT) AS ac,
  round(CASE WHEN sum(CASE WHEN sample IN ('s1', 's2', 's3') THEN {CALLED} ELSE 0 END) > 0 THEN
    sum(CASE WHEN sample IN ('s1', 's2', 's3') THEN {ALT} ELSE 0 END) / sum(CASE WHEN sample IN ('s1', 's2', 's3') THEN {CALLED} ELSE 0 END) END, 9) AS af
  FROM genotypes WHERE NOT filtered GROUP BY site""")
def chromosome_counts(spark, sf):
    return gt.chromosome_counts(ad.genotypes(spark, sf), "site", ["s1", "s2", "s3"]).select("site", "an", "ac", F.round("af", 9).alias("af"))


@query(with_("genotypes") + f"""SELECT o_orderkey % 5 AS site, CAST(sum(len(list_filter(alleles, lambda x: x = 0))) AS BIGINT) AS ref_called, CAST(sum({CALLED}) AS BIGINT) AS called
  FROM genotypes GROUP BY 1 HAVING sum(len(list_filter(alleles, lambda x: x = 0))) = sum({CALLED})""")
def monomorphic_sites(spark, sf):
    return gt.monomorphic(ad.genotypes(spark, sf).withColumn("site", F.col("o_orderkey") % 5), "site")


@query("""SELECT p_partkey, array_to_string(list_transform([-p_size / 7.0, -p_size / 3.0, -0.25], lambda x:
  CAST(floor(-10.0 * (x - greatest(-p_size / 7.0, -p_size / 3.0, -0.25)) + 0.5) AS INTEGER)), ',') AS pl FROM
  (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)""")
def gl_to_pl(spark, sf):
    size = F.col("p_size").cast("double")
    gl = F.array(-size / 7.0, -size / 3.0, F.lit(-0.25))
    return ad.read(spark, sf, "part").select("p_partkey", F.array_join(gt.likelihoods_to_pl(gl).cast("array<string>"), ",").alias("pl"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS dp, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'true' END AS db, CAST(event_id % 7 AS VARCHAR) AS ac FROM events""")
def info_parse(spark, sf):
    text = F.concat(F.lit("DP="), F.col("user_id"), F.lit(";AC=1"), F.lit(";TYPE="), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ";DB").otherwise(""), F.lit(";AC="), F.col("event_id") % 7)
    info = gt.parse_info(text)
    pick = lambda k: F.try_element_at("info", F.lit(k))
    return ad.read(spark, sf, "events").select("event_id", info.alias("info")).select("event_id", pick("DP").alias("dp"), pick("TYPE").alias("kind"), pick("DB").alias("db"), pick("AC").alias("ac"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'unfiltered' WHEN 1 THEN 'passed' ELSE 'failed' END AS state, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS n FROM events""")
def filter_state(spark, sf):
    k = F.col("event_id") % 4
    text = F.when(k == 0, ".").when(k == 1, "PASS").when(k == 2, F.col("event_type")).otherwise(F.concat(F.col("event_type"), F.lit(";q10")))
    rows = ad.read(spark, sf, "events").select("event_id", gt.parse_filters(text).alias("f"))
    state = F.when(F.col("f").isNull(), "unfiltered").when(F.size("f") == 0, "passed").otherwise("failed")
    return rows.select("event_id", state.alias("state"), F.when(F.col("f").isNotNull(), F.size("f")).alias("n"))


@query("SELECT event_id, round(CASE WHEN event_id % 5 = 0 OR event_id % 5 = 1 THEN 1.0 ELSE round(value, 3) / -10 END, 9) AS error FROM events")
def qual_parse(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, ".").when(F.col("event_id") % 5 == 1, "-1").otherwise(F.round("value", 3).cast("string"))
    return ad.read(spark, sf, "events").select("event_id", F.round(gt.parse_qual(text), 9).alias("error"))


@query("""SELECT p_partkey, 'c' || (p_partkey % 25) || chr(9) || (p_partkey * 10) || chr(9) || '.' || chr(9) || 'A' || chr(9) || CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN 'C' ELSE 'C,G' END
  || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || p_size AS line, p_partkey * 10 AS start, 1 + CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_alleles, true AS same FROM part""")
def vcf_line_roundtrip(spark, sf):
    s = F.col("p_size") % 3
    fields = (F.concat(F.lit("c"), F.col("p_partkey") % 25), (F.col("p_partkey") * 10).cast("string"), F.lit("."), F.lit("A"),
              F.when(s == 0, ".").when(s == 1, "C").otherwise("C,G"), F.lit("."), F.lit("PASS"), F.concat(F.lit("DP="), F.col("p_size")))
    lines = ad.read(spark, sf, "part").select("p_partkey", F.concat_ws("\t", *fields).alias("value"))
    parsed = tx.vcf_records(lines, keep=["p_partkey", "value"])
    return parsed.select("p_partkey", F.col("value").alias("line"), "start", F.size("alleles").alias("n_alleles"), (tx.render_vcf() == F.col("value")).alias("same"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'GT:AD:DP' ELSE 'GT:DP:PL' END AS format FROM part")
def format_keys(spark, sf):
    keys = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("DP"), F.lit("GT"), F.lit("AD"))).otherwise(F.array(F.lit("PL"), F.lit("DP"), F.lit("GT")))
    rest = F.array_sort(F.filter(keys, lambda k: k != "GT"))
    return ad.read(spark, sf, "part").select("p_partkey", F.array_join(F.concat(F.array(F.lit("GT")), rest), ":").alias("format"))


@query(with_("intervals") + """SELECT event_id, contig, start, "end", coalesce(name, '') AS name, CASE WHEN negative THEN '-' ELSE '+' END AS strand FROM intervals""")
def bed_parse(spark, sf):
    rows = ad.intervals(spark, sf)
    line = F.concat_ws("\t", "contig", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.coalesce(F.concat(F.lit('"'), F.col("name"), F.lit('"')), F.lit("")), F.lit("5"), F.when(F.col("negative"), "-").otherwise("+"))
    return tx.bed(rows.select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", "contig", "start", "end", "name", "strand")


LIST = with_("intervals") + """, x AS (SELECT *, CASE event_id % 7 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '+' END AS sign FROM intervals)
"""


def _interval_lines(spark, sf):
    sign = F.when(F.col("event_id") % 7 == 0, ".").when(F.col("event_id") % 7 == 1, "-").otherwise("+")
    line = F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), sign, F.coalesce("name", F.lit(".")))
    return ad.intervals(spark, sf).select("event_id", line.alias("value"))


@query(LIST + """SELECT event_id, contig, start, "end", sign = '-' AS negative, coalesce(name, '.') AS name FROM x WHERE sign <> '.' """)
def interval_list_parse_strict(spark, sf):
    return tx.interval_list(_interval_lines(spark, sf), strict=True, keep=["event_id"]).filter("error is null").drop("error")


@query(LIST + """SELECT event_id, contig, start, "end", sign = '-' AS negative, name FROM x""")
def interval_list_parse_lenient(spark, sf):
    return tx.interval_list(_interval_lines(spark, sf), strict=False, keep=["event_id"]).filter("error is null").drop("error")


@query(with_("alignments") + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, read_name, flags, CASE WHEN ref_index < 0 THEN '*' ELSE 'c' || ref_index END AS ref_name, pos, mapq,
  CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || m1 || 'M2D10M' AS cigar, clip + m1 + 10 AS read_length FROM alignments""")
def sam_line_roundtrip(spark, sf):
    from ..functions.alignment import read_length, render_cigar
    a = ad.alignments(spark, sf)
    ref = F.when(F.col("ref_index") < 0, "*").otherwise(F.concat(F.lit("c"), F.col("ref_index")))
    line = F.concat_ws("\t", "read_name", F.col("flags").cast("string"), ref, F.col("pos").cast("string"), F.col("mapq").cast("string"), render_cigar(F.col("cigar")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("NM:i:2"))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parsed = tx.sam(a.select(*ids, line.alias("value")), keep=ids)
    return parsed.select(*ids, "read_name", "flags", "ref_name", "pos", "mapq", render_cigar(F.col("cigar")).alias("cigar"), read_length(F.col("cigar")).alias("read_length"))


@query("""SELECT o_orderkey, CASE WHEN v BETWEEN -128 AND 127 THEN 'c' WHEN v BETWEEN 0 AND 255 THEN 'C' WHEN v BETWEEN -32768 AND 32767 THEN 's' WHEN v BETWEEN 0 AND 65535 THEN 'S'
  WHEN v BETWEEN -2147483648 AND 2147483647 THEN 'i' WHEN v < 4294967296 THEN 'I' END AS kind FROM (SELECT o_orderkey, (o_orderkey - 500) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 37 WHEN 2 THEN 100003 ELSE 300007 END AS v FROM orders)""")
def tag_integer_type(spark, sf):
    k = F.col("o_orderkey") % 4
    v = (F.col("o_orderkey") - 500) * F.when(k == 0, 1).when(k == 1, 37).when(k == 2, 100003).otherwise(300007)
    return ad.read(spark, sf, "orders").select("o_orderkey", nu.integer_tag_type(v).alias("kind"))


@query("""SELECT s_nationkey AS header, md5(string_agg('ID:' || s_suppkey || coalesce(',PU:' || CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, '') || ',SM:' || CAST(s_suppkey % 5 AS VARCHAR), ';'
  ORDER BY CASE WHEN s_suppkey % 3 <> 0 THEN s_name END NULLS FIRST, CAST(s_suppkey % 5 AS VARCHAR), CAST(s_suppkey AS VARCHAR))) AS checksum FROM supplier GROUP BY s_nationkey""")
def read_group_checksum(spark, sf):
    groups = ad.read(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("header"), F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("PU"),
        (F.col("s_suppkey") % 5).cast("string").alias("SM"))
    return hd.read_group_checksum(groups, ["PU", "SM"])


LINES = """WITH lines AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'INFO' ELSE 'FORMAT' END AS kind, 'K' || (p_partkey % 50) AS id,
  CAST(p_size % 2 + CASE WHEN p_partkey % 50 < 20 THEN 0 ELSE 1 END AS VARCHAR) AS number, CASE WHEN p_partkey % 50 < 10 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Integer' ELSE 'Float' END
  WHEN p_partkey % 50 < 15 THEN CASE WHEN p_partkey % 3 = 0 THEN 'Integer' ELSE 'String' END ELSE 'String' END AS type, p_name AS description FROM part)
"""


def _header_lines(spark, sf):
    k, m = F.col("p_partkey"), F.col("p_partkey") % 50
    kind = F.when(m < 10, F.when(k % 3 == 0, "Integer").otherwise("Float")).when(m < 15, F.when(k % 3 == 0, "Integer").otherwise("String")).otherwise("String")
    return ad.read(spark, sf, "part").select(
        k.alias("ord"), F.when(k % 2 == 0, "INFO").otherwise("FORMAT").alias("kind"), F.concat(F.lit("K"), m).alias("id"),
        (F.col("p_size") % 2 + F.when(m < 20, 0).otherwise(1)).cast("string").alias("number"), kind.alias("type"), F.col("p_name").alias("description"))


@query(LINES + """SELECT kind, id, CASE WHEN min(number) <> max(number) THEN '.' ELSE arg_min(number, ord) END AS number, arg_min(type, ord) AS type, arg_min(description, ord) AS description,
  min(type) <> max(type) AND NOT (min(type) = 'Float' AND max(type) = 'Integer') AS conflict FROM lines GROUP BY kind, id""")
def header_merge(spark, sf):
    return hd.merge(_header_lines(spark, sf))


@query(LINES + "SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY ord) = 1")
def header_dedupe(spark, sf):
    return hd.dedupe(_header_lines(spark, sf))


@query("""SELECT grp, 'left' AS side FROM (SELECT o_orderkey AS grp FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)
UNION ALL SELECT grp, 'right' FROM (SELECT l_orderkey AS grp FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""")
def differential_compare(spark, sf):
    left = ad.read(spark, sf, "orders").select(F.col("o_orderkey").alias("grp"))
    right = ad.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("grp"))
    return hd.difference(left, right)


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '?' WHEN 1 THEN '-?' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) || '.25' END AS text FROM supplier""")
def metrics_table(spark, sf):
    k = F.col("s_suppkey") % 4
    value = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).when(k == 2, F.col("s_suppkey").cast("double")).otherwise(F.col("s_suppkey") + 0.25)
    return ad.read(spark, sf, "supplier").select("s_suppkey", nu.metric_text(value).alias("text"))


@query()
def normal_cdf(spark, sf):
    return ad.read(spark, sf, "events").select("event_id", F.round(nu.normal_cdf(F.col("value"), 50.0, 20.0), 9).alias("p"))


@query("""WITH v AS (SELECT p_partkey, floor(p_size / 3) AS k, floor(p_size / 2) AS d, CAST(p_size AS DOUBLE) AS s FROM part),
 c AS (SELECT p_partkey, lgamma(s + 1) - lgamma(k + 1) - lgamma(s - k + 1) + lgamma(s + 1) - lgamma(d - k + 1) - lgamma(s - d + k + 1) - lgamma(2 * s + 1) + lgamma(d + 1) + lgamma(2 * s - d + 1) AS log_p FROM v)
SELECT p_partkey, round(log_p, 9) AS log_p FROM c""")
def hypergeometric_logp(spark, sf):
    p = F.col("p_size").cast("double")
    k = F.floor(p / 3).cast("double")
    return ad.read(spark, sf, "part").select("p_partkey", F.round(nu.hypergeometric_log(k, F.floor(p / 2).cast("double"), p, p * 2.0), 9).alias("log_p"))


@query("SELECT event_id, CAST(floor(value) + CASE WHEN value - floor(value) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM events")
def java_rounding(spark, sf):
    return ad.read(spark, sf, "events").select("event_id", nu.round_half_up(F.col("value")).alias("rounded"))


@query("""SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type AS grp, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS value FROM events GROUP BY ALL""")
def stream_window_histogram(spark, sf):
    from ..streaming import records as st

    rows = st.stream_parquet(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(F.col("value") / 25).alias("bin"))
    counts = st.drain(st.windowed_histogram(rows, "ts", "event_type", "bin", "1 day"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "grp", "bin", "value")


@query("SELECT o_orderkey, o_orderkey * 65536 + o_custkey % 65536 AS pointer, o_orderkey AS block, o_custkey % 65536 AS place FROM orders")
def virtual_pointer(spark, sf):
    from ..sources import binary as bn

    made = bn.make_pointer(F.col("o_orderkey"), F.col("o_custkey") % 65536)
    rows = ad.read(spark, sf, "orders").select("o_orderkey", made.alias("pointer"))
    return rows.select("o_orderkey", "pointer", bn.pointer_block(F.col("pointer")).alias("block"), bn.pointer_offset(F.col("pointer")).alias("place"))


@query("SELECT event_id, round(1 - exp(-value / 20), 9) AS p FROM events")
def gamma_cumulative(spark, sf):
    """With shape 1 the regularised gamma function is the exponential distribution."""
    return ad.read(spark, sf, "events").select("event_id", F.round(nu.regularized_gamma(F.lit(1.0), F.col("value") / 20), 9).alias("p"))


@query("SELECT p_partkey, round((p_size - 25.5) / 10, 6) AS z FROM part")
def normal_quantile_roundtrip(spark, sf):
    z = (F.col("p_size") - 25.5) / 10
    return ad.read(spark, sf, "part").select("p_partkey", F.round(nu.normal_quantile(nu.normal_cdf(z)), 6).alias("z"))
