"""Queries over variant, alignment and feature records with their odd cases, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as al, numeric as nu, sequence as sq, variant as va
from ..operators import headers as hd, histogram as hs, indexes as ix, intervals as iv
from ..sources import text as tx
from . import adapters as ad
from .adapters import with_
from .catalog import ID, IDS, query
from .catalog_more import _pick


@query(with_("alignments") + f"SELECT {ID}, (clip + m1 + 10) || 'S' || (m1 + 12) || 'N' AS cigar FROM alignments")
def sentinel_cigar(spark, sf):
    return ad.alignments(spark, sf).select(*IDS, al.render_cigar(al.sentinel_cigar(F.col("cigar"))).alias("cigar"))


@query(with_("alignments") + f"""SELECT {ID}, 3 AS inserted, 2 + CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 0 END AS deleted, clip + m1 + 13 AS read_length, m1 + 12 + 7 + CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 0 END AS reference_length FROM alignments""")
def indel_counts(spark, sf):
    """Insertions, skips, padding and hard clips beside the deletions of every alignment."""
    text = F.concat(F.lit("5H"), al.render_cigar(F.col("cigar")), F.lit("3I7N1P"), F.when(F.col("l_linenumber") % 2 == 0, "4D").otherwise(""), F.lit("6H"))
    rows = ad.alignments(spark, sf).withColumn("long_cigar", al.parse_cigar(text))
    c = F.col("long_cigar")
    return rows.select(*IDS, al.inserted_bases(c).alias("inserted"), al.deleted_bases(c).alias("deleted"), al.read_length(c).alias("read_length"), al.reference_length(c).alias("reference_length"))


#: A read of one document aligned to the bases of the next: 2 clipped, 5 aligned, 3 inserted, 4 aligned, 2 deleted, 6 aligned, 3 skipped, the rest aligned.
PAIR = with_("reads") + """, p AS (SELECT a.doc_id, a.bases AS r, b.bases AS f, length(a.bases) - 20 AS k FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1
  WHERE length(a.bases) > 20 AND length(b.bases) >= length(a.bases)),
e AS (SELECT doc_id, k, list_zip(string_split(r[3:7] || r[11:14] || r[15:20] || r[21:20 + k], ''), string_split(f[1:5] || f[6:9] || f[12:17] || f[21:20 + k], '')) AS z, f FROM p)
"""


def _aligned_pairs(spark, sf):
    a = ad.reads(spark, sf).select("doc_id", "bases")
    pairs = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bases").alias("reference")), "doc_id")
    n = F.length("bases")
    rows = pairs.filter((n > 20) & (F.length("reference") >= n))
    return rows.withColumn("cigar", al.parse_cigar(F.concat(F.lit("2S5M3I4M2D6M3N"), n - 20, F.lit("M"))))


@query(PAIR + "SELECT doc_id, len(list_filter(z, lambda x: x[1] <> x[2])) AS mismatches FROM e")
def count_mismatches(spark, sf):
    blocks = al.alignment_blocks(F.lit(1), F.col("cigar"))
    return _aligned_pairs(spark, sf).select("doc_id", sq.block_mismatches(F.col("bases"), blocks, F.col("reference"), F.lit(1)).alias("mismatches"))


@query(PAIR + """, m AS (SELECT doc_id, k, f, list_transform(z, lambda x: CASE WHEN x[1] = x[2] THEN '' ELSE x[2] END) AS marks FROM e),
 w AS (SELECT doc_id, marks[1:9] || ['^' || f[10:11]] || marks[10:] AS marks FROM m),
 c AS (SELECT doc_id, i, b, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, unnest(range(1, len(marks) + 1)) AS i, unnest(marks) AS b FROM w) WHERE b <> ''),
 t AS (SELECT doc_id, string_agg(CAST(i - before - 1 AS VARCHAR) || b, '' ORDER BY i) AS t, max(i) AS last, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id AS doc_id, md5(t || CAST(len(marks) - last AS VARCHAR)) AS md_md5, n - 1 + 2 + 3 AS nm FROM w JOIN t ON w.doc_id = t.doc_id""")
def md_nm_cigar(spark, sf):
    found = _aligned_pairs(spark, sf).select("doc_id", sq.md_and_nm(F.col("bases"), F.col("cigar"), F.col("reference")).alias("x"))
    return found.select("doc_id", F.md5(F.col("x.md").cast("binary")).alias("md_md5"), F.col("x.nm").cast("long").alias("nm"))


@query("""SELECT p_partkey, regexp_full_match(t, '[acmgrsvtwyhkdbnACMGRSVTWYHKDBN.=]*') AS valid FROM (SELECT p_partkey, ['acgt', 'ACGTN', '=.', 'ACXG', 'E', '', 'RYKMSWBDHVN', 'A C'][p_partkey % 8 + 1] AS t FROM part)""")
def valid_read_bases(spark, sf):
    return ad.read(spark, sf, "part").select("p_partkey", sq.valid_read_bases(_pick(F.col("p_partkey"), "acgt", "ACGTN", "=.", "ACXG", "E", "", "RYKMSWBDHVN", "A C")).alias("valid"))


@query("""SELECT o_orderkey, k = 0 AS has_error, CASE WHEN k = 0 THEN 'i' WHEN k = 1 THEN 'A' WHEN k = 2 THEN 'B' ELSE 'Z' END AS nm_type, CASE WHEN k = 0 THEN NULL ELSE o_custkey END AS dp,
 CASE k WHEN 0 THEN 'NM:i:7' WHEN 1 THEN 'AS:i:' || o_custkey || chr(9) || 'NM:A:x' WHEN 2 THEN 'AS:i:' || o_custkey || chr(9) || 'NM:B:c,1,-2' ELSE 'AS:i:' || o_custkey || chr(9) || 'NM:Z:a:b c' END AS line,
 CASE k WHEN 2 THEN 2 END AS n_numbers FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def sam_tags(spark, sf):
    """Typed tags of text fields: a repeated tag, one of a wrong shape, one whose value does not fit its type."""
    k, dp = F.col("o_orderkey") % 4, F.concat(F.lit("AS:i:"), F.col("o_custkey"))
    fields = (F.when(k == 0, F.array(F.lit("AS:i:x"), F.lit("NM:i:3"), F.lit("bad"), F.lit("NM:i:7"))).when(k == 1, F.array(dp, F.lit("NM:A:x")))
              .when(k == 2, F.array(F.lit("NM:B:c,1,-2"), dp)).otherwise(F.array(F.lit("NM:Z:a:b c"), dp)))
    rows = ad.read(spark, sf, "orders").select("o_orderkey", "o_custkey", tx.tag_map(fields).alias("tags"))
    typed = rows.withColumn("score", tx.tag_value(F.try_element_at("tags", F.lit("AS")))).withColumn("nm", tx.tag_value(F.try_element_at("tags", F.lit("NM"))))
    good = F.map_filter("tags", lambda name, value: tx.tag_value(value).isNotNull())
    return typed.select(
        "o_orderkey", F.col("score").isNull().alias("has_error"), F.col("nm.type").alias("nm_type"), F.col("score.integer").alias("dp"), tx.render_tags(good).alias("line"),
        F.when(F.col("nm.numbers").isNotNull(), F.size("nm.numbers")).alias("n_numbers"))


@query("""SELECT o_orderkey, 'NM:i:1' || CASE WHEN o_orderkey % 3 = 0 THEN chr(9) || 'RG:Z:g' ELSE '' END AS line, o_orderkey % 3 = 0 AS has_group FROM orders""")
def tag_order(spark, sf):
    """Tags set, deleted and written by name."""
    tags = F.map_concat(F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("RG"), F.lit("Z:g"), F.lit("XT"), F.lit("A:U"))).otherwise(F.create_map(F.lit("XT"), F.lit("A:U"))), F.create_map(F.lit("NM"), F.lit("i:1")))
    left = F.map_filter(tags, lambda k, v: k != "XT")
    return ad.read(spark, sf, "orders").select("o_orderkey", tx.render_tags(left).alias("line"), F.map_contains_key(left, F.lit("RG")).alias("has_group"))


BLOCK = """WITH g AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_custkey FROM orders)
"""


@query(BLOCK + """SELECT o_orderkey, CASE k WHEN 0 THEN '0,1' WHEN 1 THEN '.,.' WHEN 2 THEN '1,1,0' WHEN 3 THEN '0,2' WHEN 4 THEN '0' WHEN 5 THEN '0,1' END AS alleles,
 k = 2 AS phased, CASE WHEN k IN (0, 2) THEN CAST(o_custkey % 90 AS INTEGER) WHEN k = 3 THEN 5 END AS dp, CASE k WHEN 0 THEN 13 WHEN 3 THEN 99 END AS gq,
 CASE k WHEN 0 THEN '4,6' END AS ad, CASE k WHEN 0 THEN '0,10,20' WHEN 5 THEN '1,2,3' END AS pl,
 CASE k WHEN 3 THEN 'allele' WHEN 4 THEN 'dp' WHEN 5 THEN 'values' WHEN 6 THEN 'gt' END AS error FROM g""")
def genotype_block(spark, sf):
    """Genotype columns with missing, cut off and malformed values."""
    k, dp = F.col("o_orderkey") % 7, (F.col("o_custkey") % 90).cast("string")
    keys = F.when(k == 6, "DP:GT").otherwise("GT:DP:GQ:AD:PL")
    c = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    values = (F.when(k == 0, c("0/1:", dp, ":12.5:4,6:0,10,20")).when(k == 1, "./.:.").when(k == 2, c("1|1/0:", dp, ":-1:4,x:0,y,3")).when(k == 3, "0//2:5:99")
              .when(k == 4, "0:x").when(k == 5, "0\\1:.:.:.:1,2,3:9").otherwise(c(".:0/1")))
    rows = ad.read(spark, sf, "orders").select("o_orderkey", va.genotype_block(keys, values, F.lit(2)).alias("g"))
    text = lambda a: F.array_join(F.col(a).cast("array<string>"), ",", ".")
    return rows.select("o_orderkey", text("g.alleles").alias("alleles"), "g.phased", "g.dp", "g.gq", text("g.ad").alias("ad"), text("g.pl").alias("pl"), "g.error")


@query("""SELECT o_custkey AS site, len(l) AS n_samples, array_to_string(list_sort(list_transform(l, lambda x: x[2])), ',') AS samples FROM (
  SELECT o_custkey, list([CAST(o_orderkey AS VARCHAR), 'S' || o_orderkey]) AS l FROM orders GROUP BY o_custkey)""")
def sample_name_sort(spark, sf):
    rows = ad.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.collect_list(F.concat(F.lit("S"), F.col("o_orderkey"))).alias("l"))
    return rows.select("site", F.size("l").cast("long").alias("n_samples"), F.array_join(F.array_sort("l"), ",").alias("samples"))


@query(with_("genotypes") + """, f AS (SELECT site, arg_min(alleles, o_orderkey) FILTER (sample = 's3') AS a, max(len(alleles)) AS p, count(*) AS n FROM genotypes GROUP BY site)
SELECT site, array_to_string(list_transform(a, lambda x: coalesce(CAST(x AS VARCHAR), '.')), '/') AS genotype, CAST(p AS INTEGER) AS ploidy FROM f""")
def genotype_by_sample(spark, sf):
    some = ad.genotypes(spark, sf).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "sample", "alleles"))).alias("g"))
    found = va.genotype_of(F.col("g"), F.lit("s3"))["alleles"]
    return some.select("site", F.array_join(found.cast("array<string>"), "/", ".").alias("genotype"), va.max_ploidy(F.col("g")).alias("ploidy"))


@query("""SELECT p_partkey, k > 0 AS is_variant, k <> 1 AS has_quality, CASE WHEN k <> 1 THEN round(p_size * 1.5, 6) END AS quality, CASE WHEN k <> 1 THEN CASE WHEN p_size % 2 = 0 THEN CAST(CAST(p_size * 1.5 AS BIGINT) AS VARCHAR)
  ELSE CAST(CAST(floor(p_size * 1.5) AS BIGINT) AS VARCHAR) || '.50' END END AS text FROM (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM part)""")
def variant_site_tests(spark, sf):
    k = F.col("p_partkey") % 3
    alleles = F.when(k == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("C")))
    error = F.when(k == 1, 1.0).otherwise(F.col("p_size") * -0.15)
    quality = F.when(error != 1.0, error * -10)
    return ad.read(spark, sf, "part").select(
        "p_partkey", (F.size(alleles) > 1).alias("is_variant"), quality.isNotNull().alias("has_quality"), F.round(quality, 6).alias("quality"),
        va.quality_text(F.round(quality, 6)).alias("text"))


@query(with_("targets", "contigs") + """SELECT target_id, c.idx AS contig_index, row_number() OVER (PARTITION BY t.contig ORDER BY start, target_id) AS place, c.idx IS NULL AS unknown
FROM targets t LEFT JOIN (SELECT * FROM contigs WHERE idx < 20) c ON t.contig = c.name""")
def variant_sort(spark, sf):
    """Records by the header's contig order and start; contigs that the header lacks are marked."""
    known = ad.contigs(spark, sf).filter("idx < 20").select(F.col("name").alias("contig"), F.col("idx").alias("contig_index"))
    rows = ad.targets(spark, sf).join(known, "contig", "left")
    ranked = iv.rank_in_group(rows, "contig", F.col("start"), [F.col("start"), F.col("target_id")], "place")
    return ranked.select("target_id", "contig_index", "place", F.col("contig_index").isNull().alias("unknown"))


STANDARD = """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'INFO' ELSE 'FORMAT' END AS kind, ['DP', 'AF', 'GT', 'XX'][p_partkey % 4 + 1] AS id,
  ['1', 'A', '.'][p_partkey % 3 + 1] AS number, ['Integer', 'Float', 'String'][p_size % 3 + 1] AS type, p_name AS description FROM part),
s AS (SELECT * FROM (VALUES ('INFO', 'DP', '1', 'Integer', 'Approximate read depth; some reads may have been filtered'), ('FORMAT', 'DP', '1', 'Integer', 'Approximate read depth (reads with MQ=255 or with bad mates are filtered)'),
  ('INFO', 'AF', 'A', 'Float', 'Allele Frequency, for each ALT allele, in the same order as listed'), ('FORMAT', 'GT', '1', 'String', 'Genotype')) v(k, i, n, t, d))
"""


def _standard_lines(spark, sf):
    k = F.col("p_partkey")
    return ad.read(spark, sf, "part").select(
        "p_partkey", _pick(k, "INFO", "FORMAT").alias("kind"), _pick(k, "DP", "AF", "GT", "XX").alias("id"), _pick(k, "1", "A", ".").alias("number"),
        _pick(F.col("p_size"), "Integer", "Float", "String").alias("type"), F.col("p_name").alias("description"))


@query(STANDARD + """SELECT p_partkey, kind, id, CASE WHEN bad THEN n ELSE number END AS number, CASE WHEN bad THEN t ELSE type END AS type, CASE WHEN bad THEN d ELSE description END AS description, bad AS repaired
FROM (SELECT l.*, s.*, i IS NOT NULL AND (number <> n OR type <> t) AS bad FROM l LEFT JOIN s ON l.kind = s.k AND l.id = s.i)""")
def header_repair(spark, sf):
    return hd.repair(_standard_lines(spark, sf))


@query(STANDARD + """SELECT row_number() OVER (ORDER BY line) AS place, line FROM (SELECT DISTINCT '##' || kind || '=<ID=' || id || ',Number=' || number || ',Type=' || type || ',Description="d"">' AS line FROM l)""".replace('d"">', 'd">'))
def header_line_sort(spark, sf):
    """Rendered header lines in the order they are written; the lines of one header are few."""
    from pyspark.sql import Window as W

    lines = _standard_lines(spark, sf).withColumn("d", F.lit("d")).select(hd.render_compound("kind", "id", "number", "type", "d").alias("line")).distinct()
    return lines.select(F.row_number().over(W.orderBy("line")).cast("long").alias("place"), "line")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Integer' WHEN 1 THEN 'Flag' END AS type, CASE event_id % 3 WHEN 0 THEN user_id END AS number FROM events""")
def header_typed_values(spark, sf):
    """Attribute values under the type that the header declares for their key; an undeclared key has none."""
    lines = spark.createDataFrame([("INFO", "DP", "Integer"), ("INFO", "DB", "Flag"), ("FORMAT", "ZZ", "Integer")], "kind string, id string, type string")
    values = ad.read(spark, sf, "events").select("event_id", _pick(F.col("event_id"), "DP", "DB", "ZZ").alias("key"), F.col("user_id").cast("string").alias("value"))
    typed = hd.undeclared(values, lines, "INFO")
    return typed.select("event_id", "type", F.when(F.col("type") == "Integer", F.col("value").try_cast("long")).alias("number"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN value WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN 'nan'::DOUBLE WHEN 5 THEN 8.0 WHEN 6 THEN -0.5 END AS number FROM events""")
def vcf_double_parse(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.col("value").cast("double").cast("string")).otherwise(_pick(F.col("event_id"), "x", "Infinity", "-INF", "-nan", "1.2.3", "0x1p3", " -5e-1 "))
    text = F.when((F.col("event_id") % 7).between(0, 6), text)  # a row without an id, or with one below 0, has no text
    return ad.read(spark, sf, "events").select("event_id", va.vcf_double(text).alias("number"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.25' WHEN 1 THEN '0.125' WHEN 2 THEN '5.000e-03' WHEN 3 THEN '-' || '2.500e+00' WHEN 4 THEN '0.00' ELSE '1.01' END AS text,
  CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN 'a,.' ELSE 'a,b' END AS list FROM part""")
def vcf_value_render(spark, sf):
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, F.col("p_size") + 0.25).when(k == 1, 0.125).when(k == 2, 0.005).when(k == 3, -2.5).when(k == 4, 1e-25).otherwise(1.005)
    items = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"), F.lit(None))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return ad.read(spark, sf, "part").select("p_partkey", va.vcf_double_text(value).alias("text"), va.vcf_list_text(items).alias("list"))


@query("""SELECT grp, min(bin) AS min_bin, max(bin) AS max_bin, count(*) AS bins, max(value) AS max_value, round(avg(value), 6) AS mean_value FROM (
  SELECT l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS bin, CAST(sum(l_linenumber) AS DOUBLE) AS value FROM lineitem GROUP BY ALL) GROUP BY grp""")
def hist_extremes(spark, sf):
    h = hs.build(ad.read(spark, sf, "lineitem"), "l_returnflag", "l_quantity", F.col("l_linenumber"))
    return hs.extremes(h).withColumn("mean_value", F.round("mean_value", 6))


@query("""SELECT CASE WHEN grp = 0 THEN NULL ELSE grp END AS grp, n, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE 7.0 END AS mean, CASE WHEN n > 1 THEN 0.0 ELSE 'NaN'::DOUBLE END AS sd, CASE WHEN n > 0 THEN 7.0 END AS percentile,
  CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE 1.0 END AS probability FROM (SELECT p_size AS grp, CAST(p_size % 3 AS DOUBLE) AS n FROM part GROUP BY p_size UNION ALL SELECT 0, 2.0)""")
def hist_degenerate(spark, sf):
    """Groups of weight 0, of one observation and of a null key."""
    sizes = ad.read(spark, sf, "part").select(F.col("p_size").alias("grp")).distinct().unionByName(spark.range(1).select(F.lit(None).cast("int").alias("grp")))
    h = sizes.select("grp", F.lit(7.0).alias("bin"), F.coalesce(F.col("grp") % 3, F.lit(2)).cast("double").alias("value"))
    m, p, c = hs.moments(h), hs.percentile(h, 0.5), hs.cumulative_probability(h, 9.0)
    for other in (p, c):
        m = m.join(other.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    return m.select("grp", "n", "mean", "sd", "percentile", "probability")


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'number' WHEN 2 THEN 'number' END AS error, CASE WHEN event_id % 4 IN (0, 3) THEN 11 END AS start, CASE event_id % 4 WHEN 0 THEN 20 WHEN 3 THEN 11 END AS "end" FROM events""")
def bed_malformed(spark, sf):
    line = _pick(F.col("event_id"), "c1\t10\t20", "c1\tx\t20", "c1\t10\ty", "c1 10")
    return tx.bed(ad.read(spark, sf, "events").select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", "error", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'number' WHEN 2 THEN 'cigar' WHEN 3 THEN 'fields' END AS error, CASE WHEN event_id % 4 IN (0, 2) THEN 16 WHEN event_id % 4 = 3 THEN 4 END AS flags FROM events""")
def sam_malformed(spark, sf):
    rest = "\t*\t0\t0\t*\t*"
    line = _pick(F.col("event_id"), "q\t16\tc1\t7\t60\t5M" + rest, "q\tz\tc1\t7\t60\t5M" + rest, "q\t16\tc1\t7\t60\t5MM" + rest, "q\t4\tc1")
    return tx.sam(ad.read(spark, sf, "events").select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", "error", "flags")


@query("""SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'number' WHEN 2 THEN 'fields' END AS error, CASE event_id % 3 WHEN 0 THEN 9 END AS stop FROM events""")
def vcf_malformed(spark, sf):
    line = _pick(F.col("event_id"), "c1\t7\t.\tACG\tT\t.\tPASS\tDP=1", "c1\tx\t.\tA\tT\t.\tPASS\tDP=1", "c1\tseven")
    return tx.vcf_records(ad.read(spark, sf, "events").select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", "error", F.col("stop").cast("int").alias("stop"))


@query("""SELECT event_id, CASE k WHEN 2 THEN 'exons' WHEN 3 THEN 'exons' END AS error, CASE k WHEN 0 THEN '11-15:13-15:1,21-30:21-28:2' WHEN 1 THEN '11-15:13-15:2,21-30:21-28:1' END AS exons,
  CASE k WHEN 0 THEN '255,0,16' WHEN 1 THEN '16,32,255' WHEN 2 THEN '0,0,0' END AS colour FROM (SELECT event_id, event_id % 4 AS k FROM events)""")
def bed_exons(spark, sf):
    row = lambda strand, colour, count, sizes, starts: f"c1\t10\t40\tn\t0\t{strand}\t12\t28\t{colour}\t{count}\t{sizes}\t{starts}"
    line = _pick(F.col("event_id"), row("+", "255, 0,16", 2, "5,10,9,", "0,10"), row("-", "#1020fF", 2, "5,10", "0,10,99"), row("+", "red?", 3, "5,10", "0,10"), row("+", "1,2,300", 0, "", ""))
    found = tx.bed_exons(ad.read(spark, sf, "events").select("event_id", line.alias("value")), keep=["event_id"])
    text = F.transform("exons", lambda e: F.concat_ws("", e["start"], F.lit("-"), e["end"], F.lit(":"), e["coding_start"], F.lit("-"), e["coding_end"], F.lit(":"), e["number"]))
    return found.select("event_id", "error", F.array_join(text, ",").alias("exons"), F.array_join(F.col("colour").cast("array<string>"), ",").alias("colour"))


@query("""SELECT event_id, event_id % 5 IN (0, 1, 3) AS is_bed FROM events""")
def bed_path_sniff(spark, sf):
    return ad.read(spark, sf, "events").select("event_id", tx.is_bed_path(_pick(F.col("event_id"), "a/b.bed", "x.BED.gz", "x.bed.gz.gz", "y.bed.BGZF", "bed.txt")).alias("is_bed"))


@query(with_("intervals") + """SELECT event_id, contig || chr(9) || start || chr(9) || "end" || chr(9) || CASE WHEN negative THEN '-' ELSE '+' END || chr(9) || coalesce(name, '.') AS line FROM intervals""")
def interval_list_write(spark, sf):
    c = F.col
    return ad.intervals(spark, sf).select("event_id", tx.interval_line(c("contig"), c("start"), c("end"), c("negative"), c("name")).alias("line"))


@query("""SELECT o_orderkey AS "read", 'r' || o_orderkey || ' x' AS name, CASE WHEN o_orderkey % 4 = 1 THEN 'AC' ELSE 'ACG' END AS bases, CASE o_orderkey % 4 WHEN 1 THEN 'length' WHEN 2 THEN 'separator' WHEN 3 THEN 'truncated' END AS error FROM orders""")
def fastq_parse(spark, sf):
    """Reads of numbered lines, some of them malformed or cut off; every line has a place in the result."""
    k = F.col("o_orderkey") % 4
    lines = F.array(
        F.concat(F.lit("@r"), F.col("o_orderkey"), F.lit(" x")), F.when(k == 1, "AC").otherwise("ACG"), F.when(k == 2, "-").otherwise("+"), F.lit("@II"))
    lines = F.when(k == 3, F.slice(lines, 1, 3)).otherwise(lines)
    rows = ad.read(spark, sf, "orders").select("o_orderkey", F.posexplode(lines).alias("i", "value")).select((F.col("o_orderkey") * 4 + F.col("i")).alias("line"), "value")
    return tx.fastq_lines(rows, "line").select("read", "name", "bases", "error")


@query(with_("intervals") + """, b AS (SELECT contig, start // 100 AS bin, count(*) AS features, CAST(sum("end" - start + 1) AS BIGINT) AS size FROM intervals GROUP BY ALL),
 w AS (SELECT contig, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY contig), a AS (SELECT w.contig AS contig, w.bin AS bin, coalesce(features, 0) AS features, coalesce(size, 0) AS size FROM w LEFT JOIN b ON w.contig = b.contig AND w.bin = b.bin),
 l AS (SELECT contig, k, bin >> k AS g, sum(size) AS size, sum(features) AS features FROM a, (SELECT unnest(range(0, 20)) AS k) GROUP BY ALL),
 s AS (SELECT contig, k, max(size) AS top, sum(size) AS total, sum(features) AS features, count(*) AS blocks FROM l GROUP BY ALL),
 f AS (SELECT contig, min(k) FILTER (top * features > 100 * total OR blocks = 1 OR 100 * power(2, k) > 1e9 OR (features > 1 AND 100 * power(2, k) > 1024000)) AS stop FROM s GROUP BY contig)
SELECT s.contig AS contig, CAST(100 * power(2, k) AS BIGINT) AS width, blocks FROM s JOIN f ON s.contig = f.contig AND k = greatest(stop - 1, 0)""")
def index_bin_width(spark, sf):
    rows = ad.intervals(spark, sf)
    used = rows.groupBy("contig", F.floor(F.col("start") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("features"), F.sum(F.col("end") - F.col("start") + 1).alias("size"))
    whole = used.groupBy("contig").agg(F.max("bin").alias("top")).select("contig", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin"))
    return ix.linear_bin_width(whole.join(used, ["contig", "bin"], "left").na.fill(0, ["features", "size"]), 100)


@query(with_("intervals") + """, o AS (SELECT contig, event_id // 1000 AS chunk, start, start - lag(start) OVER w AS step, max("end" - start + 1) OVER (PARTITION BY event_id // 1000, contig ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS longest
  FROM intervals WINDOW w AS (PARTITION BY event_id // 1000, contig ORDER BY event_id))
SELECT chunk, contig, count(*) AS features, CAST(sum(CASE WHEN step >= 0 THEN step ELSE start END) AS BIGINT) AS bases_seen, max(longest) AS longest_feature, round(avg(longest), 6) AS mean_length FROM o GROUP BY ALL""")
def index_length_statistics(spark, sf):
    rows = ad.intervals(spark, sf).withColumn("chunk", F.floor(F.col("event_id") / 1000))
    found = ix.length_statistics(rows, ["chunk", "contig"], ["event_id"])
    return found.select("chunk", "contig", "features", "bases_seen", "longest_feature", F.round("mean_length", 6).alias("mean_length"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '-0' WHEN 1 THEN '0.1' ELSE '123456789012345680000' END AS text, CASE WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END AS flag FROM supplier""")
def metrics_values(spark, sf):
    k = F.col("s_suppkey") % 3
    value = F.when(k == 0, F.lit(-0.0)).when(k == 1, F.lit(0.1)).otherwise(F.lit(1.2345678901234568e20))
    return ad.read(spark, sf, "supplier").select("s_suppkey", nu.metric_text(value).alias("text"), nu.metric_flag(F.col("s_suppkey") % 2 == 0).alias("flag"))


@query(with_("intervals") + "SELECT event_id % 10 AS k, count(*) AS n FROM intervals i WHERE EXISTS (SELECT 1 FROM intervals t WHERE t.event_id % 50 = 0 AND i.contig = t.contig AND i.start <= t.\"end\" AND i.\"end\" >= t.start) GROUP BY ALL")
def overlap_semi_repeated(spark, sf):
    """Repeated rows each stay: all columns that tell events apart are dropped before the join."""
    rows = ad.intervals(spark, sf)
    return iv.overlap_join(rows.select("contig", "start", "end", (F.col("event_id") % 10).alias("k")), rows.filter("event_id % 50 = 0"), how="left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
