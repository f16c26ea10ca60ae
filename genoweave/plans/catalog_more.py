"""Queries over allele and attribute text, index tables and region sets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import sequence as sq, variant as va
from ..operators import indexes as ix, intervals as iv
from ..sources import text as tx
from . import adapters as ad
from .adapters import with_
from .catalog import MERGED, query


def _pick(column, *values):
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(column % len(values) == i, values[i]).otherwise(out)
    return out


@query("""SELECT p_partkey, CASE WHEN b = '.' THEN 'no_call' WHEN length(b) > 1 AND (b LIKE '<%' OR b LIKE '%>') THEN 'symbolic'
  WHEN contains(b, '[') OR contains(b, ']') OR (length(b) > 1 AND (b LIKE '.%' OR b LIKE '%.')) THEN 'breakend' WHEN b = '*' AND NOT r THEN 'spanning'
  WHEN regexp_matches(b, '^[ACGTNacgtn]+$') THEN 'bases' END AS kind, CASE WHEN regexp_matches(b, '^[ACGTNacgtn]+$') THEN upper(b) ELSE b END AS text
FROM (SELECT p_partkey, ['acg', '.', '<DEL>', 'A[2:5[', '*', 'AXT', '.T', '', '-', 'N'][p_partkey % 10 + 1] AS b, p_size % 2 = 0 AS r FROM part)""")
def allele_classification(spark, sf):
    bases = _pick(F.col("p_partkey"), "acg", ".", "<DEL>", "A[2:5[", "*", "AXT", ".T", "", "-", "N")
    ref = F.col("p_size") % 2 == 0
    return ad.read(spark, sf, "part").select("p_partkey", va.allele_kind(bases, ref).alias("kind"), va.allele_text(bases, ref).alias("text"))


@query("""SELECT p_partkey, regexp_full_match(t, '[.,]*') AS missing FROM (SELECT p_partkey, ['', '.', '.,.', 'a', '.a', ','][p_partkey % 6 + 1] AS t FROM part)""")
def missing_values(spark, sf):
    return ad.read(spark, sf, "part").select("p_partkey", va.is_missing(_pick(F.col("p_partkey"), "", ".", ".,.", "a", ".a", ",")).alias("missing"))


@query("""SELECT o_orderkey, array_to_string(list_transform(list_filter(string_split_regex(gt, '[/|]'), lambda x: x <> ''), lambda x: x), ',') AS alleles, contains(gt, '|') AS phased,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 90 AS VARCHAR) END AS dp
FROM (SELECT o_orderkey, o_custkey, ['0/1', '1|0', './.', '0//1', '1', '0|1/2'][o_orderkey % 6 + 1] AS gt FROM orders)""")
def genotype_text(spark, sf):
    gt = _pick(F.col("o_orderkey"), "0/1", "1|0", "./.", "0//1", "1", "0|1/2")
    values = F.concat(gt, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(":"), F.col("o_custkey") % 90)).when(F.col("o_orderkey") % 3 == 1, ":.").otherwise(""))
    alleles = F.array_join(F.transform(va.genotype_alleles(gt), lambda a: F.coalesce(a.cast("string"), F.lit("."))), ",")
    return ad.read(spark, sf, "orders").select("o_orderkey", alleles.alias("alleles"), va.is_phased(gt).alias("phased"), va.genotype_field(F.lit("GT:DP"), values, "DP").alias("dp"))


@query("""SELECT p_partkey, p_name || ';' || p_brand || '%' AS text FROM part""")
def percent_decoding(spark, sf):
    return ad.read(spark, sf, "part").select("p_partkey", va.percent_decode(F.concat(F.col("p_name"), F.lit("%3B"), F.col("p_brand"), F.lit("%25"))).alias("text"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN NULL ELSE user_id END AS n, event_id % 4 = 1 AS flag FROM events""")
def typed_attributes(spark, sf):
    text = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, ".").when(F.col("event_id") % 4 == 3, F.col("user_id").cast("string"))
    flag = F.when(F.col("event_id") % 4 == 1, "True").when(F.col("event_id") % 4 == 2, "1")
    return ad.read(spark, sf, "events").select("event_id", va.attribute_int(text, -1).cast("long").alias("n"), va.attribute_bool(flag).alias("flag"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 1 END AS parts FROM part""")
def trailing_split(spark, sf):
    text = _pick(F.col("p_partkey"), "a,b,,", ",,", ",,c", "a")
    return ad.read(spark, sf, "part").select("p_partkey", F.size(va.split_dropping_trailing(text, ",")).alias("parts"))


@query(with_("reads") + """SELECT doc_id, length(bases) - length(replace(bases, 'N', '')) AS no_calls FROM reads""")
def no_call_bases(spark, sf):
    calls = F.filter(F.split("bases", ""), lambda b: sq.is_no_call(b))
    return ad.reads(spark, sf).select("doc_id", F.size(calls).alias("no_calls"))


@query(with_("reads") + """, p AS (SELECT a.doc_id, a.bases AS x, b.bases AS y, least(length(a.bases), length(b.bases)) AS n, a.doc_id % 2 = 1 AS neg FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, len(list_filter(list_zip(string_split(x[1:n], ''), string_split(y[1:n], '')), lambda b: b[1] = b[2] OR CASE WHEN neg THEN b[2] = 'G' AND b[1] = 'A' ELSE b[2] = 'C' AND b[1] = 'T' END)) AS equal FROM p""")
def bisulfite_equal_count(spark, sf):
    a = ad.reads(spark, sf).select("doc_id", "bases")
    pairs = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bases").alias("other")), "doc_id")
    n = F.least(F.length("bases"), F.length("other"))
    cut = lambda c: F.filter(F.split(F.substr(c, F.lit(1), n), ""), lambda b: b != "")
    same = F.zip_with(cut(F.col("bases")), cut(F.col("other")), lambda x, y: sq.bisulfite_equal(x, y, F.col("doc_id") % 2 == 1))
    return pairs.select("doc_id", F.size(F.filter(same, lambda s: s)).alias("equal"))


@query(with_("reads") + """, p AS (SELECT a.doc_id, a.bases AS x, b.bases AS y, least(length(a.bases), length(b.bases)) AS n FROM reads a JOIN reads b ON b.doc_id = a.doc_id + 1),
 c AS (SELECT doc_id, n, i, b, lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before
   FROM (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, unnest(string_split(x[1:n], '')) AS a, unnest(string_split(y[1:n], '')) AS b FROM p WHERE n > 0) WHERE a <> b),
 m AS (SELECT doc_id, string_agg(CAST(i - before - 1 AS VARCHAR) || b, '' ORDER BY i) AS t, max(i) AS last, count(*) AS nm FROM c GROUP BY doc_id)
SELECT p.doc_id AS doc_id, md5(coalesce(t, '') || CAST(n - coalesce(last, 0) AS VARCHAR)) AS md_md5, coalesce(nm, 0) AS nm FROM p LEFT JOIN m ON p.doc_id = m.doc_id""")
def md_nm(spark, sf):
    a = ad.reads(spark, sf).select("doc_id", "bases")
    pairs = a.join(a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("bases").alias("other")), "doc_id")
    md = sq.md_text(F.col("bases"), F.col("other"))
    return pairs.select("doc_id", F.md5(md.cast("binary")).alias("md_md5"), sq.mismatches(F.col("bases"), F.col("other")).cast("long").alias("nm"))


@query("""WITH b AS (SELECT l_suppkey % 7 AS g, l_orderkey * 3000 AS start, l_orderkey * 3000 + l_partkey AS "end" FROM lineitem),
 o AS (SELECT *, max("end") OVER (PARTITION BY g ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
 r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach >= 2500 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT g, min(start) AS start, max("end") AS "end" FROM r GROUP BY g, run""")
def block_consolidate(spark, sf):
    start = F.col("l_orderkey") * 3000
    blocks = ad.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), start.alias("start"), (start + F.col("l_partkey")).alias("end"))
    return ix.consolidate_blocks(blocks, ["g"], 2500)


@query(with_("intervals") + """, u AS (SELECT contig, start // 800 AS bin, count(*) AS features, max("end" - start + 1) AS longest FROM intervals GROUP BY ALL),
 s AS (SELECT contig, max(longest) AS longest_feature, unnest(range(0, max(bin) + 1)) AS bin FROM u GROUP BY contig)
SELECT s.contig AS contig, s.bin AS bin, longest_feature, coalesce(features, 0) AS features FROM s LEFT JOIN u ON s.contig = u.contig AND s.bin = u.bin""")
def feature_index(spark, sf):
    return ix.feature_bins(ad.intervals(spark, sf), 800)


@query(with_("intervals") + """SELECT event_id FROM (SELECT event_id, contig, start, lag(contig) OVER w AS pc, lag(start) OVER w AS ps FROM intervals
  WINDOW w AS (PARTITION BY event_id // 100 ORDER BY event_id * 37 % 100)) WHERE pc = contig AND ps > start""")
def order_check(spark, sf):
    rows = ad.intervals(spark, sf).withColumn("chunk", F.floor(F.col("event_id") / 100)).withColumn("ord", F.col("event_id") * 37 % 100)
    return ix.out_of_order(rows, "ord", "contig", "start", ["chunk"]).select("event_id")


@query(with_("reads") + """, s AS (SELECT list_prepend('', string_split(bases, '')) AS prevs, string_split(bases, '') AS syms FROM reads WHERE bases <> '')
SELECT p.a AS prev, p.b AS sym, count(*) AS n FROM (SELECT unnest(list_transform(list_zip(prevs[1:len(syms)], syms), lambda z: {'a': z[1], 'b': z[2]})) AS p FROM s) GROUP BY ALL""")
def symbol_frequencies(spark, sf):
    return ix.symbol_pairs(ad.reads(spark, sf), "bases")


@query("""SELECT tags, first, n, row_number() OVER (ORDER BY first) - 1 AS id FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'MQ,NM' WHEN o_orderkey % 7 = 1 THEN 'AS,MQ,NM' ELSE 'NM' END AS tags, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1)""")
def tag_dictionary(spark, sf):
    k = F.col("o_orderkey")
    tags = F.when(k % 3 == 0, F.array(F.lit("NM"), F.lit("MQ"))).when(k % 7 == 1, F.array(F.lit("NM"), F.lit("MQ"), F.lit("AS"))).otherwise(F.array(F.lit("NM")))
    return ix.tag_sets(ad.read(spark, sf, "orders").select(k, tags.alias("tags_")), "tags_", "o_orderkey")


@query(with_("intervals", "targets") + """, both_ AS (SELECT contig, start, "end" FROM intervals UNION ALL SELECT contig, start, "end" FROM targets),
 o AS (SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM both_),
 r AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT contig, min(start) AS start, max("end") AS "end", count(*) AS members FROM r GROUP BY contig, run""")
def interval_concat_unique(spark, sf):
    part = lambda df: df.select("contig", "start", "end")
    return iv.merge(part(ad.intervals(spark, sf)).unionByName(part(ad.targets(spark, sf))))


@query(with_("intervals", "targets", "contigs") + MERGED + """, gaps AS (
  SELECT contig, coalesce(lag("end") OVER (PARTITION BY contig ORDER BY start), 0) + 1 AS start, start - 1 AS "end" FROM merged
  UNION ALL SELECT contig, max("end") + 1, 3000000 FROM merged GROUP BY contig
  UNION ALL SELECT name, 1, length FROM contigs WHERE name NOT IN (SELECT contig FROM merged)
) SELECT target_id, greatest(t.start, g.start) AS start, least(t."end", g."end") AS "end" FROM targets t JOIN gaps g ON t.contig = g.contig AND t.start <= g."end" AND t."end" >= g.start
WHERE g.start <= g."end" """)
def region_subtract(spark, sf):
    gaps = iv.complement(ad.intervals(spark, sf), ad.contigs(spark, sf))
    pairs = iv.overlap_join(ad.targets(spark, sf), gaps)
    return pairs.select("target_id", F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"))


@query("""SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 3 <> 0 THEN s_name END NULLS FIRST, s_suppkey % 5, s_suppkey) AS place FROM supplier""")
def read_group_sort(spark, sf):
    pu = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    order = W.partitionBy("s_nationkey").orderBy(pu.asc_nulls_first(), F.col("s_suppkey") % 5, "s_suppkey")
    return ad.read(spark, sf, "supplier").select("s_suppkey", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT s_suppkey, 'SQ' AS kind, o AS ord, CASE o WHEN 0 THEN 'SN' ELSE 'LN' END AS key, CASE o WHEN 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS value FROM supplier, (VALUES (0), (1)) v(o)""")
def alignment_header_parse(spark, sf):
    line = F.concat(F.lit("@SQ\tSN:"), F.col("s_name"), F.lit("\tLN:"), F.col("s_suppkey"))
    return tx.header_attributes(ad.read(spark, sf, "supplier").select("s_suppkey", line.alias("value")), keep=["s_suppkey"])


@query("""SELECT s_suppkey, 'INFO' AS kind, 'K' || s_suppkey AS id, '1' AS number, 'String' AS type, s_name || ', with a comma' AS description FROM supplier""")
def variant_header_parse(spark, sf):
    line = F.concat(F.lit("##INFO=<ID=K"), F.col("s_suppkey"), F.lit(',Number=1,Type=String,Description="'), F.col("s_name"), F.lit(', with a comma">'))
    return tx.variant_header_fields(ad.read(spark, sf, "supplier").select("s_suppkey", line.alias("value")), keep=["s_suppkey"])
