"""Queries over stored and indexed features, sorted files, stringency and numbers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nu, variant as va
from ..operators import feature_index as fi, histogram as hs
from ..sources import files as fl, sinks as sk, text as tx
from . import adapters as ad
from .adapters import with_
from .catalog import query


@query(with_("intervals") + """, r AS (SELECT n_nationkey, 'c' || n_nationkey AS contig, 1000 * n_nationkey + 1 AS start, 1000 * n_nationkey + 2001 + 100 * n_nationkey AS "end" FROM nation)
SELECT n_nationkey, count(*) AS features, CAST(sum(i.start) AS BIGINT) AS start_sum FROM r JOIN intervals i ON r.contig = i.contig AND i.start <= r."end" AND i."end" >= r.start GROUP BY n_nationkey""")
def feature_index_query(spark, sf):
    """Features of regions, read through a stored index: only the blocks that regions reach."""
    path = fl.scratch_path(spark, "features")
    fi.write_indexed(ad.intervals(spark, sf), path, 64, 500)
    k = F.col("n_nationkey")
    start = (k * 1000 + 1).cast("long")
    regions = ad.read(spark, sf, "nation").select(k, F.concat(F.lit("c"), k).alias("contig"), start.alias("start"), (start + 2000 + k * 100).alias("end"))
    return fi.read_regions(spark, path, regions, skip_unknown=True).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("features"), F.sum("start_f").alias("start_sum"))


@query(with_("alignments") + """SELECT row_number() OVER (ORDER BY ref_index < 0, ref_index, pos, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS line,
 read_name || chr(9) || flags || chr(9) || ref_index || chr(9) || pos || chr(9) || l_linenumber || chr(9) || l_partkey || chr(9) || l_suppkey AS value FROM alignments""")
def sorted_sink(spark, sf):
    """Alignments written in coordinate order, in parts, and read back in the order of the parts."""
    rows = ad.alignments(spark, sf).withColumn("text", F.concat_ws("\t", "read_name", "flags", "ref_index", "pos", "l_linenumber", "l_partkey", "l_suppkey"))
    path = fl.scratch_path(spark, "sorted")
    names = ad.contigs(spark, sf).select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), "length").alias("line"), "idx")
    sk.write_sorted(rows, "text", [F.col("ref_index") < 0, "ref_index", "pos", *ad.KEY], path, 16, names, sk.alignment_header_order(F.col("line"), F.col("idx")))
    return sk.read_sorted(spark, path)


@query("""WITH e AS (SELECT event_id % 5 AS k, count(*) AS n FROM events GROUP BY 1)
SELECT 'lenient' AS mode, CASE WHEN k IN (1, 4) THEN 'number' WHEN k = 2 THEN 'cigar' WHEN k = 3 THEN 'fields' ELSE 'none' END AS outcome, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL
UNION ALL SELECT mode, 'none', CAST(sum(n) AS BIGINT) FROM e, (SELECT unnest(['silent', 'strict']) AS mode) WHERE k = 0 GROUP BY ALL""")
def stringency_modes(spark, sf):
    """Alignment lines at the three stringencies: bad ones apart, only counted, or an error (here there is none left)."""
    tail = F.concat(F.lit("\t*\t0\t0\t"), F.repeat(F.lit("A"), (F.col("user_id") % 9 + 1).cast("int")), F.lit("\t*"))
    k = F.col("event_id") % 5
    text = F.concat(F.lit("q"), "event_id", F.when(k == 1, "\tx\tc1\t7").when(k == 4, "\t16\tc1\t7.5").otherwise("\t16\tc1\t7"), F.lit("\t60\t"), F.when(k == 2, "5MM").otherwise("5M"), tail)
    lines = ad.read(spark, sf, "events").select(F.when(k == 3, F.concat(F.lit("q"), "event_id")).otherwise(text).alias("value"))
    parsed = tx.sam(lines)
    lenient, silent = sk.at_stringency(parsed, "lenient"), sk.at_stringency(parsed, "silent")
    strict = sk.at_stringency(tx.sam(lines.filter(F.col("value").rlike("\t16\tc1\t7\t60\t5M\t"))), "strict", shown="read_name")
    counted = lambda rows, mode, outcome: rows.groupBy(F.lit(mode).alias("mode"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("none")
    return (counted(lenient.rows, "lenient", none).unionByName(counted(lenient.refused, "lenient", F.col("error")))
            .unionByName(counted(silent.rows, "silent", none)).unionByName(counted(strict.rows, "strict", none)))


@query("""WITH v AS (SELECT event_id, event_id % 3 AS k, CAST(CASE event_id % 3 WHEN 0 THEN (2 * event_id + 1) * 78125 // 10 WHEN 1 THEN event_id * 10 ELSE user_id * 1000000 END AS BIGINT) AS n FROM events)
SELECT event_id, CASE WHEN k = 1 THEN '-' ELSE '' END || (n // 1000000) || CASE WHEN n % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(n % 1000000 AS VARCHAR), 6, '0'), '0') END AS text FROM v""")
def metric_rounding(spark, sf):
    """Values that lie exactly between two decimals of six places go down, shorter ones stay as they are."""
    k, e = F.col("event_id") % 3, F.col("event_id")
    value = F.when(k == 0, (2 * e + 1) / 128.0).when(k == 1, -e / 100000.0).otherwise(F.col("user_id").cast("double"))
    return ad.read(spark, sf, "events").select("event_id", nu.metric_text(value).alias("text"))


@query("""WITH v AS (SELECT p_partkey, p_size + p_partkey % 400 AS n, (p_partkey % 19 + 1) / 20.0::DOUBLE AS p FROM part), x AS (SELECT *, n * (p_partkey % 7) // 6 AS x FROM v)
SELECT p_partkey, round(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p) + (n - x) * ln(1 - p), 6) AS log_p FROM x""")
def binomial_logp(spark, sf):
    n, p = F.col("p_size") + F.col("p_partkey") % 400, (F.col("p_partkey") % 19 + 1) / 20.0
    x = F.expr("(p_size + p_partkey % 400) * (p_partkey % 7) div 6")
    return ad.read(spark, sf, "part").select("p_partkey", F.round(nu.binomial_log(x, n, p, 1.0 - p), 6).alias("log_p"))


@query("""SELECT user_id % 7 AS grp, CASE WHEN event_id % 4 = 0 THEN '-0.0' WHEN event_id % 4 = 1 THEN '0.0' ELSE CAST(CAST(floor(value / 10) AS BIGINT) + 1 AS VARCHAR) || '.0' END AS bin, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL""")
def hist_signed_zero(spark, sf):
    k = F.col("event_id") % 4
    bins = F.when(k == 0, F.lit(-0.0)).when(k == 1, F.lit(0.0)).otherwise(F.floor(F.col("value") / 10) + 1.0)
    rows = ad.read(spark, sf, "events").select((F.col("user_id") % 7).alias("g"), bins.alias("b"))
    return hs.build(rows, "g", "b").select("grp", F.col("bin").cast("string").alias("bin"), "value")


@query("""WITH o AS (SELECT o_custkey AS site, o_orderkey, o_orderkey % 3 AS kind, o_orderkey % 90 AS v FROM orders),
 w AS (SELECT *, bool_or(kind = 1) OVER (PARTITION BY site ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o),
 p AS (SELECT site, o_orderkey, CASE WHEN kind = 1 THEN v || ',0' WHEN kind = 0 AND NOT coalesce(seen, false) THEN '0,' || v * 10 ELSE '.' END AS pl FROM w)
SELECT site, array_to_string(list(pl ORDER BY o_orderkey), ';') AS pl FROM p GROUP BY site""")
def likelihoods_in_record_order(spark, sf):
    """Samples with PL, with GL and with neither, by the order of the record: GL counts only before the first PL."""
    k, v = F.col("o_orderkey") % 3, F.col("o_orderkey") % 90
    own = F.struct("o_orderkey", F.when(k == 1, F.array(v.cast("int"), F.lit(0))).alias("pl"), F.when(k == 0, F.array(F.lit(-1.0), -1.0 - v)).alias("gl"))
    sites = ad.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.array_sort(F.collect_list(own)).alias("s"))
    text = F.transform(va.record_likelihoods(F.col("s")), lambda p: F.coalesce(F.array_join(p.cast("array<string>"), ","), F.lit(".")))
    return sites.select("site", F.array_join(text, ";").alias("pl"))
