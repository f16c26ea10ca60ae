"""The engine's queries over the supplied tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import alignment as al, numeric as nu, sequence as sq
from ..operators import genotypes as gt, headers as hd, histogram as hs, indexes as ix, intervals as iv, liftover as lo, pairs as pr
from . import adapters as ad
from .adapters import with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return keep


MERGED = """, ordered AS (
  SELECT *, max("end") OVER (PARTITION BY contig ORDER BY start, "end", negative, name NULLS FIRST, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals
), flagged AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY contig ORDER BY start, "end", negative, name NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS island,
    row_number() OVER (PARTITION BY contig ORDER BY start, "end", negative, name NULLS FIRST, event_id) AS rn FROM ordered
), merged AS (
  SELECT contig, min(start) AS start, max("end") AS "end", count(*) AS members, arg_min(negative, rn) AS negative,
    coalesce(string_agg(name, '|' ORDER BY rn), '') AS names FROM flagged GROUP BY contig, island
)
"""
OVERLAP = 'i.contig = t.contig AND i.start <= t."end" AND i."end" >= t.start'
SPAN = ["event_id", "contig", "start", "end"]


@query(with_("intervals", "targets") + MERGED + """
SELECT i.contig AS contig, count(*) AS n_pairs, CAST(sum(least(i."end", t."end") - greatest(i.start, t.start) + 1) AS BIGINT) AS overlap_bases
FROM merged i JOIN targets t ON """ + OVERLAP + " GROUP BY i.contig")
def overlap_count_by_contig(spark: SparkSession, sf: str) -> DataFrame:
    pairs = iv.overlap_join(iv.merge(ad.intervals(spark, sf)), ad.targets(spark, sf))
    bases = F.least("end", "end_r") - F.greatest("start", "start_r") + 1
    return pairs.groupBy("contig").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(bases).alias("overlap_bases"))


@query(with_("intervals", "contigs") + """
SELECT event_id, row_number() OVER (PARTITION BY i.contig ORDER BY coalesce(c.idx, -1), start, "end", negative, i.name NULLS FIRST, event_id) AS rank_in_contig
FROM intervals i LEFT JOIN contigs c ON i.contig = c.name""")
def interval_sort_rank(spark, sf):
    d = ad.contigs(spark, sf).select(F.col("name").alias("contig"), "idx")
    rows = ad.intervals(spark, sf).join(d, "contig", "left")  # one contig has one idx, so it orders contigs only
    order = [F.col("start"), F.col("end"), F.col("negative"), F.col("name").asc_nulls_first(), F.col("event_id")]
    return iv.rank_in_group(rows, "contig", F.col("start"), order, "rank_in_contig").select("event_id", "rank_in_contig")


@query(with_("intervals") + """
SELECT event_id, contig, row_number() OVER (PARTITION BY contig ORDER BY start, "end", negative, name NULLS FIRST, event_id) AS rank_in_contig FROM intervals""")
def interval_natural_rank(spark, sf):
    order = [F.col("start"), F.col("end"), F.col("negative"), F.col("name").asc_nulls_first(), F.col("event_id")]
    return iv.rank_in_group(ad.intervals(spark, sf), "contig", F.col("start"), order, "rank_in_contig").select("event_id", "contig", "rank_in_contig")


@query(with_("intervals") + MERGED + 'SELECT contig, start, "end", members FROM merged')
def interval_merge(spark, sf):
    return iv.merge(ad.intervals(spark, sf))


@query(with_("intervals") + MERGED + "SELECT contig, start, \"end\", negative, md5(names) AS names_md5 FROM merged")
def interval_merge_names(spark, sf):
    return iv.merge_named(ad.intervals(spark, sf), "event_id").select("contig", "start", "end", "negative", F.md5(F.col("names").cast("binary")).alias("names_md5"))


@query(with_("intervals", "contigs") + MERGED + """, gaps AS (
  SELECT contig, coalesce(lag("end") OVER (PARTITION BY contig ORDER BY start), 0) + 1 AS start, start - 1 AS "end" FROM merged
  UNION ALL SELECT contig, max("end") + 1, (SELECT max(length) FROM contigs) FROM merged GROUP BY contig
  UNION ALL SELECT name, 1, length FROM contigs WHERE name NOT IN (SELECT contig FROM merged)
) SELECT g.contig, g.start, g."end" FROM gaps g JOIN contigs c ON c.name = g.contig WHERE g.start <= g."end" """)
def interval_invert(spark, sf):
    return iv.complement(ad.intervals(spark, sf), ad.contigs(spark, sf))


@query(with_("intervals", "contigs") + """
SELECT event_id, contig, greatest(start - 5000, 1) AS start, least("end" + 700, length) AS "end"
FROM intervals i JOIN contigs c ON i.contig = c.name WHERE greatest(start - 5000, 1) <= least("end" + 700, length)""")
def interval_pad_clamp(spark, sf):
    return iv.pad_and_clamp(ad.intervals(spark, sf), ad.contigs(spark, sf), 5000, 700).select("event_id", "contig", "start", "end")


@query(with_("intervals") + """, b AS (SELECT *, start // 100 AS b0, "end" // 100 AS b1 FROM intervals), x AS (SELECT *, unnest(range(b0, b1 + 1)) AS k FROM b)
SELECT event_id, greatest(start, k * 100) AS start, least("end", k * 100 + 99) AS "end",
  CASE WHEN b0 < b1 THEN coalesce(name, 'null') || '.' || (k - b0 + 1) ELSE name END AS name FROM x""")
def interval_band_split(spark, sf):
    return iv.split_bands(ad.intervals(spark, sf), 100).select("event_id", "start", "end", "name")


@query(with_("intervals", "targets") + """
SELECT event_id, target_id, greatest(i.start, t.start) AS start, least(i."end", t."end") AS "end", i.negative AS negative,
  coalesce(i.name, 'null') || ' intersection ' || ('t' || t.target_id) AS name
FROM intervals i JOIN targets t ON """ + OVERLAP)
def interval_intersect(spark, sf):
    named = ad.targets(spark, sf).withColumn("name", F.concat(F.lit("t"), F.col("target_id")))
    return iv.intersect(ad.intervals(spark, sf), named).select(
        "event_id", F.col("target_id_r").alias("target_id"), F.col("from").alias("start"), F.col("to").alias("end"), "negative", F.col("both").alias("name"))


@query(with_("intervals", "targets") + """
SELECT event_id, target_id FROM intervals i JOIN targets t ON i.contig = t.contig AND i.start - 3 <= t."end" AND i."end" + 3 >= t.start""")
def interval_within_distance(spark, sf):
    return iv.within_distance(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf), 3).select("event_id", F.col("target_id_r").alias("target_id"))


@query(with_("intervals", "targets") + "SELECT event_id, target_id FROM intervals i JOIN targets t ON " + OVERLAP)
def overlap_join(spark, sf):
    return iv.overlap_join(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf)).select("event_id", F.col("target_id_r").alias("target_id"))


@query(with_("intervals", "targets") + """
SELECT event_id, target_id FROM intervals i JOIN targets t ON i.contig = t.contig AND i.start + 2 <= t."end" - 1 AND i."end" - 2 >= t.start + 1
WHERE i.start + 2 <= i."end" - 2 AND t.start + 1 <= t."end" - 1""")
def overlap_join_buffered(spark, sf):
    return iv.overlap_join(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf), 2, 1).select("event_id", F.col("target_id_r").alias("target_id"))


@query(with_("intervals", "targets") + "SELECT event_id, target_id FROM intervals i JOIN targets t ON " + OVERLAP)
def overlap_join_binned(spark, sf):
    return iv.overlap_join(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf), bin_width=256).select("event_id", F.col("target_id_r").alias("target_id"))


@query(with_("intervals", "targets") + "SELECT event_id FROM intervals i WHERE EXISTS (SELECT 1 FROM targets t WHERE " + OVERLAP + ")")
def overlap_semi(spark, sf):
    return iv.overlap_join(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf), how="left_semi").select("event_id")


@query(with_("intervals", "targets") + "SELECT event_id FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE " + OVERLAP + ")")
def overlap_anti(spark, sf):
    return iv.overlap_join(ad.intervals(spark, sf).select(*SPAN), ad.targets(spark, sf), how="left_anti").select("event_id")


def chain_blocks(spark, sf):
    """Two blocks of one chain per contig with a gap; every fifth contig has a second chain, every third is reversed."""
    c = ad.contigs(spark, sf)
    block = lambda chain, a, b, shift, no: c.select(
        (F.col("idx") * 10 + chain).alias("chain_id"), F.col("name").alias("contig"), F.lit(a).alias("from_start"), F.lit(b).alias("from_end"),
        F.concat(F.lit("t"), F.col("idx")).alias("to_contig"), F.lit(a + shift).alias("to_start"), F.lit(200000).alias("to_size"),
        (F.col("idx") % 3 == 0).alias("opposite"), F.lit(no).alias("block"))
    one = block(1, 0, 20000, 1000, 0).unionByName(block(1, 20005, 40000, 1010, 1))
    return one.unionByName(block(2, 10000, 15000, 7, 0).filter("contig in ('c0', 'c5', 'c10', 'c15', 'c20')"))


LIFT = with_("intervals", "contigs") + """, blocks AS (
  SELECT idx * 10 + 1 AS chain, name AS contig, idx, 0 AS a, 20000 AS b, 1000 AS t FROM contigs
  UNION ALL SELECT idx * 10 + 1, name, idx, 20005, 40000, 21015 FROM contigs
  UNION ALL SELECT idx * 10 + 2, name, idx, 10000, 15000, 10007 FROM contigs WHERE idx % 5 = 0
), hits AS (
  SELECT event_id, chain, idx, i."end" - i.start + 1 AS size, least(i."end", b) - greatest(i.start, a + 1) + 1 AS bases,
    t + greatest(i.start, a + 1) - (a + 1) AS t0, t + least(i."end", b) - a AS t1
  FROM intervals i JOIN blocks k ON i.contig = k.contig AND i.start <= b AND i."end" >= a + 1
), chains AS (
  SELECT event_id, chain, idx, size, sum(bases) AS bases, min(t0) AS t0, max(t1) AS t1 FROM hits GROUP BY ALL HAVING sum(bases) >= 0.95 * size
), lifted AS (SELECT event_id, any_value(idx) AS idx, any_value(t0) AS t0, any_value(t1) AS t1 FROM chains GROUP BY event_id HAVING count(*) = 1)
"""


@query(LIFT + """SELECT event_id, 't' || idx AS lifted_contig, CASE WHEN idx % 3 = 0 THEN 200000 - t1 + 1 ELSE t0 + 1 END AS lifted_start,
  CASE WHEN idx % 3 = 0 THEN 200000 - t0 ELSE t1 END AS lifted_end FROM lifted""")
def liftover_unique(spark, sf):
    lifted = lo.lift(ad.intervals(spark, sf), "event_id", chain_blocks(spark, sf))
    return lifted.filter("lifted_contig is not null").select("event_id", "lifted_contig", "lifted_start", "lifted_end")


@query(LIFT + "SELECT event_id FROM intervals WHERE event_id NOT IN (SELECT event_id FROM lifted)")
def liftover_failed(spark, sf):
    return lo.lift(ad.intervals(spark, sf), "event_id", chain_blocks(spark, sf)).filter("lifted_contig is null").select("event_id")


@query(with_("alignments") + """SELECT ref_index, count(*) FILTER (flags & 16 <> 0) AS reverse, count(*) FILTER (flags & 64 <> 0) AS first,
  count(*) FILTER (flags & 2048 <> 0) AS supplementary, count(*) FILTER (flags & 4 <> 0) AS unmapped FROM alignments GROUP BY ref_index""")
def flag_predicates(spark, sf):
    n = lambda bit: F.count_if(al.has_flag(F.col("flags"), bit))
    return ad.alignments(spark, sf).groupBy("ref_index").agg(
        n(al.REVERSE).alias("reverse"), n(al.FIRST).alias("first"), n(al.SUPPLEMENTARY).alias("supplementary"), n(al.UNMAPPED).alias("unmapped"))


ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
IDS = ID.split(", ")


@query(with_("alignments") + f"SELECT {ID}, CASE WHEN flags & 4 <> 0 THEN 0 ELSE pos + m1 + 12 - 1 END AS alignment_end FROM alignments")
def alignment_end(spark, sf):
    return ad.alignments(spark, sf).select(*IDS, al.alignment_end(F.col("flags"), F.col("pos"), F.col("cigar")).cast("long").alias("alignment_end"))


@query(with_("alignments") + f"SELECT {ID}, clip + m1 + 10 AS read_length FROM alignments")
def read_length(spark, sf):
    return ad.alignments(spark, sf).select(*IDS, al.read_length(F.col("cigar")).alias("read_length"))


@query(with_("alignments") + f"SELECT {ID}, CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || m1 || 'M2D10M' AS cigar FROM alignments")
def cigar_render(spark, sf):
    return ad.alignments(spark, sf).select(*IDS, al.render_cigar(F.col("cigar")).alias("cigar"))


@query(with_("alignments") + f"SELECT {ID}, CASE WHEN clip > 0 THEN 4 ELSE 3 END AS elements, true AS same FROM alignments")
def cigar_parse_roundtrip(spark, sf):
    parsed = al.parse_cigar(al.render_cigar(F.col("cigar")))
    return ad.alignments(spark, sf).select(*IDS, F.size(parsed).alias("elements"), (parsed == F.col("cigar")).alias("same"))


@query(with_("alignments") + f"""SELECT {ID}, k.no AS block, clip + CASE k.no WHEN 0 THEN 1 ELSE 1 + m1 END AS read_start,
  pos + CASE k.no WHEN 0 THEN 0 ELSE m1 + 2 END AS ref_start, CASE k.no WHEN 0 THEN m1 ELSE 10 END AS len
  FROM alignments, (VALUES (0), (1)) k(no)""")
def alignment_blocks(spark, sf):
    found = ad.alignments(spark, sf).select(*IDS, F.posexplode(al.alignment_blocks(F.col("pos"), F.col("cigar"))).alias("block", "b"))
    return found.select(*IDS, "block", "b.read_start", "b.ref_start", "b.len")


@query(with_("alignments") + f"""SELECT {ID}, (clip + 25 - CASE WHEN clip > 0 THEN clip ELSE 0 END) - 1 - clip + CASE WHEN clip > 0 THEN clip ELSE 0 END AS matched,
  clip + m1 + 10 AS read_length FROM alignments""")
def soft_clip_end(spark, sf):
    rows = ad.alignments(spark, sf).withColumn("clipped", al.soft_clip_from(F.col("cigar"), F.lit(25)))
    matched = F.aggregate(F.filter("clipped", lambda x: x["op"] == "M"), F.lit(0), lambda a, x: a + x["len"])
    lead = F.when(F.col("cigar")[0]["op"] == "S", F.col("cigar")[0]["len"]).otherwise(0)
    return rows.select(*IDS, (matched + lead).alias("matched"), al.read_length(F.col("clipped")).alias("read_length"))


@query(with_("alignments") + f"""SELECT {ID}, CASE
  WHEN s >> 14 = e >> 14 THEN 4681 + (s >> 14) WHEN s >> 17 = e >> 17 THEN 585 + (s >> 17) WHEN s >> 20 = e >> 20 THEN 73 + (s >> 20)
  WHEN s >> 23 = e >> 23 THEN 9 + (s >> 23) WHEN s >> 26 = e >> 26 THEN 1 + (s >> 26) ELSE 0 END AS bin
  FROM (SELECT *, pos - 1 AS s, greatest(pos + m1 + 12 - 1, pos) - 1 AS e FROM alignments)""")
def region_to_bin(spark, sf):
    a = ad.alignments(spark, sf)
    end = F.col("pos") + al.reference_length(F.col("cigar")) - 1
    return a.select(*IDS, al.region_bin(F.col("pos") - 1, end).cast("long").alias("bin"))


@query(with_("alignments") + "SELECT ref_index, (pos - 1) >> 14 AS win, count(*) AS n FROM alignments GROUP BY ALL")
def linear_window(spark, sf):
    return ad.alignments(spark, sf).groupBy("ref_index", al.linear_window(F.col("pos")).alias("win")).agg(F.count(F.lit(1)).alias("n"))


@query(with_("alignments") + """SELECT ref_index, count(*) FILTER (flags & 4 = 0) AS aligned, count(*) FILTER (flags & 4 <> 0) AS unaligned,
  min(pos) AS first_pos, max(pos) AS last_pos FROM alignments GROUP BY ref_index""")
def bin_index_summary(spark, sf):
    return ix.reference_counts(ad.alignments(spark, sf))


@query(with_("alignments") + """, w AS (SELECT ref_index, (pos - 1) >> 14 AS win, min(l_orderkey) AS o FROM alignments WHERE ref_index >= 0 GROUP BY ALL),
  s AS (SELECT ref_index, unnest(range(0, max(win) + 1)) AS win FROM w GROUP BY ref_index)
SELECT ref_index, win, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY ref_index ORDER BY win ROWS UNBOUNDED PRECEDING), 0) AS "offset"
FROM s LEFT JOIN w USING (ref_index, win)""")
def linear_index_backfill(spark, sf):
    return ix.linear_index(ad.alignments(spark, sf).withColumn("offset", F.col("l_orderkey"))).withColumnRenamed("window", "win")


CHUNKS = """, chunks AS (SELECT l_suppkey % 7 AS g, l_orderkey * 70001 AS start, l_orderkey * 70001 + l_partkey AS "end" FROM lineitem),
  o AS (SELECT *, (start >> 16) - (lag("end") OVER (PARTITION BY g ORDER BY start, "end") >> 16) AS gap FROM chunks),
  r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT g, min(start) AS start, max("end") AS "end", count(*) AS chunks FROM r GROUP BY g, run"""


@query(with_("contigs") + CHUNKS)
def chunk_coalesce(spark, sf):
    start = F.col("l_orderkey") * 70001
    chunks = ad.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("g"), start.alias("start"), (start + F.col("l_partkey")).alias("end"))
    return ix.coalesce_chunks(chunks, ["g"])


@query(with_("alignments") + f"""SELECT {ID}, row_number() OVER (PARTITION BY ref_index ORDER BY ref_index < 0, ref_index, CASE WHEN ref_index >= 0 THEN pos END,
  flags & 16 <> 0, read_name, flags, mapq, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place FROM alignments""")
def coordinate_sort_rank(spark, sf):
    place = F.when(F.col("ref_index") >= 0, F.col("pos"))
    return iv.rank_in_group(ad.alignments(spark, sf), "ref_index", place, [*al.coordinate_keys(), *map(F.col, ad.KEY)], "place").select(*IDS, "place")


@query(with_("alignments") + f"""SELECT {ID}, row_number() OVER (PARTITION BY read_name ORDER BY flags & 1 = 0, flags & 64 = 0, flags & 16 <> 0, flags & 256 <> 0,
  flags & 2048 <> 0, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place FROM alignments""")
def queryname_sort_rank(spark, sf):
    order = W.partitionBy("read_name").orderBy(*al.queryname_keys()[1:], *ad.KEY)
    return ad.alignments(spark, sf).select(*IDS, F.row_number().over(order).cast("long").alias("place"))


MATES = with_("alignments") + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY read_name, flags & 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM alignments
), p AS (
  SELECT a.read_name, a.flags AS f1, b.flags AS f2, a.ref_index AS r1, b.ref_index AS r2, a.pos AS p1, b.pos AS p2, a.mapq AS q1, b.mapq AS q2,
    CASE WHEN a.flags & 16 <> 0 THEN CASE WHEN a.flags & 4 <> 0 THEN 0 ELSE a.pos + a.m1 + 11 END ELSE a.pos END AS e1,
    CASE WHEN b.flags & 16 <> 0 THEN CASE WHEN b.flags & 4 <> 0 THEN 0 ELSE b.pos + b.m1 + 11 END ELSE b.pos END AS e2
  FROM ranked a JOIN ranked b ON a.read_name = b.read_name AND a.flags & 64 <> 0 AND b.flags & 64 = 0 AND a.rn = 1 AND b.rn = 1
), t AS (SELECT *, CASE WHEN f1 & 4 <> 0 OR f2 & 4 <> 0 OR r1 <> r2 THEN 0 ELSE e2 - e1 + CASE WHEN e2 >= e1 THEN 1 ELSE -1 END END AS tlen FROM p)
"""


@query(MATES + "SELECT read_name, tlen FROM t")
def insert_size(spark, sf):
    return pr.mates(ad.alignments(spark, sf), ad.KEY).select("read_name", pr.insert_size(F.col("r1"), F.col("r2")).alias("tlen"))


CIGAR_1, CIGAR_2 = (f"CASE WHEN {r}.clip > 0 THEN {r}.clip || 'S' ELSE '' END || {r}.m1 || 'M2D10M'" for r in "ab")


def _mate_sql(me: int, other: int, size: str) -> str:
    """The fields of one read of a pair after it was told of its mate."""
    mine, theirs = f"f{me} & 4 <> 0", f"f{other} & 4 <> 0"
    return f"""CAST((f{me} & ~40) + CASE WHEN f{other} & 16 <> 0 THEN 32 ELSE 0 END + CASE WHEN {theirs} THEN 8 ELSE 0 END AS INTEGER) AS r{me}_flags,
  CASE WHEN {mine} AND {theirs} THEN -1 WHEN {mine} THEN r{other} ELSE r{me} END AS r{me}_ref, CASE WHEN {mine} AND {theirs} THEN 0 WHEN {mine} THEN p{other} ELSE p{me} END AS r{me}_pos,
  CASE WHEN {mine} AND {theirs} THEN -1 WHEN {theirs} THEN r{me} ELSE r{other} END AS r{me}_mate_ref,
  CASE WHEN {mine} AND {theirs} THEN 0 WHEN {theirs} THEN p{me} ELSE p{other} END AS r{me}_mate_pos,
  f{other} & 16 <> 0 AS r{me}_mate_reverse, {theirs} AS r{me}_mate_unmapped, {size} AS r{me}_tlen,
  CASE WHEN f{other} & 4 = 0 THEN q{other} END AS r{me}_mq, CASE WHEN f{other} & 4 = 0 THEN c{other} END AS r{me}_mc"""


@query(MATES.replace("b.mapq AS q2,", f"b.mapq AS q2, {CIGAR_1} AS c1, {CIGAR_2} AS c2,") + f"SELECT read_name, {_mate_sql(1, 2, 'tlen')}, {_mate_sql(2, 1, '-tlen')} FROM t")
def set_mate_info(spark, sf):
    return pr.mate_fields(pr.mates(ad.alignments(spark, sf), ad.KEY, cigars=True))
