"""Queries that rewrite headers of alignment files, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import header_files as hf
from ..sources import files as fl
from . import adapters as ad
from .catalog import query


@query("""SELECT s_suppkey, '@RG' || chr(9) || 'ID:g' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE chr(9) || 'SM:' || CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'x' || s_nationkey END END
 || chr(9) || 'PL:y' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN chr(9) || 'DS:' || s_nationkey ELSE '' END AS line FROM supplier""")
def header_set_fields(spark, sf):
    """A read group a supplier: SM kept, overwritten in place or removed, PL set twice, DS added at the end."""
    k, nation, tab = F.col("s_suppkey"), F.col("s_nationkey"), F.lit("\t")
    rows = ad.read(spark, sf, "supplier")
    lines = rows.select(k, F.lit("f").alias("file"), F.concat(F.lit("@RG\tID:g"), k, F.lit("\tSM:"), "s_name", tab, F.lit("PL:z")).alias("value"))

    def edits(ord_, key, value, when=F.lit(True)):
        return rows.filter(when).select(
            F.lit("f").alias("file"), F.lit("@RG").alias("kind"), F.concat(F.lit("g"), k).alias("name"), F.lit(ord_).alias("ord"), F.lit(key).alias("key"), value.cast("string").alias("value"))

    all_ = edits(1, "SM", F.lit(None), k % 3 == 0).unionByName(edits(1, "SM", F.concat(F.lit("x"), nation), k % 3 == 2)).unionByName(
        edits(4, "PL", F.concat(F.lit("y"), nation))).unionByName(edits(2, "PL", F.lit("w"))).unionByName(edits(3, "DS", nation, k % 2 == 0))
    return hf.edit(lines, all_).select("s_suppkey", F.col("value").alias("line"))


FILES = """WITH b AS (SELECT o_custkey % 25 AS k, 'q' || o_orderkey || chr(9) || o_custkey AS value, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS rn FROM orders),
 h AS (SELECT n_nationkey AS k, unnest(['@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted', '@SQ' || chr(9) || 'SN:c' || n_nationkey || chr(9) || 'LN:1000', '@CO' || chr(9) || 'SO:' || n_nationkey]) AS value,
  unnest([0, 1, 2]) AS line FROM nation)
"""


def _files(spark, sf):
    """A file a nation, with three header lines and a line an order; the nation's key is ``file``."""
    k = F.col("n_nationkey")
    head = F.array(F.lit("@HD\tVN:1.6\tSO:unsorted"), F.concat(F.lit("@SQ\tSN:c"), k, F.lit("\tLN:1000")), F.concat(F.lit("@CO\tSO:"), k))
    heads = ad.read(spark, sf, "nation").select(k.cast("long").alias("k"), F.posexplode(head).alias("at", "value")).select("k", (F.col("at") - 3).cast("long").alias("o"), "value")
    body = ad.read(spark, sf, "orders").select((F.col("o_custkey") % 25).cast("long").alias("k"), F.col("o_orderkey").alias("o"), F.concat(F.lit("q"), "o_orderkey", F.lit("\t"), "o_custkey").alias("value"))
    path = fl.scratch_path(spark, "sam")
    heads.unionByName(body).repartition("k").sortWithinPartitions("k", "o").select("k", "value").write.partitionBy("k").text(path)
    return fl.numbered_lines(spark, path).withColumn("file", F.regexp_extract("file", "/k=([0-9]+)/", 1).cast("long"))


@query(FILES + """SELECT k, CAST(line AS BIGINT) AS line, CASE WHEN line = 0 AND k % 2 = 0 THEN replace(value, 'unsorted', 'coordinate') ELSE value END AS value FROM h
UNION ALL SELECT k, 3, '@CO' || chr(9) || 'edited' FROM h WHERE line = 0 AND k % 2 = 0
UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN rn + 3 ELSE rn + 2 END, value FROM b""")
def reheader_files(spark, sf):
    """Files of even nations get an edited header with one more line; no body line changes."""
    numbered = _files(spark, sf)
    header = hf.split_header(numbered)[0].filter(F.col("file") % 2 == 0)
    edited = header.withColumn("value", F.when(F.col("value").startswith("@HD"), hf.set_field(F.col("value"), "SO", "coordinate")).otherwise(F.col("value")))
    more = edited.groupBy("file").agg((F.max("line") + 1).alias("line")).withColumn("value", F.lit("@CO\tedited"))
    return hf.reheader(numbered, edited.unionByName(more)).withColumnRenamed("file", "k")


@query(FILES + """SELECT CAST(line AS BIGINT) AS line, value FROM h WHERE k = 24 UNION ALL SELECT row_number() OVER (ORDER BY k DESC, rn) + 2, value FROM b""")
def gather_files(spark, sf):
    """All files as one, the last nation's first: its header, then every body."""
    return hf.gather(_files(spark, sf), -F.col("file"))
