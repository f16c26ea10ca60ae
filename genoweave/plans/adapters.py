"""Genomic record kinds derived from the supplied tables, as DataFrames and as SQL twins.

Each adapter returns a DataFrame; ``SQL`` holds the same definition as a common
table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CONTIG_LENGTH = 3_000_000
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
BASES = ("ACGT" * 14)[: len(LETTERS)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark, sf_dir):
    """idx, name, length of the sequence dictionary."""
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("idx"), F.concat(F.lit("c"), F.col("n_nationkey")).alias("name"), F.lit(CONTIG_LENGTH).cast("long").alias("length"))


def intervals(spark, sf_dir):
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01', ts)")
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("c"), F.col("user_id") % 25).alias("contig"), (minute + 1).alias("start"),
        (minute + 1 + F.floor("value")).alias("end"), (F.col("event_id") % 3 == 0).alias("negative"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("name"))


def targets(spark, sf_dir):
    start = F.col("o_orderkey") % 43200 + 1
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("target_id"), F.concat(F.lit("c"), F.col("o_custkey") % 25).alias("contig"), start.alias("start"),
        (start + F.col("o_custkey") % 200).alias("end"))


def alignments(spark, sf_dir):
    line, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    unmapped = (F.col("l_linestatus") == "O") & (qty <= 2)
    part = lambda n, op: F.struct(n.cast("int").alias("len"), F.lit(op).alias("op"))
    cigar = F.filter(F.array(part(line - 1, "S"), part(qty + 20, "M"), part(F.lit(2), "D"), part(F.lit(10), "M")), lambda x: x["len"] > 0)
    flags = (1 + F.when(line % 2 == 1, 64).otherwise(128) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
             + F.when(unmapped, 4).otherwise(0) + F.when(line > 4, 2048).otherwise(0))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        F.concat(F.lit("q"), F.col("l_orderkey")).alias("read_name"), flags.alias("flags"),
        F.when(unmapped, -1).otherwise((F.col("l_suppkey") % 25).cast("int")).alias("ref_index"),
        F.expr("datediff(l_shipdate, date'1995-01-01') * 1000L + l_partkey % 1000 + 1").alias("pos"), qty.alias("mapq"), cigar.alias("cigar"))


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def genotypes(spark, sf_dir):
    """One row per site and sample: allele indexes (null is a no-call), filtered or not."""
    kind = F.col("o_orderkey") % 5
    alleles = (F.when(kind == 0, F.array(F.lit(0), F.lit(0))).when(kind == 1, F.array(F.lit(0), F.lit(1)))
               .when(kind == 2, F.array(F.lit(1), F.lit(1))).when(kind == 3, F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))
               .otherwise(F.array(F.lit(None).cast("int"), F.lit(1))))
    return read(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 997).alias("site"), F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("sample"), "o_orderkey",
        alleles.alias("alleles"), (F.col("o_orderstatus") == "P").alias("filtered"))


def reads(spark, sf_dir):
    """Bases made of the whole text of each document."""
    text = F.coalesce("text", F.lit(""))
    bases = F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "N")
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang"), bases.alias("bases"))


SQL = {
    "contigs": "contigs AS (SELECT n_nationkey AS idx, 'c' || n_nationkey AS name, CAST(3000000 AS BIGINT) AS length FROM nation)",
    "intervals": """intervals AS (
      SELECT event_id, 'c' || (user_id % 25) AS contig, m + 1 AS start, m + 1 + CAST(floor(value) AS BIGINT) AS "end",
             event_id % 3 = 0 AS negative, CASE WHEN event_id % 11 <> 0 THEN event_type END AS name
      FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS m FROM events))""",
    "targets": """targets AS (
      SELECT o_orderkey AS target_id, 'c' || (o_custkey % 25) AS contig, o_orderkey % 43200 + 1 AS start,
             o_orderkey % 43200 + 1 + o_custkey % 200 AS "end" FROM orders)""",
    "alignments": """alignments AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, 'q' || l_orderkey AS read_name,
        1 + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
          + CASE WHEN l_linestatus = 'O' AND l_quantity <= 2 THEN 4 ELSE 0 END + CASE WHEN l_linenumber > 4 THEN 2048 ELSE 0 END AS flags,
        CASE WHEN l_linestatus = 'O' AND l_quantity <= 2 THEN -1 ELSE CAST(l_suppkey % 25 AS INTEGER) END AS ref_index,
        datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000 + l_partkey % 1000 + 1 AS pos,
        CAST(l_quantity AS INTEGER) AS mapq, l_linenumber - 1 AS clip, CAST(l_quantity AS INTEGER) + 20 AS m1
      FROM lineitem)""",
    "genotypes": """genotypes AS (
      SELECT o_orderkey % 997 AS site, 's' || (o_custkey % 20) AS sample, o_orderkey,
        CASE o_orderkey % 5 WHEN 0 THEN [0, 0] WHEN 1 THEN [0, 1] WHEN 2 THEN [1, 1] WHEN 3 THEN [NULL, NULL] ELSE [NULL, 1] END AS alleles,
        o_orderstatus = 'P' AS filtered
      FROM orders)""",
    "reads": f"""reads AS (
      SELECT doc_id, source, lang, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS bases
      FROM documents)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
