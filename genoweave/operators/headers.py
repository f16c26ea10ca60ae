"""Header lines as rows: dedupe, merge and read-group checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def dedupe(lines: DataFrame) -> DataFrame:
    """The first line (by ``ord``) of each kind and id."""
    first = W.partitionBy("kind", "id").orderBy("ord")
    return lines.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def merge(lines: DataFrame) -> DataFrame:
    """Lines of several sources merged by kind and id.

    The first description stays. Differing numbers become ``.``; Integer and
    Float together keep the first; other differing types mark a conflict.
    """
    g = lines.groupBy("kind", "id").agg(
        F.min_by("description", "ord").alias("description"), F.min_by("type", "ord").alias("type"), F.min_by("number", "ord").alias("number_"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.min("type").alias("t0"), F.max("type").alias("t1"))
    conflict = (F.col("t0") != F.col("t1")) & ~((F.col("t0") == "Float") & (F.col("t1") == "Integer"))
    return g.select("kind", "id", F.when(F.col("low") != F.col("high"), ".").otherwise(F.col("number_")).alias("number"), "type", "description", conflict.alias("conflict"))


def read_group_checksum(groups: DataFrame, keys: list[str]) -> DataFrame:
    """MD5 over ``id`` and the attributes, groups ordered by the attributes (missing first)."""
    order = F.struct(*(F.col(k) for k in keys), F.col("id"))
    text = F.concat_ws(",", F.concat(F.lit("ID:"), F.col("id")), *(F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"])
    return groups.groupBy("header").agg(F.md5(F.array_join(rows, ";").cast("binary")).alias("checksum"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with multiplicity; ``side`` is left or right."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


#: The standard lines (kind, id, number, type, description).
STANDARD_LINES = (
    ("FORMAT", "GT", "1", "String", "Genotype"),
    ("FORMAT", "GQ", "1", "Integer", "Genotype Quality"),
    ("FORMAT", "DP", "1", "Integer", "Approximate read depth (reads with MQ=255 or with bad mates are filtered)"),
    ("FORMAT", "PL", "G", "Integer", "Normalized, Phred-scaled likelihoods for genotypes as defined in the VCF specification"),
    ("FORMAT", "AD", "R", "Integer", "Allelic depths for the ref and alt alleles in the order listed"),
    ("FORMAT", "FT", "1", "String", "Genotype-level filter"),
    ("FORMAT", "PS", "1", "Integer", "Phasing set (typically the position of the first variant in the set)"),
    ("FORMAT", "PQ", "1", "Float", "Read-backed phasing quality"),
    ("INFO", "END", "1", "Integer", "Stop position of the interval"),
    ("INFO", "DB", "0", "Flag", "dbSNP Membership"),
    ("INFO", "DP", "1", "Integer", "Approximate read depth; some reads may have been filtered"),
    ("INFO", "SB", "1", "Float", "Strand Bias"),
    ("INFO", "AF", "A", "Float", "Allele Frequency, for each ALT allele, in the same order as listed"),
    ("INFO", "AC", "A", "Integer", "Allele count in genotypes, for each ALT allele, in the same order as listed"),
    ("INFO", "AN", "1", "Integer", "Total number of alleles in called genotypes"),
    ("INFO", "MQ0", "1", "Integer", "Total Mapping Quality Zero Reads"),
    ("INFO", "MQ", "1", "Float", "RMS Mapping Quality"),
    ("INFO", "SOMATIC", "0", "Flag", "Somatic event"),
)


def repair(lines: DataFrame) -> DataFrame:
    """Lines (kind, id, number, type, description, …) of standard ids with another count or type become the standard line.

    A description alone never does. ``repaired`` tells which changed; other columns pass through.
    """
    names = ["number", "type", "description"]
    known = lines.sparkSession.createDataFrame(STANDARD_LINES, "kind_ string, id_ string, number_ string, type_ string, description_ string")
    joined = lines.join(F.broadcast(known), (F.col("kind") == F.col("kind_")) & (F.col("id") == F.col("id_")), "left")  # eighteen rows
    bad = F.col("id_").isNotNull() & (~F.col("number").eqNullSafe(F.col("number_")) | ~F.col("type").eqNullSafe(F.col("type_")))
    return joined.select(
        *(F.when(bad, F.col(c + "_")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in lines.columns), bad.alias("repaired"))


def undeclared(values: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """Rows (…, key, value) with the declared type of their key as ``type``; null where the header has no such line of ``kind``."""
    declared = lines.filter(F.col("kind") == kind).groupBy(F.col("id").alias("id_")).agg(F.first("type").alias("type"))
    return values.join(declared, F.col("key") == F.col("id_"), "left").drop("id_")


def render_compound(kind: str, id_: str, number: str, type_: str, description: str):
    """A structured header line as text, from column names."""
    return F.concat(
        F.lit("##"), F.col(kind), F.lit("=<ID="), F.col(id_), F.lit(",Number="), F.col(number), F.lit(",Type="), F.col(type_), F.lit(',Description="'),
        F.regexp_replace(F.regexp_replace(F.col(description), r"\\", r"\\\\"), '"', r'\\"'), F.lit('">'))
