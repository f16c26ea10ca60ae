"""Sorted text files with one header, and reading at a stringency.

A sorted file is a folder: ``header`` holds the header lines, ``body`` the lines
in parts, each sorted and each before the next, and ``manifest`` the parts in order
with their lines. Readers put the parts together by the manifest, as whole-file
readers do with concatenated parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F

from .files import numbered_lines

#: The order of an alignment header's line kinds.
HEADER_KINDS = ("@HD", "@SQ", "@RG", "@PG", "@CO")


def alignment_header_order(line: Column, position: Column) -> list[Column]:
    """Sort keys of alignment header lines: by kind (others last), then as given."""
    kind = F.lit(len(HEADER_KINDS))
    for i, name in enumerate(HEADER_KINDS):
        kind = F.when(F.substring(line, 1, 3) == name, i).otherwise(kind)
    return [kind, position]


def variant_header_order(line: Column, position: Column) -> list[Column]:
    """Sort keys of variant header lines: the version, then lines by their text with contigs by their position, then the columns."""
    contig = line.startswith("##contig=")
    group = F.when(line.startswith("##fileformat="), 0).when(line.startswith("##"), 1).otherwise(2)
    return [group, F.when(contig, "##contig=").otherwise(line), F.when(contig, position)]


def write_sorted(rows: DataFrame, line: str, order: list[str | Column], path: str, parts: int, header: DataFrame | None = None, header_order: list[Column] | None = None) -> None:
    """Write the text column ``line`` of ``rows`` in the total order of ``order``, in at most ``parts`` parts, after the lines of ``header`` (column ``line``)."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(F.col(line).alias("value")).write.text(f"{path}/body")
    if header is not None:
        header.orderBy(*(header_order or [])).coalesce(1).select(F.col("line").alias("value")).write.text(f"{path}/header")  # a header is one short file
    lines = numbered_lines(spark, f"{path}/body")
    per_part = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    name = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    before = F.coalesce(F.sum("lines").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # one row a part
    per_part.select(name.alias("part"), "file", "lines").withColumn("before", before).write.parquet(f"{path}/manifest")


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a sorted file's body, numbered from 0 through all its parts."""
    parts = spark.read.parquet(f"{path}/manifest").select(F.col("file").alias("file_"), "before")
    joined = numbered_lines(spark, f"{path}/body").join(parts, F.col("file") == F.col("file_"))
    return joined.select((F.col("line") + F.col("before")).alias("line"), "value")


@dataclass
class Reading:
    """Rows that were read, rows that were refused, and their counts (``rows``, ``refused``) once an action on ``rows`` has run."""

    rows: DataFrame
    refused: DataFrame
    counts: Observation


def at_stringency(parsed: DataFrame, stringency: str, error: str = "error", shown: str | None = None) -> Reading:
    """Parsed rows with an ``error`` column at a stringency.

    ``strict``: the first bad row ends the job, with its error (and the column ``shown``) in the
    message. ``lenient``: bad rows are kept apart in ``refused``. ``silent``: they are only counted.
    """
    counts = Observation()
    counted = parsed.observe(counts, F.count_if(F.col(error).isNull()).alias("rows"), F.count_if(F.col(error).isNotNull()).alias("refused"))
    bad = F.col(error).isNotNull()
    if stringency == "strict":
        said = F.concat(F.lit("malformed record: "), F.col(error), *((F.lit(": "), F.coalesce(F.col(shown).cast("string"), F.lit("null"))) if shown else ()))
        return Reading(counted.filter(F.when(bad, F.raise_error(said).cast("boolean")).otherwise(True)).drop(error), parsed.filter(F.lit(False)), counts)
    if stringency not in ("lenient", "silent"):
        raise ValueError(f"no such stringency: {stringency}")
    return Reading(counted.filter(~bad).drop(error), parsed.filter(bad) if stringency == "lenient" else parsed.filter(F.lit(False)), counts)
