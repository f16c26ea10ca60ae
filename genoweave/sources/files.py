"""Text files whose records span lines: lines get their number in the file without a file being read whole.

Spark reads a file in splits. A split's lines come in order, so a line's number is
its place in the split plus the lines of the splits before it: one small row per
split, added up per file. Records that cross splits then meet by line number.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .text import fastq_lines

#: Splits (one row of a few hundred bytes each) that are broadcast to the lines; more are joined.
MOST_BROADCAST = 100_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 in each file. Compressed files are one split."""
    raw = spark.read.text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = splits.select(F.col("file").alias("file_"), F.col("split").alias("split_"), (before - F.col("first")).alias("shift"))
    if raw.rdd.getNumPartitions() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    joined = lines.join(starts, (F.col("file") == F.col("file_")) & (F.col("split") == F.col("split_")))
    return joined.select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def fastq_reads(numbered: DataFrame) -> DataFrame:
    """Reads of ``numbered_lines``: (file, read, name, bases, quality, error); four lines are a read, whatever they hold."""
    return fastq_lines(numbered, "line", ["file"])


def _owner(numbered: DataFrame, starts: Column, size: Column | None = None, band: int = 1 << 16) -> DataFrame:
    """Lines with the number of the last line at or before them for which ``starts`` holds, as ``owner`` (null before the first).

    With ``size``, also its sum over the file's lines before, as ``before``. Lines
    are looked through in bands, in one exchange; what a band begins with comes from
    small tables of the bands before.
    """
    size = F.lit(0) if size is None else size
    marked = numbered.withColumn("band_", F.floor(F.col("line") / band)).withColumn("mark_", F.when(starts, F.col("line"))).withColumn("size_", size.cast("long"))
    tops = marked.groupBy("file", "band_").agg(F.max("mark_").alias("top_"), F.sum("size_").alias("total_"))
    earlier = W.partitionBy("file").orderBy("band_").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = tops.select(F.col("file").alias("file_"), F.col("band_").alias("band__"), F.max("top_").over(earlier).alias("carried_"), F.coalesce(F.sum("total_").over(earlier), zero).alias("start_"))
    order = W.partitionBy("file", "band_").orderBy("line")
    inside = marked.withColumn("inside_", F.max("mark_").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("sum_", F.coalesce(F.sum("size_").over(order.rowsBetween(W.unboundedPreceding, -1)), zero))
    joined = inside.join(carried, (F.col("file") == F.col("file_")) & (F.col("band_") == F.col("band__")))
    return joined.select(*numbered.columns, F.coalesce("inside_", "carried_").alias("owner"), (F.col("start_") + F.col("sum_")).alias("before"))


def fasta_pieces(numbered: DataFrame) -> DataFrame:
    """Lines of sequences as pieces (file, contig, offset, bases, error), ready for ``chunk_table``; no sequence is put together.

    A name runs to the first white space. Blanks at a line's end are no bases.
    Text before the first name has the ``error`` ``header`` and no contig. A
    line's offset is the bases of the file before it less those before its sequence's name.
    """
    bases = F.regexp_replace("value", r"\s+$", "")
    is_name = F.col("value").startswith(">")
    owned = _owner(numbered, is_name, F.when(is_name, 0).otherwise(F.length(bases)))
    names = owned.filter(F.col("line") == F.col("owner")).select(
        F.col("file").alias("file_"), F.col("line").alias("owner_"), F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("contig"), F.col("before").alias("first_"))
    body = owned.filter(~F.coalesce(F.col("line") == F.col("owner"), F.lit(False))).withColumn("bases", bases).filter("bases <> ''")
    joined = body.join(names, (F.col("file") == F.col("file_")) & (F.col("owner") == F.col("owner_")), "left")
    return joined.select("file", "contig", (F.col("before") - F.coalesce("first_", F.lit(0).cast("long"))).alias("offset"), "bases", F.when(F.col("owner").isNull(), "header").alias("error"))


def chains(numbered: DataFrame) -> DataFrame:
    """Blocks of liftover chain files with what is wrong with their chain.

    A row per block line: (file, chain_line, chain_id, contig, from_start, from_end, to_contig,
    to_start, to_size, opposite, block, error); a chain with an ``error`` is one row
    without places. Errors: ``header`` (not 13 fields, or no number where one
    must be), ``fields`` (a block line that isn't one number or three),
    ``unfinished`` (the last line isn't the terminal block), ``terminal`` (lines after it),
    ``sum`` (blocks and gaps don't reach the ends that the header gives), ``stray`` (lines that belong to no chain).
    Lines beginning with ``#`` are left out. Lines travel with their file's number among all
    files instead of its path, which is longer than they are; files and their numbers are broadcast.
    """
    files = F.broadcast(numbered.select(F.col("file").alias("path_")).distinct().withColumn("no_", F.row_number().over(W.orderBy("path_"))))
    numbered = numbered.join(files, F.col("file") == F.col("path_")).select(F.col("no_").alias("file"), "line", "value")
    spaced = numbered.filter(~F.col("value").startswith("#")).withColumn("value", F.trim("value"))
    owned = _owner(spaced, F.col("value").startswith("chain"))
    h = F.split("value", r"\s+")
    whole = lambda i: F.get(h, F.lit(i)).try_cast("long")
    good = (F.size(h) == 13) & (h[0] == "chain") & F.get(h, F.lit(1)).try_cast("double").isNotNull()
    for i in (3, 5, 6, 8, 10, 11, 12):
        good = good & whole(i).isNotNull()
    head = owned.filter(F.col("line") == F.col("owner")).select(
        F.col("file").alias("file_"), F.col("line").alias("chain_line"), F.coalesce(good, F.lit(False)).alias("good"), whole(12).alias("chain_id"), F.get(h, F.lit(2)).alias("contig"), whole(5).alias("f0"), whole(6).alias("f1"),
        F.get(h, F.lit(7)).alias("to_contig"), whole(8).alias("to_size"), (F.get(h, F.lit(9)) == "-").alias("opposite"), whole(10).alias("t0"), whole(11).alias("t1"))
    b = F.transform(h, lambda x: x.try_cast("long"))
    body = owned.filter((F.col("value") != "") & ~F.coalesce(F.col("line") == F.col("owner"), F.lit(False))).withColumn("b", b)
    size, gap_f, gap_t = F.col("b")[0], F.coalesce(F.get("b", F.lit(1)), F.lit(0).cast("long")), F.coalesce(F.get("b", F.lit(2)), F.lit(0).cast("long"))
    fine = F.size("b").isin(1, 3) & ~F.exists("b", lambda x: x.isNull())
    order = W.partitionBy("file", "owner").orderBy("line")
    prior = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    steps = body.select(
        "file", "owner", "line", F.coalesce(fine, F.lit(False)).alias("fine"), F.size("b").alias("n"), size.alias("size"), (F.row_number().over(order) - 1).alias("block"),
        F.coalesce(F.sum(size + gap_f).over(prior), zero).alias("df"), F.coalesce(F.sum(size + gap_t).over(prior), zero).alias("dt"))
    folded = steps.groupBy("file", "owner").agg(
        F.bool_and("fine").alias("all_fine"), F.max_by("n", "line").alias("last_n"), F.count_if(F.col("n") == 1).alias("terminals"),
        F.max(F.col("df") + F.col("size")).alias("f_len"), F.max(F.col("dt") + F.col("size")).alias("t_len"), F.min("line").alias("first_line"))
    checked = head.join(folded, (F.col("file_") == F.col("file")) & (F.col("chain_line") == F.col("owner")), "full")
    error = (F.when(F.col("chain_line").isNull(), "stray").when(~F.col("good"), "header").when(F.col("owner").isNull(), "unfinished").when(~F.col("all_fine"), "fields")
             .when(F.col("terminals") > 1, "terminal").when(F.col("last_n") != 1, F.when(F.col("terminals") == 1, "terminal").otherwise("unfinished"))
             .when((F.col("f_len") != F.col("f1") - F.col("f0")) | (F.col("t_len") != F.col("t1") - F.col("t0")), "sum"))
    judged = checked.select(F.coalesce("file_", "file").alias("file"), F.coalesce("chain_line", "first_line").alias("chain_line"), "chain_id", "contig", "f0", "to_contig", "t0", "to_size", "opposite", error.alias("error"))
    places = steps.select(F.col("file").alias("file__"), F.col("owner").alias("owner__"), "df", "dt", "size", "block")
    sound = judged.filter("error is null").join(places, (F.col("file") == F.col("file__")) & (F.col("chain_line") == F.col("owner__")))
    rows = sound.select(
        "file", "chain_line", "chain_id", "contig", (F.col("f0") + F.col("df")).alias("from_start"), (F.col("f0") + F.col("df") + F.col("size")).alias("from_end"), "to_contig",
        (F.col("t0") + F.col("dt")).alias("to_start"), "to_size", "opposite", F.col("block").cast("int").alias("block"), "error")
    none = F.lit(None).cast("long")
    bad = judged.filter("error is not null").select(
        "file", "chain_line", "chain_id", "contig", none.alias("from_start"), none.alias("from_end"), "to_contig", none.alias("to_start"), "to_size", "opposite", F.lit(None).cast("int").alias("block"), "error")
    found = rows.unionByName(bad)
    return found.join(files, F.col("file") == F.col("no_")).withColumn("file", F.col("path_")).drop("path_", "no_")


def missing_targets(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Target contigs of chain blocks that a dictionary (name, …) lacks, with their number of blocks."""
    known = dictionary.select(F.col("name").alias("to_contig")).distinct()
    return blocks.filter("error is null").join(known, "to_contig", "left_anti").groupBy("to_contig").agg(F.count(F.lit(1)).alias("blocks"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; with a local master and none set, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="genoweave-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
