"""A linear index as an access path: features stored in sorted blocks, with the blocks that each bin of a contig reaches.

Features are dealt out by (contig, start) ranges, one folder a block. The index
has one row per contig and used bin: the first and last block with a feature that
starts there; and per contig the longest feature. A region is widened to the
left by that length, as a feature that begins before it can reach into it, and
only the blocks of its bins are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WIDTH = 8000


def write_indexed(features: DataFrame, path: str, blocks: int, width: int = WIDTH) -> None:
    """Store ``features`` (contig, start, end from 1, …) under ``path`` in about ``blocks`` blocks with their index.

    The column ``block`` is the store's own. Null contigs and starts are kept and meet no region.
    """
    if "block" in {c.lower() for c in features.columns}:
        raise ValueError("the column block is the store's own")
    ranged = features.repartitionByRange(blocks, "contig", "start").sortWithinPartitions("contig", "start").withColumn("block", F.spark_partition_id())
    ranged.write.partitionBy("block").parquet(f"{path}/data")
    stored = features.sparkSession.read.parquet(f"{path}/data")
    bins = stored.filter("contig is not null and start is not null").groupBy("contig", F.floor(F.col("start") / width).alias("bin")).agg(
        F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.max(F.col("end") - F.col("start") + 1).alias("longest"), F.count(F.lit(1)).alias("features"))
    bins.withColumn("width", F.lit(width)).write.parquet(f"{path}/index")


def region_blocks(index: DataFrame, regions: DataFrame) -> DataFrame:
    """``regions`` (contig, start, end, …) with the blocks to read for them, one row a block, as ``block``.

    A region on a contig that the index doesn't know has one row with ``known`` false and no
    block; one that no bin answers has none.
    """
    longest = index.groupBy("contig").agg(F.max("longest").alias("longest_"), F.max("width").alias("width_"), F.max("bin").alias("last_bin_"), F.min("bin").alias("first_bin_"))
    known = regions.join(longest.withColumnRenamed("contig", "contig_"), F.col("contig") == F.col("contig_"), "left")
    low = F.greatest(F.floor(F.greatest(F.col("start") - F.col("longest_"), F.lit(0)) / F.col("width_")), F.col("first_bin_"))
    high = F.least(F.floor(F.col("end") / F.col("width_")), F.col("last_bin_"))
    ranged = known.withColumn("known", F.col("contig_").isNotNull()).withColumn("bins_", F.when(F.col("known") & (low <= high), F.sequence(low, high)))
    at = ranged.withColumn("bin_", F.explode_outer("bins_")).drop("bins_", "longest_", "width_", "last_bin_", "first_bin_", "contig_")
    small = index.select(F.col("contig").alias("of_contig_"), F.col("bin").alias("of_bin_"), "first_block", "last_block")
    met = at.join(small, (F.col("contig") == F.col("of_contig_")) & (F.col("bin_") == F.col("of_bin_")), "left").filter(F.col("first_block").isNotNull() | ~F.col("known"))
    grouped = met.groupBy(*regions.columns, "known").agg(F.min("first_block").alias("a_"), F.max("last_block").alias("b_"))
    return grouped.withColumn("block", F.explode_outer(F.sequence("a_", "b_"))).drop("a_", "b_")


def read_region(spark: SparkSession, path: str, contig: str, start: int, end: int) -> DataFrame:
    """Stored features that overlap a region, from its blocks alone; an unknown contig is an error."""
    index = spark.read.parquet(f"{path}/index")
    asked = spark.createDataFrame([(contig, start, end)], "contig string, start long, end long")
    found = region_blocks(index, asked).agg(F.bool_and("known").alias("known"), F.min("block").alias("a"), F.max("block").alias("b")).first()
    if found["known"] is False:
        raise ValueError(f"the index has no contig {contig}")
    data = spark.read.parquet(f"{path}/data")
    inside = F.col("block").between(found["a"], found["b"]) if found["a"] is not None else F.lit(False)
    return data.filter(inside & (F.col("contig") == contig) & (F.col("start") <= end) & (F.col("end") >= start)).drop("block")


def read_regions(spark: SparkSession, path: str, regions: DataFrame, skip_unknown: bool = False) -> DataFrame:
    """Pairs of regions (contig, start, end, …) and stored features that overlap them; the features' columns get the suffix ``_f``.

    Blocks are joined by their number, a partition column, so blocks that no region asks for are pruned when the
    query runs. Regions on unknown contigs are an error unless they are to be skipped.
    """
    asked = region_blocks(spark.read.parquet(f"{path}/index"), regions)
    sure = asked.filter("known").drop("known") if skip_unknown else asked.filter(F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the index has no contig "), F.coalesce("contig", F.lit("null")))).cast("boolean"))).drop("known")
    data = spark.read.parquet(f"{path}/data")
    features = data.select(*(F.col(c).alias(f"{c}_f") for c in data.columns))
    same = (F.col("block") == F.col("block_f")) & (F.col("contig") == F.col("contig_f")) & (F.col("start_f") <= F.col("end")) & (F.col("end_f") >= F.col("start"))
    return sure.join(features, same).drop("block", "block_f")
