"""Contiguous shards of near-equal bytes, by global prefix sums (DataFrame functions only).

The table is range-partitioned by its key once and written with each row's
partition number. Totals per partition (one small row each) give every
partition's start in bytes and in rows; a window inside each partition adds the
rest. A row goes to the shard in which its first byte falls when the whole is
cut at equal targets, so shards are contiguous in key order and differ by less
than one row's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import free_name, materialize, shuffle_partitions, table


def byte_size(text):
    """UTF-8 bytes of a text column (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def balanced_shards(df: DataFrame, key: str, size: str, n_shards: int,
                    tie_breakers: tuple[str, ...] = (), shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in key order inside a shard).

    ``size`` must be a positive bigint column. Null keys come first; rows with
    equal keys are ordered by ``tie_breakers`` and are otherwise
    interchangeable, repeated rows each keep a slot. An empty table gives an
    empty result. Other columns pass through unchanged; helper columns avoid
    their names, and columns named like the results are replaced.
    """
    df = df.drop(shard, slot)
    spark, columns = df.sparkSession, df.columns
    part = free_name(columns, "part_no")
    byte0, row0, row, prior_bytes, all_bytes, of_shard, first_row = (
        free_name([*columns, part, shard, slot], x)
        for x in ("byte_start", "row_start", "row_no", "bytes_before", "all_bytes", "of_shard", "first_row"))
    order = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in tie_breakers)]

    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn(part, F.spark_partition_id())
    ranged = materialize(ranged, "shard-ranged")

    totals = ranged.groupBy(part).agg(F.sum(size).alias("bytes_in"), F.count(F.lit(1)).alias("rows_in"))
    # one row per partition: the only place where a single task sees everything
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col(part),
        F.coalesce(F.sum("bytes_in").over(before), F.lit(0)).alias(byte0),
        F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias(row0),
        F.sum("bytes_in").over(W.partitionBy()).alias(all_bytes),
    )
    inside = W.partitionBy(part).orderBy(*order)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranged.withColumn(row, F.row_number().over(inside) - 1)
        .withColumn(prior_bytes, F.coalesce(F.sum(size).over(prior), F.lit(0)))
        .join(F.broadcast(starts), part)
        .withColumn(shard, F.expr(f"int(least((`{byte0}` + `{prior_bytes}`) * {n_shards} div `{all_bytes}`, {n_shards - 1}))"))
        .withColumn(row, F.col(row) + F.col(row0))
        .select(*columns, shard, row)
    )
    placed = materialize(placed, "shard-placed")
    firsts = placed.groupBy(shard).agg(F.min(row).alias(first_row)).withColumnRenamed(shard, of_shard)
    return (
        placed.join(F.broadcast(firsts), F.col(shard) == F.col(of_shard))
        .withColumn(slot, F.col(row) - F.col(first_row))
        .select(*columns, shard, slot)
    )


def op9_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, law ``bytes``; null text has size 1 and crc 0."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return balanced_shards(rows, "doc_id", "size", 8, ("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
