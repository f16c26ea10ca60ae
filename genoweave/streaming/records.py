"""Streams: the line readers run on a text stream unchanged, and histograms keep state per window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_histogram(df: DataFrame, time: str, group: str, bin_: str, window: str, watermark: str | None = None) -> DataFrame:
    """Counts per time window, group and bin; with a watermark, state is dropped and late rows are too."""
    if watermark:
        df = df.withWatermark(time, watermark)
    return df.groupBy(F.window(time, window).alias("w"), F.col(group).alias("grp"), F.col(bin_).alias("bin")).agg(F.count(F.lit(1)).alias("value")).select(
        F.col("w.start").alias("window_start"), "grp", "bin", "value")


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result (for bounded results such as counts)."""
    name = "drained_" + uuid.uuid4().hex
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)


def stream_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
