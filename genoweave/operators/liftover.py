"""Liftover of intervals through alignment chains.

Chain blocks: chain_id, contig, from_start, from_end (0-based half-open), to_contig,
to_start, to_size, opposite (target strand), block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .intervals import overlap_join


def lift(intervals: DataFrame, key: str, blocks: DataFrame, min_match: float = 0.95) -> DataFrame:
    """One row per interval: the lifted place, or nulls.

    An interval lifts if exactly one chain maps at least ``min_match`` of its
    bases; a second qualifying chain disqualifies it, chains below the
    threshold do not. On the opposite strand the place counts from the
    target's end.
    """
    sides = blocks.withColumn("start", F.col("from_start") + 1).withColumn("end", F.col("from_end"))
    pairs = overlap_join(intervals, sides)
    first = F.greatest("start", "start_r")
    last = F.least("end", "end_r")
    hits = pairs.select(
        key, (F.col("end") - F.col("start") + 1).alias("size"), F.col("chain_id_r").alias("chain"), F.col("to_contig_r").alias("to_contig"),
        F.col("to_size_r").alias("to_size"), F.col("opposite_r").alias("opposite"), (last - first + 1).alias("bases"),
        (F.col("to_start_r") + first - F.col("start_r")).alias("t0"), (F.col("to_start_r") + last - F.col("start_r") + 1).alias("t1"))
    by_chain = hits.groupBy(key, "chain").agg(
        F.first("size").alias("size"), F.sum("bases").alias("bases"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.first("to_contig").alias("to_contig"), F.first("to_size").alias("to_size"), F.first("opposite").alias("opposite"))
    good = by_chain.filter(F.col("bases") >= F.lit(min_match) * F.col("size"))
    lifted = good.groupBy(key).agg(
        F.count(F.lit(1)).alias("chains"), *(F.first(c).alias(c) for c in ("t0", "t1", "to_contig", "to_size", "opposite"))).filter("chains = 1")
    start = F.when(F.col("opposite"), F.col("to_size") - F.col("t1") + 1).otherwise(F.col("t0") + 1)
    end = F.when(F.col("opposite"), F.col("to_size") - F.col("t0")).otherwise(F.col("t1"))
    places = lifted.select(key, F.col("to_contig").alias("lifted_contig"), start.alias("lifted_start"), end.alias("lifted_end"), F.col("opposite").alias("flipped"))
    return intervals.join(places, key, "left")
