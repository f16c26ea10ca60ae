"""Index tables computed from alignments: bins, 16 kb linear index, chunk coalescing, metadata counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.alignment import UNMAPPED, has_flag, linear_window
from . import bands


def reference_counts(df: DataFrame) -> DataFrame:
    """Aligned and unaligned records and the extreme positions of each reference."""
    un = has_flag(F.col("flags"), UNMAPPED)
    return df.groupBy("ref_index").agg(
        F.count_if(~un).alias("aligned"), F.count_if(un).alias("unaligned"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def linear_index(df: DataFrame) -> DataFrame:
    """The smallest offset of each 16 kb window, empty windows filled from the one before (0 at the front)."""
    placed = df.filter("ref_index >= 0").groupBy("ref_index", linear_window(F.col("pos")).alias("window")).agg(F.min("offset").alias("offset"))
    whole = placed.groupBy("ref_index").agg(F.max("window").alias("top")).select("ref_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("window"))
    order = W.partitionBy("ref_index").orderBy("window").rowsBetween(W.unboundedPreceding, 0)
    filled = whole.join(placed.withColumn("window", F.col("window").cast("long")), ["ref_index", "window"], "left")
    return filled.withColumn("offset", F.coalesce(F.last("offset", ignorenulls=True).over(order), F.lit(0)))


def coalesce_chunks(chunks: DataFrame, keys: list[str], block_bits: int = 16, band: int = 1 << 32) -> DataFrame:
    """Chunks (start, end virtual offsets) joined with the last one if they begin in the block where that ends, or the next.

    A group is worked off in bands of ``band`` offsets.
    """
    rows = bands.cut(chunks, "start", band)
    carried = bands.carry(rows, keys, before_=(F.max_by("end", F.struct("start", "end")), bands.last_known))
    order = bands.inside(keys, "start", "end")
    last = F.when(F.row_number().over(order) == 1, F.col("before_")).otherwise(F.lag("end").over(order))
    gap = F.shiftright("start", block_bits) - F.shiftright(last, block_bits)
    opened = carried.withColumn("opens_", F.when(gap.isNull() | (gap > 1), 1).otherwise(0))
    return bands.runs(opened, keys, ["start", "end"], start=(F.min("start"), F.min), end=(F.max("end"), F.max), chunks=(F.count(F.lit(1)), F.sum))


def consolidate_blocks(blocks: DataFrame, keys: list[str], gap: int = 1000, band: int = 1 << 32) -> DataFrame:
    """Byte ranges (start, end exclusive) joined where less than ``gap`` bytes lie between; groups are worked off in bands of ``band`` bytes."""
    rows = bands.cut(blocks, "start", band)
    carried = bands.carry(rows, keys, before_=(F.max("end"), F.max))
    reach = F.greatest("before_", F.max("end").over(bands.inside(keys, "start", "end").rowsBetween(W.unboundedPreceding, -1)))
    opened = carried.withColumn("reach_", reach).withColumn("opens_", F.when(F.col("reach_").isNull() | (F.col("start") - F.col("reach_") >= gap), 1).otherwise(0))
    return bands.runs(opened, keys, ["start", "end"], start=(F.min("start"), F.min), end=(F.max("end"), F.max))


def feature_bins(features: DataFrame, width: int = 8000) -> DataFrame:
    """Linear feature index: per contig every bin up to the last used one, its features, and the longest feature."""
    used = features.groupBy("contig", F.floor(F.col("start") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("features"), F.max(F.col("end") - F.col("start") + 1).alias("longest"))
    whole = used.groupBy("contig").agg(F.max("bin").alias("top"), F.max("longest").alias("longest_feature"))
    scaffold = whole.select("contig", "longest_feature", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin"))
    return scaffold.join(used.drop("longest"), ["contig", "bin"], "left").na.fill(0, ["features"])


def out_of_order(df: DataFrame, order: str, contig: str, start: str, keys: list[str], band: int = 1 << 20) -> DataFrame:
    """Rows whose start goes back on the contig of the row before, by the integer column ``order``; a group is worked off in bands of it."""
    place = F.struct(F.col(contig).alias("contig"), F.col(start).alias("start"))
    rows = bands.carry(bands.cut(df, order, band), keys, before_=(F.max_by(place, order), bands.last_known))
    w = bands.inside(keys, order)
    last = F.when(F.row_number().over(w) == 1, F.col("before_")).otherwise(F.lag(place).over(w))
    back = (F.col("last_.contig") == F.col(contig)) & (F.col("last_.start") > F.col(start))
    return rows.withColumn("last_", last).filter(back).drop("last_", "before_", "band_")


def symbol_pairs(df: DataFrame, text: str) -> DataFrame:
    """Counts of symbol pairs (previous, symbol; the first of a text has an empty previous)."""
    symbols = F.filter(F.split(text, ""), lambda c: c != "")
    before = F.concat(F.array(F.lit("")), symbols)  # one longer: the pair without a symbol is left out
    pairs = F.zip_with(symbols, before, lambda c, p: F.struct(p.alias("prev"), c.alias("sym")))
    return df.select(F.explode(pairs).alias("p")).filter("p.sym is not null").groupBy("p.prev", "p.sym").agg(F.count(F.lit(1)).alias("n"))


def tag_sets(df: DataFrame, tags: str, ordinal: str) -> DataFrame:
    """Distinct sorted tag lists with dense ids in first-seen order (the dictionary is small, one window ranks it)."""
    seen = df.groupBy(F.array_join(F.array_sort(tags), ",").alias("tags")).agg(F.min(ordinal).alias("first"), F.count(F.lit(1)).alias("n"))
    return seen.withColumn("id", F.row_number().over(W.orderBy("first")) - 1)


def linear_bin_width(blocks: DataFrame, width: int, densest: int = 100, widest: int = 1_024_000) -> DataFrame:
    """The bin width of each contig's linear index: (contig, width, blocks).

    ``blocks`` are (contig, bin, size, features), every bin up to the last.
    Pairs of bins are joined and the width doubled as long as the fullest bin
    holds at most ``densest`` average features, more than one bin is left and,
    with more than one feature, the width is at most ``widest``. All widths are
    scored in one pass, as a bin of width ``width * 2 ** k`` is ``bin >> k``.
    """
    levels = 0
    while width << levels <= 2 * widest or levels < 18:
        levels += 1
    some = blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    sized = some.groupBy("contig", "level", F.expr("shiftright(bin, level)").alias("b")).agg(F.sum("size").alias("size"), F.sum("features").alias("features"))
    scored = sized.groupBy("contig", "level").agg(F.max("size").alias("top"), F.sum("size").alias("total"), F.sum("features").alias("features"), F.count(F.lit(1)).alias("blocks"))
    at = F.lit(width) * F.pow(F.lit(2.0), F.col("level"))
    score = F.col("top") * F.col("features")  # against densest * total: the fullest bin's size in average features
    stops = (score > densest * F.col("total")) | (F.col("blocks") == 1) | (at > 1e9) | ((F.col("features") > 1) & (at > widest))
    first = scored.groupBy("contig").agg(F.min(F.when(stops, F.col("level"))).alias("stop"))
    best = first.select("contig", F.greatest(F.col("stop") - 1, F.lit(0)).alias("level"))
    return scored.join(best, ["contig", "level"]).select("contig", (F.lit(width) * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("width"), "blocks")


def length_statistics(features: DataFrame, keys: list[str], order: list[str], band: int = 1 << 20) -> DataFrame:
    """Per group: features, bases seen, longest, and mean and sample deviation of the running longest length.

    Bases seen adds the distance to the start before, or the whole start where
    starts go back (and at the front). The first column of ``order`` is an
    integer; a group is worked off in bands of it.
    """
    w = bands.inside(keys, *order)
    length = F.col("end") - F.col("start") + 1
    rows = bands.carry(bands.cut(features, order[0], band), keys, before_=(F.max_by("start", F.struct(*order)), bands.last_known), top_=(F.max(length), F.max))
    step = F.col("start") - F.when(F.row_number().over(w) == 1, F.col("before_")).otherwise(F.lag("start").over(w))
    running = rows.withColumn("seen", F.when(step >= 0, step).otherwise(F.col("start"))).withColumn(
        "longest", F.greatest("top_", F.max(length).over(w.rowsBetween(W.unboundedPreceding, 0))))
    return running.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features"), F.sum("seen").alias("bases_seen"), F.max("longest").alias("longest_feature"), F.avg("longest").alias("mean_length"),
        F.stddev_samp("longest").alias("sd_length"))
