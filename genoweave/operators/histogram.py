"""Weighted histograms: (group, bin, value) tables and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

NEAR = 1 / 2000  # share of a group on each side of a wanted percentile that is ranked
ACCURACY = 20_000  # of the approximate percentiles that bracket it


def build(df: DataFrame, group: str, bin_: str, weight: Column | int = 1) -> DataFrame:
    """(grp, bin, value): summed weights. -0.0 and 0.0 are bins of their own, which Spark's grouping alone would join."""
    w = F.lit(weight) if isinstance(weight, int) else weight
    bins = F.col(bin_).cast("double")
    minus = F.when(bins == 0, bins.cast("string").startswith("-")).otherwise(False)
    summed = df.groupBy(F.col(group).alias("grp"), bins.alias("bin"), minus.alias("minus_")).agg(F.sum(w).cast("double").alias("value"))
    return summed.select("grp", F.when(F.col("minus_"), F.lit(-0.0)).otherwise(F.col("bin")).alias("bin"), "value")


def _ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: NaN or an infinity where ``b`` is 0."""
    by_zero = F.when(a.isNull() | b.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _with(h: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows with the statistics of their group; null groups are a group too."""
    other = stats.withColumnRenamed("grp", "grp_")
    return h.join(other, F.col("grp").eqNullSafe(F.col("grp_"))).drop("grp_")


def moments(h: DataFrame) -> DataFrame:
    """Count, sum, mean and weighted sample standard deviation.

    A group of weight 0 has a NaN mean; one observation, a NaN deviation.
    """
    m = h.groupBy("grp").agg(F.sum("value").alias("n"), F.sum(F.col("bin") * F.col("value")).alias("total")).withColumn("mean", _ratio(F.col("total"), F.col("n")))
    d = _with(h, m).groupBy("grp").agg(
        F.first("n").alias("n"), F.first("total").alias("total"), F.first("mean").alias("mean"),
        F.sum(F.col("value") * F.pow(F.col("bin") - F.col("mean"), 2)).alias("ss"))
    return d.select("grp", "n", "total", "mean", F.sqrt(_ratio(F.col("ss"), F.col("n") - 1)).alias("sd"))


def extremes(h: DataFrame) -> DataFrame:
    """Smallest and largest bin, number of bins, largest value and the mean value of a bin."""
    return h.groupBy("grp").agg(
        F.min("bin").alias("min_bin"), F.max("bin").alias("max_bin"), F.count("bin").alias("bins"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def _cumulative(h: DataFrame) -> DataFrame:
    up_to = W.partitionBy("grp").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return h.withColumn("cum", F.sum("value").over(up_to)).withColumn("n", F.sum("value").over(W.partitionBy("grp")))


def median(h: DataFrame) -> DataFrame:
    """Mean of the two middle bins (the one middle bin for an odd count)."""
    c = _cumulative(h)
    low = F.min(F.when(F.col("cum") >= F.floor((F.col("n") + 1) / 2), F.col("bin")))
    high = F.min(F.when(F.col("cum") >= F.floor(F.col("n") / 2) + 1, F.col("bin")))
    return c.groupBy("grp").agg(((low + high) / 2).alias("median"))


def mad(h: DataFrame) -> DataFrame:
    """Median of absolute deviations from the median, and the deviation estimated from it."""
    away = _with(h, median(h)).groupBy("grp", F.abs(F.col("bin") - F.col("median")).alias("bin")).agg(F.sum("value").alias("value"))
    return median(away).select("grp", F.col("median").alias("mad"), (F.col("median") * 1.4826).alias("sd_by_mad"))


def percentile(h: DataFrame, p: float) -> DataFrame:
    """The first bin whose cumulative share reaches ``p`` (never interpolated); null for a group of weight 0."""
    if not 0 < p < 1:
        raise ValueError("percentile must be inside (0, 1)")
    return _cumulative(h).groupBy("grp").agg(F.min(F.when(F.try_divide("cum", "n") >= p, F.col("bin"))).alias("percentile"))


def cumulative_probability(h: DataFrame, x: float) -> DataFrame:
    """Share of the weight at bins up to ``x`` (NaN for a group of weight 0)."""
    found = h.groupBy("grp").agg(F.coalesce(F.sum(F.when(F.col("bin") <= x, F.col("value"))), F.lit(0.0)).alias("up_to"), F.sum("value").alias("n"))
    return found.select("grp", _ratio(F.col("up_to"), F.col("n")).alias("probability"))


def mode(h: DataFrame) -> DataFrame:
    """The bin with the largest value, the lowest on ties."""
    return h.groupBy("grp").agg(F.max_by("bin", F.struct(F.col("value"), -F.col("bin"))).alias("mode"))


def trim(h: DataFrame, width: float) -> DataFrame:
    """Without bins above ``width``; a group that holds a NaN bin stays whole."""
    blocked = F.max(F.isnan("bin")).over(W.partitionBy("grp"))
    return h.withColumn("blocked", blocked).filter((F.col("bin") <= width) | F.col("blocked")).drop("blocked")


def list_percentile(df: DataFrame, group: str, value: str, p: float, rule: str = "legacy") -> DataFrame:
    """Exact percentile of values: ``legacy`` interpolates at p(n + 1), ``r1`` takes the nearest rank; NaN left out.

    Two approximate percentiles bracket the wanted one; the values below, inside
    and above are counted exactly, and only the parts that hold the wanted ranks
    (as a rule the bracket, two ``NEAR`` of the group) are ranked, equal values as
    one row. The result doesn't depend on how good the bracket is.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(group).alias("grp"), F.col(value).alias("x"))
    near = F.percentile_approx("x", F.array(F.lit(max(0.0, p - NEAR)), F.lit(min(1.0, p + NEAR))), ACCURACY)
    sided = _with(clean, clean.groupBy("grp").agg(near.alias("near"), F.count(F.lit(1)).alias("n")))
    sided = sided.withColumn("side", F.when(F.col("x") < F.col("near")[0], 0).when(F.col("x") <= F.col("near")[1], 1).otherwise(2))
    at = F.lit(p) * (F.col("n") + 1) if rule == "legacy" else F.ceil(F.lit(p) * F.col("n"))
    low = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(at)))
    high = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(at) + (1 if rule == "legacy" else 0)))
    part = F.when((at < 1) | (at >= F.col("n")), 0.0).otherwise(at - F.floor(at)) if rule == "legacy" else F.lit(0.0)
    sides = sided.groupBy("grp", "side", "n").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("grp").orderBy("side").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    wanted = sides.withColumn("before", before).filter((F.col("before") < high) & (F.col("before") + F.col("rows") >= low))
    wanted = wanted.select(F.col("grp").alias("grp_"), F.col("side").alias("side_"), "before")
    held = sided.join(wanted, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("side") == F.col("side_")))
    values = held.groupBy("grp", "side", "x").agg(F.count(F.lit(1)).alias("c"), F.first("before").alias("before"), F.first("n").alias("n"))
    ranked = values.withColumn("cum", F.col("before") + F.sum("c").over(W.partitionBy("grp", "side").orderBy("x").rowsBetween(W.unboundedPreceding, 0)))
    found = ranked.groupBy("grp").agg(
        F.min(F.when(F.col("cum") >= low, F.col("x"))).alias("a"), F.min(F.when(F.col("cum") >= high, F.col("x"))).alias("b"), F.max(part).alias("f"))
    return found.select("grp", (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("percentile"))
