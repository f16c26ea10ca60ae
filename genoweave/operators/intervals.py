"""Interval algebra over (contig, start, end), 1-based and closed at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BIN = 1 << 8  # width of the smallest cells in which interval joins meet
STEP = 8  # factor from one level of cells to the next
LEVELS = 9
MEMBERS = 1 << 10  # most rows of one span that travel as one row through an interval join
SPREAD = 32  # tasks that put out pairs, for each of the session's shuffle partitions
BAND = 1 << 17  # width of the bands in which a contig's intervals are merged first


def overlaps(a: DataFrame, b: DataFrame) -> Column:
    """Closed overlap on one contig, as a join condition."""
    return (a["contig"] == b["contig"]) & (a["start"] <= b["end"]) & (a["end"] >= b["start"])


def merge(df: DataFrame) -> DataFrame:
    """Merged spans (contig, start, end, members) of overlapping and abutting intervals.

    A contig is worked off in bands. How far the intervals of the bands before
    reach, and where the last span before a band begins, are small tables with a
    row per contig and band; inside a band a span opens where a start lies beyond what was reached.
    So no contig is sorted whole, whether its intervals merge or not.
    """
    keys = ["contig", "band_"]
    rows = df.select("contig", "start", "end", F.floor(F.col("start") / BAND).alias("band_"))

    def from_before(table: DataFrame, value: str, name: str) -> DataFrame:
        earlier = W.partitionBy("contig").orderBy("band_").rowsBetween(W.unboundedPreceding, -1)
        return table.select(F.col("contig").alias("of_contig_"), F.col("band_").alias("of_band_"), F.max(value).over(earlier).alias(name))

    def with_before(rows_: DataFrame, table: DataFrame) -> DataFrame:
        same = F.col("contig").eqNullSafe(F.col("of_contig_")) & F.col("band_").eqNullSafe(F.col("of_band_"))
        return rows_.join(table, same).drop("of_contig_", "of_band_")

    reached = from_before(rows.groupBy(*keys).agg(F.max("end").alias("top_")), "top_", "carried_")
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.greatest("carried_", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    flagged = with_before(rows, reached).withColumn("reach_", reach).withColumn("opens_", F.when(F.col("reach_").isNull() | (F.col("start") > F.col("reach_") + 1), 1).otherwise(0))
    numbered = flagged.withColumn("island_", F.sum("opens_").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = numbered.groupBy(*keys, "island_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members"))
    begun = from_before(inside.groupBy(*keys).agg(F.max(F.when(F.col("island_") > 0, F.col("start"))).alias("last_")), "last_", "begun_")
    owned = with_before(inside, begun).withColumn("opener_", F.when(F.col("island_") > 0, F.col("start")).otherwise(F.col("begun_")))
    return owned.groupBy("contig", "opener_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("members").alias("members")).drop("opener_")


def merge_named(df: DataFrame, tie: str) -> DataFrame:
    """Merged spans with the first member's strand and all names joined by ``|`` in sort order (null names left out).

    Spans come from ``merge``; each interval then finds the span it lies in. A
    span's names are one string by definition.
    """
    spans = merge(df).select("contig", "start", "end")
    inside = overlap_join(spans, df.select("contig", "start", "end", "negative", "name", F.col(tie).alias("tie")))
    member = F.struct(F.col("start_r").alias("s"), F.col("end_r").alias("e"), F.col("negative_r").alias("n"), F.col("name_r").alias("name"), F.col("tie_r").alias("tie"))
    return inside.groupBy("contig", "start", "end").agg(F.array_sort(F.collect_list(member)).alias("m")).select(
        "contig", "start", "end", F.col("m")[0]["n"].alias("negative"),
        F.array_join(F.transform(_by_order("m"), lambda x: x["name"]), "|").alias("names"))


def _by_order(members: str) -> Column:
    """Members in sort order, null names before others among equal spans and strands."""
    key = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["n"].alias("n"), x["name"].isNotNull().alias("named"), x["name"].alias("name"), x["tie"].alias("tie"))
    return F.array_sort(F.transform(members, key))


def rank_in_group(df: DataFrame, group: str, position: Column, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their 1-based rank inside ``group`` by ``order``, whose first key is the integer ``position`` (null ones come last).

    A group's rows are ranked inside bands of positions, and a band's rank
    starts from the counts of the bands before it, so no group is sorted whole.
    """
    band = F.floor(position / BAND)
    banded = df.withColumn("band_", band)
    totals = banded.groupBy(group, "band_").agg(F.count(F.lit(1)).alias("rows_"))
    before = F.sum("rows_").over(W.partitionBy(group).orderBy(F.col("band_").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select(F.col(group).alias("group_"), F.col("band_").alias("of_band_"), F.coalesce(before, F.lit(0)).alias("before_"))
    inside = banded.withColumn("inside_", F.row_number().over(W.partitionBy(group, "band_").orderBy(*order)))
    joined = inside.join(starts, F.col(group).eqNullSafe(F.col("group_")) & F.col("band_").eqNullSafe(F.col("of_band_")))
    return joined.withColumn(rank, (F.col("inside_") + F.col("before_")).cast("long")).drop("band_", "group_", "of_band_", "before_", "inside_")


def complement(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Gaps of each contig in the dictionary (idx, name, length); contigs outside it vanish."""
    spans = merge(df).join(F.broadcast(dictionary.select(F.col("name").alias("contig"), "length")), "contig", "right")
    order = W.partitionBy("contig").orderBy("start")
    prior = F.coalesce(F.lag("end").over(order), F.lit(0))
    before = spans.select("contig", (prior + 1).alias("start"), (F.coalesce("start", F.col("length") + 1) - 1).alias("end"))
    last = spans.groupBy("contig").agg(F.max("end").alias("reach"), F.first("length").alias("length")).filter("reach is not null")
    after = last.select("contig", (F.col("reach") + 1).alias("start"), F.col("length").alias("end"))
    return before.unionByName(after).filter("start <= end")


def pad_and_clamp(df: DataFrame, dictionary: DataFrame, left: int, right: int) -> DataFrame:
    """Pad and cut at the contig's ends; emptied intervals are dropped."""
    joined = df.join(F.broadcast(dictionary.select(F.col("name").alias("contig"), "length")), "contig")
    padded = joined.withColumn("start", F.greatest(F.col("start") - left, F.lit(1))).withColumn("end", F.least(F.col("end") + right, F.col("length")))
    return padded.filter("start <= end").drop("length")


def split_bands(df: DataFrame, band: int) -> DataFrame:
    """Cut at multiples of ``band``; an interval inside one band passes through, pieces get names with .1, .2, …"""
    first, last = F.floor(F.col("start") / band), F.floor(F.col("end") / band)
    pieces = df.withColumn("b", F.explode(F.when(first < last, F.sequence(first, last)).otherwise(F.array(first))))
    inside = pieces.withColumn("cut", first < last)
    return inside.select(
        *[c for c in df.columns if c not in ("start", "end", "name")],
        F.greatest("start", F.col("b") * band).alias("start"), F.least("end", (F.col("b") + 1) * band - 1).alias("end"),
        F.when(F.col("cut"), F.concat(F.coalesce("name", F.lit("null")), F.lit("."), F.col("b") - first + 1)).otherwise(F.col("name")).alias("name"))


def _levels(df: DataFrame, buffer: int, bin_width: int, tag: str) -> DataFrame:
    """Rows that a buffer leaves something of, with their span and the level whose cells are as wide as they are long."""
    s, e = F.col("start") + buffer, F.col("end") - buffer
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(e - s < bin_width * STEP**i, i).otherwise(level)
    return df.withColumn(f"{tag}s", s).withColumn(f"{tag}e", e).filter(F.col(f"{tag}s") <= F.col(f"{tag}e")).withColumn(f"{tag}level", level)


def overlap_join(left: DataFrame, right: DataFrame, left_buffer: int = 0, right_buffer: int = 0, how: str = "inner", bin_width: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs of overlapping intervals; ``right``'s columns get the suffix ``_r`` (or another, as names must not clash).

    A positive buffer shrinks its side; intervals that it empties match
    nothing. Rows of one span are copies as far as the join goes: they meet as one row with
    its members (at most ``MEMBERS``; more go on in further rows), and members are
    put out where two spans have met. So what is compared and shuffled grows with the distinct
    spans, and pairs cost no more than writing them. As a row that is shuffled can become a
    million pairs, sizes of shuffled data don't tell how many tasks they need: cells are dealt to ``SPREAD`` times the session's
    shuffle partitions, and members are in order, so that what a task writes has few values, in runs. Select the columns that are wanted
    before: all of them travel with their span. ``how`` may be left_semi or left_anti; these look each
    distinct interval up once, in the merged spans of ``right``, and keep repeated rows.
    Null contigs and places match nothing.
    """
    keys = ["contig", "start", "end"]
    if how != "inner":
        s, e = F.col("start") + right_buffer, F.col("end") - right_buffer
        reach = merge(right.select("contig", s.alias("start"), e.alias("end")).filter("start <= end").distinct()).select(*keys)
        hits = _meeting_spans(left.select(*keys).distinct(), reach.withColumnsRenamed({c: c + suffix for c in keys}), left_buffer, 0, bin_width, suffix).select(*keys).distinct()
        return left.join(hits, keys, how).select(*left.columns)
    renamed = {c: c + suffix for c in right.columns}
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in renamed.values()}:
        raise ValueError(f"both sides would have {sorted(clash)}: choose another suffix")
    used = [*left.columns, *renamed.values()]
    ml, mr = _free("_members_l", used), _free("_members_r", used)
    tasks = SPREAD * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _meeting_spans(_gathered(left, keys, ml), _gathered(right.withColumnsRenamed(renamed), [k + suffix for k in keys], mr), left_buffer, right_buffer, bin_width, suffix, tasks)
    each = pairs.withColumn(mr, F.explode(mr)).withColumn(ml, F.explode(ml))

    def of(columns: list[str], own: list[str], members: str) -> list[Column]:
        others = [c for c in columns if c not in own]
        return [F.col(c) if c in own else (F.col(members) if len(others) == 1 else F.col(members)[c]).alias(c) for c in columns]

    return each.select(*of(left.columns, keys, ml), *of(list(renamed.values()), [k + suffix for k in keys], mr))


def _free(name: str, used: list[str]) -> str:
    """A name that begins no used column."""
    while any(c.lower().startswith(name) for c in used):
        name = "_" + name
    return name


def _gathered(df: DataFrame, keys: list[str], members: str) -> DataFrame:
    """A row per span (``keys``) and up to ``MEMBERS`` of its rows, whose other columns are the array ``members`` (of structs, or of the one other column).

    Members are sorted by their texts, then by flags, then by numbers; other kinds don't count.
    """
    others = [c for c in df.columns if c not in keys]
    place = _free("_place", df.columns)
    kinds = dict(df.dtypes)
    order = [c for kind in ("string", "boolean", "int", "bigint") for c in others if kinds[c] == kind] or keys[1:2]
    numbered = df.filter(F.col(keys[0]).isNotNull()).withColumn(
        place, F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / MEMBERS))
    found = numbered.groupBy(*keys, place).agg(F.collect_list(F.struct(*(others or [F.lit(1).alias(place)]))).alias(members)).drop(place)
    return found.withColumn(members, F.col(members)[others[0]]) if len(others) == 1 else found


def _meeting_spans(left: DataFrame, right: DataFrame, left_buffer: int, right_buffer: int, bin_width: int, suffix: str, tasks: int | None = None) -> DataFrame:
    """Pairs of rows whose spans overlap; ``right``'s columns end in the suffix already.

    Cells have levels, each ``STEP`` times as wide as the one below; an
    interval lies in at most two cells of its own level, the narrowest that is
    as wide as it is long. A pair meets at the higher of its two levels, in the
    first cell that both reach, so once. Which levels a side has is one number, a
    scalar subquery of the plan: building it runs no job. Rows are joined on
    (contig, level, cell), so neither side needs to fit in memory, few long
    intervals don't widen the cells of the many short ones, and cells that stay hot
    are split by adaptive execution, or are one of many ``tasks`` if their number is given.
    """
    tag = _free("_x", [*left.columns, *right.columns])  # helper columns begin with what no column of either side does
    a, b = _levels(left, left_buffer, bin_width, f"{tag}l_"), _levels(right.withColumns({"start": F.col("start" + suffix), "end": F.col("end" + suffix)}), right_buffer, bin_width, f"{tag}r_")
    b = b.drop("start", "end")
    width = lambda at: F.element_at(F.lit([bin_width * STEP**i for i in range(LEVELS)]), at + 1)

    def cells(df: DataFrame, side: str, other: DataFrame, other_side: str) -> DataFrame:
        """One row per cell of the own level (if the other side has that or a lower one) and of each higher level that it has."""
        mask = other.agg(F.coalesce(F.bit_or(F.element_at(F.lit([1 << i for i in range(LEVELS)]), F.col(f"{other_side}level") + 1)), F.lit(0)).alias("mask")).scalar()
        level = F.col(f"{side}level")
        rows = df.withColumn(f"{side}mask", mask)
        own = F.filter(F.array(level), lambda x: F.col(f"{side}mask").bitwiseAND(F.element_at(F.lit([(2 << i) - 1 for i in range(LEVELS)]), level + 1)) != 0)
        higher = F.filter(F.lit(list(range(LEVELS))), lambda x: (x > level) & (F.col(f"{side}mask").bitwiseAND(F.element_at(F.lit([1 << i for i in range(LEVELS)]), x + 1)) != 0))
        at = rows.withColumn(f"{side}at", F.explode(F.concat(own, higher))).withColumn(f"{side}first", F.floor(F.col(f"{side}s") / width(F.col(f"{side}at"))))
        return at.withColumn(f"{side}cell", F.explode(F.sequence(f"{side}first", F.floor(F.col(f"{side}e") / width(F.col(f"{side}at"))))))

    x, y = f"{tag}l_", f"{tag}r_"
    ca, cb = cells(a, x, b, y), cells(b, y, a, x)
    if tasks:
        ca, cb = ca.repartition(tasks, "contig", f"{x}at", f"{x}cell"), cb.repartition(tasks, "contig" + suffix, f"{y}at", f"{y}cell")
    c = F.col
    meets = (c("contig") == c("contig" + suffix)) & (c(x + "at") == c(y + "at")) & (c(x + "cell") == c(y + "cell"))
    once = (c(x + "at") == F.greatest(c(x + "level"), c(y + "level"))) & (c(x + "cell") == F.greatest(c(x + "first"), c(y + "first")))
    pairs = ca.join(cb, meets & once & (c(x + "s") <= c(y + "e")) & (c(x + "e") >= c(y + "s")))
    return pairs.select(*left.columns, *right.columns)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common parts; the left strand stays and names are joined by `` intersection `` (null reads ``null``)."""
    pairs = overlap_join(left, right)
    return pairs.withColumn("from", F.greatest("start", "start_r")).withColumn("to", F.least("end", "end_r")).withColumn(
        "both", F.concat(F.coalesce("name", F.lit("null")), F.lit(" intersection "), F.coalesce("name_r", F.lit("null"))))


def within_distance(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Pairs that overlap once one side is padded by ``distance``."""
    return overlap_join(left, right, left_buffer=-distance)
