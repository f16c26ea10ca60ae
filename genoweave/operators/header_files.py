"""Headers of alignment files as editable rows: setting fields, replacing headers, gathering files under one header.

Files are ``files.numbered_lines``: (file, line, value). Only header lines are
rewritten; body lines pass by untouched, with a number shifted by one value per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The field that names a line of a kind.
NAMED_BY = {"@SQ": "SN", "@RG": "ID", "@PG": "ID"}


def set_field(line: Column, key: Column | str, value: Column | str | None) -> Column:
    """The header line with a field set: an existing one keeps its place, a new one goes last, a null value removes it.

    Comments have no fields and stay as they are; a null line stays null.
    """
    key, value = (x if isinstance(x, Column) else F.lit(x) for x in (key, value))
    value = value.cast("string")
    parts = F.split(line, "\t")
    start = F.concat(key, F.lit(":"))
    fields = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    without = F.filter(fields, lambda x: ~x.startswith(start))
    new = F.concat(start, value)
    placed = F.transform(fields, lambda x: F.when(x.startswith(start), new).otherwise(x))
    chosen = F.when(value.isNull(), without).when(F.exists(fields, lambda x: x.startswith(start)), placed).otherwise(F.concat(fields, F.array(new)))
    return F.when(line.startswith("@CO"), line).otherwise(F.array_join(F.concat(F.slice(parts, 1, 1), chosen), "\t"))


def line_name(line: Column) -> Column:
    """The name of a header line among its kind (sequence, read group, program); empty for other kinds."""
    found = F.lit("")
    for kind, field in NAMED_BY.items():
        found = F.when(line.startswith(kind + "\t"), F.regexp_extract(line, f"\t{field}:([^\t]*)", 1)).otherwise(found)
    return found


def edit(lines: DataFrame, edits: DataFrame, file: str = "file", line: str = "value") -> DataFrame:
    """Header lines with the fields that ``edits`` (file, kind, name, ord, key, value) set, in the order of ``ord``.

    ``kind`` is the line's first field (@RG), ``name`` as by ``line_name``. Lines
    without edits stay; edits without a line do nothing.
    """
    step = F.struct("ord", "key", F.col("value").alias("to"))
    wanted = edits.groupBy(F.col("file").alias("file_"), F.col("kind").alias("kind_"), F.col("name").alias("name_")).agg(F.array_sort(F.collect_list(step)).alias("steps_"))
    same = (F.col(file) == F.col("file_")) & (F.split(line, "\t")[0] == F.col("kind_")) & (line_name(F.col(line)) == F.col("name_"))
    edited = F.aggregate("steps_", F.col(line), lambda text, s: set_field(text, s["key"], s["to"]))
    return lines.join(wanted, same, "left").withColumn(line, F.when(F.col("steps_").isNull(), F.col(line)).otherwise(edited)).drop("file_", "kind_", "name_", "steps_")


def _bodies(numbered: DataFrame) -> DataFrame:
    """(file_, head_, size_) of each file: its header lines (those before the first without an @) and all its lines."""
    first = F.min(F.when(~F.col("value").startswith("@"), F.col("line")))
    return numbered.groupBy(F.col("file").alias("file_")).agg(F.coalesce(first, F.max("line") + 1).alias("head_"), (F.max("line") + 1).alias("size_"))


def split_header(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The header lines and the body lines, each (file, line, value)."""
    known = numbered.join(_bodies(numbered), F.col("file") == F.col("file_"))
    pick = lambda cond: known.filter(cond).select("file", "line", "value")
    return pick(F.col("line") < F.col("head_")), pick(F.col("line") >= F.col("head_"))


def reheader(numbered: DataFrame, header: DataFrame) -> DataFrame:
    """(file, line, value) with each file's header replaced by its lines in ``header`` (file, line, value; numbers only order them).

    Files without a line there keep their header. Body lines keep value and order.
    """
    fresh = header.select("file", (F.row_number().over(W.partitionBy("file").orderBy("line")) - 1).cast("long").alias("line"), "value")
    sizes = header.groupBy(F.col("file").alias("of_file_")).agg(F.count(F.lit(1)).alias("new_"))
    files = _bodies(numbered).join(sizes, F.col("file_") == F.col("of_file_"), "left")
    known = numbered.join(files, F.col("file") == F.col("file_"))
    kept = known.filter(F.col("new_").isNull() | (F.col("line") >= F.col("head_")))
    moved = kept.select("file", (F.col("line") + F.coalesce(F.col("new_") - F.col("head_"), F.lit(0))).alias("line"), "value")
    return moved.unionByName(fresh.join(files.select("file_"), F.col("file") == F.col("file_"), "left_semi"))


def gather(numbered: DataFrame, place: Column) -> DataFrame:
    """(line, value) of all files as one, in the order of ``place`` (of ``file``): the first file's header, then every body."""
    per_file = _bodies(numbered)
    at = W.orderBy("place_")  # one row a file
    lines = F.when(F.row_number().over(at) == 1, F.col("size_")).otherwise(F.col("size_") - F.col("head_"))
    ranked = per_file.join(numbered.select(F.col("file").alias("f_"), place.alias("place_")).distinct(), F.col("file_") == F.col("f_")).drop("f_")
    counted = ranked.withColumn("dropped_", F.when(F.row_number().over(at) == 1, F.lit(0).cast("long")).otherwise(F.col("head_"))).withColumn("lines_", lines)
    before = F.coalesce(F.sum("lines_").over(at.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    shifts = counted.select("file_", "dropped_", (before - F.col("dropped_")).alias("shift_"))
    known = numbered.join(shifts, F.col("file") == F.col("file_")).filter(F.col("line") >= F.col("dropped_"))
    return known.select((F.col("line") + F.col("shift_")).alias("line"), "value")
