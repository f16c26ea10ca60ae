"""Column functions over alignment records: flags, CIGAR, bins, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))
CIGAR = "array<struct<len:int,op:string>>"


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def _length(cigar: Column, ops: str) -> Column:
    return F.aggregate(
        F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["len"])


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that the alignment spans."""
    return _length(cigar, "MDN=X")


def read_length(cigar: Column) -> Column:
    return _length(cigar, "MIS=X")


def alignment_end(flags: Column, pos: Column, cigar: Column) -> Column:
    """Last reference base (0 if unmapped)."""
    return F.when(has_flag(flags, UNMAPPED), 0).otherwise(pos + reference_length(cigar) - 1)


def render_cigar(cigar: Column) -> Column:
    """Text form; ``*`` if empty."""
    return F.when(F.size(cigar) == 0, "*").otherwise(F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""))


def parse_cigar(text: Column) -> Column:
    """Elements of a text form (``*`` is empty); null if it is malformed or a length is beyond an int."""
    part = r"([0-9]+)([MIDNSHP=X])"
    lengths = F.regexp_extract_all(text, F.lit(part), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(part), F.lit(2))
    elements = F.zip_with(lengths, ops, lambda n, o: F.struct(n.try_cast("int").alias("len"), o.alias("op")))
    return F.when(text == "*", F.array().cast(CIGAR)).when(text.rlike(f"^(?:{part})+$") & ~F.exists(lengths, lambda n: n.try_cast("int").isNull()), elements)


def alignment_blocks(pos: Column, cigar: Column) -> Column:
    """Aligned blocks (read_start, ref_start, len), 1-based; adjacent M are not merged."""
    zero = F.struct(F.lit(1).cast("long").alias("read"), pos.cast("long").alias("ref"), F.array().cast("array<struct<read_start:bigint,ref_start:bigint,len:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        block = F.array(F.struct(a["read"].alias("read_start"), a["ref"].alias("ref_start"), n.alias("len")))
        return F.struct(
            (a["read"] + F.when(op.isin("M", "I", "S", "=", "X"), n).otherwise(0)).alias("read"),
            (a["ref"] + F.when(op.isin("M", "D", "N", "=", "X"), n).otherwise(0)).alias("ref"),
            F.when(op.isin("M", "=", "X"), F.concat(a["out"], block)).otherwise(a["out"]).alias("out"))

    return F.aggregate(cigar, zero, step, lambda a: a["out"])


def soft_clip_from(cigar: Column, clip_from: Column) -> Column:
    """Soft-clip a read from its 1-based position ``clip_from`` to its end; trailing hard clips stay."""
    tail = F.when(F.element_at(cigar, -1)["op"] == "H", F.slice(cigar, -1, 1)).otherwise(F.array().cast(CIGAR))
    body = F.when(F.size(tail) > 0, F.slice(cigar, 1, F.size(cigar) - 1)).otherwise(cigar)
    zero = F.struct(F.lit(0).alias("read"), F.array().cast(CIGAR).alias("out"))

    def step(a: Column, x: Column) -> Column:
        reads = x["op"].isin("M", "I", "S", "=", "X")
        kept = F.greatest(F.lit(0), F.least(x["len"], clip_from - 1 - a["read"]))
        n = F.when(reads, kept).when(a["read"] < clip_from - 1, x["len"]).otherwise(0)
        return F.struct(
            (a["read"] + F.when(reads, x["len"]).otherwise(0)).alias("read"),
            F.when(n > 0, F.concat(a["out"], F.array(F.struct(n.cast("int").alias("len"), x["op"].alias("op"))))).otherwise(a["out"]).alias("out"))

    def clipped(a: Column) -> Column:  # the walk's result is bound here, so that it is walked once
        front, total = a["out"], a["read"]
        trimmed = F.when((F.size(front) > 0) & F.element_at(front, -1)["op"].isin("D", "N", "S"), F.slice(front, 1, F.size(front) - 1)).otherwise(front)
        merged = F.when((F.size(front) > 0) & (F.element_at(front, -1)["op"] == "S"), F.element_at(front, -1)["len"]).otherwise(0)
        clip = F.array(F.struct((total - clip_from + 1 + merged).cast("int").alias("len"), F.lit("S").alias("op")))
        return F.when(clip_from > total, cigar).otherwise(F.concat(trimmed, clip, tail))

    return F.aggregate(body, zero, step, clipped)


def region_bin(start: Column, end: Column) -> Column:
    """The smallest bin of the six-level scheme that holds 0-based half-open [start, end); null beyond 512 Mbp."""
    last = F.greatest(end, start + 1) - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.lit(offset) + F.shiftright(start, shift)).otherwise(out)
    return F.when((start >= 0) & (last < 1 << 29), out.cast("int"))


def linear_window(pos: Column) -> Column:
    """The 16 kb window of a 1-based position."""
    return F.shiftright(pos - 1, 14)


def coordinate_keys(prefix: str = "") -> list[Column]:
    """Sort keys of coordinate order: unmapped last and equal in position, then strand, name, flags and quality."""
    c = lambda n: F.col(prefix + n)
    placed = c("ref_index") >= 0
    return [~placed, c("ref_index"), F.when(placed, c("pos")), has_flag(c("flags"), REVERSE), c("read_name"), c("flags"), c("mapq")]


def queryname_keys(prefix: str = "") -> list[Column]:
    """Sort keys of query-name order: name, paired, first of pair, forward, primary, not supplementary."""
    c = lambda n: F.col(prefix + n)
    f = c("flags")
    return [c("read_name"), ~has_flag(f, PAIRED), ~has_flag(f, FIRST), has_flag(f, REVERSE), has_flag(f, SECONDARY), has_flag(f, SUPPLEMENTARY)]


def sentinel_cigar(cigar: Column) -> Column:
    """What stands in for a CIGAR of too many elements: the read's length clipped, then the reference length skipped."""
    part = lambda n, op: F.struct(n.cast("int").alias("len"), F.lit(op).alias("op"))
    return F.array(part(read_length(cigar), "S"), part(reference_length(cigar), "N"))


def inserted_bases(cigar: Column) -> Column:
    return _length(cigar, "I")


def deleted_bases(cigar: Column) -> Column:
    """Deleted bases; skipped regions are none."""
    return _length(cigar, "D")
