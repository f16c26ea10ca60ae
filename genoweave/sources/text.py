"""Readers of line formats as column expressions: they run on ``spark.read.text`` and on ``readStream`` alike.

Each takes a DataFrame with a ``value`` column (one line a row) and keeps the
columns named in ``keep``. Malformed rows are errors in a column or nulls, as
stated, never lost silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.alignment import parse_cigar


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of text files (compressed ones too), as a batch or a stream."""
    return (spark.readStream if streaming else spark.read).text(path)


def bed(df: DataFrame, keep: list[str] = (), start_offset: int = 1) -> DataFrame:
    """BED rows: contig, start (shifted), end, name (quotes removed), score, strand; blank and header lines give no row.

    Fields part at tabs, or at runs of spaces where there is no tab. Two fields
    make a one-base feature. A score that is no number drops what follows it.
    ``error`` is ``number`` where a place is no number (the places are null
    then), else null.
    """
    body = df.filter((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    f = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split(F.trim("value"), " +"))
    rows = body.select(*keep, f.alias("f")).filter(F.size("f") >= 2)
    at = lambda i: F.get("f", F.lit(i))
    start, end = at(1).try_cast("long") + start_offset, at(2).try_cast("long")
    error = F.when(start.isNull() | ((F.size("f") > 2) & end.isNull()), "number")
    score = F.when(at(4) == ".", F.lit(float("nan")).cast("float")).otherwise(at(4).try_cast("float"))
    on = (F.size("f") > 4) & score.isNotNull()
    return rows.select(
        *keep, at(0).alias("contig"), F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), F.coalesce(end, start)).alias("end"),
        F.regexp_replace(F.coalesce(at(3), F.lit("")), '"', "").alias("name"), score.alias("score"),
        F.when(on & at(5).isin("+", "-"), at(5)).alias("strand"), error.alias("error"))


def interval_list(df: DataFrame, strict: bool, keep: list[str] = ()) -> DataFrame:
    """Interval-list rows: contig, start, end, negative, name, error.

    The strict form asks for exactly five fields, a + or - strand and
    start <= end + 1, and takes names verbatim. The lenient form asks for five
    or more, takes any other strand as + and a name ``.`` as none. Header lines
    (``@``) and blank ones give no row; a bad line has its error and nulls.
    """
    body = df.filter((F.trim("value") != "") & ~F.col("value").startswith("@"))
    rows = body.select(*keep, F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    start, end = at(1).try_cast("long"), at(2).try_cast("long")
    error = F.when((F.size("f") != 5) if strict else (F.size("f") < 5), "fields").when(start.isNull() | end.isNull(), "number")
    if strict:
        error = error.when(start > end + 1, "order").when(~at(3).isin("+", "-"), "strand")
    good = error.isNull()
    name = at(4) if strict else F.when(at(4) != ".", at(4))
    return rows.select(
        *keep, F.when(good, at(0)).alias("contig"), F.when(good, start).alias("start"), F.when(good, end).alias("end"),
        F.when(good, at(3) == "-").alias("negative"), F.when(good, name).alias("name"), error.alias("error"))


def sam(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Alignment rows of SAM text: the eleven fields and a map of tags (TAG -> TYPE:VALUE); header lines give no row.

    ``*`` is null for bases and qualities. ``error`` names what is wrong with a
    line (``fields``, ``number``, ``cigar``), else null; what doesn't parse is null.
    Of a repeated tag the last counts.
    """
    rows = df.filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(*keep, F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    numbers = {i: at(i).try_cast(kind) for i, kind in ((1, "int"), (3, "long"), (4, "int"), (7, "long"), (8, "long"))}
    bad = numbers[1].isNull()
    for i in (3, 4, 7, 8):
        bad = bad | numbers[i].isNull()
    error = F.when(F.size("f") < 11, "fields").when(bad, "number").when(F.col("cigar").isNull(), "cigar")
    star = lambda c: F.when(c != "*", c)
    # a column of its own, so that what reads it more than once doesn't parse it again
    parsed = rows.withColumn("cigar", parse_cigar(at(5)))
    return parsed.select(
        *keep, at(0).alias("read_name"), numbers[1].alias("flags"), at(2).alias("ref_name"), numbers[3].alias("pos"), numbers[4].alias("mapq"),
        "cigar", at(6).alias("mate_ref_name"), numbers[7].alias("mate_pos"), numbers[8].alias("tlen"),
        star(at(9)).alias("bases"), star(at(10)).alias("quality"), tag_map(F.slice("f", 12, 1 << 20)).alias("tags"), error.alias("error"))


def tag_map(fields: Column) -> Column:
    """Tags (TAG -> TYPE:VALUE) of text fields TAG:TYPE:VALUE; the last of a repeated tag, fields of another shape left out."""
    good = F.filter(fields, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    entries = F.transform(good, lambda t, i: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 4, 1 << 30).alias("value"), i.alias("i")))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def tag_value(value: Column) -> Column:
    """A tag's typed value as (type, integer, number, text, numbers); null fields where the type has none, null for a value that doesn't fit its type."""
    kind, text = F.substring(value, 1, 1), F.substring(value, 3, 1 << 30)
    parts = F.slice(F.split(text, ","), 2, 1 << 20)
    whole = F.when(kind == "i", text.try_cast("long"))
    number = F.when(kind == "f", text.try_cast("double"))
    numbers = F.when(kind == "B", F.transform(parts, lambda x: x.try_cast("double")))
    good = (F.when(kind == "i", whole.isNotNull()).when(kind == "f", number.isNotNull()).when(kind == "A", F.length(text) == 1)
            .when(kind == "H", text.rlike("^([0-9A-Fa-f]{2})*$")).when(kind == "B", text.rlike("^[cCsSiIf](,|$)") & ~F.exists(numbers, lambda x: x.isNull())).otherwise(kind == "Z"))
    return F.when(good, F.struct(kind.alias("type"), whole.alias("integer"), number.alias("number"), F.when(kind.isin("A", "Z", "H"), text).alias("text"), numbers.alias("numbers")))


def render_tags(tags: Column) -> Column:
    """Tags as fields of a line, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")


def vcf_records(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Site columns of VCF text: contig, start, stop, id, alleles, qual, filter, info (text), and the genotype block undecoded.

    ``stop`` comes from INFO's END, else from the reference allele. Lines
    beginning with ``#`` give no row. The reference allele is upper case.
    ``error`` is ``fields`` for fewer than eight fields, ``number`` where a
    place is no number (null then), else null.
    """
    rows = df.filter(~F.col("value").startswith("#")).select(*keep, F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    start = at(1).try_cast("long")
    error = F.when(F.size("f") < 8, "fields").when(start.isNull(), "number")
    declared = F.regexp_extract(at(7), "(?:^|;)END=([0-9]+)", 1)
    alts = F.filter(F.split(at(4), ","), lambda a: a != ".")
    return rows.select(
        *keep, at(0).alias("contig"), start.alias("start"), F.when(declared != "", declared.try_cast("long")).otherwise(start + F.length(at(3)) - 1).alias("stop"),
        at(2).alias("id"), F.concat(F.array(F.upper(at(3))), alts).alias("alleles"), at(5).alias("qual"), at(6).alias("filter"), at(7).alias("info"),
        F.when(F.size("f") > 8, F.array_join(F.slice("f", 9, 1 << 20), "\t")).alias("genotypes"), error.alias("error"))


def render_vcf() -> Column:
    """A line from the columns of ``vcf_records``."""
    alts = F.slice("alleles", 2, 1 << 20)
    site = F.concat_ws("\t", "contig", F.col("start").cast("string"), "id", F.col("alleles")[0], F.when(F.size(alts) == 0, ".").otherwise(F.array_join(alts, ",")), "qual", "filter", "info")
    return F.concat(site, F.coalesce(F.concat(F.lit("\t"), F.col("genotypes")), F.lit("")))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of FASTQ files: (file, read, name, bases, quality, error), see ``files.fastq_reads``."""
    from .files import fastq_reads, numbered_lines

    return fastq_reads(numbered_lines(spark, path))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequences (name up to white space, bases with their case) of FASTA files."""
    chunks = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    rows = F.split("value", "\n")
    bases = F.array_join(F.transform(F.slice(rows, 2, 1 << 30), lambda x: F.rtrim(F.regexp_replace(x, "\\s+$", ""))), "")
    return chunks.select(F.regexp_extract(rows[0], "^\\S*", 0).alias("name"), bases.alias("bases"))


def write_lines(df: DataFrame, column: str, path: str, compression: str | None = None) -> None:
    """Write one column as text files."""
    df.select(F.col(column).alias("value")).write.text(path, compression=compression)


def header_attributes(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Alignment header lines as rows: kind (HD, SQ, …), ord of the attribute, key, value; other lines give none."""
    lines_ = df.filter(F.col("value").rlike("^@(HD|SQ|RG|PG)\t"))
    attributes = F.slice(F.split("value", "\t"), 2, 1 << 20)
    rows = lines_.select(*keep, F.substring("value", 2, 2).alias("kind"), F.posexplode(attributes).alias("ord", "a"))
    return rows.select(*keep, "kind", "ord", F.substring("a", 1, 2).alias("key"), F.substring("a", 4, 1 << 30).alias("value"))


def variant_header_fields(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Structured variant header lines as (kind, id, number, type, description); a quoted value may hold commas, and quotes and backslashes behind a backslash."""
    body = df.filter(F.col("value").rlike("^##[A-Za-z]+=<.*>$"))
    inner = F.regexp_extract("value", "^##[A-Za-z]+=<(.*)>$", 1)
    field = r'([A-Za-z0-9_.]+)=("(?:[^"\\]|\\.)*"|[^,]*)'
    pairs = F.arrays_zip(F.regexp_extract_all(inner, F.lit(field), F.lit(1)).alias("k"), F.regexp_extract_all(inner, F.lit(field), F.lit(2)).alias("v"))
    last = lambda key: F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]
    quoted = lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), r'\\(["\\])', "$1")).otherwise(c)
    return body.select(*keep, F.regexp_extract("value", "^##([A-Za-z]+)=", 1).alias("kind"), last("ID").alias("id"), last("Number").alias("number"), last("Type").alias("type"), quoted(last("Description")).alias("description"))


def chain_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of liftover chain files, see ``files.chains``; a chain that is wrong is one row with its error and no places."""
    from .files import chains, numbered_lines

    return chains(numbered_lines(spark, path))


def bed_exons(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Exons of twelve-column BED lines: start, end, coding_start, coding_end, number; and the line's colour.

    Coding bounds are cut to the exon; numbers run backwards on the negative
    strand. Lists longer than the count are cut; a count of 0, a shorter list
    or a bad number gives the ``error`` ``exons`` and no exon.
    """
    f = lambda i: F.get("f", F.lit(i))
    rows = df.select(*keep, F.split("value", "\t").alias("f")).filter(F.size("f") >= 12)
    count, start = f(9).try_cast("int"), f(1).try_cast("long") + 1
    numbers = lambda c: F.transform(F.slice(F.split(c, ","), F.lit(1), F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))), lambda x: x.try_cast("long"))
    sizes, starts = numbers(f(10)), numbers(f(11))
    coding, coding_end = f(6).try_cast("long") + 1, f(7).try_cast("long")
    wrong = lambda a: (F.size(a) < count) | F.exists(a, lambda x: x.isNull())
    bad = count.isNull() | (count <= 0) | start.isNull() | coding.isNull() | coding_end.isNull() | wrong(sizes) | wrong(starts)

    def exon(p: Column, i: Column) -> Column:
        first = start + p["starts"]
        last = first + p["sizes"] - 1
        return F.struct(first.alias("start"), last.alias("end"), F.greatest(coding, first).alias("coding_start"), F.least(coding_end, last).alias("coding_end"),
                        F.when(f(5) == "-", count - i).otherwise(i + 1).cast("int").alias("number"))

    exons = F.transform(F.arrays_zip(starts.alias("starts"), sizes.alias("sizes")), exon)
    return rows.select(*keep, F.when(~F.coalesce(bad, F.lit(True)), exons).alias("exons"), bed_colour(f(8)).alias("colour"), F.when(F.coalesce(bad, F.lit(True)), "exons").alias("error"))


def bed_colour(text: Column) -> Column:
    """Red, green and blue of ``r,g,b`` or ``#rrggbb``; black for anything else, null for a part outside 0 to 255."""
    parts = F.transform(F.slice(F.split(text, ","), 1, 3), lambda x: F.trim(x).try_cast("int"))
    black = F.array(F.lit(0), F.lit(0), F.lit(0))
    digits = F.transform(F.array(F.lit(2), F.lit(4), F.lit(6)), lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("int"))
    triple = (F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull())
    return (F.when(text.contains(",") & triple, F.when(~F.exists(parts, lambda x: ~x.between(0, 255)), parts)).when(text.rlike("^#[0-9A-Fa-f]{6}$"), digits).otherwise(black))


def is_bed_path(path: Column) -> Column:
    """A name ending in .bed, before one compressed extension if there is one; case doesn't matter."""
    return F.regexp_replace(F.lower(path), r"\.(gz|gzip|bgz|bgzf)$", "").endswith(".bed")


def interval_line(contig: Column, start: Column, end: Column, negative: Column, name: Column) -> Column:
    """An interval-list line; no name is a dot."""
    return F.concat_ws("\t", contig, start.cast("string"), end.cast("string"), F.when(negative, "-").otherwise("+"), F.coalesce(name, F.lit(".")))


def fastq_lines(df: DataFrame, order: str, keys: list[str] = ()) -> DataFrame:
    """Reads of rows (order, value) that number the lines of a file from 0: name, bases, quality, error.

    Four lines are a read, whatever they hold, so nothing is lost: ``error`` is
    ``header`` without ``@``, ``separator`` without ``+``, ``length`` where bases
    and qualities differ in length, ``truncated`` where lines are missing,
    ``blank`` where one of them holds nothing but white space.
    """
    place = F.col(order) % 4
    at = lambda i: F.max(F.when(place == i, F.col("value")))
    reads = df.groupBy(*keys, F.floor(F.col(order) / 4).alias("read")).agg(*(at(i).alias(f"l{i}") for i in range(4)), F.count(F.lit(1)).alias("lines"))
    error = (F.when(F.col("lines") < 4, "truncated").when(~F.col("l0").startswith("@"), "header").when(~F.col("l2").startswith("+"), "separator")
             .when((F.trim("l1") == "") | (F.trim("l3") == ""), "blank")
             .when(F.octet_length("l1") != F.octet_length("l3"), "length"))
    return reads.select(*keys, "read", F.substring("l0", 2, 1 << 30).alias("name"), F.col("l1").alias("bases"), F.col("l3").alias("quality"), error.alias("error"))
