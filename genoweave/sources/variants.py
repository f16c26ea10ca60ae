"""Variant files with their header: the frame of each file (version, samples, declared lines) meets its body lines by file.

A folder of files of several versions, declarations and sample orders is one
plan. Input are ``files.numbered_lines``; frames and declarations are aggregations
over header lines, one row a file, and join the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variant as va
from .text import variant_header_fields

#: The columns of every file, and the versions that files name (those read here first).
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")
READ_VERSIONS = ("VCFv4.0", "VCFv4.1", "VCFv4.2", "VCFv4.3")
OTHER_VERSIONS = ("VCRv3.2", "VCFv3.3", "VCFv4.4")


def _header(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, column_line, column_text, first_body) of every file, and the meta lines before its column line."""
    v, line = F.col("value"), F.col("line")
    columns, body = v.startswith("#") & ~v.startswith("##"), ~v.startswith("#")
    ends = numbered.groupBy("file").agg(
        F.min(F.when(columns, line)).alias("column_line"), F.min_by(F.when(columns, v), F.when(columns, line)).alias("column_text"), F.min(F.when(body, line)).alias("first_body"))
    reach = F.least(F.coalesce("column_line", "first_body"), F.coalesce("first_body", "column_line"))
    known = ends.select(F.col("file").alias("file_"), F.coalesce(reach, F.lit((1 << 62)).cast("long")).alias("reach_"))
    meta = numbered.filter(v.startswith("##")).join(known, (F.col("file") == F.col("file_")) & (F.col("line") < F.col("reach_"))).select("file", "line", "value")
    return ends, meta


def header_lines(numbered: DataFrame) -> DataFrame:
    """Structured meta lines before each file's column line: (file, line, kind, id, number, type, description)."""
    return variant_header_fields(_header(numbered)[1], keep=["file", "line"])


def frames(numbered: DataFrame) -> DataFrame:
    """One row a file: (file, version, samples, column_line, info, error).

    ``info`` maps each declared INFO key to its type and number (the first
    line of a key counts). Samples keep the order of the column line, a repeated
    name its first place. Errors: ``unsupported`` (a version nobody knows),
    ``version`` (one that isn't read here), ``no version``, ``no columns`` (the body begins before the
    column line), ``few columns``, ``column name``, ``format`` (the ninth isn't FORMAT), ``no samples`` (FORMAT alone).
    """
    ends, meta = _header(numbered)
    parts = va.split_dropping_trailing(F.substring("value", 3, 1 << 30), "=")
    named = meta.withColumn("p", parts).filter((F.size("p") == 2) & F.get("p", F.lit(0)).isin("format", "fileformat")).select("file", "line", F.col("p")[1].alias("version"))
    wrong = F.when(~F.col("version").isin(*READ_VERSIONS, *OTHER_VERSIONS), "unsupported").when(~F.col("version").isin(*READ_VERSIONS), "version")
    versions = named.withColumn("wrong", wrong).groupBy("file").agg(F.max_by("version", "line").alias("version"), F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("line"))).alias("wrong"))
    declared = variant_header_fields(meta, keep=["file", "line"]).filter("kind = 'INFO' and id is not null").groupBy("file", "id").agg(F.min_by(F.struct("type", "number"), "line").alias("d"))
    info = declared.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("id", "d"))).alias("info"))
    joined = ends.join(versions, "file", "left").join(info, "file", "left")
    c = va.split_dropping_trailing(F.substring("column_text", 2, 1 << 30), "\t")
    rows = joined.withColumn("c", c)
    misnamed = F.lit(False)
    for i, name in enumerate(COLUMNS):
        misnamed = misnamed | (F.get("c", F.lit(i)) != name)
    samples = F.array_distinct(F.slice("c", len(COLUMNS) + 2, 1 << 20))
    none = F.col("column_line").isNull() | (F.col("first_body") < F.col("column_line"))
    error = (F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.coalesce(none, F.lit(False)), "no columns").when(F.col("version").isNull(), "no version").when(F.size("c") < len(COLUMNS), "few columns")
             .when(misnamed, "column name").when(F.get("c", F.lit(len(COLUMNS))) != "FORMAT", "format").when(F.size("c") == len(COLUMNS) + 1, "no samples"))
    return rows.select("file", "version", F.coalesce(samples, F.array().cast("array<string>")).alias("samples"), "column_line",
                       F.coalesce("info", F.create_map().cast("map<string,struct<type:string,number:string>>")).alias("info"), error.alias("error"))


def attribute_entries(text: Column, declared: Column, decode: Column) -> Column:
    """INFO text as an array of (key, value: (flag, values), gone).

    A bare key is a flag, or missing (no values) if it is declared as something else;
    ``KEY=`` is missing; a declared Flag written ``KEY=0`` is left out. Values are
    percent-decoded where ``decode`` holds (keys never).
    """
    def one(e: Column) -> Column:
        at = F.instr(e, "=")
        key = F.when(at > 0, F.substr(e, F.lit(1), at - 1)).otherwise(e)
        raw = F.split(F.when(at > 0, F.substr(e, at + 1)), ",", -1)
        values = F.when(decode, F.transform(raw, va.percent_decode)).otherwise(raw)
        kind = F.try_element_at(declared, key)["type"]
        flag = values.isNull() & F.coalesce(kind == "Flag", F.lit(True))
        single = F.size(raw) == 1
        gone = F.coalesce(single & (kind == "Flag") & (values[0] == "0"), F.lit(False))
        kept = F.when(~F.coalesce(single & (values[0] == ""), F.lit(False)), values)
        return F.struct(key.alias("key"), F.struct(flag.alias("flag"), kept.alias("values")).alias("value"), gone.alias("gone"))

    return F.filter(F.transform(F.filter(F.split(text, ";", -1), lambda _: text != "."), one), lambda e: ~e["gone"])


def attribute_map(entries: str) -> Column:
    """A column of ``attribute_entries`` as a map; the last of a repeated key counts. It is a column of its own so that no entry is parsed twice."""
    e = F.col(entries)
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def _settled(c: Column) -> Column:
    """A value as a generated column of one row: a filter on it is applied to the value and doesn't repeat its expression further down."""
    return F.explode(F.array(c))


def records(numbered: DataFrame, frame: DataFrame) -> DataFrame:
    """Body lines of files with their frame, decoded by the file's version.

    (file, line, contig, start, stop, id, alleles, log10_error, filters, info, format, genotypes, samples, error,
    error_line). ``genotypes`` are the sample columns as text. Lines beginning with ``#`` give
    no row. A leading tab is stepped over. Errors: ``frame`` (the file's header is wrong),
    ``columns``, ``position``, ``id``, ``quality``, ``filter``, ``info``, ``end``, ``alleles``; a row with one has nulls. ``error_line``
    counts from 1; for ``columns`` it is that of the line before.
    """
    head = frame.select(F.col("file").alias("file_"), "version", "samples", "column_line", F.col("info").alias("declared"), F.col("error").alias("frame_error"))
    body = numbered.filter(~F.col("value").startswith("#")).join(head, F.col("file") == F.col("file_"))
    with_samples = F.size("samples") > 0
    text = F.when(F.col("value").startswith("\t"), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    parts = F.when(with_samples, F.split(text, "\t", 9)).otherwise(F.split(text, "\t", 8))
    rows = body.withColumn("p", parts).withColumn("expected", F.when(with_samples, 9).otherwise(8))
    at = lambda i: F.get("p", F.lit(i))
    decode = F.col("version") >= "VCFv4.3"
    entries = F.when((F.size("p") == F.col("expected")) & (at(7) != ""), attribute_entries(at(7), F.col("declared"), decode))
    rows = rows.withColumn("entries", _settled(entries)).withColumn("attributes", _settled(attribute_map("entries"))).drop("entries")
    start, quality = at(1).try_cast("long"), va.vcf_double(at(5))
    reference, alts = F.upper(at(3)), F.split(at(4), ",", -1)
    bad_alleles = (va.allele_kind(reference, F.lit(True)) != "bases") | va.allele_kind(reference, F.lit(True)).isNull() | F.exists(alts, lambda a: va.allele_kind(a, F.lit(False)).isNull())
    end = F.try_element_at("attributes", F.lit("END"))["values"]
    stop = F.get(end, F.lit(0)).try_cast("long")
    error = (F.when(F.col("frame_error").isNotNull(), "frame").when(F.size("p") != F.col("expected"), "columns").when(start.isNull(), "position").when(at(2) == "", "id")
             .when((at(5) != ".") & quality.isNull(), "quality").when(at(6).isin("", "0"), "filter").when((at(7) == "") | at(7).rlike("[\t ]"), "info").when(end.isNotNull() & stop.isNull(), "end").when(bad_alleles, "alleles"))
    rows = rows.withColumn("error", _settled(error))
    error, good = F.col("error"), F.col("error").isNull()
    log10 = F.when((at(5) == ".") | (F.abs(quality + 1) < 1e-6), 1.0).otherwise(quality / -10)
    filters = F.when(at(6) == "PASS", F.array().cast("array<string>")).when(at(6) != ".", F.split(at(6), ";", -1))
    alleles = F.concat(F.array(reference), F.filter(alts, lambda a: a != "."))
    block = F.split(at(8), "\t", -1)
    only = lambda c, name: F.when(good, c).alias(name)
    return rows.select(
        "file", "line", only(at(0), "contig"), only(start, "start"), only(F.coalesce(stop, start + F.length(reference) - 1), "stop"), only(at(2), "id"), only(alleles, "alleles"), only(log10, "log10_error"),
        only(filters, "filters"), only(F.col("attributes"), "info"), only(block[0], "format"), only(F.slice(block, 2, 1 << 20), "genotypes"), "samples", "error",
        F.when(error == "columns", F.col("line")).when(error.isNotNull(), F.col("line") + 1).alias("error_line"), "declared")


def expected_count(number: Column, n_alleles: Column) -> Column:
    """Values that a declared number asks for: A one per alternate, R one per allele, G one per diploid genotype; null for any (``.``)."""
    return (F.when(number == "A", n_alleles - 1).when(number == "R", n_alleles).when(number == "G", (n_alleles * (n_alleles + 1) / 2).cast("int")).otherwise(number.try_cast("int")))


def typed_attributes(info: Column, declared: Column, n_alleles: Column, keep_undeclared: bool = True) -> Column:
    """Attributes under their declared type: a map of key to (type, integers, numbers, texts, flag, error).

    A value of ``.`` is null in its array; a missing attribute has no array.
    Errors: ``type`` (a value that isn't of the type), ``count`` (not as many values as declared, checked against the
    alleles), ``flag`` (a Flag with values, or a key without where the type wants some), ``undeclared`` (unless such keys are kept, as texts).
    """
    def one(key: Column, v: Column) -> Column:
        d = F.try_element_at(declared, key)
        kind, values = F.coalesce(d["type"], F.lit("String")), v["values"]
        missing = lambda x: F.when(x != ".", x)
        integers = F.when(kind == "Integer", F.transform(values, lambda x: missing(x).try_cast("long")))
        numbers = F.when(kind == "Float", F.transform(values, lambda x: va.vcf_double(missing(x))))
        texts = F.when(kind.isin("String", "Character"), F.transform(values, missing))
        fits = lambda x: (x == ".") | (F.when(kind == "Integer", x.try_cast("long").isNotNull()).when(kind == "Float", va.vcf_double(x).isNotNull()).when(kind == "Character", F.length(x) == 1).otherwise(True))
        want = expected_count(d["number"], n_alleles)
        error = (F.when(d.isNull() & F.lit(not keep_undeclared), "undeclared").when(d.isNotNull() & (((kind == "Flag") & values.isNotNull()) | ((kind != "Flag") & v["flag"])), "flag")
                 .when(F.exists(values, lambda x: ~fits(x)), "type").when((kind != "Flag") & (F.size(values) != want) & ~((F.size(values) == 1) & (values[0] == ".")), "count"))
        return F.struct(d["type"].alias("type"), integers.alias("integers"), numbers.alias("numbers"), texts.alias("texts"), v["flag"].alias("flag"), error.alias("error"))

    return F.transform_values(info, one)


#: The fields of a genotype, in the order of a gathered one; other values are attributes.
GENOTYPE = (("alleles", "array<int>"), ("phased", "boolean"), ("ad", "array<int>"), ("dp", "int"), ("gq", "int"), ("pl", "array<int>"), ("filters", "string"), ("attributes", "map<string,string>"))


def format_keys(genotypes: Column) -> Column:
    """The FORMAT keys of a site's genotypes (an array): those that some sample has a value for, by name, GT before them if some sample has alleles; GT alone if there is nothing."""
    def when_some(key: str, field: str) -> Column:
        return F.when(F.exists(genotypes, lambda g: g[field].isNotNull()), F.lit(key))

    filtered = F.exists(genotypes, lambda g: F.coalesce(g["filters"] != "PASS", F.lit(False)))
    fixed = F.array(*(when_some(k, k.lower()) for k in ("AD", "DP", "GQ", "PL")), F.when(filtered, F.lit("FT")))
    own = F.flatten(F.transform(genotypes, lambda g: F.transform(g["attributes"], lambda e: e["key"])))
    named = F.array_sort(F.array_distinct(F.concat(F.filter(fixed, lambda k: k.isNotNull()), own)))
    keys = F.when(F.exists(genotypes, lambda g: F.size(g["alleles"]) > 0), F.concat(F.array(F.lit("GT")), named)).otherwise(named)
    return F.when(F.size(keys) == 0, F.array(F.lit("GT"))).otherwise(keys)


def _sample_column(g: Column, keys: Column, keep_trailing: bool) -> Column:
    """A sample's column; null where it has no alleles but GT is asked for."""
    called = g["alleles"].cast("array<string>")
    gt = F.when(F.size(called) > 0, F.when(F.coalesce(g["phased"], F.lit(False)), F.array_join(called, "|", ".")).otherwise(F.array_join(called, "/", ".")))
    numbers = lambda a: F.array_join(a.cast("array<string>"), ",")

    def value(k: Column) -> Column:
        text = (F.when(k == "FT", F.coalesce(g["filters"], F.lit("PASS"))).when(k == "AD", numbers(g["ad"])).when(k == "DP", g["dp"].cast("string")).when(k == "GQ", g["gq"].cast("string"))
                .when(k == "PL", numbers(g["pl"])).otherwise(F.get(F.filter(g["attributes"], lambda e: e["key"] == k), F.lit(0))["value"]))
        return F.coalesce(text, F.lit("."))

    rest = F.transform(F.filter(keys, lambda k: k != "GT"), value)
    last = F.aggregate(F.transform(rest, lambda x, i: F.when(~va.is_missing(x), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    kept = rest if keep_trailing else F.slice(rest, F.lit(1), last)
    return F.when(keys[0] != "GT", F.array_join(kept, ":")).when(gt.isNotNull(), F.array_join(F.concat(F.array(gt), kept), ":"))


def with_genotype_columns(sites: DataFrame, genotypes: DataFrame, key: str, samples: list[str], keep_trailing: bool = False) -> DataFrame:
    """``sites`` with ``genotype_text``: FORMAT and the columns of the header's samples in its order, tabs between.

    ``genotypes`` is a long table (key, sample, and the fields of ``GENOTYPE`` that there are).
    Each genotype gets its sample's place in the header, and a site's missing places
    are filled, so the work is in proportion to the samples. A sample without a
    genotype has no-calls at the site's largest ploidy (2 if there is none). Missing
    values at a sample's end are cut unless kept. FT is PASS for a sample without
    filters. Of a repeated sample one counts. Genotypes of samples that the header
    lacks count for keys and ploidy, but aren't written. The text is null where a
    sample without alleles would need GT.
    """
    spark = sites.sparkSession
    header = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(samples))], "sample_ string, at_ int")
    n = len(set(samples))
    header = F.broadcast(header) if n <= 100_000 else header
    fields = [(F.col(c) if c in genotypes.columns else F.lit(None)).cast(t).alias(c) for c, t in GENOTYPE[:-1]]
    entries = F.coalesce(F.map_entries(F.col("attributes") if "attributes" in genotypes.columns else F.lit(None).cast(GENOTYPE[-1][1])), F.array().cast("array<struct<key:string,value:string>>"))
    placed = genotypes.join(header, F.col("sample") == F.col("sample_"), "left")
    gathered = placed.groupBy(F.col(key).alias("key_")).agg(F.collect_list(F.struct("at_", *fields, entries.alias("attributes"))).alias("g_"))  # a site's line holds all its samples
    joined = sites.join(gathered, F.col(key) == F.col("key_"), "left")
    kind = "array<struct<at_:int," + ",".join(f"{c}:{t}" for c, t in GENOTYPE[:-1]) + ",attributes:array<struct<key:string,value:string>>>>"
    known = joined.withColumn("g_", F.coalesce("g_", F.array().cast(kind))).withColumn("keys_", format_keys(F.col("g_"))).withColumn("ploidy_", va.max_ploidy(F.col("g_")))
    here = F.filter("g_", lambda g: g["at_"].isNotNull())
    places = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    empty = lambda t: F.lit(None).cast(t)
    absent = F.transform(F.array_except(places, F.transform(here, lambda g: g["at_"])), lambda i: F.struct(
        i.alias("at_"), F.array_repeat(empty("int"), F.col("ploidy_")).alias("alleles"), *(empty(t).alias(c) for c, t in GENOTYPE[1:-1]), F.array().cast("array<struct<key:string,value:string>>").alias("attributes")))
    full = known.withColumn("all_", F.array_sort(F.concat(here, absent.cast(kind))))
    once = F.filter("all_", lambda g, i: (i == 0) | (g["at_"] != F.get("all_", i - 1)["at_"]))
    written = full.withColumn("columns_", F.transform(once, lambda g: _sample_column(g, F.col("keys_"), keep_trailing)))
    text = F.concat(F.array_join("keys_", ":"), F.lit("\t"), F.array_join("columns_", "\t"))
    return written.withColumn("genotype_text", F.when(~F.exists("columns_", lambda c: c.isNull()), text)).drop("key_", "g_", "keys_", "ploidy_", "all_", "columns_")
