"""Column functions over alleles, genotype text, attributes and escaped text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def allele_kind(bases: Column, is_ref: Column) -> Column:
    """``no_call``, ``symbolic``, ``breakend``, ``spanning``, ``bases``; null if refused (empty, ``-``, other letters, ``*`` as reference)."""
    breakend = bases.contains("[") | bases.contains("]") | ((F.length(bases) > 1) & (bases.startswith(".") | bases.endswith(".")))
    return (
        F.when(bases == ".", "no_call").when((F.length(bases) > 1) & (bases.startswith("<") | bases.endswith(">")), "symbolic").when(breakend, "breakend")
        .when((bases == "*") & ~is_ref, "spanning").when(bases.rlike("^[ACGTNacgtn]+$"), "bases"))


def allele_text(bases: Column, is_ref: Column) -> Column:
    """Plain bases in upper case, everything else kept."""
    return F.when(allele_kind(bases, is_ref) == "bases", F.upper(bases)).otherwise(bases)


def is_missing(text: Column) -> Column:
    """Only dots and commas; the empty string counts."""
    return text.rlike("^[.,]*$")


def genotype_alleles(gt: Column) -> Column:
    """Allele indexes of a GT field (``.`` is null); empty tokens are skipped."""
    tokens = F.filter(F.split(gt, r"[/|\\]"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.when(t != ".", t.try_cast("int")))


def is_phased(gt: Column) -> Column:
    return gt.contains("|")


def genotype_field(format_: Column, values: Column, key: str) -> Column:
    """The value of a key in a genotype block; null if absent, cut off or ``.``."""
    at = F.array_position(F.split(format_, ":"), key).cast("int")
    value = F.get(F.split(values, ":"), F.when(at > 0, at - 1).otherwise(1 << 20))
    return F.when(~is_missing(value), value)


def percent_decode(text: Column) -> Column:
    """%XX escapes of one byte as characters; anything else stays."""
    parts = F.split(text, "(?=%[0-9A-Fa-f]{2})")
    one = lambda p: F.when(
        p.rlike("^%[0-9A-Fa-f]{2}"), F.concat(F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int")), F.substring(p, 4, 1 << 30))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def attribute_int(value: Column, default: int) -> Column:
    """An absent key or an empty value gives the default; a literal ``.`` is null."""
    return F.when(value.isNull() | (value == ""), default).otherwise(value.try_cast("int"))


def attribute_bool(value: Column) -> Column:
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def split_dropping_trailing(text: Column, pattern: str) -> Column:
    """Parts without the empty ones at the end."""
    parts = F.split(text, pattern)
    last = F.aggregate(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(parts, F.lit(1), last)


def genotype_block(format_: Column, sample: Column, n_alleles: Column) -> Column:
    """One sample's genotype: alleles (null is a no-call), phased, dp, gq, ad, pl, error.

    A key that is absent, cut off or ``.`` is null. One bad element nulls the
    whole of AD or PL; a bad DP is an error (``dp``), as are an allele index
    outside the site's (``allele``), GT behind another key (``gt``) and more
    values than keys (``values``). GQ is rounded half up, -1 is null.
    """
    keys, values = F.split(format_, ":"), F.split(sample, ":")
    field = lambda key: genotype_field(format_, sample, key)
    ints = lambda key: _all_ints(F.split(field(key), ","))
    dp, gq = field("DP"), F.floor(field("GQ").try_cast("double") + 0.5).try_cast("int")
    gt_at = F.array_position(keys, "GT")
    tokens = F.when(gt_at == 1, F.filter(F.split(values[0], r"[/|\\]"), lambda t: t != ""))
    alleles = F.transform(tokens, lambda t: F.when(t != ".", t.try_cast("int")))
    bad = F.exists(tokens, lambda t: (t != ".") & F.coalesce(~t.try_cast("int").between(0, n_alleles - 1), F.lit(True)))
    error = (F.when(F.size(values) > F.size(keys), "values").when(gt_at > 1, "gt").when(bad, "allele")
             .when(dp.isNotNull() & dp.try_cast("int").isNull(), "dp"))
    return F.struct(
        alleles.alias("alleles"), (F.coalesce(values[0].contains("|"), F.lit(False)) & (gt_at == 1)).alias("phased"), dp.try_cast("int").alias("dp"),
        F.when(gq != -1, gq).alias("gq"), ints("AD").alias("ad"), ints("PL").alias("pl"), error.alias("error"))


def _all_ints(parts: Column) -> Column:
    """The parts as integers; null if one is none."""
    numbers = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def record_likelihoods(samples: Column) -> Column:
    """PL of each of a record's samples (an array of structs with ``pl`` and ``gl``, in the header's order).

    A sample's GL is converted only as long as no sample before it had a PL of
    its own; one that has both keeps its PL.
    """
    from ..operators.genotypes import likelihoods_to_pl

    first = F.array_position(F.transform(samples, lambda s: s["pl"].isNotNull()), True)
    return F.transform(samples, lambda s, i: F.coalesce(s["pl"], F.when((first == 0) | (i < first - 1), likelihoods_to_pl(s["gl"]))))


def genotype_of(genotypes: Column, sample: Column) -> Column:
    """The first genotype (a struct with ``sample``) of a sample; null if there is none."""
    return F.get(F.filter(genotypes, lambda g: g["sample"] == sample), F.lit(0))


def max_ploidy(genotypes: Column, default: int = 2) -> Column:
    """The largest number of alleles of a genotype."""
    return F.coalesce(F.array_max(F.transform(genotypes, lambda g: F.size(g["alleles"]))), F.lit(default))


def vcf_double(text: Column) -> Column:
    """A number as variant files write it: decimal or hexadecimal, ``inf``, ``infinity`` and ``nan`` in any case and with a sign; else null."""
    low = F.lower(F.trim(text))
    special = F.when(low.rlike(r"^[+-]?nan$"), float("nan")).when(low.rlike(r"^-inf(inity)?$"), float("-inf")).when(low.rlike(r"^\+?inf(inity)?$"), float("inf"))
    return F.when(special.isNotNull(), special).otherwise(text.try_cast("double"))


def vcf_double_text(value: Column) -> Column:
    """Two decimals from 1 on, three from a hundredth on, else an exponent (negative values too); next to 0 it is 0.00."""
    return (F.when(value.isNull(), F.lit(None)).when(value >= 1, F.format_string("%.2f", value)).when(value >= 0.01, F.format_string("%.3f", value))
            .when(F.abs(value) >= 1e-20, F.format_string("%.3e", value)).otherwise("0.00"))


def quality_text(value: Column) -> Column:
    """Two decimals, left off if both are 0; null stays null."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.2f", value), r"\.00$", ""))


def vcf_list_text(values: Column) -> Column:
    """Values joined by commas, a missing one and an empty list as ``.``."""
    return F.when(F.size(values) == 0, ".").otherwise(F.array_join(values, ",", "."))
