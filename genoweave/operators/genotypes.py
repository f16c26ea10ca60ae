"""Genotype classification and allele counts; alleles are indexes into the site's list, null is a no-call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def genotype_type(alleles: Column) -> Column:
    """UNAVAILABLE, NO_CALL, MIXED, HOM_REF, HOM_VAR or HET (two different called alleles, reference or not)."""
    called = F.filter(alleles, lambda a: a.isNotNull())
    return (
        F.when(F.size(alleles) == 0, "UNAVAILABLE").when(F.size(called) == 0, "NO_CALL").when(F.size(called) < F.size(alleles), "MIXED")
        .when(F.size(F.array_distinct(called)) > 1, "HET").when(called[0] == 0, "HOM_REF").otherwise("HOM_VAR"))


def chromosome_counts(genotypes: DataFrame, site: str, founders: list[str] | None = None) -> DataFrame:
    """AN and AC of the alternate over unfiltered genotypes, and AF among founders (all samples if none are named)."""
    founder = F.col("sample").isin(founders) if founders else F.lit(True)
    called = lambda a: F.size(F.filter(a, lambda x: x.isNotNull()))
    alternate = lambda a: F.size(F.filter(a, lambda x: x > 0))
    used = genotypes.filter(~F.col("filtered"))
    counted = used.groupBy(site).agg(
        F.sum(called(F.col("alleles"))).alias("an"), F.sum(alternate(F.col("alleles"))).alias("ac"),
        F.sum(F.when(founder, called(F.col("alleles"))).otherwise(0)).alias("fn"), F.sum(F.when(founder, alternate(F.col("alleles"))).otherwise(0)).alias("fc"))
    return counted.select(site, "an", "ac", F.when(F.col("fn") > 0, F.col("fc") / F.col("fn")).alias("af"))


def counts_per_alternate(sites: DataFrame, genotypes: DataFrame, site: str, n_alleles: str, founders: list[str] | None = None, remove_stale: bool = True) -> DataFrame:
    """(site, an, ac, af): called alleles, and count and frequency of each alternate as arrays, over unfiltered genotypes.

    Counts are of all samples, frequencies of the founders (all if none are
    named). Alleles are counted per site and allele, then laid out by the
    site's number of alleles. A site without genotypes has nulls; one where nobody is called as well if stale
    values are removed, else AN 0 and frequencies 0; one without alternates has AN only. Without a
    called founder frequencies are NaN.
    """
    founder = F.col("sample").isin(founders) if founders else F.lit(True)
    one = genotypes.filter(~F.col("filtered")).select(F.col(site).alias("site_"), founder.alias("founder_"), F.explode("alleles").alias("allele_")).filter("allele_ is not null")
    counted = one.groupBy("site_", "allele_").agg(F.count(F.lit(1)).alias("n_"), F.count_if("founder_").alias("f_"))
    entry = lambda value: F.map_from_entries(F.collect_list(F.struct("allele_", value)))
    laid = counted.groupBy("site_").agg(F.sum("n_").alias("an_"), F.sum("f_").alias("fn_"), entry("n_").alias("ns_"), entry("f_").alias("fs_"))
    seen = genotypes.select(F.col(site).alias("seen_")).distinct()
    rows = sites.select(site, F.col(n_alleles).alias("alleles_")).join(seen, F.col(site) == F.col("seen_"), "left").join(laid, F.col(site) == F.col("site_"), "left")
    zero = F.lit(0).cast("long")
    an, alternates = F.coalesce("an_", zero), F.when(F.col("alleles_") > 1, F.sequence(F.lit(1), F.col("alleles_") - 1))
    of = lambda counts: F.transform(alternates, lambda a: F.coalesce(F.try_element_at(counts, a), zero))
    share = lambda f: F.when(an == 0, 0.0).when(F.coalesce("fn_", zero) == 0, float("nan")).otherwise(f / F.nullif("fn_", zero))
    known = F.col("seen_").isNotNull() & ((an > 0) | F.lit(not remove_stale))
    return rows.select(site, F.when(known, an).alias("an"), F.when(known, of(F.col("ns_"))).alias("ac"), F.when(known, F.transform(of(F.col("fs_")), share)).alias("af"))


def monomorphic(genotypes: DataFrame, site: str) -> DataFrame:
    """Sites at which every called allele is the reference."""
    count = lambda test: F.sum(F.size(F.filter("alleles", test)))
    return genotypes.groupBy(site).agg(count(lambda x: x == 0).alias("ref_called"), count(lambda x: x.isNotNull()).alias("called")).filter("ref_called = called")


def likelihoods_to_pl(gl: Column) -> Column:
    """log10 likelihoods as phred: shifted so that the best is 0, times -10, clamped, rounded half up; NaN gives 0."""
    best = F.array_max(gl)
    def one(x: Column) -> Column:
        v = F.lit(-10.0) * (x - best)
        return F.when(F.isnan(v), 0).otherwise(F.floor(F.least(v, F.lit(2147483647.0)) + 0.5)).cast("int")
    return F.transform(gl, one)


def parse_info(info: Column) -> Column:
    """Key-value map of an INFO field; the last of repeated keys wins, a bare key reads ``true``; ``.`` is empty."""
    entries = F.transform(F.split(info, ";"), lambda e: F.split(e, "=", 2))
    keys = F.array_distinct(F.transform(entries, lambda e: e[0]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e[0] == k), -1)
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.get(last(k), F.lit(1)), F.lit("true")).alias("value")))
    return F.when(info == ".", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs))


def parse_filters(text: Column) -> Column:
    """``.`` is null (not applied), ``PASS`` is empty, otherwise the names."""
    return F.when(text == ".", F.lit(None).cast("array<string>")).when(text == "PASS", F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def parse_qual(text: Column) -> Column:
    """log10 error: ``.`` and about -1 give 1.0 (none)."""
    q = text.try_cast("double")
    return F.when((text == ".") | (F.abs(q + 1) < 1e-6), 1.0).otherwise(q / -10)
