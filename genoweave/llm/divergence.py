"""How far each source's use of words lies from its language and from the other sources of it.

Terms are counted per language and source where texts are read, and each
language keeps the terms of at least ``least_docs`` of its documents. The kept
terms, sorted by their UTF-8 bytes and dealt out by range, are the dictionary:
one sorted array per language and chunk, in which a term's place is its id.
Tasks look counted terms up in their chunk by ``searchsorted`` and add them up
by ``bincount`` to one dense vector per source; vectors of a chunk give the
chunk's share of every pair's difference and its foremost terms per source. As
ids keep byte order, ties need no look at the terms. A task holds two blocks of
at most ``SOURCE_BLOCK`` sources, whatever the number of sources.

Null text, language and source read as ''. Texts without terms still give their
group. A language without kept terms has no terms and differences of 0. Repeated
rows count each. Other columns are left alone. All arithmetic is on integers;
products are taken in two steps, so counts may reach 2 ** 48.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import ascii_words, materialize, table

SCALE = 1_000_000_000
#: Kept terms per chunk of the dictionary, and the number of chunks from which chunks grow instead.
CHUNK, MOST_CHUNKS = 4096, 4096
SOURCE_BLOCK = 128
#: Distinct (language, source, term) that a task counts before it hands them on; a count holds documents above DOCS_AT and occurrences below.
TABLE_ROWS = 600_000
DOCS_AT = 1 << 40
split_terms = ascii_words(b"abcdefghijklmnopqrstuvwxyz")


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs) counted by task: occurrences and documents."""

    def rows(counted: dict) -> Iterator[pa.RecordBatch]:
        for (lang_, source_), terms in counted.items():
            k = len(terms)
            both = pa.array(terms.values(), pa.int64())
            names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(k, np.int32)), pa.array([x], pa.string())).cast(pa.string()) for x in (lang_, source_)]
            docs_ = pc.shift_right(both, 40)
            n = pc.bit_wise_and(both, DOCS_AT - 1)
            yield pa.RecordBatch.from_arrays([*names, pa.array(terms.keys(), pa.binary()), n, docs_], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict = defaultdict(dict)
        held = 0
        for batch in batches:
            for lang_, source_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = counted[lang_, source_]
                before = len(terms)
                get = terms.get
                for term, n in Counter(split_terms(value.as_py())).items():
                    terms[term] = get(term, 0) + n + DOCS_AT
                held += len(terms) - before
                if held >= TABLE_ROWS:
                    yield from rows(counted)
                    counted.clear()
                    held = 0
        yield from rows(counted)

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.col(text).cast("binary"))
    return named.mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exactly: SCALE is taken in two factors with the remainder between."""
    first, second = 31_250, SCALE // 31_250
    below = np.asarray(total, np.int64) + 5 * kept
    whole, left = np.divmod((counts + 5) * first, below)
    return 1 + whole * second + left * second // below


def _chunk(key: pd.Series, dictionary: pd.DataFrame, counts: pd.DataFrame, top: int) -> pd.DataFrame:
    """One chunk of a language and two blocks of its sources: differences of each source to all of the other block; the foremost terms where both are one block."""
    entry = dictionary.iloc[0]
    terms = np.array(list(entry["terms"]), dtype=object)
    size = len(terms)
    left, right = list(entry["left"]), list(entry["right"])
    same = entry["a"] == entry["b"]
    names = left if same else left + right
    totals = np.array(list(entry["left_n"]) + ([] if same else list(entry["right_n"])), np.int64)
    of = {s: i for i, s in enumerate(names)}
    ids = np.searchsorted(terms, counts["term"].to_numpy(object)) if len(counts) else np.zeros(0, np.int64)
    rows = counts["source"].map(of).to_numpy(np.int64) if len(counts) else np.zeros(0, np.int64)
    flat = rows * size + ids
    n = counts["n"].to_numpy(np.int64)
    cells = len(names) * size
    # float sums of halves are exact
    vectors = sum(np.bincount(flat, part, cells).astype(np.int64) << shift for part, shift in ((n & 0xFFFFFF, 0), (n >> 24, 24))).reshape(len(names), size)
    p = shares(vectors, totals[:, None], entry["kept"])
    out = []
    for i, name in enumerate(left if same else names):
        # each source of one block against all of the other
        others = slice(0, len(left)) if same else slice(len(left), len(names)) if i < len(left) else slice(0, len(left))
        facing = entry["a"] if same or i >= len(left) else entry["b"]
        out.append((name, int(facing), np.abs(p[i] - p[others]).sum(axis=1), None, 0))
        if same and size:
            everywhere = np.zeros(size, np.int64)
            everywhere[ids] = counts["in_lang"].to_numpy(np.int64)
            gain = p[i] - shares(everywhere, int(entry["lang_n"]), entry["kept"])
            hit = np.flatnonzero((vectors[i] > 0) & (gain > 0))
            hit = hit[np.lexsort((hit, -gain[hit]))][:top]
            out += [(name, 0, None, terms[j], int(gain[j])) for j in hit]
    frame = pd.DataFrame(out, columns=["source", "facing", "gaps", "term", "value"])
    frame.insert(0, "lang", entry["lang"])
    return frame


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the difference to every other one, and its ``top`` foremost terms."""
    spark = docs.sparkSession
    # one exchange by (lang, term) serves the totals over sources, the choice of terms and the sums of what stays
    partial = count_terms(docs, text, lang, source).repartition("lang", "term")
    total = partial.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("in_lang")).filter(F.col("in_docs") >= least_docs)
    chosen = partial.join(total.hint("shuffle_hash"), ["lang", "term"])
    kept = materialize(chosen.groupBy("lang", "source", "term", "in_lang").agg(F.sum("n").alias("n")), "kept-terms")

    distinct = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"))
    n_terms = distinct.count()
    pieces = max(1, min(MOST_CHUNKS, -(-n_terms // CHUNK)))
    ranged = distinct.repartitionByRange(pieces, "lang", "term").withColumn("chunk", F.spark_partition_id())
    dictionary = materialize(ranged.groupBy("lang", "chunk").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.sum("in_lang").alias("in_lang")), "dictionary")
    # where chunks begin: at most MOST_CHUNKS rows, and one more per language that has terms
    begins = sorted((r["lang"].encode(), bytes(r["first"]), r["chunk"]) for r in dictionary.select("lang", "chunk", F.col("terms")[0].alias("first")).toLocalIterator())
    starts = spark.sparkContext.broadcast(([b[:2] for b in begins], [b[2] for b in begins]))

    @F.pandas_udf("int")
    def chunk_of(langs: pd.Series, terms: pd.Series) -> pd.Series:
        keys, chunks = starts.value
        return pd.Series([chunks[bisect_right(keys, (a.encode(), bytes(t))) - 1] for a, t in zip(langs, terms)], dtype="int32")

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(of_group, ["lang", "source"], "left").na.fill(0, ["n"]).withColumn("block", F.floor(place / SOURCE_BLOCK).cast("int"))
    groups = materialize(groups, "groups")
    blocks = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")).select(
        "lang", "block", F.transform("g", lambda x: x["source"]).alias("names"), F.transform("g", lambda x: x["n"]).alias("sums"))
    per_lang = dictionary.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"), F.sum("in_lang").alias("lang_n"))
    # a language without terms has one chunk without terms
    chunks = blocks.select("lang").distinct().join(dictionary.drop("in_lang"), "lang", "left").join(per_lang, "lang", "left").select(
        "lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), F.coalesce("terms", F.array().cast("array<binary>")).alias("terms"),
        F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), F.coalesce("lang_n", F.lit(0).cast("long")).alias("lang_n"))
    first = blocks.select("lang", F.col("block").alias("a"), F.col("names").alias("left"), F.col("sums").alias("left_n"))
    second = blocks.select("lang", F.col("block").alias("b"), F.col("names").alias("right"), F.col("sums").alias("right_n"))
    work = chunks.join(first.join(second, "lang").filter("a <= b"), "lang")
    last = groups.groupBy("lang").agg(F.max("block").alias("last"))
    to_pairs = F.explode(F.transform(F.sequence(F.lit(0), "last"), lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b"))))
    sent = kept.withColumn("chunk", chunk_of("lang", "term")).join(groups.select("lang", "source", "block"), ["lang", "source"]).join(last, "lang").select(
        "lang", "chunk", to_pairs.alias("at"), "source", "term", "n", "in_lang").select("lang", "chunk", "at.a", "at.b", "source", "term", "n", "in_lang")
    keys = ["lang", "chunk", "a", "b"]

    def share(key, entry: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return _chunk(key, entry, counts, top)

    parts = work.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(share, "lang string, source string, facing int, gaps array<long>, term binary, value long")
    parts = materialize(parts, "parts")
    # a chunk's differences are one array per source and block of others; at most MOST_CHUNKS arrays (and one more) meet
    faced = parts.filter("term is null").groupBy("lang", "source", "facing").agg(F.collect_list("gaps").alias("g"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    whole = faced.select("lang", "source", F.col("facing").alias("block"), F.aggregate(F.slice("g", 2, MOST_CHUNKS + 1), F.col("g")[0], add).alias("gaps"))
    named = whole.join(blocks.select("lang", "block", "names"), ["lang", "block"]).select("lang", "source", F.explode(F.arrays_zip("names", "gaps")).alias("x"))
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), F.col("x.names").cast("binary").alias("item"), F.col("x.gaps").alias("value")).filter(F.col("source").cast("binary") != F.col("item"))
    terms = parts.filter("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    both = pairs.unionByName(terms).withColumn("rank", F.row_number().over(ranked))
    return both.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (lang, source) group of the documents against the other sources of its language and against the language."""
    return audit(table(spark, sf_dir, "documents"))
