"""Importance resampling towards a target distribution over hashed n-gram features.

All n-gram strings of both tables are counted globally, so the dictionary has one
row per distinct string: each is hashed once, strings are added up in buckets,
and a bucket's gain goes back to its strings. Documents then take the gains of
their own feature counts. The dictionary is joined in two parts: strings that make
up at least one in ``HEAVY`` of all features (so at most ``HEAVY`` of them, of at
most ``HEAVY_BYTES`` bytes) are broadcast and leave one sum per document; the
others, none of which can be hot, are shuffled. Tasks split texts and count in
Arrow batches; counting tables are written out whenever they reach ``TABLE_ROWS``.

Null texts and texts without words have no features and weight 0. Repeated rows
each count and are each returned. Null document ids count as the empty string
where an id is hashed and come first in ties. An empty target or corpus counts 0
in every bucket. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import ascii_words, free_name, materialize, table

HEAVY = 50_000
HEAVY_BYTES = 256
#: Distinct strings that a task counts before it hands them on.
TABLE_ROWS = 200_000
#: Words of a lower-cased text: runs of ASCII letters, digits and all that isn't ASCII.
split_words = ascii_words(b"abcdefghijklmnopqrstuvwxyz0123456789")


def runs_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space."""
    out = list(words)
    for k in range(2, longest + 1):
        out += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _counts(df: DataFrame, text: str, longest: int, side: str) -> DataFrame:
    """Feature strings of a table with their counts by task, as (feature, s, t)."""

    def rows(counted: Counter) -> pa.RecordBatch:
        n = pa.array(counted.values(), pa.int64())
        none = pa.array([0] * len(counted), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.binary()), *((n, none) if side == "s" else (none, n))], ["feature", "s", "t"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                counted.update(runs_of(split_words(value.as_py()), longest))
                if len(counted) >= TABLE_ROWS:
                    yield rows(counted)
                    counted.clear()
        if counted:
            yield rows(counted)

    return df.select(F.col(text).cast("binary")).mapInArrow(count, "feature binary, s long, t long")


def feature_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """The dictionary: every distinct feature of ``docs`` (and of ``target``) with its counts s and t, its bucket and the bucket's gain."""
    counted = _counts(docs, text, longest, "s").unionByName(_counts(target, text, longest, "t"))
    distinct = counted.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    dictionary = materialize(distinct.withColumn("bucket", F.crc32("feature") % buckets), "features")
    sums = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("bs"), F.sum("t").cast("double").alias("bt"))
    total = sums.agg(F.coalesce(F.sum("bs"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("bt"), F.lit(0.0)).alias("all_t"))
    ratio = ((F.col("bt") + 1) * (F.col("all_s") + buckets)) / ((F.col("bs") + 1) * (F.col("all_t") + buckets))
    gains = sums.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))  # beside one row of totals
    return dictionary.join(F.broadcast(gains), "bucket")  # at most ``buckets`` rows


def document_weights(docs: DataFrame, gains: DataFrame, longest: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, n_words, copies, n_features, weight) per distinct (key, text); ``mark`` hashes the text.

    ``gains`` is a written table. ``weight`` is the floored mean of the gains of
    the document's features, 0 without any. ``copies`` counts repeated rows.
    """
    total = gains.agg(F.sum("s").alias("all_s")).first()["all_s"] or 0
    hot = (F.col("s") * HEAVY >= F.lit(total)) & (F.octet_length("feature") <= HEAVY_BYTES) & (F.col("s") > 0)
    heavy_rows = gains.filter(hot).select("feature", "gain").toArrow()  # at most HEAVY rows, as their shares add up to 1
    heavy = docs.sparkSession.sparkContext.broadcast(dict(zip(heavy_rows.column(0).to_pylist(), heavy_rows.column(1).to_pylist())))
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document (feature null) with its sum over hot strings, and one per other distinct feature of it."""
        known = heavy.value

        def rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            at, features, counts, sums, words = zip(*found)
            take = pa.array(at, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(features, pa.binary()), *(pa.array(x, pa.int64()) for x in (counts, sums, words))],
                ["key", "mark", "feature", "n", "g", "n_words"])

        for batch in batches:
            found: list[tuple] = []
            for i, value in enumerate(batch.column(2)):
                tokens = split_words(value.as_py())
                own = n_hot = 0
                for feature, n in Counter(runs_of(tokens, longest)).items():
                    gain = known.get(feature)
                    if gain is None:
                        found.append((i, feature, n, 0, len(tokens)))
                    else:
                        own, n_hot = own + gain * n, n_hot + n
                found.append((i, None, n_hot, own, len(tokens)))
                if len(found) >= TABLE_ROWS:
                    yield rows(batch, found)
                    found = []
            if found:
                yield rows(batch, found)

    base = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("binary"))
    # a document's own row has a key of its own in the join (no feature begins with a zero byte), so these rows spread
    own = F.concat(F.lit("\0"), F.col("mark").cast("string")).cast("binary")
    counted = base.mapInArrow(count, f"key {kind}, mark long, feature binary, n long, g long, n_words long").withColumn("own", F.col("feature").isNull())
    keyed = counted.withColumn("feature", F.coalesce("feature", own))
    rest = gains.filter(~hot & (F.col("s") > 0)).select(F.col("feature").alias("rest"), "gain")
    joined = keyed.join(rest, F.col("feature") == F.col("rest"), "left")
    gained = F.col("g") + F.coalesce(F.col("gain") * F.col("n"), F.lit(0).cast("long"))
    summed = joined.groupBy("key", "mark", "n_words").agg(F.sum("n").alias("n"), F.count_if("own").alias("copies"), F.sum(gained).alias("g"))
    mean = F.expr("(g - pmod(g, n)) div n")  # floors also below 0
    return summed.select("key", "mark", "n_words", "copies", F.expr("n div copies").alias("n_features"), F.when(F.col("n") > 0, mean).otherwise(0).cast("long").alias("weight"))


def noise(key: Column, seed: int) -> Column:
    """The key's Gumbel noise in thousandths, fixed by sha256 of ``seed:key``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null for those that aren't drawn.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) highest
    scores are drawn, ties to the smaller key. A score's documents are ranked by
    themselves after the counts of the higher scores: scores are whole numbers within a few
    ten thousand (logarithms of counts), so there is a bounded number of them.
    """
    gains = feature_gains(docs, target, longest, buckets, text)
    weights = document_weights(docs, materialize(gains, "gains"), longest, key, text)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    scored = weights.select("key", "mark", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).alias("score"), copies.alias("copy"))
    scored = materialize(scored, "scores")
    fit = F.col("n_words") >= least_words
    per_score = scored.filter(fit).groupBy(F.col("score").alias("of_score")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.col("of_score").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = per_score.select("of_score", before.alias("before"), F.expr(f"sum(n) over () * {int(percent)} div 100").alias("drawn"))
    near = scored.join(F.broadcast(starts), F.col("score") == F.col("of_score"), "left")
    close = fit & F.coalesce(F.col("before") < F.col("drawn"), F.lit(False))
    columns = ["key", "mark", "n_features", "weight", "score"]
    inside = F.row_number().over(W.partitionBy("score").orderBy(F.col("key").asc_nulls_first(), "mark", "copy"))
    place = (F.col("before") + F.col("inside")).cast("long")
    ranked = near.filter(close).withColumn("inside", inside).select(*columns, F.when(place <= F.col("drawn"), place).alias("rank"))
    return ranked.unionByName(near.filter(~close).select(*columns, F.lit(None).cast("long").alias("rank"))).withColumnRenamed("key", key)


def drawn_documents(docs: DataFrame, ranks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents (all columns) that ``resample`` drew; repeated rows are drawn as often as they were ranked."""
    mark, nth, k, m, c = (free_name(docs.columns, x) for x in ("mark", "nth", "of_key", "of_mark", "of_nth"))
    chosen = ranks.filter("rank is not null").groupBy(F.col(key).alias(k), F.col("mark").alias(m)).agg(F.count(F.lit(1)).alias(c))
    hit = docs.withColumn(mark, F.xxhash64(F.col(text))).join(chosen, F.col(key).eqNullSafe(F.col(k)) & (F.col(mark) == F.col(m)))
    same = W.partitionBy(key, mark).orderBy(F.lit(1))
    return hit.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) <= F.col(c)).select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's distribution of words."""
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
