"""Operators over tables whose other columns are named like helpers and results: the results are those of the bare table."""

from pyspark.sql import functions as F

from genoweave.llm.decontam import drop_contaminated, find_items
from genoweave.llm.language import identify, train
from genoweave.llm.neardup import near_duplicates, one_of_each
from genoweave.llm.pii import detect, redact
from genoweave.llm.resampling import resample
from genoweave.llm.topk import top_k


def rows_of(df):
    return sorted((tuple(str(x) for x in r) for r in df.collect()))


def widened(df, *names):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def test_top_k(spark):
    bare = spark.createDataFrame([(i, [i % 5, i % 3, -i]) for i in range(40)], "vec_id long, v array<long>")
    wide = widened(bare, "query_id", "score", "rank", "ids", "vectors", "dim", "round")
    assert rows_of(top_k(wide, wide.filter("vec_id < 4"), "vec_id", "v", 3)) == rows_of(top_k(bare, bare.filter("vec_id < 4"), "vec_id", "v", 3))


def test_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = ("item_id", "start", "end", "distance", "matches", "found")
    wide, wide_items = widened(docs, *names), widened(items, "doc_id", "piece", "start")
    columns = find_items(docs, items).columns
    assert rows_of(find_items(wide, wide_items).select(*columns)) == rows_of(find_items(docs, items))
    kept = drop_contaminated(wide, wide_items)
    assert kept.columns == wide.columns and rows_of(kept.select("doc_id")) == rows_of(drop_contaminated(docs, items).select("doc_id"))


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    wide = widened(docs, "held_out", "language_result", "trigram", "n")
    bare, more = identify(docs, train(docs)), identify(wide, train(wide))
    assert more.columns == [*wide.columns, "lang_pred", "score"] and rows_of(more.select("doc_id", "lang_pred", "score")) == rows_of(bare.select("doc_id", "lang_pred", "score"))
    again = identify(more, train(docs))
    assert sorted(again.columns) == sorted(more.columns)


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    wide = widened(docs, "class_id", "kept", "text_hash", "component_id", "keep_key", "row_rank", "n_shingles", "node")
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert rows_of(near_duplicates(wide).select(*columns)) == rows_of(near_duplicates(docs).select(*columns))
    kept = one_of_each(wide)
    assert kept.columns == wide.columns and rows_of(kept.select("doc_id")) == rows_of(one_of_each(docs).select("doc_id"))


def test_personal_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    wide = widened(docs, "kind", "start", "end", "pairs_of_email", "pii_spans", "base")
    found = detect(wide)
    assert rows_of(found.select("doc_id", "pii_spans")) == rows_of(detect(docs).select("doc_id", "pii_spans"))
    assert set(wide.columns) <= set(found.columns) and {r.kind for r in found.select("kind").distinct().collect()} == {0}
    assert rows_of(redact(found).select("doc_id", "text")) == rows_of(redact(detect(docs)).select("doc_id", "text"))


def test_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert rows_of(resample(widened(docs, "key", "mark", "feature", "n", "g", "gain", "score"), widened(target, "feature", "t"))) == rows_of(resample(docs, target))
