"""The corpus pipeline: language ID, near-duplicate removal, decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genoweave.llm.common import crc_mod, free_name, materialize, ship_code, table
from genoweave.llm.decontam import drop_contaminated
from genoweave.llm.language import identify, train
from genoweave.llm.neardup import one_of_each
from genoweave.llm.packing import pack, token_pieces
from genoweave.llm.pii import detect, redact
from genoweave.llm.tokens import tokenizer_path

#: A document stays if it has a language and at least this share of its letters is in it.
LEAST_LANGUAGE_SHARE = 0.5
#: Encoded words that a worker remembers in stage packing; workers of other stages still live beside it.
CACHE_WORDS = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters, mostly of one language."""
    ship_code(spark)
    model = train(docs.filter(crc_mod("doc_id", 3) != 1))
    clash = {c: free_name([*docs.columns, "lang_pred", "score"], f"own_{c}") for c in docs.columns if c in ("lang_pred", "score")}
    found = identify(docs.withColumnsRenamed(clash), model)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at similarity 0.80."""
    ship_code(spark)
    return one_of_each(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows changed texts."""
    columns = docs.columns
    before = free_name(columns, "text_before")
    prefix = free_name(columns, "pii_")
    out = redact(detect(docs.withColumn(before, F.col("text")), prefix=prefix), prefix=prefix)
    if "n_chars" in columns:
        same = F.col("text").eqNullSafe(F.col(before))
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 4096 tokens."""
    ship_code(spark)
    pieces = materialize(token_pieces(docs, tokenizer_path("word_bpe_49k.json"), cache_words=CACHE_WORDS), "pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Language scores, signatures and tokenizers have no SQL form; tests hold the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each stage's rows written as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
