"""Shared helpers: the folder for intermediate tables, and table readers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and
    all tasks run in this process (tests) a temporary folder is used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="genoweave-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage and survives the loss of executors. The schema is passed
    on, so an empty table keeps its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_code(spark: SparkSession) -> None:
    """Give this package to Python workers that may not have it on their path (once per Spark context)."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_genoweave_shipped", False) or not os.path.isdir(package):
        return
    root, target = os.path.dirname(package), os.path.join(tempfile.mkdtemp(prefix="genoweave-"), "genoweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    sc._genoweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df_columns, base: str) -> str:
    """``base``, or ``base`` with underscores before it until it clashes with no column."""
    taken = {c.lower() for c in df_columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def ascii_words(letters: bytes):
    """A function from a UTF-8 text (None: empty) to its words in lower case (A-Z only): runs of ``letters`` and of bytes outside ASCII."""
    table_ = bytes(c if c in letters or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())

    def split(raw: bytes | None) -> list[bytes]:
        return raw.translate(table_).split() if raw else []

    return split


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo ``modulus`` (null: remainder of crc32 of '')."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)
