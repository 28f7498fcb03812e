"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import scratch, written  # noqa: F401  for all operators here


#: Bytes of an Arrow batch, unless the session sets its own bound: what a Python worker and the JVM hold of a task's
#: rows at once, besides a row of more bytes.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes where the session leaves Spark's default of 64 MB."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read with Spark's own reader (any store)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    while name.casefold() in {c.casefold() for c in df.columns}:
        name += "_"
    return name


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as long, text) with a null text as empty; other columns go, so none can clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; SWEETLAKE_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("SWEETLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
