"""What the training-data operators share: tables, texts, words and stored intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from planlens.session import new_shared_path

#: A word, as a pattern of the JVM, of Python and of RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python operator holds as Python objects.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """The text; a missing one is the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal digits modulo ``modulus``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def store(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and go on from there.

    The table survives lost executors and is computed once, whoever reads it.
    """
    path = store_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_where(rows: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """The columns of ``_row`` where ``condition`` holds.

    Not a filter: the optimizer would push it below the projections and compute
    a statistic again for every place in the condition that uses it.
    """
    kept = rows.select(F.explode(F.when(condition, F.array("_row"))).alias("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``_row`` beside ``_h1`` and ``_h2``, 128 bits of digest over all its columns and over which are missing."""
    missing = [F.col(f"`{c}`").isNull() for c in docs.columns]
    values = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(
        F.struct("*").alias("_row"),
        F.xxhash64(*values, *missing).alias("_h1"),
        F.xxhash64(F.lit(1), *missing, *values[::-1]).alias("_h2"),
    )


def repeated(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct rows of ``docs``, all columns, each as often as ``counts`` (_h1, _h2, _n) says; the others go.

    Counts are made from narrow columns, so whole rows move once, to their
    count, and are stored nowhere.
    """
    found = keyed(docs).join(counts, ["_h1", "_h2"])
    first = Window.partitionBy("_h1", "_h2").orderBy("_h1")
    out = found.withColumn("_k", F.row_number().over(first)).where("_k = 1 and _n > 0")
    out = out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def store_path(spark: SparkSession, name: str) -> str:
    return new_shared_path(spark, f"llm-{name}")


def text_steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive slices of a batch with at most STEP_BYTES of text (or one row), and the texts as UTF-8."""
    texts = batch.column(column)
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    elif pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_binary())
    sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > STEP_BYTES:
            yield batch.slice(start, i - start), [x or b"" for x in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start), [x or b"" for x in texts.slice(start).to_pylist()]


def shared_files(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all machines share, and the folder's path in it."""
    return pa.fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
