"""Scans with declared types, cell cleaning, small literal tables, sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from planlens.functions.text import clean_names
from planlens.session import new_shared_path

# Cells that mean "no answer".
NA_TOKENS = ("NA", "NS", "")

# Column type letters: character, number, integer, date, logical; "-" skips.
_TYPES = {"c": T.StringType(), "n": T.DoubleType(), "i": T.LongType(), "D": T.DateType(), "l": T.BooleanType()}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\n", "\\n")
        return f"'{escaped}'"
    return str(value)


def literal_table(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A small constant table that the optimizer sees with its exact size."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def id_range(spark: SparkSession, first: int, last: int, name: str = "plan_id") -> DataFrame:
    """All ids from ``first`` to ``last``."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def blank_to_null(value: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """Trim a cell and turn the no-answer tokens into NULL."""
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(~trimmed.isin(*tokens), trimmed)


def clean_cells(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """``blank_to_null`` on every text column."""
    return df.select(
        *[
            blank_to_null(df[f.name], tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else df[f.name]
            for f in df.schema.fields
        ]
    )


def with_column_types(df: DataFrame, spec: str) -> DataFrame:
    """Give the columns, by position, the types of a letter code such as ``"ncnccc"``.

    One letter stands for all columns.  Text that does not fit becomes NULL.
    """
    letters = spec * len(df.columns) if len(spec) == 1 else spec
    if len(letters) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(letters)} type letters")
    return df.select(
        *[df[name].try_cast(_TYPES[t]).alias(name) for name, t in zip(df.columns, letters, strict=True) if t != "-"]
    )


def read_sheet_csv(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    spec: str = "c",
    tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Read an exported sheet: declared columns, cleaned cells, declared types; no inference.

    A file whose header has other names is an error.  Files are split among
    tasks unless ``multi_line`` says that cells hold line breaks.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"header": True, "enforceSchema": False, "multiLine": multi_line, "escape": '"'}
    raw = spark.read.schema(schema).options(**options).csv(path)
    return with_column_types(clean_cells(raw, tokens), spec)


def with_clean_names(df: DataFrame) -> DataFrame:
    """All column names in snake case."""
    return df.toDF(*clean_names(df.columns))


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def numbers_in_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """Lenient number conversion of a column range."""
    chosen = set(column_range(df, first, last))
    return df.select(*[df[c].try_cast("double").alias(c) if c in chosen else df[c] for c in df.columns])


def numbers_from_text(df: DataFrame) -> DataFrame:
    """Lenient number conversion of all text columns."""
    return df.select(
        *[
            df[f.name].try_cast("double").alias(f.name) if isinstance(f.dataType, T.StringType) else df[f.name]
            for f in df.schema.fields
        ]
    )


def fill_nulls(df: DataFrame, value=0) -> DataFrame:
    """NULL to a constant in every column of the constant's kind."""
    return df.fillna(value)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a Parquet table, e.g. the review partitioned by its record type."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def store_by_key(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Store ``df`` as a table in buckets of ``key`` in the shared folder and read it from there.

    Rows of a key lie in one file, sorted by it, so aggregates and joins by the
    key need no shuffle.  For keys with a bounded number of rows, such as a
    plan's answers; there are as many buckets as shuffle partitions unless told otherwise.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_shared_path(spark, "buckets")
    name = f"planlens_{path[-32:]}"
    # dealt out as the buckets are, so that each task writes one file
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with a header and without an index column."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
