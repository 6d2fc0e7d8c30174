"""Long to wide, wide to long, and the transposed questionnaire sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions.nulls import to_number
from planlens.questions import component


def stat_rows(review: DataFrame) -> DataFrame:
    """The coded answers, without the extracted text details."""
    return review.where(F.col("type") == "stat")


def answers_wide(review: DataFrame, codes: Sequence[str], numeric: bool = False) -> DataFrame:
    """One row per plan, one column per question code.

    One conditional aggregate per code instead of ``pivot``: the answers of a
    plan lie together, so the partial aggregate shrinks them to one row before
    the only shuffle, whereas ``pivot`` first groups by plan and code.  Rows of
    other codes stay in, so that a plan without any of the codes has a row of NULLs.
    A numeric result also keeps the aggregate hash-based.
    """
    value = to_number(F.col("entry")) if numeric else F.col("entry")
    cells = stat_rows(review).select("plan_id", "q_code", value.alias("cell"))
    return cells.groupBy("plan_id").agg(*[F.expr(f"max(CASE WHEN q_code = '{c}' THEN cell END) AS {c}") for c in codes])


def cell_max(value: Column, here: Column) -> Column:
    """The value of a pivot cell; the largest if the cell is not unique."""
    return F.max(F.when(here, value))


def spread_counts(df: DataFrame, row: Sequence[str], name: str, names: Sequence[str], value: Column) -> DataFrame:
    """Long to wide with a fixed column list; absent cells are NULL."""
    return df.groupBy(*row).agg(*[F.sum(F.when(F.col(name) == n, value)).alias(n) for n in names])


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long over the given columns."""
    return df.unpivot(list(ids), list(columns), name, value)


def sheet_long(sheet: DataFrame, sheet_id: str | None = None) -> DataFrame:
    """Questionnaire sheets to one row per plan, record type and question.

    A sheet has one row per question (``q_num``), two heading columns ``code``
    and ``plan-id``, and two columns per plan, one for each record type; rows 1
    and 2 hold the plan name and the record type.  Plans are numbered by column
    position, the numbering continuing from sheet to sheet.  Only the sheet
    rows are shuffled (by sheet, to meet their headings); the cells are
    spread into rows afterwards.
    """
    fixed = {"code", "plan-id", "q_num", sheet_id}
    cells = [c for c in sheet.columns if c not in fixed]
    key = F.col(sheet_id) if sheet_id else F.lit(0)
    rows = sheet.select(key.cast("long").alias("_sheet"), "q_num", F.array(*[F.col(f"`{c}`") for c in cells]).alias("_cells"))
    heads = (
        rows.where(F.col("q_num") <= 2)
        .groupBy(F.col("_sheet").alias("_head"))
        .agg(
            cell_max(F.col("_cells"), F.col("q_num") == 1).alias("_names"),
            cell_max(F.col("_cells"), F.col("q_num") == 2).alias("_types"),
        )
    )
    per_sheet = len(cells) // 2
    joined = rows.where(F.col("q_num") > 2).join(heads, F.col("_sheet") == F.col("_head"))
    spread = joined.select(
        "_sheet",
        "q_num",
        F.posexplode(F.arrays_zip(F.col("_names"), F.col("_types"), F.col("_cells"))).alias("_at", "_cell"),
    )
    plan = F.col("_sheet") * per_sheet + F.floor(F.col("_at") / 2) + 1
    return spread.where(F.col("_cell._names") != "name").select(
        plan.cast("long").alias("plan_id"),
        F.col("_cell._names").alias("name"),
        F.col("_cell._types").alias("type"),
        F.concat(F.lit("Q_"), F.col("q_num")).alias("q_id"),
        "q_num",
        F.col("_cell._cells").alias("entry"),
    )


def sheet_key(sheet: DataFrame) -> DataFrame:
    """The question key that the heading columns of the sheets state, each question once."""
    return sheet.select(
        F.concat(F.lit("Q_"), F.col("q_num")).alias("q_id"),
        F.col("code").alias("q_code"),
        F.col("`plan-id`").alias("q_long"),
        "q_num",
        component(F.col("q_num")).alias("category"),
    ).distinct()
