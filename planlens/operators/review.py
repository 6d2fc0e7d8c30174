"""The long review table and small reports on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from planlens.functions.nulls import STATUSES, answer_status, in_set, n_distinct, not_in_set, percent, ratio, to_number
from planlens.functions.text import remove_all, sentence_case, trim_space
from planlens.operators.reshape import answers_wide, spread_counts, stat_rows, to_long
from planlens.questions import EXCLUDED_PLANS


def with_key(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Attach code, wording and component; the key has one row per question."""
    return answers.join(F.broadcast(key), ["q_id", "q_num"], "left")


def exclude_plans(df: DataFrame, plans: Sequence[int] = tuple(EXCLUDED_PLANS)) -> DataFrame:
    """Drop the listed plans; rows without a plan stay."""
    return df.where(not_in_set(F.col("plan_id"), plans))


def review_long(answers: DataFrame, key: DataFrame, excluded: Sequence[int] = tuple(EXCLUDED_PLANS)) -> DataFrame:
    """The fact table: answers with key attributes, without excluded plans."""
    return with_key(exclude_plans(answers, excluded), key).select(
        "plan_id", "name", "type", "q_id", "q_num", "entry", "q_code", "q_long", "category"
    )


def plan_ids(review: DataFrame) -> DataFrame:
    return review.select("plan_id").distinct()


def plan_names(review: DataFrame) -> DataFrame:
    return review.select("plan_id", "name").distinct()


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per group; NULL is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def language_share(review: DataFrame) -> DataFrame:
    """Languages with their number and share of plans, most frequent first."""
    counts = count_by(stat_rows(review).where(F.col("q_code") == "metadata_language"), "entry", name="count")
    total = F.sum("count").over(Window.partitionBy())  # over one row per language
    return counts.select(
        sentence_case(F.col("entry")).alias("entry"),
        "count",
        F.bround(ratio(F.col("count"), total), 3).alias("proportion"),
    ).orderBy(F.desc_nulls_last("count"))


def strategy_table(review: DataFrame) -> DataFrame:
    """The distinct texts of explicit climate strategies, under report headings."""
    code = F.col("q_code")
    chosen = review.where(
        (F.col("type") == "detail")
        & (code.contains("cc") | code.contains("climate"))
        & F.col("entry").isNotNull()
        & not_in_set(code, ["climate_mention", "climate_action"])
    )
    return chosen.select(
        F.col("plan_id").alias("Plan"),
        F.col("name").alias("Name"),
        sentence_case(F.col("category")).alias("Component"),
        trim_space(remove_all(F.col("q_long"), "-")).alias("Indicator"),
        F.col("entry").alias("Strategy"),
    ).distinct()


def climate_subset(review: DataFrame) -> DataFrame:
    """The climate component plus the explicit climate questions of other components."""
    code = F.col("q_code")
    return stat_rows(review).where(
        (F.col("category") == "climate")
        | (code == "obj_cc_any")
        | (code == "design_cc_any")
        | (code == "monitor_exp_any")
    )


def assessment_total(review: DataFrame, n_plans=None) -> DataFrame:
    """Plans with a completed or planned assessment, their share, their countries."""
    wide = answers_wide(review, ["country", "assess_any", "assess_climate"])
    # An answer that is no number ("Planned") counts as planned, like a missing one.
    hit = in_set(to_number(F.col("assess_any")), [1.0], with_null=True) | in_set(
        to_number(F.col("assess_climate")), [1.0], with_null=True
    )
    totals = wide.agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(hit).alias("n_plans"),
        n_distinct(F.when(hit, F.col("country"))).alias("n_countries"),
    )
    whole = F.col("_all") if n_plans is None else F.lit(n_plans)
    return totals.select("n_plans", percent(F.col("n_plans"), whole).alias("pct_assess"), "n_countries")


def stated_answers(review: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One row per plan, one column per code: what the plan states, before answers become numbers.

    "answered" (a number), "planned", "other" (another text) or "missing", also
    where a plan has no row of the code; of several the first that applies.
    The indicators take the last three for planned.
    """
    cells = stat_rows(review).select("plan_id", "q_code", answer_status(F.col("entry")).alias("status"))
    wide = cells.groupBy("plan_id").agg(*[F.max(F.when(F.col("q_code") == c, F.col("status"))).alias(c) for c in codes])
    named = F.array(*[F.lit(s) for s in STATUSES])
    return wide.select("plan_id", *[F.get(named, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in codes])


def planned_counts(review: DataFrame, codes: Sequence[str], n_plans=None) -> DataFrame:
    """Per code the plans of each status, and the shares that are taken for planned and that state it."""
    long = to_long(stated_answers(review, codes), ["plan_id"], codes, "q_code", "status")
    counts = long.groupBy("q_code").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.count_if(F.col("status") != "answered").alias("n_taken"),
        F.count(F.lit(1)).alias("_all"),
    )
    whole = F.col("_all") if n_plans is None else F.lit(n_plans)
    shares = {"pct_taken": percent(F.col("n_taken"), whole), "pct_planned": percent(F.col("n_planned"), whole)}
    return counts.withColumns(shares).drop("_all")


def design_entry_counts(review: DataFrame) -> DataFrame:
    """Design answers by code and value, with the share of ones among ones and zeros."""
    design = stat_rows(review).where(F.col("category") == "design")
    counts = count_by(design, "q_code", "entry")
    wide = spread_counts(counts, ["q_code"], "entry", ["0", "0.5", "1"], F.col("n"))
    return wide.withColumn("pct_1", ratio(F.col("1"), F.col("1") + F.col("0")) * 100)
