"""From answers to the 73 indicators and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions.levels import level_rank, recode, recode_rank
from planlens.functions.nulls import lenient_sum, not_in_set, percent, strict_sum
from planlens.functions.text import split_parts
from planlens.operators.reshape import answers_wide, to_long
from planlens.rules import (
    ASSESSMENTS,
    FIGURE_LABELS,
    MANAGEMENT,
    RULES,
    SECTIONS,
    STATS,
    STRICT_SECTIONS,
    THREAT_LABELS,
    Rule,
    input_codes,
    rule_table,
    section_rules,
)


def indicators(review: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """plan_id and one column per rule: one shuffle, then one projection.

    Only the answer codes that the rules read are widened, which also keeps
    every row below the field limit of generated code.
    """
    wide = answers_wide(review, input_codes(rules), numeric=True)
    return wide.selectExpr("plan_id", *[r.column for r in rules])


def indicator_matrix(review: DataFrame) -> DataFrame:
    return indicators(review)


def indicator_full_join(review: DataFrame) -> DataFrame:
    """The matrix put together from six section tables.

    The answers are widened once.  Each section gives one tagged row a plan, in
    which the columns of the others are missing, so that one aggregate by plan is
    the full join of all six, NULL plans included; the rows already lie by plan.
    """
    wide = answers_wide(review, input_codes(RULES), numeric=True)
    stats = [r.stat for r in RULES]
    matrix = wide.selectExpr("plan_id", *[r.column for r in RULES])
    rows = [
        F.struct(*[(F.col(r.stat) if r.section == section else F.lit(None).cast(matrix.schema[r.stat].dataType)).alias(r.stat) for r in RULES])
        for section in SECTIONS
    ]
    tagged = matrix.select("plan_id", F.explode(F.array(*rows)).alias("_row")).select("plan_id", "_row.*")
    return tagged.groupBy("plan_id").agg(*[F.max(c).alias(c) for c in stats])


def _rule_sum(rule: Rule) -> Column:
    entry = F.col(rule.stat)
    if rule.section == ASSESSMENTS:
        return F.count_if(entry == 1).cast("double")
    return strict_sum(entry) if rule.section in STRICT_SECTIONS else lenient_sum(entry)


def stack(rows: Sequence[Sequence[str]], names: Sequence[str]) -> Column:
    """Spread one row into several; ``rows`` hold SQL expressions."""
    cells = ", ".join(", ".join(row) for row in rows)
    return F.expr(f"stack({len(rows)}, {cells}) AS ({', '.join(names)})")


def summarise(matrix: DataFrame, rules: Sequence[Rule], n_plans=None) -> DataFrame:
    """One row per indicator: number and percentage of plans.

    All totals come from one aggregate over one row per plan; the single
    result row is then spread.  ``n_plans`` replaces the denominator, which
    otherwise is the number of plans.  An assessment indicator that no plan
    meets has no row.
    """
    sums = matrix.agg(*[_rule_sum(r).alias(r.stat) for r in rules], F.count(F.lit(1)).alias("_plans"))
    spread = [(f"'{r.stat}'", r.stat, f"'{r.type}'", str(r.figure), f"'{r.section}'") for r in rules]
    rows = sums.select("_plans", stack(spread, ["stat", "n_plans", "type", "figure", "category"]))
    whole = F.col("_plans") if n_plans is None else F.lit(n_plans)
    kept = rows.where((F.col("category") != ASSESSMENTS) | (F.col("n_plans") > 0))
    return kept.select(
        "stat", "n_plans", percent(F.col("n_plans"), whole).alias("pct"), "type", "figure", "category"
    )


def section_summary(review: DataFrame, section: str, n_plans=None) -> DataFrame:
    rules = section_rules(section)
    return summarise(indicators(review, rules), rules, n_plans)


def all_stat(review: DataFrame, n_plans=None) -> DataFrame:
    """The six summaries in one pass over the plans, with the section order."""
    stats = summarise(indicators(review), RULES, n_plans)
    return stats.withColumn("category_rank", level_rank(F.col("category"), SECTIONS))


def all_by_plan(review: DataFrame, n_plans=None) -> DataFrame:
    """One row per plan and indicator with the attributes and totals of the indicator.

    The joined table has one row per rule, so its size does not depend on the data.
    """
    matrix = indicators(review)
    totals = summarise(matrix, RULES, n_plans).select("stat", "n_plans", "pct")
    attributes = rule_table(review.sparkSession).join(totals, "stat", "left")
    return plan_entries(matrix).join(F.broadcast(attributes), "stat", "left")


def plan_entries(matrix: DataFrame) -> DataFrame:
    """The matrix as one row per plan and indicator."""
    return to_long(matrix, ["plan_id"], STATS, "stat", "entry")


def entries_with_rules(review: DataFrame) -> DataFrame:
    """Entries with the fixed attributes of their rule, without totals."""
    rules = rule_table(review.sparkSession)
    return plan_entries(indicators(review)).join(F.broadcast(rules), "stat", "left")


def results_long(review: DataFrame) -> DataFrame:
    """All results under report headings, labels in lower case."""
    return entries_with_rules(review).select(
        F.col("plan_id").alias("Plan ID"),
        F.lower("category").alias("Component"),
        F.col("stat").alias("Criteria"),
        F.lower("type").alias("Climate Change Inclusion"),
        F.col("entry").alias("Value"),
    )


def figure_indicators(stats: DataFrame) -> DataFrame:
    """The 24 indicators of the main figure with label and label order."""
    return stats.where(F.col("figure") == 1).select(
        "stat",
        recode(F.col("stat"), FIGURE_LABELS).alias("stat_long"),
        recode_rank(F.col("stat"), FIGURE_LABELS).alias("stat_rank"),
        "n_plans",
        "pct",
        "type",
        "category",
    )


def threat_matrix(review: DataFrame, n_plans=None) -> DataFrame:
    """Five threats by three inclusion types."""
    rules = [r for r in section_rules(MANAGEMENT) if r.stat.startswith("threat_")]
    stats = summarise(indicators(review, rules), rules, n_plans)
    named = stats.select("*", *split_parts(F.col("stat"), "_", ["cat", "subcat", "part"]))
    kept = named.where(not_in_set(F.col("subcat"), ["adapt", "any"]))
    return kept.select(
        "stat",
        recode(F.col("subcat"), THREAT_LABELS).alias("threat"),
        recode_rank(F.col("subcat"), THREAT_LABELS).alias("threat_rank"),
        "type",
        "n_plans",
        "pct",
    )


def split_stats(stats: DataFrame) -> DataFrame:
    """Summary rows with the parts of the indicator name."""
    return stats.select("stat", *split_parts(F.col("stat"), "_", ["cat", "subcat", "part"]), "n_plans")


def labelled_threats(stats: DataFrame) -> DataFrame:
    """Summary rows whose second name part is replaced by its label where it has one."""
    subcat = F.col("subcat")
    return split_stats(stats).select(
        "stat", recode(subcat, THREAT_LABELS).alias("label"), recode_rank(subcat, THREAT_LABELS).alias("label_rank"), "n_plans"
    )
