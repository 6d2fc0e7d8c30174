"""The older, condensed scoring: binary answers, combined flags, capped totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.functions.levels import level_rank
from planlens.functions.nulls import (
    all_nonzero,
    any_nonzero,
    cap,
    first_match,
    flag,
    in_set,
    percent,
    replace_where,
    row_total,
)
from planlens.functions.text import sentence_case
from planlens.operators.inclusion import short_names
from planlens.operators.indicators import stack
from planlens.operators.joins import full_join, left_join
from planlens.operators.ranking import numbered
from planlens.operators.reshape import stat_rows, to_long
from planlens.operators.review import plan_names
from planlens.questions import ANSWER_CODES, QUESTION_CODES, THREATS, component_of
from planlens.session import materialise

CA, RA = "Climate Action", "Recommended Action"

_COMPONENT_OF = {code: component_of(n) for n, code in QUESTION_CODES.items() if code in ANSWER_CODES}

# Components in report order.
COMPONENTS = ["climate", "objectives", "assessment", "design", "monitoring", "management"]

# Codes of each level in the condensed scoring.
CLIMATE_CODES = [
    "climate_plan",
    "climate_action",
    "obj_cc_any",
    "assess_climate",
    "design_adaptive_climate",
    "design_cc_any",
    "monitor_exp_any",
    "threat_cc_combined",
]
ACTION_CODES = [
    "obj_lt_any",
    "assess_any_combined",
    "design_resilience",
    "design_adaptive_fully",
    "design_adaptive_zoning",
    "design_adaptive_any",
    "monitor_sci",
    "monitor_soc",
    "threat_strat_combined",
]
AWARE_CODES = ["climate_mention", "obj_mgmt_any", "design_any", "monitor_any", "mgmt_adapt", "threat_any_combined"]

# Codes that the condensed scoring leaves out again.
DROPPED_CODES = ["monitor_soc", "design_adaptive_zoning", "design_adaptive_fully"]

# Differences of the earlier statistics, and the radar codes.
EARLIER_EXTRA = {CA: ["climate_mitigation"], RA: ["obj_both_sp_unit"], "General Awareness": ["obj_any"]}
RADAR_CODES = [
    "climate_plan",
    "climate_action",
    "climate_mention",
    "obj_mgmt_any",
    "obj_cc_any",
    "obj_lt_any",
    "assess_any_combined",
    "assess_climate",
    "design_cc_any",
    "design_resilience",
    "design_any",
    "monitor_any",
    "monitor_sci",
    "monitor_exp_any",
    "threat_cc_combined",
    "threat_strat_combined",
    "threat_any_combined",
]


def binary_answers(review: DataFrame) -> DataFrame:
    """Planned or present answers as 1, all others as 0 (0.5 and NULL included)."""
    stat = stat_rows(review)
    missing_type = (F.col("q_code") == "design_type") & F.col("entry").isNull()
    filled = replace_where(F.col("entry"), missing_type, "0")
    return stat.withColumn("entry", in_set(filled, ["Planned", "1"]).cast("double"))


def _threat_codes(suffix: str) -> list[str]:
    return ["threat" + (suffix or "_any"), *(f"threat_{t}{suffix}" for t in THREATS)]


def _combined(earlier: bool) -> list[tuple[str, str, list[str], Column]]:
    """Component, code, inputs and value of the combined flags."""
    any_threat, strategy, climate = _threat_codes(""), _threat_codes("_strat"), _threat_codes("_cc")
    assess = ["assess_any", "assess_climate"]
    combined = [
        ("assessment", "threat_any_combined", any_threat, flag(any_nonzero(any_threat))),
        ("management", "threat_strat_combined", strategy, flag(any_nonzero(strategy))),
        ("management", "threat_cc_combined", climate, flag(any_nonzero(climate))),
        ("assessment", "assess_any_combined", assess, flag(any_nonzero(assess))),
        ("objectives", "obj_mgmt_any", [], F.lit(1)),
    ]
    if earlier:
        both = ["obj_sp", "obj_unit"]
        combined.append(("objectives", "obj_both_sp_unit", both, flag(all_nonzero(both))))
    return combined


def all_entries(review: DataFrame, codes: Sequence[str], earlier: bool = False) -> DataFrame:
    """Binary answers of the listed codes plus the combined flags, from one pass over the answers.

    A plan's answers become one row, whose cells are spread again: a listed
    code has a row where the plan has an answer row, a combined flag always.
    """
    components = dict(_COMPONENT_OF)
    if earlier:
        components["climate_mitigation"] = "management"
    combined = [c for c in _combined(earlier) if c[1] in codes]
    base = [c for c in dict.fromkeys(codes) if c in ANSWER_CODES and components[c] != "metadata"]
    inputs = list(dict.fromkeys([*base, *[code for _, _, codes_, _ in combined for code in codes_]]))
    wide = binary_answers(review).groupBy("plan_id").agg(
        *[F.expr(f"max(CASE WHEN q_code = '{code}' THEN entry END) AS {code}") for code in inputs]
    )
    flags = [code for _, code, _, _ in combined]
    cells = [(f"'{components[c]}'", f"'{c}'", c) for c in base] + [(f"'{c}'", f"'{code}'", code) for c, code, _, _ in combined]
    rows = wide.select("plan_id", *base, *[value.cast("double").alias(code) for _, code, _, value in combined])
    spread = rows.select("plan_id", stack(cells, ["category", "q_code", "entry"]))
    return spread.where(F.col("entry").isNotNull() | F.col("q_code").isin(*flags))


def condensed_flags(review: DataFrame) -> DataFrame:
    """The condensed codes of every plan with component, value and level."""
    kept = [c for c in CLIMATE_CODES + ACTION_CODES + AWARE_CODES if c not in DROPPED_CODES]
    entries = all_entries(review, kept)
    code = F.col("q_code")
    level = first_match(
        [
            (code.isin(*CLIMATE_CODES), CA),
            (code.isin(*ACTION_CODES), RA),
            (code.isin(*AWARE_CODES), "General Management Awareness"),
        ]
    )
    return entries.select("plan_id", "category", "q_code", "entry", level.alias("level"))


def condensed_summary(review: DataFrame, plan_region: DataFrame) -> DataFrame:
    """Capped component totals per plan with name, region and the rank of the name.

    Names are placed by their mean total, those with the same mean in the order of the names.
    """
    flags = condensed_flags(review)
    totals = flags.groupBy("plan_id").agg(
        *[strict_sum_where(F.col("entry"), F.col("category") == c).alias(c) for c in COMPONENTS]
    )
    names = full_join(short_names(plan_names(review)), plan_region, "plan_id")
    named = materialise(full_join(totals, names, "plan_id").withColumn("total", row_total(COMPONENTS)))
    means = named.where(F.col("name_short").isNotNull()).groupBy(F.col("name_short").alias("_short"))
    known = means.agg(F.avg("total").alias("_mean")).where(F.col("_mean").isNotNull())
    ranks = numbered(known, ["_mean", "_short"], "name_rank").drop("_mean")
    ranked = left_join(named, ranks.withColumnRenamed("_short", "name_short"), "name_short")
    long = to_long(ranked, ["name_short", "region", "total", "name_rank"], COMPONENTS, "indicator", "entry")
    return long.where(~(F.col("entry") == 0)).select(
        "name_short",
        "region",
        "total",
        "name_rank",
        "indicator",
        level_rank(F.col("indicator"), COMPONENTS).alias("indicator_rank"),
        cap(F.col("entry"), 3.0).cast("int").cast("string").alias("entry"),
    )


def strict_sum_where(value: Column, here: Column) -> Column:
    """Strict sum over a part of the group; NULL for an empty part."""
    return F.when(F.count_if(here & value.isNull()) == 0, F.sum(F.when(here, value)))


def _with_percent(counts: DataFrame, n_plans) -> DataFrame:
    """The counts with their percentage of the plans.

    Every plan has the flag ``obj_mgmt_any``, so its count is theirs.  The
    window holds one row per code and answer, whatever the number of plans.
    """
    every = F.max(F.when(F.col("q_code") == "obj_mgmt_any", F.col("_known"))).over(Window.partitionBy())
    whole = F.lit(n_plans) if n_plans is not None else every
    return counts.withColumn("pct", percent(F.col("n"), whole)).drop("_known")


def earlier_level_stats(review: DataFrame, n_plans=None) -> DataFrame:
    """Plans per component, level, code and answer, with their percentage of the plans with coded answers."""
    levels = {
        CA: CLIMATE_CODES + EARLIER_EXTRA[CA],
        RA: ACTION_CODES + EARLIER_EXTRA[RA],
        "General Awareness": AWARE_CODES + EARLIER_EXTRA["General Awareness"],
    }
    entries = all_entries(review, [c for codes in levels.values() for c in codes], earlier=True)
    level = first_match([(F.col("q_code").isin(*codes), name) for name, codes in levels.items()])
    counts = entries.groupBy(
        sentence_case(F.col("category")).alias("category"), level.alias("level"), "q_code", "entry"
    ).agg(F.count(F.lit(1)).alias("n"), F.count("plan_id").alias("_known"))
    return _with_percent(counts, n_plans)


def earlier_code_stats(review: DataFrame, n_plans=None) -> DataFrame:
    """Plans that meet each code, whatever its level, with their percentage of the plans with coded answers."""
    entries = all_entries(review, [*ANSWER_CODES, *[code for _, code, _, _ in _combined(True)]], earlier=True)
    met = entries.where(F.col("entry") == 1).groupBy("category", "q_code", "entry")
    return _with_percent(met.agg(F.count(F.lit(1)).alias("n"), F.count("plan_id").alias("_known")), n_plans)


def radar_score(review: DataFrame) -> DataFrame:
    """Codes met per plan and component; NULL where a component has none."""
    met = all_entries(review, RADAR_CODES, earlier=True).where(F.col("entry") == 1)
    hits = [F.sum(F.when(F.col("category") == c, F.lit(1))).alias(c) for c in COMPONENTS]
    return met.groupBy("plan_id").agg(*hits)
