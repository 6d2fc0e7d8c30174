"""The questionnaire: question numbers, codes and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planlens.sources.tables import literal_table

# 83 questions; the first two hold the plan name and record type.
N_QUESTIONS = 83
FIRST_ANSWER = 3

COMPONENTS = ["metadata", "climate", "objectives", "assessment", "design", "monitoring", "management"]

# Question numbers of each component.
COMPONENT_RANGES = [
    ("metadata", [(1, 6), (80, 83)]),
    ("climate", [(7, 12)]),
    ("objectives", [(13, 30)]),
    ("assessment", [(31, 33)]),
    ("design", [(34, 47)]),
    ("monitoring", [(50, 59)]),
    ("management", [(48, 49), (60, 79)]),
]

# Plans left out of every analysis.
EXCLUDED_PLANS = [173, 174, 128, 103]

THREATS = ["compliance", "tourism", "pollution", "invasive", "habitat"]

# Question codes by component, first question number first.
_CODE_BLOCKS = [
    (3, ["country", "metadata_language"]),
    (
        7,
        [
            "climate_mention",
            "climate_plan",
            "climate_action",
            "climate_mitigation",
            "climate_sink",
            "climate_limitations",
        ],
    ),
    (
        13,
        [
            "obj_any",
            "obj_sp",
            "obj_unit",
            "obj_cc_any",
            "obj_lt_any",
            "obj_lt_function",
            "obj_lt_resilience",
            "obj_lt_baseline",
            "obj_lt_monitor",
            "obj_lt_reference",
            "obj_cc_function",
            "obj_cc_general",
            "obj_cc_resilience",
            "obj_cc_research",
            "obj_cc_green",
            "obj_cc_awareness",
        ],
    ),
    (31, ["assess_any", "assess_climate"]),
    (
        34,
        [
            "design_any",
            "design_type",
            "design_resilience",
            "design_cc_any",
            "design_cc_resilient",
            "design_cc_critical",
            "design_cc_connect",
            "design_cc_shifting",
            "design_cc_refugia",
            "design_adaptive_any",
            "design_adaptive_fully",
            "design_adaptive_zoning",
            "design_adaptive_climate",
        ],
    ),
    (48, ["mgmt_adapt"]),
    (50, ["monitor_any", "monitor_sci", "monitor_soc", "monitor_imp_any", "monitor_exp_any", "monitor_exp_research"]),
    (62, ["threat_any", "threat_strat", "threat_cc"]),
    (65, [f"threat_{t}{suffix}" for t in THREATS for suffix in ("", "_strat", "_cc")]),
]


def component_of(number: int) -> str:
    for name, ranges in COMPONENT_RANGES:
        if any(low <= number <= high for low, high in ranges):
            return name
    raise ValueError(f"no component for question {number}")


def question_codes() -> dict[int, str]:
    """Question number to code; questions without a published code get a plain one."""
    named = {first + i: code for first, codes in _CODE_BLOCKS for i, code in enumerate(codes)}
    prefix = {"objectives": "obj", "assessment": "assess", "monitoring": "monitor", "management": "mgmt"}
    codes = {1: "name", 2: "type"}
    for n in range(FIRST_ANSWER, N_QUESTIONS + 1):
        component = component_of(n)
        codes[n] = named.get(n, f"{prefix.get(component, component)}_q{n}")
    return codes


QUESTION_CODES = question_codes()
ANSWER_CODES = [QUESTION_CODES[n] for n in range(FIRST_ANSWER, N_QUESTIONS + 1)]


def question_text(number: int) -> str:
    """Question wording with the dashes and stray blanks of a hand-kept sheet."""
    return f" - Question {number}: {QUESTION_CODES[number].replace('_', '-')}\t"


def component(q_num: Column) -> Column:
    """Component of a question number, NULL outside the questionnaire."""

    def inside(ranges: list[tuple[int, int]]) -> Column:
        (low, high), *rest = ranges
        test = q_num.between(low, high)
        for low, high in rest:
            test = test | q_num.between(low, high)
        return test

    (name, ranges), *others = COMPONENT_RANGES
    result = F.when(inside(ranges), name)
    for name, ranges in others:
        result = result.when(inside(ranges), name)
    return result


def question_key(spark: SparkSession) -> DataFrame:
    """q_id, q_num, q_code, q_long and category for the 83 questions."""
    rows = [(n, QUESTION_CODES[n], question_text(n)) for n in range(1, N_QUESTIONS + 1)]
    key = literal_table(spark, ["q_num", "q_code", "q_long"], rows)
    return key.select(
        F.concat(F.lit("Q_"), F.col("q_num")).alias("q_id"),
        "q_num",
        "q_code",
        "q_long",
        component(F.col("q_num")).alias("category"),
    )
