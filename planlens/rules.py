"""The 73 yes/no indicators as data.

A rule holds its section, inclusion type, whether the main figure shows it, and
a SQL expression over the numeric answer columns of one plan.  Comparisons with
a missing answer are NULL unless the rest of the condition decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from planlens.questions import ANSWER_CODES, THREATS
from planlens.sources.tables import literal_table

# Section and inclusion-type labels, in report order.
SECTIONS = ["Climate change", "Objectives", "Assessments", "Design", "Monitoring", "Adaptive management"]
TYPES = ["Climate Action", "Recommended Action", "General Awareness"]
CLIMATE, OBJECTIVES, ASSESSMENTS, DESIGN, MONITORING, MANAGEMENT = SECTIONS
CA, RA, GA = TYPES

# Sections whose totals become NULL on one NULL entry; the others skip NULL.
STRICT_SECTIONS = {CLIMATE, OBJECTIVES, DESIGN}


@dataclass(frozen=True)
class Rule:
    stat: str
    section: str
    type: str
    figure: int
    sql: str

    @property
    def column(self) -> str:
        return f"CAST({self.sql} AS DOUBLE) AS {self.stat}"

    @property
    def inputs(self) -> list[str]:
        words = set(re.findall(r"\w+", self.sql))
        return [code for code in ANSWER_CODES if code in words]


def _any(codes: Iterable[str], test: str) -> str:
    return "(" + " OR ".join(f"{code} {test}" for code in codes) + ")"


def _one(*codes: str) -> str:
    return _any(codes, "= 1")


def _nonzero(*codes: str) -> str:
    return _any(codes, "<> 0")


def _included(code: str) -> str:
    """Planned (0.5) or present (1); a missing answer is neither."""
    return f"coalesce({code} IN (0.5D, 1D), false)"


def _one_or_missing(*codes: str) -> str:
    """Done or planned: planned answers are NULL once they are numbers."""
    return "(" + " OR ".join(f"{code} IS NULL OR {code} = 1" for code in codes) + ")"


EXPLICIT_CLIMATE = (
    "climate_mention",
    "climate_plan",
    "climate_action",
    "climate_mitigation",
    "climate_sink",
    "climate_limitations",
    "obj_cc_any",
    "design_cc_any",
    "monitor_exp_any",
)


def _threat_codes(suffix: str = "") -> tuple[str, ...]:
    general = "threat" + (suffix or "_any")
    return (general, *(f"threat_{t}{suffix}" for t in THREATS))


def _climate_rules():
    total = "(" + " + ".join(EXPLICIT_CLIMATE) + ")"
    yield "climate_mention", CA, 1, "climate_mention"
    yield "climate_mention_only", CA, 0, f"{total} = 1"
    yield "climate_plan", CA, 1, "climate_plan"
    yield "climate_some", CA, 1, f"{total} > 1 AND climate_plan = 0"


def _objective_rules():
    long_term = [f"obj_lt_{x}" for x in ("function", "resilience", "baseline", "monitor", "reference")]
    yield "obj_cons_any", GA, 1, "obj_any"
    yield "obj_cons_sp", RA, 0, "obj_sp"
    yield "obj_cons_unit", RA, 0, "obj_unit"
    yield "obj_cons_both", RA, 1, "obj_sp = 1 AND obj_unit = 1"
    yield "obj_mgmt_any", GA, 1, _one("obj_any", "obj_cc_any", "obj_lt_any", "monitor_any")
    yield "obj_mgmt_lt", RA, 1, _one(*long_term)
    yield "obj_mgmt_eco", RA, 0, "obj_lt_function"
    yield "obj_mgmt_monitor", RA, 0, _one("obj_lt_baseline", "obj_lt_monitor")
    yield "obj_mgmt_res", RA, 0, "obj_lt_resilience"
    yield "obj_mgmt_ref", RA, 0, "obj_lt_reference"
    yield "obj_cc_any", CA, 1, "obj_cc_any"
    yield "obj_cc_gen", CA, 0, _one("obj_cc_function", "obj_cc_general", "obj_cc_resilience")


def _assessment_rules():
    yield "assess_threat", GA, 1, _nonzero(*_threat_codes())
    yield "assess_any", RA, 0, "assess_any"
    yield "assess_any_planned", RA, 0, "assess_any IS NULL"
    yield "assess_any_both", RA, 1, _one_or_missing("assess_any")
    yield "assess_climate", CA, 0, "assess_climate"
    yield "assess_cc_planned", CA, 0, "assess_climate IS NULL"
    yield "assess_cc_both", CA, 1, _one_or_missing("assess_climate")
    yield "assess_all", RA, 0, _one_or_missing("assess_any", "assess_climate")


def _design_rules():
    yield "design_any", GA, 1, "design_any"
    yield "design_type_zoning", GA, 0, "design_type = 0.5"
    yield "design_type_boundaries", GA, 0, "design_type = 1"
    yield "design_resilience_all", RA, 1, _included("design_resilience")
    yield "design_cc_all", CA, 1, _included("design_cc_any")
    yield "design_cc_planned", CA, 0, "design_cc_any = 0.5"
    yield "design_cc_current", CA, 0, "design_cc_any = 1"
    for kind in ("resilient", "critical", "connect", "shifting", "refugia"):
        yield f"design_cc_{kind}_all", CA, 0, _included(f"design_cc_{kind}")
    yield "design_adaptive_any", RA, 1, "design_adaptive_any"
    yield "design_adaptive_fully", RA, 0, "design_adaptive_fully"
    yield "design_adaptive_zoning", RA, 0, "design_adaptive_zoning"
    yield "design_adaptive_both", RA, 0, "design_adaptive_fully = 1 AND design_adaptive_zoning = 1"
    yield "design_cc_adaptive", CA, 1, "design_adaptive_climate"


def _monitoring_rules():
    yield "monitor_any", GA, 1, "monitor_any"
    yield "monitor_planned", GA, 0, "monitor_any = 1 AND monitor_sci = 0 AND monitor_soc = 0"
    yield "monitor_sci", RA, 1, "monitor_sci"
    yield "monitor_soc", RA, 1, "monitor_soc"
    yield "monitor_cc_explicit", CA, 1, "monitor_exp_any"
    yield "monitor_cc_implicit", RA, 0, "monitor_imp_any = 1 AND monitor_exp_any = 0"
    yield "monitor_cc_all", RA, 0, _one("monitor_imp_any", "monitor_exp_any")
    yield "monitor_cc_research", CA, 0, _one("obj_cc_research", "monitor_exp_research")


def _management_rules():
    protection = ("climate_mitigation", "climate_sink")
    extra = ("obj_cc_green", "obj_cc_awareness")
    yield "mgmt_adapt", GA, 1, "mgmt_adapt"
    yield "mgmt_adapt_anymitigation", CA, 1, f"{_one(*protection)} OR {_nonzero(*extra)}"
    yield "mgmt_adapt_protection", CA, 0, _one(*protection)
    yield "mgmt_adapt_green", CA, 0, "obj_cc_green"
    yield "mgmt_adapt_awareness", CA, 0, "obj_cc_awareness"
    yield "mgmt_adapt_limitation", CA, 0, "climate_limitations"
    yield "threat_any", GA, 0, _nonzero(*_threat_codes())
    yield "threat_any_strat", RA, 1, _nonzero(*_threat_codes("_strat"))
    yield "threat_any_cc", CA, 1, _nonzero(*_threat_codes("_cc"))
    for threat in THREATS:
        yield f"threat_{threat}", GA, 0, f"threat_{threat}"
        yield f"threat_{threat}_strat", RA, 0, f"threat_{threat}_strat"
        yield f"threat_{threat}_cc", CA, 0, f"threat_{threat}_cc"


_BY_SECTION = {
    CLIMATE: _climate_rules,
    OBJECTIVES: _objective_rules,
    ASSESSMENTS: _assessment_rules,
    DESIGN: _design_rules,
    MONITORING: _monitoring_rules,
    MANAGEMENT: _management_rules,
}

RULES: list[Rule] = [
    Rule(stat, section, type_, figure, sql)
    for section, rules in _BY_SECTION.items()
    for stat, type_, figure, sql in rules()
]
STATS = [r.stat for r in RULES]

# Figure labels of the 24 main indicators, in figure order.
FIGURE_LABELS = {
    "climate_plan": "Detailed climate change action plan",
    "climate_some": "Explicit climate change strategy",
    "climate_mention": "Mentions climate change",
    "obj_cc_any": "Explicit climate change objective",
    "obj_cons_both": "Both species- and unit-level objectives",
    "obj_mgmt_lt": "Long-term management objective",
    "obj_cons_any": "Any conservation objective",
    "obj_mgmt_any": "Any management objective",
    "assess_cc_both": "Explicit climate change assessment ",
    "assess_any_both": "Any threat assessment",
    "assess_threat": "Identified potential threat or stressor",
    "design_cc_all": "Design considers climate change",
    "design_cc_adaptive": "Adaptive design connected to climate change",
    "design_adaptive_any": "Any adaptive design",
    "design_resilience_all": "Design includes resilience principle",
    "design_any": "Provides design criteria",
    "monitor_cc_explicit": "Explicit climate change monitoring",
    "monitor_soc": "Socioeconomic monitoring",
    "monitor_sci": "Ecological monitoring",
    "monitor_any": "Any objectives for monitoring",
    "mgmt_adapt_anymitigation": "Climate mitigation strategy",
    "threat_any_cc": "Threat reduction strategy linked to climate change",
    "threat_any_strat": "Strategy to address interacting threat",
    "mgmt_adapt": "Discusses adaptive management",
}

# Threat labels in figure order.
THREAT_LABELS = {
    "invasive": "Invasive Species",
    "tourism": "Tourism",
    "compliance": "Lack of Compliance",
    "pollution": "Marine Debris or Pollution",
    "habitat": "Habitat Degradation",
}


def section_rules(section: str) -> list[Rule]:
    return [r for r in RULES if r.section == section]


def input_codes(rules: Sequence[Rule]) -> list[str]:
    """The answer codes that a list of rules reads, each once."""
    return list(dict.fromkeys(code for rule in rules for code in rule.inputs))


def rule_table(spark: SparkSession) -> DataFrame:
    """stat, type, figure and category of the 73 indicators."""
    return literal_table(
        spark, ["stat", "type", "figure", "category"], [(r.stat, r.type, r.figure, r.section) for r in RULES]
    )
