"""The registered queries once more, as SQL for another engine.

The statements are written independently of the operators: window ranks instead
of bucket counts, closed forms instead of rings, spelled-out conditions instead
of the rule table.  Only the constant questionnaire codes are shared.
"""

from __future__ import annotations

from planlens.questions import ANSWER_CODES, N_QUESTIONS, QUESTION_CODES, question_text

EXCLUDED = "173, 174, 128, 103"


def _flag(condition: str) -> str:
    """1, 0 or NULL, as a double."""
    return f"CAST(CASE WHEN {condition} THEN 1 WHEN NOT ({condition}) THEN 0 END AS DOUBLE)"


def _pct(n: str, whole: str) -> str:
    return f"round_even(CAST({n} AS DOUBLE) / {whole} * 100, 1)"


# Review tables

_CATEGORY = """CASE WHEN q_num <= 6 OR q_num >= 80 THEN 'metadata'
  WHEN q_num <= 12 THEN 'climate' WHEN q_num <= 30 THEN 'objectives' WHEN q_num <= 33 THEN 'assessment'
  WHEN q_num <= 47 THEN 'design' WHEN q_num IN (48, 49, 60, 61) THEN 'management'
  WHEN q_num <= 59 THEN 'monitoring' ELSE 'management' END"""

_KEY_ROWS = ", ".join(f"({n}, '{QUESTION_CODES[n]}', '{question_text(n)}')" for n in range(1, N_QUESTIONS + 1))

_REVIEW = f"""
cust AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
qkey AS (SELECT 'Q_' || q_num AS q_id, q_num, q_code, q_long, {_CATEGORY} AS category
  FROM (VALUES {_KEY_ROWS}) t(q_num, q_code, q_long)),
coded AS (SELECT c_custkey AS plan_id, c_name || ' (segment ' || c_mktsegment || ')' AS name, c_mktsegment, n_name,
    CAST(n AS INTEGER) AS q_num, (c_custkey * 31 + n * n * 17 + CAST(floor(abs(c_acctbal)) AS BIGINT)) % 11 AS h
  FROM cust, range(3, 84) r(n)),
stat_entry AS (SELECT *, CASE WHEN q_num = 3 THEN n_name
    WHEN q_num = 4 THEN CASE plan_id % 5 WHEN 1 THEN 'spanish' WHEN 2 THEN 'french' WHEN 3 THEN 'portuguese' ELSE 'english' END
    WHEN h < 4 THEN '1' WHEN h < 8 THEN '0'
    WHEN h = 8 THEN CASE WHEN q_num BETWEEN 34 AND 47 THEN '0.5' ELSE '0' END
    WHEN h = 9 THEN CASE WHEN q_num BETWEEN 31 AND 33 THEN 'Planned' ELSE '1' END
    WHEN q_num BETWEEN 31 AND 33 OR q_num BETWEEN 50 AND 59 THEN NULL ELSE '0' END AS entry FROM coded),
answers AS (SELECT plan_id, name, 'stat' AS type, 'Q_' || q_num AS q_id, q_num, entry FROM stat_entry
  UNION ALL SELECT plan_id, name, 'detail', 'Q_' || q_num, q_num,
    CASE WHEN entry IN ('1', '0.5', 'Planned') THEN ' - ' || lower(c_mktsegment) || ' measure ' || q_num END FROM stat_entry),
review AS (SELECT plan_id, name, type, q_id, a.q_num, entry, q_code, q_long, category
  FROM answers a JOIN qkey USING (q_id) WHERE plan_id NOT IN ({EXCLUDED})),
stat AS (SELECT * FROM review WHERE type = 'stat'),
review_plans AS (SELECT DISTINCT plan_id FROM review),
n_all AS (SELECT count(DISTINCT plan_id) AS whole FROM review)"""


def _wide(codes, value: str = "TRY_CAST(entry AS DOUBLE)", source: str = "stat") -> str:
    cells = ", ".join(f"max(CASE WHEN q_code = '{c}' THEN {value} END) AS {c}" for c in codes)
    return f"(SELECT plan_id, {cells} FROM {source} GROUP BY plan_id)"


_WIDE = f",\nwide AS {_wide(ANSWER_CODES)}"

# Indicators

_THREATS = ["compliance", "tourism", "pollution", "invasive", "habitat"]
_ANY_THREAT = "threat_any <> 0 OR threat_compliance <> 0 OR threat_habitat <> 0 OR threat_tourism <> 0 OR threat_invasive <> 0 OR threat_pollution <> 0"
_TOTAL = """(climate_mention + climate_plan + climate_action + climate_mitigation + climate_sink + climate_limitations
 + obj_cc_any + design_cc_any + monitor_exp_any)"""
_CLIMATE, _RECOMMENDED, _GENERAL = "Climate Action", "Recommended Action", "General Awareness"

# section: stat, type, figure, expression
_INDICATORS = {
    "Climate change": [
        ("climate_mention", _CLIMATE, 1, "climate_mention"),
        ("climate_mention_only", _CLIMATE, 0, _flag(f"{_TOTAL} = 1")),
        ("climate_plan", _CLIMATE, 1, "climate_plan"),
        ("climate_some", _CLIMATE, 1, _flag(f"({_TOTAL} > 1 AND climate_plan = 0)")),
    ],
    "Objectives": [
        ("obj_cons_any", _GENERAL, 1, "obj_any"),
        ("obj_cons_sp", _RECOMMENDED, 0, "obj_sp"),
        ("obj_cons_unit", _RECOMMENDED, 0, "obj_unit"),
        ("obj_cons_both", _RECOMMENDED, 1, _flag("(obj_sp = 1 AND obj_unit = 1)")),
        ("obj_mgmt_any", _GENERAL, 1, _flag("(obj_any = 1 OR obj_cc_any = 1 OR obj_lt_any = 1 OR monitor_any = 1)")),
        (
            "obj_mgmt_lt",
            _RECOMMENDED,
            1,
            _flag(
                "(obj_lt_function = 1 OR obj_lt_resilience = 1 OR obj_lt_baseline = 1 OR obj_lt_monitor = 1 OR obj_lt_reference = 1)"
            ),
        ),
        ("obj_mgmt_eco", _RECOMMENDED, 0, "obj_lt_function"),
        ("obj_mgmt_monitor", _RECOMMENDED, 0, _flag("(obj_lt_baseline = 1 OR obj_lt_monitor = 1)")),
        ("obj_mgmt_res", _RECOMMENDED, 0, "obj_lt_resilience"),
        ("obj_mgmt_ref", _RECOMMENDED, 0, "obj_lt_reference"),
        ("obj_cc_any", _CLIMATE, 1, "obj_cc_any"),
        ("obj_cc_gen", _CLIMATE, 0, _flag("(obj_cc_function = 1 OR obj_cc_general = 1 OR obj_cc_resilience = 1)")),
    ],
    "Assessments": [
        ("assess_threat", _GENERAL, 1, _flag(f"({_ANY_THREAT})")),
        ("assess_any", _RECOMMENDED, 0, "assess_any"),
        ("assess_any_planned", _RECOMMENDED, 0, _flag("assess_any IS NULL")),
        ("assess_any_both", _RECOMMENDED, 1, _flag("(coalesce(assess_any, 1) = 1)")),
        ("assess_climate", _CLIMATE, 0, "assess_climate"),
        ("assess_cc_planned", _CLIMATE, 0, _flag("assess_climate IS NULL")),
        ("assess_cc_both", _CLIMATE, 1, _flag("(coalesce(assess_climate, 1) = 1)")),
        ("assess_all", _RECOMMENDED, 0, _flag("(coalesce(assess_any, 1) = 1 OR coalesce(assess_climate, 1) = 1)")),
    ],
    "Design": [
        ("design_any", _GENERAL, 1, "design_any"),
        ("design_type_zoning", _GENERAL, 0, _flag("design_type = 0.5")),
        ("design_type_boundaries", _GENERAL, 0, _flag("design_type = 1")),
        ("design_resilience_all", _RECOMMENDED, 1, _flag("coalesce(design_resilience, 0) IN (0.5, 1)")),
        ("design_cc_all", _CLIMATE, 1, _flag("coalesce(design_cc_any, 0) IN (0.5, 1)")),
        ("design_cc_planned", _CLIMATE, 0, _flag("design_cc_any = 0.5")),
        ("design_cc_current", _CLIMATE, 0, _flag("design_cc_any = 1")),
        *[
            (f"design_cc_{k}_all", _CLIMATE, 0, _flag(f"coalesce(design_cc_{k}, 0) IN (0.5, 1)"))
            for k in ("resilient", "critical", "connect", "shifting", "refugia")
        ],
        ("design_adaptive_any", _RECOMMENDED, 1, "design_adaptive_any"),
        ("design_adaptive_fully", _RECOMMENDED, 0, "design_adaptive_fully"),
        ("design_adaptive_zoning", _RECOMMENDED, 0, "design_adaptive_zoning"),
        ("design_adaptive_both", _RECOMMENDED, 0, _flag("(design_adaptive_fully = 1 AND design_adaptive_zoning = 1)")),
        ("design_cc_adaptive", _CLIMATE, 1, "design_adaptive_climate"),
    ],
    "Monitoring": [
        ("monitor_any", _GENERAL, 1, "monitor_any"),
        ("monitor_planned", _GENERAL, 0, _flag("(monitor_any = 1 AND monitor_sci = 0 AND monitor_soc = 0)")),
        ("monitor_sci", _RECOMMENDED, 1, "monitor_sci"),
        ("monitor_soc", _RECOMMENDED, 1, "monitor_soc"),
        ("monitor_cc_explicit", _CLIMATE, 1, "monitor_exp_any"),
        ("monitor_cc_implicit", _RECOMMENDED, 0, _flag("(monitor_imp_any = 1 AND monitor_exp_any = 0)")),
        ("monitor_cc_all", _RECOMMENDED, 0, _flag("(monitor_imp_any = 1 OR monitor_exp_any = 1)")),
        ("monitor_cc_research", _CLIMATE, 0, _flag("(obj_cc_research = 1 OR monitor_exp_research = 1)")),
    ],
    "Adaptive management": [
        ("mgmt_adapt", _GENERAL, 1, "mgmt_adapt"),
        (
            "mgmt_adapt_anymitigation",
            _CLIMATE,
            1,
            _flag("(climate_mitigation = 1 OR climate_sink = 1 OR obj_cc_green <> 0 OR obj_cc_awareness <> 0)"),
        ),
        ("mgmt_adapt_protection", _CLIMATE, 0, _flag("(climate_mitigation = 1 OR climate_sink = 1)")),
        ("mgmt_adapt_green", _CLIMATE, 0, "obj_cc_green"),
        ("mgmt_adapt_awareness", _CLIMATE, 0, "obj_cc_awareness"),
        ("mgmt_adapt_limitation", _CLIMATE, 0, "climate_limitations"),
        ("threat_any", _GENERAL, 0, _flag(f"({_ANY_THREAT})")),
        (
            "threat_any_strat",
            _RECOMMENDED,
            1,
            _flag("(threat_strat <> 0 OR " + " OR ".join(f"threat_{t}_strat <> 0" for t in _THREATS) + ")"),
        ),
        (
            "threat_any_cc",
            _CLIMATE,
            1,
            _flag("(threat_cc <> 0 OR " + " OR ".join(f"threat_{t}_cc <> 0" for t in _THREATS) + ")"),
        ),
        *[
            row
            for t in _THREATS
            for row in (
                (f"threat_{t}", _GENERAL, 0, f"threat_{t}"),
                (f"threat_{t}_strat", _RECOMMENDED, 0, f"threat_{t}_strat"),
                (f"threat_{t}_cc", _CLIMATE, 0, f"threat_{t}_cc"),
            )
        ],
    ],
}
_ALL = [(section, *row) for section, rows in _INDICATORS.items() for row in rows]
_STATS = [row[1] for row in _ALL]


def _matrix(rows) -> str:
    return f"(SELECT plan_id, {', '.join(f'{sql} AS {stat}' for _, stat, _, _, sql in rows)} FROM wide)"


_ATTRIBUTES = ", ".join(
    f"('{stat}', '{kind}', {figure}, '{section}', {list(_INDICATORS).index(section) + 1})"
    for section, stat, kind, figure, _ in _ALL
)
_LONG = f""",
matrix AS {_matrix(_ALL)},
attributes AS (SELECT * FROM (VALUES {_ATTRIBUTES}) t(stat, type, figure, category, category_rank)),
entries AS (SELECT plan_id, stat, entry FROM (FROM matrix UNPIVOT INCLUDE NULLS (entry FOR stat IN ({", ".join(_STATS)})))),
sums AS (SELECT stat, category, CAST(CASE
    WHEN category IN ('Climate change', 'Objectives', 'Design') THEN CASE WHEN count(*) = count(entry) THEN sum(entry) END
    WHEN category = 'Assessments' THEN nullif(count(*) FILTER (entry = 1), 0)
    ELSE coalesce(sum(entry), 0) END AS DOUBLE) AS n_plans
  FROM entries JOIN attributes USING (stat) GROUP BY stat, category),
summary AS (SELECT stat, n_plans, {_pct("n_plans", "whole")} AS pct, type, figure, a.category, category_rank
  FROM attributes a JOIN sums USING (stat), n_all WHERE a.category <> 'Assessments' OR n_plans IS NOT NULL),
levels AS (SELECT *, CASE WHEN climate_action > 0 THEN 'Climate Action' WHEN recommended_action > 0 THEN 'Recommended Action'
    WHEN general_awareness > 0 THEN 'General Awareness' END AS level
  FROM (SELECT plan_id, category, sum(coalesce(entry, 0)) FILTER (type = 'Climate Action') AS climate_action,
      sum(coalesce(entry, 0)) FILTER (type = 'Recommended Action') AS recommended_action,
      sum(coalesce(entry, 0)) FILTER (type = 'General Awareness') AS general_awareness
    FROM entries JOIN attributes USING (stat) GROUP BY plan_id, category)),
scores AS (SELECT plan_id, coalesce(sum(climate_action), 0) AS total_climate, coalesce(sum(recommended_action), 0) AS total_rec,
  coalesce(sum(general_awareness), 0) AS total_aware FROM levels GROUP BY plan_id),
lcounts AS (SELECT plan_id, count(*) FILTER (level = 'Climate Action') AS climate_count,
  count(*) FILTER (level = 'Recommended Action') AS rec_count, count(*) FILTER (level = 'General Awareness') AS aware_count,
  count(*) FILTER (level IS NULL) AS not_included FROM levels GROUP BY plan_id)"""

# Areas

_AREAS = """
atlas AS (SELECT c_custkey AS mpa_id, CAST(c_custkey % 10 <> 0 AS INTEGER) AS implemente,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'All' WHEN 'BUILDING' THEN 'Part' ELSE 'None' END AS no_take,
    CAST(c_custkey % 7 <> 0 AS INTEGER) AS is_mpa, n_name AS country, r_name AS region,
    r_name || '-' || (n_nationkey % 2) AS subregion
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
searched AS (SELECT *, o_custkey // 8 + 1 AS cluster, o_orderpriority <> '4-NOT SPECIFIED' AS done FROM orders),
search AS (SELECT o_custkey AS mpa_id, CASE WHEN NOT done THEN 'NS' WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderstatus = 'P' THEN 'F-AI'
      ELSE 'NI' END AS search, CASE WHEN done AND o_orderstatus <> 'O' THEN cluster END AS plan_id, o_orderpriority AS notes,
    CASE WHEN o_orderstatus = 'P' THEN 'shared' END AS network, 'Area ' || o_custkey AS name FROM searched),
plans AS (SELECT cluster AS plan_id, 'Plan ' || cluster AS name, min(country) AS country, CAST(min(year(o_orderdate)) AS INTEGER) AS mp_year
  FROM searched JOIN atlas ON o_custkey = mpa_id WHERE done AND o_orderstatus <> 'O' GROUP BY cluster),
all_plans AS (SELECT DISTINCT c_custkey // 8 + 1 AS plan_id FROM customer),
qualified AS (SELECT * FROM atlas WHERE implemente = 1 AND no_take IN ('Part', 'All') AND is_mpa = 1),
lost AS (SELECT plan_id FROM all_plans WHERE plan_id NOT IN
  (SELECT plan_id FROM search WHERE plan_id IS NOT NULL AND mpa_id IN (SELECT mpa_id FROM qualified))),
listed AS (SELECT * FROM qualified UNION ALL SELECT * FROM atlas WHERE mpa_id IN
  (SELECT mpa_id FROM search WHERE plan_id IN (SELECT plan_id FROM lost)))"""

_META = """,
meta AS (SELECT l.*, CASE WHEN s.plan_id IS NOT NULL AND s.plan_id NOT IN (SELECT plan_id FROM review_plans) THEN 'NI'
      WHEN search = 'F-AI' THEN 'F' ELSE search END AS search, s.plan_id, notes, network AS network_from_mp, s.name AS name_search,
    p.name AS name_plan, p.country AS country_plan, mp_year
  FROM listed l LEFT JOIN search s ON l.mpa_id IS NOT DISTINCT FROM s.mpa_id LEFT JOIN plans p ON s.plan_id IS NOT DISTINCT FROM p.plan_id),
found AS (SELECT * FROM meta WHERE search = 'F')"""


def _edge(lat: str) -> str:
    """Steradians between the equator and a great-circle edge from one corner to the other at one latitude."""
    half = f"tan(radians({lat}) / 2)"
    return f"2 * atan2(tan(radians(w) / 2) * 2 * {half}, 1 + {half} * {half})"


def _box_km2(lat: str, width: str) -> str:
    south, north = _edge(lat).replace("radians(w)", f"radians({width})"), _edge(f"{lat} + {width}").replace(
        "radians(w)", f"radians({width})"
    )
    return f"(abs({north} - ({south})) * 6371010.0::DOUBLE * 6371010.0::DOUBLE / 1000000)"


_BOXES = f"""
boxes AS (SELECT p_partkey AS mpa_id, CAST(p_partkey * 37 % 340 - 170 AS DOUBLE) AS lon, CAST(p_partkey * 53 % 140 - 70 AS DOUBLE) AS lat,
    CAST(p_size * p_size AS DOUBLE) / 500 AS w, p_size % 2 = 0 AS holed, p_size % 5 = 0 AS doubled FROM part WHERE p_partkey % 50 > 7),
sizes AS (SELECT mpa_id, {_box_km2("lat", "w")} - CASE WHEN holed THEN {_box_km2("(lat + w / 4)", "(w / 2)")} ELSE 0 END
    + CASE WHEN doubled THEN {_box_km2("(lat - w - 1)", "w")} ELSE 0 END AS area_calc FROM boxes),
centres AS (SELECT mpa_id, lon + w / 2 AS X, (a * (lat + w / 2) + b * (lat - w / 2 - 1)) / (a + b) AS Y
  FROM (SELECT *, CASE WHEN holed THEN 0.75::DOUBLE ELSE 1 END AS a, CASE WHEN doubled THEN 1 ELSE 0 END AS b FROM boxes))"""

_SIZE = "CASE WHEN {0} > 100000 THEN 'Very Large' WHEN {0} >= 100 THEN 'Large' WHEN {0} >= 10 THEN 'Small' WHEN {0} < 10 THEN 'Very Small' END"
_SIZE_RANK = "CASE WHEN {0} > 100000 THEN 4 WHEN {0} >= 100 THEN 3 WHEN {0} >= 10 THEN 2 WHEN {0} < 10 THEN 1 END"

_SIZED = f""",
sized AS (SELECT f.*, area_calc, {_SIZE.format("area_calc")} AS size_class, {_SIZE_RANK.format("area_calc")} AS size_rank
  FROM found f LEFT JOIN sizes USING (mpa_id)),
plan_sizes AS (SELECT plan_id, CASE WHEN count(*) = count(area_calc) THEN sum(area_calc) END AS total FROM sized GROUP BY plan_id)"""

_POINTS = """,
mention AS (SELECT plan_id, CASE entry WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' END AS mentioned FROM stat WHERE q_code = 'climate_mention'),
points AS (SELECT c.mpa_id, m.plan_id, X, Y, coalesce(mentioned, 'No plan located') AS climate_mention
  FROM centres c JOIN meta m USING (mpa_id) LEFT JOIN mention t ON m.plan_id IS NOT DISTINCT FROM t.plan_id
  WHERE X BETWEEN -185 AND 185 AND Y BETWEEN -89 AND 89)"""

_FACTS = """,
described AS (SELECT DISTINCT plan_id, name_plan, country_plan, mp_year FROM found),
regions AS (SELECT DISTINCT plan_id, region FROM found),
n_mpas AS (SELECT plan_id, count(DISTINCT mpa_id) AS n_areas, CASE WHEN count(*) = count(area_calc) THEN sum(area_calc) END AS total_plan_area FROM sized GROUP BY plan_id),
facts AS (SELECT plan_id, name_plan, country_plan, mp_year, region, n_areas, round(total_plan_area, 3) AS total_plan_area
  FROM described FULL JOIN regions USING (plan_id) FULL JOIN n_mpas USING (plan_id))"""

_REGIONS = """,
all_regions AS (SELECT DISTINCT plan_id, region FROM meta WHERE plan_id IN (SELECT plan_id FROM review_plans))"""

# Names

_TERMS = [
    ("Marine Protected Area", "MPA"),
    ("Marine Reserve", "MR"),
    ("National Park", "NP"),
    ("Marine Park", "MP"),
    ("Biosphere Reserve", "BR"),
    ("National Marine Sanctuary", "NMS"),
    ("Marine National Monument", "MNM"),
    ("Conservation Area", "CA"),
    ("Ecological Station", "ES"),
    ("National Wildlife Refuge", "NWR"),
    ("Parks and ", ""),
]


def _shortened(column: str) -> str:
    for term, short in _TERMS:
        column = f"regexp_replace({column}, '{term}', '{short}')"
    return column


_NAMES = f"""
english AS (SELECT p_partkey AS plan_id, p_name || ' ' || term || ' and ' || term || ' (' || p_brand || ')' AS name_english
  FROM (SELECT *, CASE p_partkey % 11 {" ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_TERMS))} END AS term FROM part)),
names AS (SELECT *, {_shortened("name_english")} AS name_abbrev FROM english)"""

# Condensed scoring

_BINARY = f""",
bin AS (SELECT plan_id, q_code, category, CAST(entry IS NOT DISTINCT FROM 'Planned' OR entry IS NOT DISTINCT FROM '1' AS DOUBLE) AS entry FROM stat),
bwide AS {_wide(ANSWER_CODES, "entry", "bin")},
combined AS (
  SELECT plan_id, 'assessment' AS category, 'threat_any_combined' AS q_code, {_flag("(" + _ANY_THREAT + ")")} AS entry FROM bwide
  UNION ALL SELECT plan_id, 'management', 'threat_strat_combined',
    {_flag("(threat_strat + " + " + ".join(f"threat_{t}_strat" for t in _THREATS) + " > 0)")} FROM bwide
  UNION ALL SELECT plan_id, 'management', 'threat_cc_combined',
    {_flag("(threat_cc + " + " + ".join(f"threat_{t}_cc" for t in _THREATS) + " > 0)")} FROM bwide
  UNION ALL SELECT plan_id, 'assessment', 'assess_any_combined', greatest(assess_any, assess_climate) FROM bwide
  UNION ALL SELECT plan_id, 'objectives', 'obj_mgmt_any', CAST(1 AS DOUBLE) FROM bwide),
earlier AS (SELECT plan_id, CASE WHEN q_code = 'climate_mitigation' THEN 'management' ELSE category END AS category, q_code, entry
    FROM bin WHERE category <> 'metadata'
  UNION ALL SELECT * FROM combined
  UNION ALL SELECT plan_id, 'objectives', 'obj_both_sp_unit', obj_sp * obj_unit FROM bwide)"""

_CLIMATE_CODES = """'climate_plan', 'climate_action', 'obj_cc_any', 'assess_climate', 'design_adaptive_climate', 'design_cc_any',
 'monitor_exp_any', 'threat_cc_combined'"""
_ACTION_CODES = "'obj_lt_any', 'assess_any_combined', 'design_resilience', 'design_adaptive_any', 'monitor_sci', 'threat_strat_combined'"
_AWARE_CODES = "'climate_mention', 'obj_mgmt_any', 'design_any', 'monitor_any', 'mgmt_adapt', 'threat_any_combined'"

_FLAGS = f""",
flags AS (SELECT plan_id, category, q_code, entry, CASE WHEN q_code IN ({_CLIMATE_CODES}) THEN 'Climate Action'
    WHEN q_code IN ({_ACTION_CODES}) THEN 'Recommended Action' ELSE 'General Management Awareness' END AS level
  FROM (SELECT plan_id, category, q_code, entry FROM bin WHERE category <> 'metadata' UNION ALL SELECT * FROM combined)
  WHERE q_code IN ({_CLIMATE_CODES}, {_ACTION_CODES}, {_AWARE_CODES}))"""

_COMPONENTS = ["climate", "objectives", "assessment", "design", "monitoring", "management"]


def _with(*parts_and_body: str) -> str:
    *parts, body = parts_and_body
    text = ",".join(p.strip().strip(",") for p in parts)
    return f"WITH {text}\n{body}"


_ASSESSMENT = [QUESTION_CODES[n] for n in (31, 32, 33)]
_STATED = ", ".join(
    f"""CASE WHEN count(TRY_CAST(entry AS DOUBLE)) FILTER (q_code = '{c}') > 0 THEN 'answered'
  WHEN count(*) FILTER (q_code = '{c}' AND entry = 'Planned') > 0 THEN 'planned'
  WHEN count(entry) FILTER (q_code = '{c}') > 0 THEN 'other' ELSE 'missing' END AS {c}"""
    for c in _ASSESSMENT
)


def _review(body: str) -> str:
    return _with(_REVIEW, body)


def _numeric(body: str) -> str:
    return _with(_REVIEW, _WIDE, body)


def _indicators(body: str) -> str:
    return _with(_REVIEW, _WIDE, _LONG, body)


def _meta(body: str) -> str:
    return _with(_REVIEW, _AREAS, _META, body)


def _sized(body: str) -> str:
    return _with(_REVIEW, _AREAS, _META, _BOXES, _SIZED, body)


def _section(name: str) -> str:
    return _indicators(f"SELECT stat, n_plans, pct, type, figure, category FROM summary WHERE category = '{name}'")


def _split(i: int) -> str:
    return f"nullif(split_part(stat, '_', {i}), '')"


_RAW_CELL = """CASE o_orderkey % 5 WHEN 3 THEN o_orderstatus WHEN 4 THEN o_orderstatus END"""

_FIGURE_LABELS = """('climate_plan', 'Detailed climate change action plan'), ('climate_some', 'Explicit climate change strategy'),
('climate_mention', 'Mentions climate change'), ('obj_cc_any', 'Explicit climate change objective'),
('obj_cons_both', 'Both species- and unit-level objectives'), ('obj_mgmt_lt', 'Long-term management objective'),
('obj_cons_any', 'Any conservation objective'), ('obj_mgmt_any', 'Any management objective'),
('assess_cc_both', 'Explicit climate change assessment '), ('assess_any_both', 'Any threat assessment'),
('assess_threat', 'Identified potential threat or stressor'), ('design_cc_all', 'Design considers climate change'),
('design_cc_adaptive', 'Adaptive design connected to climate change'), ('design_adaptive_any', 'Any adaptive design'),
('design_resilience_all', 'Design includes resilience principle'), ('design_any', 'Provides design criteria'),
('monitor_cc_explicit', 'Explicit climate change monitoring'), ('monitor_soc', 'Socioeconomic monitoring'),
('monitor_sci', 'Ecological monitoring'), ('monitor_any', 'Any objectives for monitoring'),
('mgmt_adapt_anymitigation', 'Climate mitigation strategy'), ('threat_any_cc', 'Threat reduction strategy linked to climate change'),
('threat_any_strat', 'Strategy to address interacting threat'), ('mgmt_adapt', 'Discusses adaptive management')"""

_THREAT_LABELS = """('invasive', 'Invasive Species', 1), ('tourism', 'Tourism', 2), ('compliance', 'Lack of Compliance', 3),
('pollution', 'Marine Debris or Pollution', 4), ('habitat', 'Habitat Degradation', 5)"""

_DENSITY = """
bw AS (SELECT g, n, 0.9::DOUBLE * least(sd, (q3 - q1) / 1.34) * n ** (-0.2::DOUBLE) AS h FROM (SELECT climate_mention AS g, count(*) AS n,
    stddev_samp(Y) AS sd, quantile_cont(Y, 0.25) AS q1, quantile_cont(Y, 0.75) AS q3 FROM points GROUP BY climate_mention) WHERE n > 1),
mesh AS (SELECT *, -89 - 4 * h AS start, (178 + 8 * h) / 511 AS step FROM bw),
placed AS (SELECT g, (Y - start) / step AS p FROM points JOIN mesh ON g = climate_mention),
nodes AS (SELECT g, node, sum(weight) AS weight FROM (SELECT g, floor(p) AS node, 1 - (p - floor(p)) AS weight FROM placed
    UNION ALL SELECT g, floor(p) + 1, p - floor(p) FROM placed) GROUP BY g, node),
grid AS (SELECT g, h, n, step, i AS point, -89 + i * (178::DOUBLE / 511) AS y, (-89 + i * (178::DOUBLE / 511) - start) / step AS p
  FROM mesh, range(0, 512) r(i))"""


def oracle_sql() -> dict[str, str]:
    section_list = ", ".join(f"'{s}'" for s in _INDICATORS)
    wide_codes = ANSWER_CODES[ANSWER_CODES.index("climate_mention") :]
    numeric_codes = wide_codes[: wide_codes.index("threat_habitat_cc") + 1]
    climate_codes = [c for c in ANSWER_CODES if c.startswith("climate_")]
    explicit = climate_codes + ["obj_cc_any", "design_cc_any", "monitor_exp_any"]
    coded = ", ".join(
        f"max(CASE WHEN q_code = '{c}' THEN {'TRY_CAST(entry AS DOUBLE)' if c in numeric_codes else 'entry'} END) AS {c}"
        for c in wide_codes
    )
    statements = {
        "typed_scan": """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus, CAST(o_custkey AS DOUBLE) AS o_custkey,
            o_orderpriority FROM orders""",
        "text_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders",
        "column_range": "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders",
        "na_tokens": f"""SELECT CAST(o_orderkey AS VARCHAR) AS plan_id, {_RAW_CELL} AS document_type,
            CASE WHEN o_orderkey % 5 = 4 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS area_number,
            o_orderpriority AS notes_text FROM orders""",
        "clean_names": """SELECT o_custkey AS plan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'appendix' ELSE 'plan' END AS document_type,
            CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 + 1 END AS DOUBLE) AS time_listed,
            CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS work_plan FROM orders""",
        "write_roundtrip": _review(
            "SELECT q_code, entry, count(*) AS n, CAST(sum(plan_id) AS BIGINT) AS plan_sum FROM stat GROUP BY q_code, entry"
        ),
        "search_union": _with(_AREAS, "SELECT * FROM search"),
        "missing_ids": _with(_AREAS, "SELECT plan_id FROM lost"),
        "semi_join_ids": _with(_AREAS, "SELECT * FROM search WHERE mpa_id IN (SELECT mpa_id FROM qualified)"),
        "anti_join_ids": _with(_AREAS, "SELECT * FROM search WHERE mpa_id NOT IN (SELECT mpa_id FROM qualified)"),
        "exclude_ids": _with(
            _AREAS, "SELECT mpa_id, plan_id FROM search WHERE plan_id IS NULL OR plan_id NOT IN (173, 174, 128, 103)"
        ),
        "null_safe_left_join": _with(
            _AREAS,
            """SELECT s.mpa_id, s.plan_id, s.search, plan_rows, last_search FROM search s LEFT JOIN
            (SELECT plan_id, count(*) AS plan_rows, max(search) AS last_search FROM search GROUP BY plan_id) p
            ON s.plan_id IS NOT DISTINCT FROM p.plan_id""",
        ),
        "review_long": _review("SELECT * FROM review"),
        "review_wide": _review(f"SELECT * FROM {_wide(ANSWER_CODES, 'entry')}"),
        "coded_to_numeric": _review(f"SELECT plan_id, {coded} FROM stat GROUP BY plan_id"),
        "climate_subset": _review(
            """SELECT plan_id, q_code, entry FROM stat
            WHERE q_num BETWEEN 7 AND 12 OR q_code IN ('obj_cc_any', 'design_cc_any', 'monitor_exp_any')"""
        ),
        "climate_wide": _numeric(f"SELECT plan_id, {', '.join(explicit)}, {_TOTAL} AS total_climate FROM wide"),
        "sheet_unpivot": _review("SELECT plan_id + 1 AS plan_id, name, type, q_id, q_num, entry FROM answers"),
        "question_category": _review("SELECT q_id, q_code, q_long, q_num, category FROM qkey"),
        "category_order": _review(
            """SELECT category, CASE category WHEN 'metadata' THEN 1 WHEN 'climate' THEN 2 WHEN 'objectives' THEN 3
            WHEN 'assessment' THEN 4 WHEN 'design' THEN 5 WHEN 'monitoring' THEN 6 WHEN 'management' THEN 7 END AS category_rank,
            count(*) AS n FROM review GROUP BY category"""
        ),
        "count_by_group": _with(_AREAS, "SELECT search, plan_id, count(*) AS n FROM search GROUP BY search, plan_id"),
        "language_share": _review(
            """SELECT upper(entry[1]) || lower(entry[2:]) AS entry, count, round_even(CAST(count AS DOUBLE) / sum(count) OVER (), 3) AS proportion
            FROM (SELECT entry, count(*) AS count FROM stat WHERE q_num = 4 GROUP BY entry)"""
        ),
        "strategy_table": _review(
            """SELECT DISTINCT plan_id AS "Plan", name AS "Name", upper(category[1]) || category[2:] AS "Component",
            regexp_replace(replace(q_long, '-', ''), '^\\s+|\\s+$', '', 'g') AS "Indicator", entry AS "Strategy" FROM review
            WHERE type = 'detail' AND entry IS NOT NULL AND (q_code LIKE '%cc%' OR q_code LIKE '%climate%')
            AND q_code NOT IN ('climate_mention', 'climate_action')"""
        ),
        "flag_three_valued": _numeric(
            """SELECT plan_id, CAST(monitor_any = 1 AS INTEGER) AS any_is_one,
            CAST(monitor_any = 1 AND monitor_sci = 0 AS INTEGER) AS any_without_sci,
            CAST(monitor_any = 1 OR monitor_soc = 1 AS INTEGER) AS any_or_soc FROM wide"""
        ),
        "null_in_set": _numeric(
            """SELECT plan_id, CASE WHEN assess_any IS NULL OR assess_any = 1 THEN 1 ELSE 0 END AS done_or_planned,
            CASE WHEN assess_any = 1 THEN 1 ELSE 0 END AS done, CASE WHEN assess_climate = 1 THEN 0 ELSE 1 END AS climate_not_done,
            CASE WHEN assess_climate <> 1 THEN 1 ELSE 0 END AS climate_neither FROM wide"""
        ),
        "row_any": _numeric(
            """SELECT plan_id, CAST(monitor_any = 1 OR monitor_imp_any = 1 OR assess_any = 1 OR threat_any = 1 AS INTEGER) AS any_one,
            CAST(monitor_any <> 0 OR monitor_imp_any <> 0 OR assess_any <> 0 AS INTEGER) AS any_nonzero FROM wide"""
        ),
        "row_all": _numeric(
            """SELECT plan_id, CAST(obj_sp <> 0 AND obj_unit <> 0 AS INTEGER) AS both,
            CAST(obj_sp <> 0 AND obj_unit <> 0 AND monitor_any <> 0 AS INTEGER) AS all_three FROM wide"""
        ),
        "row_sum": _numeric("SELECT plan_id, monitor_any + monitor_sci + monitor_soc + design_type AS total FROM wide"),
        "column_sums": _numeric(
            """SELECT CASE WHEN count(*) = count(monitor_any) THEN sum(monitor_any) END AS strict_any,
            coalesce(sum(monitor_any), 0) AS lenient_any, CASE WHEN count(*) = count(obj_any) THEN sum(obj_any) END AS strict_obj,
            count(DISTINCT coalesce(monitor_any, -1)) AS values_with_null, count(DISTINCT monitor_any) AS values_without_null FROM wide"""
        ),
        "conditional_update": _review(
            """SELECT plan_id, q_code, CASE WHEN entry = 'Planned' THEN '1' WHEN q_code = 'assess_any' THEN coalesce(entry, '0')
            ELSE entry END AS entry FROM stat"""
        ),
        "planned_to_binary": _review(
            "SELECT plan_id, q_code, CAST(coalesce(entry IN ('Planned', '1'), false) AS DOUBLE) AS entry FROM stat"
        ),
        "design_flags": _numeric(f"SELECT * FROM {_matrix([r for r in _ALL if r[0] == 'Design'])}"),
        "fill_missing": _numeric(
            """SELECT plan_id, coalesce(monitor_any, 0) AS monitor_any, coalesce(assess_any, 0) AS assess_any,
            coalesce(assess_climate, 0) AS assess_climate FROM wide"""
        ),
        "stat_summary_climate": _section("Climate change"),
        "stat_summary_obj": _section("Objectives"),
        "stat_summary_assess": _section("Assessments"),
        "stat_summary_design": _section("Design"),
        "stat_summary_monitor": _section("Monitoring"),
        "stat_summary_mgmt": _section("Adaptive management"),
        "all_stat": _indicators("SELECT * FROM summary"),
        "figure_indicators": _indicators(
            f"""SELECT stat, stat_long, CAST(stat_rank AS INTEGER) AS stat_rank, n_plans, pct, type, category FROM summary JOIN
            (SELECT *, row_number() OVER () AS stat_rank FROM (VALUES {_FIGURE_LABELS}) t(stat, stat_long)) USING (stat) WHERE figure = 1"""
        ),
        "split_stat_name": _indicators(
            f"SELECT stat, {_split(1)} AS cat, {_split(2)} AS subcat, {_split(3)} AS part, n_plans FROM summary"
        ),
        "label_recode": _indicators(
            f"""SELECT stat, coalesce(label, subcat) AS label, coalesce(label_rank, 6) AS label_rank, n_plans
            FROM (SELECT *, {_split(2)} AS subcat FROM summary) LEFT JOIN (VALUES {_THREAT_LABELS}) t(subcat, label, label_rank) USING (subcat)"""
        ),
        "assessment_total": _review(
            f"""SELECT n_plans, {_pct("n_plans", "whole")} AS pct_assess, n_countries FROM (SELECT count(*) AS n_plans,
            count(DISTINCT country) AS n_countries FROM (SELECT plan_id, max(CASE WHEN q_code = 'country' THEN entry END) AS country,
              max(CASE WHEN q_code = 'assess_any' THEN TRY_CAST(entry AS DOUBLE) END) AS a,
              max(CASE WHEN q_code = 'assess_climate' THEN TRY_CAST(entry AS DOUBLE) END) AS c FROM stat GROUP BY plan_id)
            WHERE a IS NULL OR a = 1 OR c IS NULL OR c = 1), n_all"""
        ),
        "stated_answers": _review(f"SELECT plan_id, {_STATED} FROM stat GROUP BY plan_id"),
        "planned_counts": _review(
            f"""SELECT q_code, n_missing, n_other, n_planned, n_answered, whole - n_answered AS n_taken,
            {_pct("(whole - n_answered)", "whole")} AS pct_taken, {_pct("n_planned", "whole")} AS pct_planned FROM (
            SELECT q_code, count(*) FILTER (s = 'missing') AS n_missing, count(*) FILTER (s = 'other') AS n_other,
              count(*) FILTER (s = 'planned') AS n_planned, count(*) FILTER (s = 'answered') AS n_answered, count(*) AS whole
            FROM (UNPIVOT (SELECT plan_id, {_STATED} FROM stat GROUP BY plan_id) ON {", ".join(_ASSESSMENT)} INTO NAME q_code VALUE s)
            GROUP BY q_code)"""
        ),
        "design_entry_counts": _review(
            """SELECT q_code, "0", "0.5", "1", round(CAST("1" AS DOUBLE) / ("1" + "0") * 100, 6) AS pct_1 FROM (
            SELECT q_code, nullif(count(*) FILTER (entry = '0'), 0) AS "0", nullif(count(*) FILTER (entry = '0.5'), 0) AS "0.5",
              nullif(count(*) FILTER (entry = '1'), 0) AS "1" FROM stat WHERE category = 'design' GROUP BY q_code)"""
        ),
        "indicator_matrix": _numeric(f"SELECT * FROM {_matrix(_ALL)}"),
        "indicator_full_join": _numeric(f"SELECT * FROM {_matrix(_ALL)}"),
        "all_by_plan": _indicators(
            f"""SELECT plan_id, stat, entry, n_plans, {_pct("n_plans", "whole")} AS pct, type, figure, a.category
            FROM entries JOIN attributes a USING (stat) JOIN sums USING (stat), n_all"""
        ),
        "plan_results_long": _indicators(
            """SELECT plan_id AS "Plan ID", lower(category) AS "Component", stat AS "Criteria", lower(type) AS "Climate Change Inclusion",
            entry AS "Value" FROM entries JOIN attributes USING (stat)"""
        ),
        "threat_matrix": _indicators(
            f"""SELECT stat, label AS threat, label_rank AS threat_rank, type, n_plans, pct FROM (SELECT *, {_split(2)} AS subcat FROM summary
            WHERE starts_with(stat, 'threat_')) JOIN (VALUES {_THREAT_LABELS}) t(subcat, label, label_rank) USING (subcat)"""
        ),
        "inclusion_levels": _indicators("SELECT * FROM levels"),
        "inclusion_levels_wide": _indicators(
            f"SELECT * FROM (PIVOT (SELECT plan_id, category, level FROM levels) ON category IN ({section_list}) USING max(level) GROUP BY plan_id)"
        ),
        "plan_scores": _indicators("SELECT * FROM scores"),
        "level_counts": _indicators("SELECT * FROM lcounts"),
        "plan_region": _with(_REVIEW, _AREAS, _META, _REGIONS, "SELECT * FROM all_regions"),
        "region_count": _with(
            _REVIEW, _AREAS, _META, _REGIONS, "SELECT region, count(*) AS n FROM all_regions GROUP BY region"
        ),
        "level_heatmap": _with(
            _REVIEW,
            _WIDE,
            _LONG,
            _AREAS,
            _META,
            _REGIONS,
            _NAMES,
            """, named AS (SELECT * FROM scores JOIN lcounts USING (plan_id) LEFT JOIN names USING (plan_id)),
            ranks AS (SELECT name_abbrev, row_number() OVER (ORDER BY climate_count, rec_count, aware_count, total_climate, total_rec, plan_id, name_abbrev)
                AS name_rank FROM (SELECT *, row_number() OVER (PARTITION BY name_abbrev
                ORDER BY climate_count, rec_count, aware_count, total_climate, total_rec, plan_id) AS k FROM named WHERE name_abbrev IS NOT NULL) WHERE k = 1)""",
            """SELECT plan_id, category, climate_action, recommended_action, general_awareness, coalesce(level, 'Not Included') AS level,
              CASE level WHEN 'General Awareness' THEN 1 WHEN 'Recommended Action' THEN 2 WHEN 'Climate Action' THEN 3 ELSE 4 END AS level_rank,
              name_english, n.name_abbrev, region, total_climate, total_rec, total_aware, climate_count, rec_count, aware_count, not_included,
              name_rank, CASE WHEN region IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'left' ELSE 'right' END AS panel
            FROM levels JOIN named n USING (plan_id) LEFT JOIN all_regions USING (plan_id) LEFT JOIN ranks r ON n.name_abbrev = r.name_abbrev""",
        ),
        "abbreviate_names": _with(_NAMES, "SELECT * FROM names"),
        "strip_parenthetical": _review(
            "SELECT DISTINCT plan_id, name, regexp_replace(name, '\\s*\\([^)]+\\)', '', 'g') AS name_short FROM review"
        ),
        "condensed_flags": _with(_REVIEW, _BINARY, _FLAGS, "SELECT * FROM flags"),
        "condensed_summary": _with(
            _REVIEW,
            _BINARY,
            _FLAGS,
            _AREAS,
            _META,
            f""", totals AS (SELECT plan_id, {", ".join(f"sum(entry) FILTER (category = '{c}') AS {c}" for c in _COMPONENTS)}
              FROM flags GROUP BY plan_id),
            named AS (SELECT *, {" + ".join(_COMPONENTS)} AS total FROM totals FULL JOIN (SELECT DISTINCT plan_id,
                regexp_replace(name, '\\s*\\([^)]+\\)', '', 'g') AS name_short FROM review) USING (plan_id)
              FULL JOIN (SELECT DISTINCT plan_id, region FROM found) USING (plan_id)),
            ranks AS (SELECT name_short, row_number() OVER (ORDER BY mean, name_short) AS name_rank FROM
              (SELECT name_short, avg(total) AS mean FROM named WHERE name_short IS NOT NULL GROUP BY name_short) WHERE mean IS NOT NULL)""",
            f"""SELECT name_short, region, total, name_rank, indicator, CAST(list_position([{", ".join(f"'{c}'" for c in _COMPONENTS)}], indicator) AS INTEGER)
              AS indicator_rank, CAST(CAST(CASE WHEN entry > 3 THEN 3 ELSE entry END AS INTEGER) AS VARCHAR) AS entry
            FROM (FROM named LEFT JOIN ranks USING (name_short)) UNPIVOT (entry FOR indicator IN ({", ".join(_COMPONENTS)})) WHERE entry <> 0""",
        ),
        "legacy_level_stats": _with(
            _REVIEW,
            _BINARY,
            f"""SELECT upper(category[1]) || category[2:] AS category, level, q_code, entry, n, {_pct("n", "whole")} AS pct FROM (
              SELECT category, CASE WHEN q_code IN ({_CLIMATE_CODES}, 'climate_mitigation') THEN 'Climate Action'
                WHEN q_code IN ({_ACTION_CODES}, 'monitor_soc', 'design_adaptive_zoning', 'design_adaptive_fully', 'obj_both_sp_unit')
                THEN 'Recommended Action' WHEN q_code IN ({_AWARE_CODES}, 'obj_any') THEN 'General Awareness' END AS level, q_code, entry, count(*) AS n
              FROM earlier GROUP BY ALL) , n_all WHERE level IS NOT NULL""",
        ),
        "legacy_code_stats": _with(
            _REVIEW,
            _BINARY,
            f"""SELECT category, q_code, entry, n, {_pct("n", "whole")} AS pct FROM (SELECT category, q_code, entry, count(*) AS n FROM earlier
              WHERE entry = 1 GROUP BY ALL), n_all""",
        ),
        "radar_score": _with(
            _REVIEW,
            _BINARY,
            f"""SELECT plan_id, {", ".join(f"nullif(count(*) FILTER (category = '{c}'), 0) AS {c}" for c in _COMPONENTS)} FROM earlier
            WHERE entry = 1 AND q_code IN ('climate_plan', 'climate_action', 'climate_mention', 'obj_mgmt_any', 'obj_cc_any', 'obj_lt_any',
              'assess_any_combined', 'assess_climate', 'design_cc_any', 'design_resilience', 'design_any', 'monitor_any', 'monitor_sci',
              'monitor_exp_any', 'threat_cc_combined', 'threat_strat_combined', 'threat_any_combined') GROUP BY plan_id""",
        ),
        "qualify_areas": _with(_AREAS, "SELECT * FROM qualified"),
        "filter_steps": _with(
            _AREAS,
            """SELECT CAST(step AS INTEGER) AS step, condition, n_areas FROM (
            SELECT 0 AS step, 'all' AS condition, count(*) AS n_areas FROM atlas
            UNION ALL SELECT 1, 'implemented', count(*) FROM atlas WHERE implemente = 1
            UNION ALL SELECT 2, 'no-take', count(*) FROM atlas WHERE implemente = 1 AND no_take IN ('Part', 'All')
            UNION ALL SELECT 3, 'is an area', count(*) FROM qualified
            UNION ALL SELECT 4, 'wholly no-take', count(*) FROM qualified WHERE no_take = 'All')""",
        ),
        "qualify_strict_lost_plans": _with(
            _AREAS,
            """SELECT * FROM atlas WHERE mpa_id IN (SELECT mpa_id FROM search WHERE plan_id IN (SELECT plan_id FROM all_plans
            WHERE plan_id NOT IN (SELECT plan_id FROM search JOIN qualified USING (mpa_id) WHERE no_take = 'All' AND plan_id IS NOT NULL)))""",
        ),
        "area_list": _with(_AREAS, "SELECT * FROM listed"),
        "area_metadata": _meta("SELECT * FROM meta"),
        "search_status": _with(
            _REVIEW,
            _AREAS,
            """SELECT mpa_id, CASE WHEN plan_id IS NOT NULL AND plan_id NOT IN (SELECT plan_id FROM review_plans) THEN 'NI'
            WHEN search = 'F-AI' THEN 'F' ELSE search END AS search, plan_id, notes, network, name FROM search""",
        ),
        "area_found": _meta("SELECT * FROM found"),
        "overview_totals": _meta(
            """SELECT count(DISTINCT mpa_id) AS n_areas_search, count(DISTINCT plan_id) FILTER (search = 'F') AS n_plans,
            count(DISTINCT mpa_id) FILTER (search = 'F') AS n_areas_w_plans FROM meta"""
        ),
        "multi_area_plans": _meta(
            """SELECT count(*) AS n_multiple_areas, max(n) AS max_areas FROM
            (SELECT count(DISTINCT mpa_id) AS n FROM found GROUP BY plan_id) WHERE n > 1"""
        ),
        "geography_stats": _meta(
            """SELECT count(DISTINCT country) AS n_countries, min(mp_year) AS earliest_year, round(avg(mp_year), 8) AS average_year,
            round(CAST(count(DISTINCT plan_id) FILTER (mp_year > 1997) AS DOUBLE) / count(DISTINCT plan_id), 8) AS pct_last_decade FROM found"""
        ),
        "country_table": _meta(
            "SELECT country, CAST(count(*) AS BIGINT) AS n_areas, count(DISTINCT plan_id) AS n_plans FROM found GROUP BY country"
        ),
        "region_table": _meta("SELECT region, count(*) AS n_zones, count(DISTINCT plan_id) AS n_plans FROM found GROUP BY region"),
        "region_subregion_table": _meta(
            "SELECT region, subregion, count(*) AS n_zones, count(DISTINCT plan_id) AS n_plans FROM found GROUP BY region, subregion"
        ),
        "plan_time_stats": _review(
            """SELECT min(t) AS min_time, max(t) AS max_time, round(avg(t), 8) AS avg_time, round(stddev_samp(t), 8) AS sd_time,
            count(*) FILTER (t IS NULL) AS num_nas, count(w) AS num_work_plan, round(CAST(count(w) AS DOUBLE) / max(whole), 8) AS pct_work_plan
            FROM (SELECT CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 + 1 END AS DOUBLE) AS t,
              CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS w FROM orders
              WHERE o_orderkey % 3 <> 0 AND o_custkey IN (SELECT plan_id FROM review_plans)), n_all"""
        ),
        "ring_quality": """SELECT p_partkey AS mpa_id, CASE p_partkey % 50 WHEN 0 THEN 'not closed' WHEN 1 THEN 'too few points'
            WHEN 2 THEN 'coordinate out of range' WHEN 3 THEN 'missing coordinate' WHEN 4 THEN 'no ring' WHEN 5 THEN 'crosses itself'
            WHEN 6 THEN 'hole outside its shell' WHEN 7 THEN 'crosses itself' END AS problem FROM part""",
        "polygon_area": _with(_BOXES, "SELECT mpa_id, round(area_calc, 3) AS area_calc FROM sizes"),
        "polygon_centroid": _with(_BOXES, "SELECT mpa_id, round(X, 6) AS \"X\", round(Y, 6) AS \"Y\" FROM centres"),
        "area_size_class": _sized("SELECT mpa_id, plan_id, round(area_calc, 3) AS area_calc, size_class, size_rank FROM sized"),
        "plan_size_class": _sized(
            f"""SELECT {_SIZE.format("total")} AS size_class, {_SIZE_RANK.format("total")} AS size_rank, count(*) AS n
            FROM plan_sizes GROUP BY ALL"""
        ),
        "plan_area_total": _sized("""
            SELECT CASE WHEN count(*) = count(total) THEN round(sum(total), 2) END AS total_review_area,
                   count(*) - count(total) AS n_unmeasured
            FROM plan_sizes"""),
        "map_points": _with(
            _REVIEW,
            _AREAS,
            _META,
            _BOXES,
            _POINTS,
            """SELECT mpa_id, plan_id, round(X, 6) AS "X", round(Y, 6) AS "Y", climate_mention,
            CASE climate_mention WHEN 'No' THEN 1 WHEN 'Yes' THEN 2 ELSE 3 END AS class_rank FROM points""",
        ),
        "latitude_density": _with(
            _REVIEW,
            _AREAS,
            _META,
            _BOXES,
            _POINTS,
            _DENSITY,
            """SELECT g AS climate_mention, CAST(point AS INTEGER) AS point, round(y, 8) AS y, round(sum(weight * (
              (1 - (p - floor(p))) * exp(-(((floor(p) - node) * step / h) ** 2) / 2) + (p - floor(p)) * exp(-(((floor(p) + 1 - node) * step / h) ** 2) / 2)))
              / (n * h * sqrt(2 * pi())), 8) AS density FROM grid JOIN nodes USING (g) GROUP BY g, point, y, n, h""",
        ),
        "plan_table": _with(_REVIEW, _AREAS, _META, _BOXES, _SIZED, _FACTS, "SELECT * FROM facts"),
        "plan_results_wide": _with(
            _REVIEW,
            _WIDE,
            _LONG,
            _AREAS,
            _META,
            _BOXES,
            _SIZED,
            _FACTS,
            f"SELECT * FROM facts FULL JOIN (SELECT plan_id, {', '.join(f'coalesce({s}, 0) AS {s}' for s in _STATS)} FROM matrix) USING (plan_id)",
        ),
    }
    # the same results from the review as it is stored
    return statements | {"stored_review_stat": statements["all_stat"], "stored_review_levels": statements["inclusion_levels"]}
