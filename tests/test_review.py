"""Indicators, levels, areas and reports on hand-made and derived reviews."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlens.operators import areas, condensed, geometry, inclusion, indicators, reports, review
from planlens.operators.reshape import sheet_key, sheet_long
from planlens.questions import COMPONENTS, QUESTION_CODES, component_of, question_key
from planlens.rules import FIGURE_LABELS, RULES, SECTIONS, input_codes
from planlens.sources.derived import DerivedTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bed(spark):
    return DerivedTables(spark, FOLDER)


def small_review(spark, plans):
    """A review from {plan: {code: entry}}; codes not given are answered "0"."""
    numbers = {code: n for n, code in QUESTION_CODES.items()}
    rows = [
        (plan, f"Plan {plan} (x)", "stat", f"Q_{n}", n, given.get(code, "0"))
        for plan, given in plans.items()
        for code, n in numbers.items()
        if n > 2
    ]
    answers = spark.createDataFrame(rows, "plan_id long, name string, type string, q_id string, q_num int, entry string")
    return review.review_long(answers, question_key(spark))


def test_rule_table():
    assert Counter(r.section for r in RULES) == dict(zip(SECTIONS, (4, 12, 8, 17, 8, 24), strict=True))
    assert {r.stat for r in RULES if r.figure} == set(FIGURE_LABELS) and len(FIGURE_LABELS) == 24
    assert len(RULES) == 73 and len(input_codes(RULES)) == 62


def test_components():
    sizes = Counter(component_of(n) for n in range(1, 84))
    assert [sizes[c] for c in COMPONENTS] == [10, 6, 18, 3, 14, 10, 22]


def test_indicators_of_one_plan(spark):
    plans = {
        1: {"climate_mention": "1"},
        2: {"climate_mention": "1", "climate_sink": "1", "obj_sp": "1", "obj_unit": "1", "assess_any": "Planned"},
        3: {"assess_climate": None, "design_type": "0.5", "design_cc_any": "0.5", "monitor_any": None, "threat_habitat": "1"},
    }
    rows = {r["plan_id"]: r for r in indicators.indicator_matrix(small_review(spark, plans)).collect()}
    assert (rows[1]["climate_mention_only"], rows[1]["climate_some"]) == (1, 0)
    assert (rows[2]["climate_mention_only"], rows[2]["climate_some"]) == (0, 1)
    assert (rows[2]["obj_cons_both"], rows[2]["assess_any"], rows[2]["assess_any_planned"]) == (1, None, 1)
    assert (rows[2]["assess_any_both"], rows[1]["assess_any_both"], rows[2]["mgmt_adapt_protection"]) == (1, 0, 1)
    assert (rows[3]["design_type_zoning"], rows[3]["design_cc_all"], rows[3]["design_cc_current"]) == (1, 1, 0)
    assert (rows[3]["obj_mgmt_any"], rows[3]["monitor_planned"], rows[3]["assess_threat"]) == (None, None, 1)
    assert (rows[3]["assess_cc_both"], rows[3]["assess_all"], rows[1]["assess_all"]) == (1, 1, 0)


def test_summaries(spark):
    plans = {n: {"climate_mention": "1" if n < 3 else "0", "monitor_any": None if n == 0 else "1"} for n in range(4)}
    stats = {r["stat"]: r for r in indicators.all_stat(small_review(spark, plans)).collect()}
    assert (stats["climate_mention"]["n_plans"], stats["climate_mention"]["pct"]) == (3, 75.0)
    assert stats["obj_mgmt_any"]["n_plans"] is None and stats["obj_mgmt_any"]["pct"] is None
    assert (stats["monitor_any"]["n_plans"], stats["monitor_any"]["pct"]) == (3, 75.0)
    assert "assess_any" not in stats and "assess_all" not in stats
    halves = indicators.section_summary(small_review(spark, plans), "Monitoring", n_plans=6).collect()
    assert {r["stat"]: r["pct"] for r in halves}["monitor_any"] == 50.0


def test_a_plan_without_the_codes_keeps_its_row(spark):
    review_df = small_review(spark, {1: {"monitor_any": "1"}, 2: {}}).where("plan_id = 1 OR category <> 'monitoring'")
    stats = {r["stat"]: r for r in indicators.section_summary(review_df, "Monitoring").collect()}
    assert (stats["monitor_any"]["n_plans"], stats["monitor_any"]["pct"]) == (1, 50.0)


def test_excluded_plans(spark):
    rows = spark.createDataFrame([(173,), (1,), (None,), (103,)], "plan_id long")
    assert {r[0] for r in review.exclude_plans(rows).collect()} == {1, None}


def test_full_join_chain_equals_the_matrix(bed):
    matrix = indicators.indicator_matrix(bed.review())
    joined = indicators.indicator_full_join(bed.review()).select(*matrix.columns)
    assert matrix.exceptAll(joined).count() == 0 and matrix.count() == joined.count()


def test_level_counts_cover_all_components(bed):
    counts = inclusion.level_counts(bed.review())
    total = F.col("climate_count") + F.col("rec_count") + F.col("aware_count") + F.col("not_included")
    assert {r[0] for r in counts.select(total).distinct().collect()} == {len(SECTIONS)}


def test_percentages_follow_from_counts(bed):
    plans = bed.review().agg(F.count_distinct("plan_id")).scalar()
    stats = indicators.all_stat(bed.review()).select("n_plans", "pct", F.bround(F.col("n_plans") / plans * 100, 1).alias("want"))
    assert stats.where(~F.col("pct").eqNullSafe(F.col("want"))).count() == 0


def test_sheets_lead_back_to_the_answers(bed):
    answers = bed.answers().select((F.col("plan_id") + 1).alias("plan_id"), "name", "type", "q_id", "q_num", "entry")
    back = sheet_long(bed.sheets(), "sheet_id").select(*answers.columns)
    assert answers.exceptAll(back).count() == 0 and answers.count() == back.count()
    assert sheet_key(bed.sheets()).count() == 83


def test_one_sheet_without_number(spark):
    rows = [
        (1, "name", "x", "Plan A", "Plan A", "Plan B", "Plan B"),
        (2, "type", "x", "stat", "detail", "stat", "detail"),
        (3, "country", "Which?", "NZ", None, None, "text"),
    ]
    sheet = spark.createDataFrame(rows, "q_num int, code string, `plan-id` string, `c 1` string, c2 string, c3 string, c4 string")
    got = sorted((r["plan_id"], r["name"], r["type"], r["entry"]) for r in sheet_long(sheet).collect() if r["entry"])
    assert got == [(1, "Plan A", "stat", "NZ"), (2, "Plan B", "detail", "text")]


def test_binary_answers(spark):
    wide = {"assess_any": "Planned", "design_type": None, "design_cc_any": "0.5", "obj_any": "1"}
    rows = condensed.binary_answers(small_review(spark, {1: wide})).collect()
    entry = {r["q_code"]: r["entry"] for r in rows}
    assert [entry[c] for c in ("assess_any", "design_type", "design_cc_any", "obj_any", "obj_sp")] == [1, 0, 0, 1, 0]


def test_condensed_totals_are_capped(spark):
    ones = {c: "1" for c in ("climate_plan", "climate_action", "climate_mention", "design_any", "design_cc_any")}
    regions = spark.createDataFrame([(1, "Pacific"), (1, "Indian"), (9, "Nowhere")], "plan_id long, region string")
    rows = condensed.condensed_summary(small_review(spark, {1: ones, 2: {}}), regions).collect()
    got = {(r["name_short"], r["region"], r["indicator"]): r["entry"] for r in rows}
    assert got == {
        ("Plan 1", region, component): entry
        for region in ("Pacific", "Indian")
        for component, entry in (("climate", "3"), ("objectives", "1"), ("design", "2"))
    } | {("Plan 2", None, "objectives"): "1"}
    assert {r["name_short"]: r["name_rank"] for r in rows} == {"Plan 2": 1, "Plan 1": 2}


def test_heat_map_order_and_regions(spark):
    names = spark.createDataFrame(
        [(1, "Reef Marine Reserve"), (2, "Bay Marine Reserve"), (3, "Bay Marine Reserve")],
        "plan_id long, name_english string",
    )
    regions = spark.createDataFrame([(1, "Pacific"), (1, "Indian"), (2, "Atlantic")], "plan_id long, region string")
    plans = {1: {"climate_plan": "1"}, 2: {}, 3: {"climate_plan": "1"}, 4: {}}
    rows = inclusion.level_heatmap(small_review(spark, plans), names, regions, ["Atlantic"]).collect()
    assert Counter(r["plan_id"] for r in rows) == {1: 12, 2: 6, 3: 6, 4: 6}
    assert {(r["name_abbrev"], r["name_rank"]) for r in rows} == {("Bay MR", 1), ("Reef MR", 2), (None, None)}
    assert {(r["plan_id"], r["panel"]) for r in rows} == {(1, "right"), (2, "left"), (3, "right"), (4, "right")}
    assert {r["level"] for r in rows if r["plan_id"] == 2} == {"Not Included"}


def test_area_flow(spark):
    atlas = spark.createDataFrame(
        [(1, 1, "All", 1), (2, 1, "None", 1), (3, 1, "Part", 1), (4, 0, "All", 1), (5, 1, "Part", 1)],
        "mpa_id long, implemente int, no_take string, is_mpa int",
    )
    search = spark.createDataFrame(
        [
            (1, "F", 10, None, None, "a"),
            (2, "F-AI", 11, None, None, "b"),
            (3, "NI", None, None, None, "c"),
            (4, "F", 10, None, None, "d"),
            (3, "F", 12, None, None, "e"),
        ],
        "mpa_id long, search string, plan_id long, notes string, network string, name string",
    )
    plans = spark.createDataFrame([(10, "P", "NZ", 2010), (11, "Q", "FJ", 2001)], "plan_id long, name string, country string, mp_year int")
    numbers = spark.createDataFrame([(n,) for n in (10, 11, 12, 13)], "plan_id long")
    reviewed = spark.createDataFrame([(10,), (11,)], "plan_id long")
    assert {r[0] for r in areas.missing_plans(search, areas.qualify_areas(atlas), numbers).collect()} == {11, 13}
    assert sorted(r["mpa_id"] for r in areas.area_list(atlas, search, numbers).collect()) == [1, 2, 3, 5]
    assert {r["mpa_id"] for r in areas.lost_by_strict_rule(atlas, search, numbers).collect()} == {2, 3}
    rows = areas.area_metadata(atlas, search, plans, numbers, reviewed).collect()
    got = sorted((r["mpa_id"], r["search"] or "", r["plan_id"] or 0, r["name_plan"] or "") for r in rows)
    assert got == [(1, "F", 10, "P"), (2, "F", 11, "Q"), (3, "NI", 0, ""), (3, "NI", 12, ""), (5, "", 0, "")]
    found = areas.found(areas.area_metadata(atlas, search, plans, numbers, reviewed))
    assert tuple(areas.plan_areas(found).agg(F.sum("n_areas"), F.count("*")).first()) == (2, 2)


def test_filter_counts_shrink(bed):
    atlas = bed.atlas()
    implemented = atlas.where(F.col("implemente") == 1)
    no_take = implemented.where(F.col("no_take").isin("Part", "All"))
    counts = [f.count() for f in (atlas, implemented, no_take, areas.qualify_areas(atlas), areas.qualify_areas(atlas, ["All"]))]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_filter_steps_are_observed(spark, bed):
    atlas = bed.atlas()
    stored, steps = areas.qualify_counted(atlas)
    implemented = atlas.where(F.col("implemente") == 1)
    no_take = implemented.where(F.col("no_take").isin("Part", "All"))
    want = [atlas, implemented, no_take, areas.qualify_areas(atlas), areas.qualify_areas(atlas, ["All"])]
    assert [r["n_areas"] for r in steps.orderBy("step").collect()] == [f.count() for f in want]
    assert stored.exceptAll(areas.qualify_areas(atlas)).count() == 0
    unknown = spark.createDataFrame([(1, None, "All", 1), (2, 1, None, 1), (3, 1, "All", None), (4, 1, "All", 1)], "mpa_id long, implemente int, no_take string, is_mpa int")
    assert [r["n_areas"] for r in areas.qualify_counted(unknown)[1].orderBy("step").collect()] == [4, 3, 2, 1, 1]
    assert [r["n_areas"] for r in areas.qualify_counted(unknown.limit(0))[1].orderBy("step").collect()] == [0, 0, 0, 0, 0]


def test_distinct_counts_do_not_multiply_rows(spark):
    """Missing ids, areas found and not found, plans of several years; no plan expands its input."""
    rows = [(1, "F", 10, "NZ", 2010), (1, "NS", None, "NZ", None), (2, "F", 10, None, 2012), (None, "F", 11, "FJ", 2001), (3, None, None, "FJ", None), (3, "F", None, "FR", 1990)]
    frame = spark.createDataFrame(rows, "mpa_id long, search string, plan_id long, country string, mp_year int")
    totals = areas.overview_totals(frame)
    assert tuple(totals.first()) == (3, 2, 3)
    assert areas.overview_totals(frame, na_rm=False).first()["n_areas_search"] == 4
    geography = areas.geography_stats(frame, 2005)
    assert tuple(geography.first()) == (3, 1990, (2010 + 2012 + 2001 + 1990) / 4, 0.5)
    assert tuple(areas.overview_totals(frame.limit(0)).first()) == (0, 0, 0)
    assert areas.geography_stats(frame.limit(0)).first()["average_year"] is None
    for result in (totals, geography):
        assert "Expand" not in result._jdf.queryExecution().executedPlan().toString()


def test_plan_facts_in_one_aggregate(spark):
    """A plan with two regions, one of them unknown, and two descriptions has a row for each; an unmeasured area makes its total missing."""
    rows = [(10, 1, "A", "P", "NZ", 2010), (10, 1, "A", "P", "NZ", 2010), (10, 2, None, "P", "NZ", 2011), (11, 3, "B", None, None, None), (None, 9, None, None, None, None)]
    frame = spark.createDataFrame(rows, "plan_id long, mpa_id long, region string, name_plan string, country_plan string, mp_year int")
    ring = lambda x: [[[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 0.0)]]]
    shapes = spark.createDataFrame([(1, ring(0.0)), (2, ring(5.0))], "mpa_id long, geometry array<array<array<struct<lon:double,lat:double>>>>")
    facts = reports.plan_facts(frame, shapes)
    size = {r["mpa_id"]: r["area_calc"] for r in geometry.polygon_area(shapes).collect()}
    got = {(r["plan_id"], r["mp_year"], r["region"]): (r["n_areas"], r["total_plan_area"]) for r in facts.collect()}
    both = (2, pytest.approx(2 * size[1] + size[2]))
    assert got == {(10, y, g): both for y in (2010, 2011) for g in ("A", None)} | {(11, None, "B"): (1, None), (None, None, None): (1, None)}
    assert facts.count() == 6


def test_metadata_reads_each_table_once_or_twice(bed):
    scans = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("FileScan")
    args = bed.atlas(), bed.search(), bed.all_plans()
    metadata = areas.area_metadata(bed.atlas(), bed.search(), bed.plans(), bed.all_plans(), review.plan_ids(bed.review()))
    points = geometry.map_points(bed.geometry(), areas.area_links(*args), bed.review())
    assert scans(metadata) <= 12 and scans(points) <= 20
    assert "NestedLoop" not in metadata._jdf.queryExecution().executedPlan().toString()


def test_stated_answers(spark):
    plans = {
        1: {"assess_any": "Planned", "assess_climate": None},
        2: {"assess_any": " planned ", "assess_climate": ""},
        3: {"assess_any": "see annex", "assess_climate": "0.5"},
        4: {"assess_any": "1", "assess_climate": "0"},
    }
    frame = small_review(spark, plans)
    again = frame.where("plan_id = 1 and q_code = 'assess_climate'").withColumn("entry", F.lit("Planned"))
    twice = frame.where("plan_id = 4 and q_code = 'assess_any'").withColumn("entry", F.lit("Planned"))
    lone = frame.where("plan_id = 4 and q_code = 'country'").withColumn("plan_id", F.lit(None).cast("long"))
    frame = frame.unionByName(again).unionByName(twice).unionByName(lone)
    codes = ["assess_any", "assess_climate"]
    found = {r.plan_id: (r.assess_any, r.assess_climate) for r in review.stated_answers(frame, codes).collect()}
    assert found == {
        1: ("planned", "planned"),
        2: ("planned", "missing"),
        3: ("other", "answered"),
        4: ("answered", "answered"),
        None: ("missing", "missing"),
    }
    counts = {r.q_code: r for r in review.planned_counts(frame, codes, 4).collect()}
    assert tuple(counts["assess_any"])[1:] == (1, 1, 2, 1, 4, 100.0, 50.0)
    assert tuple(counts["assess_climate"])[1:] == (2, 0, 1, 2, 3, 75.0, 25.0)
    plan = review.stated_answers(frame, codes)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert review.planned_counts(frame.limit(0), codes).count() == 0


def test_stated_answers_agree_with_the_indicators(spark):
    bed = DerivedTables(spark, "/root/testdata/sf0.001")
    stated = {r.q_code: r.n_taken for r in review.planned_counts(bed.review(), ["assess_any", "assess_climate"]).collect()}
    rows = indicators.indicator_matrix(bed.review()).agg(F.sum("assess_any_planned"), F.sum("assess_cc_planned")).first()
    assert (stated["assess_any"], stated["assess_climate"]) == tuple(rows)
