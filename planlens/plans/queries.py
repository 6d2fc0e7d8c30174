"""The registered queries: each builds its result from one folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from planlens.functions import nulls
from planlens.functions.levels import level_rank, only_levels
from planlens.operators import areas, condensed, geometry, inclusion, indicators, joins, reports, reshape, review
from planlens.operators.density import kernel_density
from planlens.questions import ANSWER_CODES, COMPONENT_RANGES, COMPONENTS, EXCLUDED_PLANS, QUESTION_CODES
from planlens.rules import (
    ASSESSMENTS,
    CLIMATE,
    DESIGN,
    MANAGEMENT,
    MONITORING,
    OBJECTIVES,
    section_rules,
)
from planlens.session import materialise, new_shared_path
from planlens.sources import tables
from planlens.sources.derived import DerivedTables

Query = Callable[[SparkSession, str], DataFrame]

RECENT_AFTER = 1997
LEFT_PANEL = ("AFRICA", "AMERICA", "ASIA")

ASSESSMENT_CODES = [QUESTION_CODES[n] for low, high in dict(COMPONENT_RANGES)["assessment"] for n in range(low, high + 1)]

_REGISTRY: dict[str, Query] = {}


def _query(build: Callable[[DerivedTables], DataFrame]) -> Callable[[DerivedTables], DataFrame]:
    _REGISTRY[build.__name__] = lambda spark, folder: build(DerivedTables(spark, folder))
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round sums of doubles, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def _numeric(bed: DerivedTables, *codes: str) -> DataFrame:
    return reshape.answers_wide(bed.review(), codes, numeric=True)


def _area_metadata(bed: DerivedTables) -> DataFrame:
    return areas.area_metadata(
        bed.atlas(), bed.search(), bed.plans(), bed.all_plans(), review.plan_ids(bed.review())
    )


def _found(bed: DerivedTables) -> DataFrame:
    return areas.found(_area_metadata(bed))


def _sized(bed: DerivedTables) -> DataFrame:
    return geometry.with_size(_found(bed), bed.geometry())


def _map_points(bed: DerivedTables) -> DataFrame:
    links = areas.area_links(bed.atlas(), bed.search(), bed.all_plans())
    return geometry.map_points(bed.geometry(), links, bed.review())


# Scans, cells, names, sinks


@_query
def typed_scan(bed: DerivedTables) -> DataFrame:
    """The orders as a CSV file, read by its declared types."""
    names, path = ["o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice"], new_shared_path(bed.spark, "orders")
    tables.write_csv(bed.table("orders").select(*names), path)
    return tables.read_sheet_csv(bed.spark, path, names, "ncnc-")


@_query
def text_scan(bed: DerivedTables) -> DataFrame:
    return tables.with_column_types(bed.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "c")


@_query
def column_range(bed: DerivedTables) -> DataFrame:
    orders = bed.table("orders")
    return orders.select(*tables.column_range(orders, "o_custkey", "o_totalprice"))


@_query
def na_tokens(bed: DerivedTables) -> DataFrame:
    return tables.with_clean_names(tables.clean_cells(bed.raw_cells()))


@_query
def clean_names(bed: DerivedTables) -> DataFrame:
    return tables.with_clean_names(bed.references())


@_query
def write_roundtrip(bed: DerivedTables) -> DataFrame:
    """The review written as Parquet by record type, its stat rows as CSV, both read back and counted."""
    spark = bed.spark
    parquet, csv = new_shared_path(spark, "review"), new_shared_path(spark, "results")
    tables.write_table(bed.review(), parquet, ["type"])
    stored = spark.read.parquet(parquet)
    columns = ["plan_id", "q_code", "entry"]
    tables.write_csv(reshape.stat_rows(stored).select(*columns), csv)
    back = tables.read_sheet_csv(spark, csv, columns, "icc")
    return back.groupBy("q_code", "entry").agg(F.count(F.lit(1)).alias("n"), F.sum("plan_id").alias("plan_sum"))


@_query
def stored_review_stat(bed: DerivedTables) -> DataFrame:
    """The review stored in buckets of plans; its indicators then need no shuffle by plan."""
    return indicators.all_stat(tables.store_by_key(bed.review(), "plan_id"))


@_query
def stored_review_levels(bed: DerivedTables) -> DataFrame:
    return inclusion.inclusion_levels(tables.store_by_key(bed.review(), "plan_id"))


# Ids and joins


@_query
def search_union(bed: DerivedTables) -> DataFrame:
    return bed.search()


@_query
def missing_ids(bed: DerivedTables) -> DataFrame:
    return areas.missing_plans(bed.search(), areas.qualify_areas(bed.atlas()), bed.all_plans())


@_query
def semi_join_ids(bed: DerivedTables) -> DataFrame:
    return joins.semi_join(bed.search(), areas.qualify_areas(bed.atlas()), "mpa_id")


@_query
def anti_join_ids(bed: DerivedTables) -> DataFrame:
    return areas.areas_outside(bed.search(), areas.qualify_areas(bed.atlas()))


@_query
def exclude_ids(bed: DerivedTables) -> DataFrame:
    return review.exclude_plans(bed.search().select("mpa_id", "plan_id"), EXCLUDED_PLANS)


@_query
def null_safe_left_join(bed: DerivedTables) -> DataFrame:
    search = bed.search().select("mpa_id", "plan_id", "search")
    per_plan = search.groupBy("plan_id").agg(F.count(F.lit(1)).alias("plan_rows"), F.max("search").alias("last_search"))
    return joins.left_join(search, per_plan, "plan_id")


# Review


@_query
def review_long(bed: DerivedTables) -> DataFrame:
    return bed.review()


@_query
def review_wide(bed: DerivedTables) -> DataFrame:
    return reshape.answers_wide(bed.review(), ANSWER_CODES)


@_query
def coded_to_numeric(bed: DerivedTables) -> DataFrame:
    wide = reshape.answers_wide(bed.review(), ANSWER_CODES[ANSWER_CODES.index("climate_mention") :])
    return tables.numbers_in_range(wide, "climate_mention", "threat_habitat_cc")


@_query
def climate_subset(bed: DerivedTables) -> DataFrame:
    return review.climate_subset(bed.review()).select("plan_id", "q_code", "entry")


@_query
def climate_wide(bed: DerivedTables) -> DataFrame:
    chosen = review.climate_subset(bed.review())
    codes = [c for c in ANSWER_CODES if c.startswith("climate_")] + ["obj_cc_any", "design_cc_any", "monitor_exp_any"]
    return reshape.answers_wide(chosen, codes, numeric=True).withColumn("total_climate", nulls.row_total(codes))


@_query
def sheet_unpivot(bed: DerivedTables) -> DataFrame:
    return reshape.sheet_long(bed.sheets(), "sheet_id")


@_query
def question_category(bed: DerivedTables) -> DataFrame:
    return reshape.sheet_key(bed.sheets())


@_query
def category_order(bed: DerivedTables) -> DataFrame:
    counts = review.count_by(bed.review(), "category")
    known = only_levels(F.col("category"), COMPONENTS)
    return counts.select(known.alias("category"), level_rank(known, COMPONENTS).alias("category_rank"), "n")


@_query
def count_by_group(bed: DerivedTables) -> DataFrame:
    return review.count_by(bed.search(), "search", "plan_id")


@_query
def language_share(bed: DerivedTables) -> DataFrame:
    return review.language_share(bed.review())


@_query
def strategy_table(bed: DerivedTables) -> DataFrame:
    return review.strategy_table(bed.review())


# NULL policies on whole answer tables


@_query
def flag_three_valued(bed: DerivedTables) -> DataFrame:
    wide = _numeric(bed, "monitor_any", "monitor_sci", "monitor_soc")
    one = lambda c: F.col(c) == 1
    return wide.select(
        "plan_id",
        nulls.flag(one("monitor_any")).alias("any_is_one"),
        nulls.flag(one("monitor_any") & (F.col("monitor_sci") == 0)).alias("any_without_sci"),
        nulls.flag(one("monitor_any") | one("monitor_soc")).alias("any_or_soc"),
    )


@_query
def null_in_set(bed: DerivedTables) -> DataFrame:
    wide = _numeric(bed, "assess_any", "assess_climate")
    return wide.select(
        "plan_id",
        nulls.flag(nulls.in_set(F.col("assess_any"), [1.0], with_null=True)).alias("done_or_planned"),
        nulls.flag(nulls.in_set(F.col("assess_any"), [1.0])).alias("done"),
        nulls.flag(nulls.not_in_set(F.col("assess_climate"), [1.0])).alias("climate_not_done"),
        nulls.flag(nulls.not_in_set(F.col("assess_climate"), [1.0], with_null=True)).alias("climate_neither"),
    )


@_query
def row_any(bed: DerivedTables) -> DataFrame:
    codes = ["monitor_any", "monitor_imp_any", "assess_any", "threat_any"]
    wide = _numeric(bed, *codes)
    return wide.select(
        "plan_id",
        nulls.flag(nulls.any_equal(codes, 1)).alias("any_one"),
        nulls.flag(nulls.any_nonzero(codes[:3])).alias("any_nonzero"),
    )


@_query
def row_all(bed: DerivedTables) -> DataFrame:
    codes = ["obj_sp", "obj_unit", "monitor_any"]
    wide = _numeric(bed, *codes)
    return wide.select(
        "plan_id",
        nulls.flag(nulls.all_nonzero(codes[:2])).alias("both"),
        nulls.flag(nulls.all_nonzero(codes)).alias("all_three"),
    )


@_query
def row_sum(bed: DerivedTables) -> DataFrame:
    codes = ["monitor_any", "monitor_sci", "monitor_soc", "design_type"]
    return _numeric(bed, *codes).select("plan_id", nulls.row_total(codes).alias("total"))


@_query
def column_sums(bed: DerivedTables) -> DataFrame:
    wide = _numeric(bed, "monitor_any", "obj_any")
    return wide.agg(
        nulls.strict_sum(F.col("monitor_any")).alias("strict_any"),
        nulls.lenient_sum(F.col("monitor_any")).alias("lenient_any"),
        nulls.strict_sum(F.col("obj_any")).alias("strict_obj"),
        nulls.n_distinct(F.col("monitor_any"), na_rm=False).alias("values_with_null"),
        nulls.n_distinct(F.col("monitor_any")).alias("values_without_null"),
    )


@_query
def conditional_update(bed: DerivedTables) -> DataFrame:
    answers = reshape.stat_rows(bed.review())
    missing = (F.col("q_code") == "assess_any") & F.col("entry").isNull()
    entry = nulls.replace_where(F.col("entry"), missing, "0")
    return answers.select("plan_id", "q_code", nulls.replace_where(entry, F.col("entry") == "Planned", "1").alias("entry"))


@_query
def planned_to_binary(bed: DerivedTables) -> DataFrame:
    return condensed.binary_answers(bed.review()).select("plan_id", "q_code", "entry")


@_query
def design_flags(bed: DerivedTables) -> DataFrame:
    return indicators.indicators(bed.review(), section_rules(DESIGN))


@_query
def fill_missing(bed: DerivedTables) -> DataFrame:
    return tables.fill_nulls(_numeric(bed, "monitor_any", "assess_any", "assess_climate"))


# Indicators


def _section(name: str, section: str) -> None:
    _REGISTRY[name] = lambda spark, folder: indicators.section_summary(DerivedTables(spark, folder).review(), section)


_section("stat_summary_climate", CLIMATE)
_section("stat_summary_obj", OBJECTIVES)
_section("stat_summary_assess", ASSESSMENTS)
_section("stat_summary_design", DESIGN)
_section("stat_summary_monitor", MONITORING)
_section("stat_summary_mgmt", MANAGEMENT)


@_query
def all_stat(bed: DerivedTables) -> DataFrame:
    return indicators.all_stat(bed.review())


@_query
def figure_indicators(bed: DerivedTables) -> DataFrame:
    return indicators.figure_indicators(indicators.all_stat(bed.review()))


@_query
def split_stat_name(bed: DerivedTables) -> DataFrame:
    return indicators.split_stats(indicators.all_stat(bed.review()))


@_query
def label_recode(bed: DerivedTables) -> DataFrame:
    return indicators.labelled_threats(indicators.all_stat(bed.review()))


@_query
def assessment_total(bed: DerivedTables) -> DataFrame:
    return review.assessment_total(bed.review())


@_query
def stated_answers(bed: DerivedTables) -> DataFrame:
    return review.stated_answers(bed.review(), ASSESSMENT_CODES)


@_query
def planned_counts(bed: DerivedTables) -> DataFrame:
    return review.planned_counts(bed.review(), ASSESSMENT_CODES)


@_query
def design_entry_counts(bed: DerivedTables) -> DataFrame:
    return _rounded(review.design_entry_counts(bed.review()), 6, "pct_1")


@_query
def indicator_matrix(bed: DerivedTables) -> DataFrame:
    return indicators.indicator_matrix(bed.review())


@_query
def indicator_full_join(bed: DerivedTables) -> DataFrame:
    return indicators.indicator_full_join(bed.review())


@_query
def all_by_plan(bed: DerivedTables) -> DataFrame:
    return indicators.all_by_plan(bed.review())


@_query
def plan_results_long(bed: DerivedTables) -> DataFrame:
    return indicators.results_long(bed.review())


@_query
def threat_matrix(bed: DerivedTables) -> DataFrame:
    return indicators.threat_matrix(bed.review())


# Levels


@_query
def inclusion_levels(bed: DerivedTables) -> DataFrame:
    return inclusion.inclusion_levels(bed.review())


@_query
def inclusion_levels_wide(bed: DerivedTables) -> DataFrame:
    return inclusion.inclusion_levels_wide(bed.review())


@_query
def plan_scores(bed: DerivedTables) -> DataFrame:
    return inclusion.plan_scores(bed.review())


@_query
def level_counts(bed: DerivedTables) -> DataFrame:
    return inclusion.level_counts(bed.review())


def _reviewed_regions(bed: DerivedTables) -> DataFrame:
    regions = areas.plan_region(_area_metadata(bed))
    return joins.semi_join(regions, review.plan_ids(bed.review()), "plan_id")


@_query
def plan_region(bed: DerivedTables) -> DataFrame:
    return _reviewed_regions(bed)


@_query
def region_count(bed: DerivedTables) -> DataFrame:
    return inclusion.region_count(_reviewed_regions(bed))


@_query
def level_heatmap(bed: DerivedTables) -> DataFrame:
    return inclusion.level_heatmap(bed.review(), bed.names(), _reviewed_regions(bed), LEFT_PANEL)


@_query
def abbreviate_names(bed: DerivedTables) -> DataFrame:
    return inclusion.abbreviate_names(bed.names())


@_query
def strip_parenthetical(bed: DerivedTables) -> DataFrame:
    return inclusion.short_names(review.plan_names(bed.review()))


@_query
def condensed_flags(bed: DerivedTables) -> DataFrame:
    return condensed.condensed_flags(bed.review())


@_query
def condensed_summary(bed: DerivedTables) -> DataFrame:
    return condensed.condensed_summary(bed.review(), areas.plan_region(_found(bed)))


@_query
def legacy_level_stats(bed: DerivedTables) -> DataFrame:
    return condensed.earlier_level_stats(bed.review())


@_query
def legacy_code_stats(bed: DerivedTables) -> DataFrame:
    return condensed.earlier_code_stats(bed.review())


@_query
def radar_score(bed: DerivedTables) -> DataFrame:
    return condensed.radar_score(bed.review())


# Areas


@_query
def qualify_areas(bed: DerivedTables) -> DataFrame:
    return areas.qualify_areas(bed.atlas())


@_query
def filter_steps(bed: DerivedTables) -> DataFrame:
    return areas.qualify_counted(bed.atlas())[1]


@_query
def qualify_strict_lost_plans(bed: DerivedTables) -> DataFrame:
    return areas.lost_by_strict_rule(bed.atlas(), bed.search(), bed.all_plans())


@_query
def area_list(bed: DerivedTables) -> DataFrame:
    return areas.area_list(bed.atlas(), bed.search(), bed.all_plans())


@_query
def area_metadata(bed: DerivedTables) -> DataFrame:
    return _area_metadata(bed)


@_query
def search_status(bed: DerivedTables) -> DataFrame:
    return areas.with_status(bed.search(), review.plan_ids(bed.review()))


@_query
def area_found(bed: DerivedTables) -> DataFrame:
    return _found(bed)


@_query
def overview_totals(bed: DerivedTables) -> DataFrame:
    return areas.overview_totals(_area_metadata(bed))


@_query
def multi_area_plans(bed: DerivedTables) -> DataFrame:
    return areas.multi_area_plans(_found(bed))


@_query
def geography_stats(bed: DerivedTables) -> DataFrame:
    return _rounded(areas.geography_stats(_found(bed), RECENT_AFTER), 8, "average_year", "pct_last_decade")


@_query
def country_table(bed: DerivedTables) -> DataFrame:
    return areas.areas_and_plans(_found(bed), "country")


@_query
def region_table(bed: DerivedTables) -> DataFrame:
    return areas.areas_and_plans(_found(bed), "region", n_areas="n_zones")


@_query
def region_subregion_table(bed: DerivedTables) -> DataFrame:
    return areas.areas_and_plans(_found(bed), "region", "subregion", n_areas="n_zones")


@_query
def plan_time_stats(bed: DerivedTables) -> DataFrame:
    refs = tables.with_clean_names(bed.references())
    stats = areas.document_times(refs, review.plan_ids(bed.review()))
    return _rounded(stats, 8, "avg_time", "sd_time", "pct_work_plan")


# Geometry and density


@_query
def ring_quality(bed: DerivedTables) -> DataFrame:
    return geometry.ring_quality(bed.geometry()).select("mpa_id", "problem")


@_query
def polygon_area(bed: DerivedTables) -> DataFrame:
    return _rounded(geometry.polygon_area(bed.geometry()), 3, "area_calc")


@_query
def polygon_centroid(bed: DerivedTables) -> DataFrame:
    return _rounded(geometry.polygon_centroid(bed.geometry()), 6, "X", "Y")


@_query
def area_size_class(bed: DerivedTables) -> DataFrame:
    sized = _sized(bed).select("mpa_id", "plan_id", "area_calc", "size_class", "size_rank")
    return _rounded(sized, 3, "area_calc")


@_query
def plan_size_class(bed: DerivedTables) -> DataFrame:
    return geometry.plan_size_class(_sized(bed))


@_query
def plan_area_total(bed: DerivedTables) -> DataFrame:
    return _rounded(geometry.plan_area_total(_sized(bed)), 2, "total_review_area")


@_query
def map_points(bed: DerivedTables) -> DataFrame:
    return _rounded(_map_points(bed), 6, "X", "Y")


@_query
def latitude_density(bed: DerivedTables) -> DataFrame:
    latitudes = materialise(_map_points(bed).select("climate_mention", "Y"))
    density = kernel_density(latitudes, "climate_mention", "Y", *geometry.LAT_LIMITS)
    return _rounded(density, 8, "y", "density")


# Plan tables


@_query
def plan_table(bed: DerivedTables) -> DataFrame:
    return _rounded(reports.plan_table(_found(bed), bed.geometry()), 3, "total_plan_area")


@_query
def plan_results_wide(bed: DerivedTables) -> DataFrame:
    results = reports.plan_results_wide(_found(bed), bed.geometry(), bed.review())
    return _rounded(results, 3, "total_plan_area")
