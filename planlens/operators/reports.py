"""Plan tables that bring areas and indicators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from planlens.functions.nulls import n_distinct, strict_sum
from planlens.operators.geometry import with_size
from planlens.operators.indicators import indicators
from planlens.operators.joins import full_join
from planlens.sources.tables import fill_nulls


def plan_facts(rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """Metadata, regions, number of areas and managed area of each plan: one row for each region and description.

    One aggregate by plan: it meets the rows of a plan and area first, which
    also shrinks a plan with very many areas, and a plan's few regions and
    descriptions are sets beside its totals.
    """
    described, region = ["name_plan", "country_plan", "mp_year"], F.struct("region")
    sized = with_size(rows.select("plan_id", "mpa_id", "region", *described), geometry)
    facts = sized.groupBy("plan_id").agg(
        n_distinct(F.col("mpa_id")).alias("n_areas"),
        strict_sum(F.col("area_calc")).alias("total_plan_area"),
        F.collect_set(F.struct(*described)).alias("_described"),
        F.collect_set(region).alias("_regions"),  # a struct, so that an unknown region counts
    )
    spread = facts.select("*", F.explode("_described").alias("_d")).select("*", F.explode("_regions").alias("_r"))
    return spread.select("plan_id", "_d.*", "_r.region", "n_areas", "total_plan_area")


def plan_table(rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """The plan facts in the order of the plan ids."""
    return plan_facts(rows, geometry).orderBy(F.asc_nulls_last("plan_id"))


def plan_results_wide(rows: DataFrame, geometry: DataFrame, review: DataFrame) -> DataFrame:
    """The plan facts with all indicators; missing indicator values of a reviewed plan are 0."""
    facts = plan_facts(rows, geometry)
    matrix = fill_nulls(indicators(review))
    return full_join(facts, matrix, "plan_id").orderBy(F.asc_nulls_last("plan_id"))
