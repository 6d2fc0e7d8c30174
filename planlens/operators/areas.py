"""Qualifying areas, lost plans, search status, and counts of areas and plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from planlens.functions.nulls import n_distinct, ratio, replace_where
from planlens.operators.joins import anti_join, left_join, lookup_join, mark_member, semi_join
from planlens.session import materialise
from planlens.sources.tables import literal_table

AREA = "mpa_id"
PLAN = "plan_id"

# Search outcomes found, found with another area, not included.
FOUND, FOUND_SHARED, NOT_INCLUDED = "F", "F-AI", "NI"


def union_search(*lists: DataFrame) -> DataFrame:
    """Search lists one below the other, columns matched by name."""
    columns = ["mpa_id", "search", "plan_id", "notes", "network", "name"]
    result = lists[0].select(*columns)
    for other in lists[1:]:
        result = result.unionByName(other.select(*columns))
    return result


def qualifies(no_take: Sequence[str] = ("Part", "All")) -> list[tuple[str, Column]]:
    """The conditions of a qualifying area, in the order in which they are applied, with their names."""
    return [
        ("implemented", F.col("implemente") == 1),
        ("no-take", F.col("no_take").isin(*no_take)),
        ("is an area", F.col("is_mpa") == 1),
    ]


def qualify_areas(atlas: DataFrame, no_take: Sequence[str] = ("Part", "All")) -> DataFrame:
    """Implemented areas that are wholly or partly no-take and count as areas."""
    return atlas.where(reduce(and_, [condition for _, condition in qualifies(no_take)]))


def qualify_counted(atlas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The qualifying areas, stored, and how many areas each step left: step, condition, n_areas.

    The counts are observed while the areas are written, so the atlas is read
    once.  The filters lie in the task that writes, whose counts enter once
    however often it is tried.  The last row tells how many areas a stricter
    rule, wholly no-take, would keep.
    """
    rows, seen = atlas, []
    for name, condition in [("all", None), *qualifies()]:
        rows = rows if condition is None else rows.where(condition)
        watch = Observation()
        rows = rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("no_take") == "All").alias("strict"))
        seen.append((name, watch))
    stored = materialise(rows)
    counts = [(name, watch.get["rows"]) for name, watch in seen] + [("wholly no-take", seen[-1][1].get["strict"])]
    steps = literal_table(atlas.sparkSession, ["step", "condition", "n_areas"], [(i, *c) for i, c in enumerate(counts)])
    return stored, steps.withColumn("n_areas", F.col("n_areas").cast("long"))


def missing_plans(
    search: DataFrame, areas: DataFrame, all_plans: DataFrame
) -> DataFrame:
    """Plans that no qualifying area leads to."""
    reached = semi_join(search, areas, AREA).select("plan_id")
    return anti_join(all_plans.select("plan_id"), reached, PLAN)


def areas_outside(search: DataFrame, areas: DataFrame) -> DataFrame:
    """Search rows whose area does not qualify."""
    return anti_join(search, areas, AREA)


def areas_of_plans(
    atlas: DataFrame, search: DataFrame, plans: DataFrame
) -> DataFrame:
    """Areas that the search links to the given plans."""
    rows = semi_join(search.select("mpa_id", "plan_id"), plans, PLAN)
    return semi_join(atlas, rows, AREA)


def area_list(
    atlas: DataFrame,
    search: DataFrame,
    all_plans: DataFrame,
) -> DataFrame:
    """Qualifying areas plus the areas of plans that would otherwise be lost.

    The rows of the atlas are read once and marked with the narrow list of lost
    areas; none of those qualifies, or its plan would not be lost.
    """
    lost = missing_plans(search, qualify_areas(atlas).select(AREA), all_plans)
    links = semi_join(search.select(AREA, "plan_id"), lost, PLAN)
    marked = mark_member(atlas, links, AREA, "_lost")
    kept = reduce(and_, [condition for _, condition in qualifies()])
    return marked.where(F.coalesce(kept, F.lit(False)) | F.col("_lost")).drop("_lost")


def area_links(atlas: DataFrame, search: DataFrame, all_plans: DataFrame) -> DataFrame:
    """mpa_id and plan_id of the listed areas and all their search rows: the narrow form of the area metadata."""
    listed = materialise(area_list(atlas, search, all_plans).select(AREA))
    return lookup_join(listed, search.select(AREA, "plan_id", "search"), AREA).select(AREA, "plan_id")


def lost_by_strict_rule(
    atlas: DataFrame,
    search: DataFrame,
    all_plans: DataFrame,
) -> DataFrame:
    """Areas of the plans that only fully no-take areas would lose."""
    lost = missing_plans(search, qualify_areas(atlas, ("All",)), all_plans)
    return areas_of_plans(atlas, search, lost)


def with_search(areas: DataFrame, search: DataFrame) -> DataFrame:
    """Areas with their search rows; an area may have many."""
    renamed = search.withColumnsRenamed({"name": "name_search", "network": "network_from_mp"})
    return lookup_join(areas, renamed, AREA)


def with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows with the metadata of their plan."""
    renamed = plans.withColumnsRenamed({"name": "name_plan", "country": "country_plan"})
    return left_join(rows, renamed, PLAN)


def with_status(rows: DataFrame, review_plans: DataFrame) -> DataFrame:
    """Final search status: shared finds count as found, plans outside the review as not included."""
    marked = mark_member(rows, review_plans, PLAN, "_reviewed")
    shared = replace_where(F.col("search"), F.col("search") == FOUND_SHARED, FOUND)
    outside = ~F.col("_reviewed") & F.col("plan_id").isNotNull()
    return marked.withColumn("search", replace_where(shared, outside, NOT_INCLUDED)).drop("_reviewed")


def area_metadata(
    atlas: DataFrame,
    search: DataFrame,
    plans: DataFrame,
    all_plans: DataFrame,
    review_plans: DataFrame,
) -> DataFrame:
    """Area list with search outcome, plan metadata and final status.

    The area list, itself the result of several joins, is stored once.
    """
    listed = materialise(area_list(atlas, search, all_plans))
    rows = with_search(listed, search)
    return with_status(with_plan(rows, plans), review_plans)


def found(areas: DataFrame) -> DataFrame:
    """Areas with a plan; rows of unknown status are dropped."""
    return areas.where(F.col("search") == FOUND)


def _by_id(pairs: DataFrame, first: Sequence[Column], second: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Two tagged rows for each row of ``pairs``, whose ids of two kinds are to be counted: ``_first`` tells them apart.

    Counting different values of two columns in one aggregate would multiply
    every input row; here only the different pairs are doubled.
    """
    row = lambda tag, values: F.struct(F.lit(tag).alias("_first"), *[v.alias(n) for n, v in zip(names, values, strict=True)])
    return pairs.select(F.inline(F.array(row(True, first), row(False, second))))


def overview_totals(areas: DataFrame, na_rm: bool = True) -> DataFrame:
    """Areas searched, plans included, areas those plans cover."""
    hit = F.coalesce(F.col("search") == FOUND, F.lit(False))
    pairs = areas.groupBy("mpa_id", F.when(hit, F.col("plan_id")).alias("plan_id")).agg(F.max(hit).alias("_hit"))
    ids = [[F.col(c).cast("string"), F.col("_hit")] for c in ("mpa_id", "plan_id")]
    per_id = _by_id(pairs, *ids, ["_id", "_hit"]).groupBy("_first", "_id").agg(F.max("_hit").alias("_hit"))
    known, area = F.col("_id").isNotNull(), F.col("_first")
    return per_id.agg(
        F.count_if(area & (known | F.lit(not na_rm))).alias("n_areas_search"),
        F.count_if(~area & known).alias("n_plans"),
        F.count_if(area & known & F.col("_hit")).alias("n_areas_w_plans"),
    )


def plan_areas(rows: DataFrame) -> DataFrame:
    """Number of different areas per plan."""
    return rows.groupBy("plan_id").agg(n_distinct(F.col("mpa_id")).alias("n_areas"))


def multi_area_plans(rows: DataFrame) -> DataFrame:
    """Plans with more than one area, and the largest number of areas."""
    several = plan_areas(rows).where(F.col("n_areas") > 1)
    return several.agg(F.count(F.lit(1)).alias("n_multiple_areas"), F.max("n_areas").alias("max_areas"))


def geography_stats(rows: DataFrame, recent_after: int = 2009) -> DataFrame:
    """Countries, publication years, and the share of plans published after a year."""
    pairs = rows.groupBy("country", "plan_id").agg(
        F.max(F.col("mp_year") > recent_after).alias("_recent"),
        F.min("mp_year").alias("_least"),
        F.sum("mp_year").alias("_sum"),
        F.count("mp_year").alias("_known"),
    )
    names = ["_id", "_recent", "_least", "_sum", "_known"]
    country = [F.col("country").cast("string"), F.lit(False), *[F.col(c) for c in names[2:]]]
    plan = [F.col("plan_id").cast("string"), F.col("_recent"), *[F.lit(None)] * 3]
    per_id = _by_id(pairs, country, plan, names).groupBy("_first", "_id").agg(
        F.max("_recent").alias("_recent"), F.min("_least").alias("_least"), F.sum("_sum").alias("_sum"), F.sum("_known").alias("_known")
    )
    known, first = F.col("_id").isNotNull(), F.col("_first")
    totals = per_id.agg(
        F.count_if(first & known).alias("n_countries"),
        F.min("_least").alias("earliest_year"),
        F.try_divide(F.sum("_sum"), F.sum("_known")).alias("average_year"),
        F.count_if(~first & known & F.col("_recent")).alias("_recent"),
        F.count_if(~first & known).alias("_plans"),
    )
    return totals.select(
        "n_countries",
        "earliest_year",
        "average_year",
        ratio(F.col("_recent"), F.col("_plans")).alias("pct_last_decade"),
    )


def areas_and_plans(rows: DataFrame, *keys: str, n_areas: str = "n_areas", na_rm: bool = True) -> DataFrame:
    """Area rows and different plans per country, region or subregion.

    Rows are first counted per group and plan, so that a group with a large
    share of all rows is shrunk before it meets in one task.
    """
    per_plan = rows.groupBy(*keys, "plan_id").agg(F.count(F.lit(1)).alias("_rows"))
    plans = F.count("plan_id") if na_rm else F.count(F.lit(1))
    return per_plan.groupBy(*keys).agg(F.sum("_rows").alias(n_areas), plans.alias("n_plans"))


def plan_region(rows: DataFrame) -> DataFrame:
    """The regions of each plan."""
    return rows.select("plan_id", "region").distinct()


def document_times(refs: DataFrame, review_plans: DataFrame, n_plans=None) -> DataFrame:
    """Durations stated in plan documents, and how many have a work plan."""
    documents = refs.where(F.col("document_type") == "plan")
    chosen = semi_join(documents, review_plans, PLAN)
    whole = F.lit(n_plans) if n_plans is not None else review_plans.agg(F.count_distinct("plan_id")).scalar()
    times = chosen.agg(
        F.min("time_listed").alias("min_time"),
        F.max("time_listed").alias("max_time"),
        F.avg("time_listed").alias("avg_time"),
        F.stddev_samp("time_listed").alias("sd_time"),
        F.count_if(F.col("time_listed").isNull()).alias("num_nas"),
        F.coalesce(F.sum(F.when(F.col("work_plan").isNull(), 0).otherwise(1)), F.lit(0)).alias("num_work_plan"),
    )
    return times.withColumn("pct_work_plan", ratio(F.col("num_work_plan"), whole))


