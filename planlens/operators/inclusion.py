"""Inclusion level per plan and component, scores, and the heat-map frame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions.levels import level_rank
from planlens.functions.nulls import in_set
from planlens.functions.text import clean_name, drop_parenthetical, replace_first_chain
from planlens.operators.indicators import indicators, stack
from planlens.operators.joins import left_join
from planlens.operators.ranking import numbered
from planlens.rules import CA, GA, RA, SECTIONS, TYPES, section_rules
from planlens.session import materialise

NOT_INCLUDED = "Not Included"

# Inclusion levels from weakest to strongest, then none.
LEVELS = [GA, RA, CA, NOT_INCLUDED]

# Name shortenings in the order they are applied.
NAME_RULES = [
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


def abbreviate_names(names: DataFrame) -> DataFrame:
    """plan_id, name_english and its short form."""
    return names.select(
        "plan_id", "name_english", replace_first_chain(F.col("name_english"), NAME_RULES).alias("name_abbrev")
    )


def short_names(names: DataFrame) -> DataFrame:
    """Plan names without bracketed remarks."""
    return names.withColumn("name_short", drop_parenthetical(F.col("name")))


_TYPE_COLUMNS = [clean_name(t) for t in TYPES]
_CELL = [*_TYPE_COLUMNS, "level"]

# Count column of each level.
_COUNTS = {CA: "climate_count", RA: "rec_count", GA: "aware_count", None: "not_included"}


def _score(section: str, type_: str) -> str:
    """SQL for the number of indicators met; NULL where a section has none of the type."""
    stats = [r.stat for r in section_rules(section) if r.type == type_]
    return " + ".join(f"coalesce({s}, 0D)" for s in stats) if stats else "CAST(NULL AS DOUBLE)"


def _level(i: int) -> str:
    tests = " ".join(f"WHEN {clean_name(t)}_{i} > 0 THEN '{t}'" for t in TYPES)
    return f"CASE {tests} END AS level_{i}"


def _total(type_: str) -> str:
    return " + ".join(f"coalesce({clean_name(type_)}_{i}, 0D)" for i in range(len(SECTIONS)))


def _count(level: str | None) -> str:
    wanted = f"'{level}'" if level else "CAST(NULL AS STRING)"
    return " + ".join(f"CAST(level_{i} <=> {wanted} AS BIGINT)" for i in range(len(SECTIONS)))


def plan_levels(review: DataFrame) -> DataFrame:
    """One row per plan with scores and level of every component, total scores and level counts.

    All of them are expressions over the indicators of a plan: the only shuffle
    is the one that brings its answers together.
    """
    sections = list(enumerate(SECTIONS))
    scores = [f"{_score(s, t)} AS {clean_name(t)}_{i}" for i, s in sections for t in TYPES]
    levels = indicators(review).selectExpr("plan_id", *scores).selectExpr("*", *[_level(i) for i, _ in sections])
    return levels.selectExpr(
        "*",
        f"{_total(CA)} AS total_climate",
        f"{_total(RA)} AS total_rec",
        f"{_total(GA)} AS total_aware",
        *[f"{_count(level)} AS {name}" for level, name in _COUNTS.items()],
    )


def _cells() -> Column:
    """Spread the components of a plan into rows."""
    rows = [(f"'{s}'", *[f"{c}_{i}" for c in _CELL]) for i, s in enumerate(SECTIONS)]
    return stack(rows, ["category", *_CELL])


def inclusion_levels(review: DataFrame) -> DataFrame:
    """Score per inclusion type and the level they give, per plan and component."""
    return plan_levels(review).select("plan_id", _cells())


def inclusion_levels_wide(review: DataFrame) -> DataFrame:
    """One row per plan, one level column per component."""
    return plan_levels(review).select("plan_id", *[F.col(f"level_{i}").alias(s) for i, s in enumerate(SECTIONS)])


def plan_scores(review: DataFrame) -> DataFrame:
    """Total score per plan and inclusion type."""
    return plan_levels(review).select("plan_id", "total_climate", "total_rec", "total_aware")


def level_counts(review: DataFrame) -> DataFrame:
    """Components per plan and level; 0 where a level does not occur."""
    return plan_levels(review).select("plan_id", *_COUNTS.values())


_ORDER = ["climate_count", "rec_count", "aware_count", "total_climate", "total_rec"]


def level_heatmap(
    review: DataFrame, names: DataFrame, regions: DataFrame, left_panel: Iterable[str] | None = None
) -> DataFrame:
    """Levels with names, regions, scores and the order of the names.

    Names and regions join on plan rows, which are spread into components last.
    A plan in two regions has two rows per component.  A name is placed where
    its lowest plan stands; ``left_panel`` splits the regions.
    """
    named = materialise(left_join(plan_levels(review), abbreviate_names(names), "plan_id"))
    position = F.min(F.struct(*_ORDER, "plan_id")).alias("_first")
    firsts = named.where(F.col("name_abbrev").isNotNull()).groupBy("name_abbrev").agg(position)
    firsts = firsts.select("name_abbrev", "_first.*")
    ranks = numbered(firsts, [*_ORDER, "plan_id", "name_abbrev"], "name_rank").select("name_abbrev", "name_rank")
    ranked = left_join(named, ranks, "name_abbrev")
    placed = left_join(ranked, regions, "plan_id")
    panel = F.lit(None).cast("string")
    if left_panel is not None:
        panel = F.when(in_set(F.col("region"), list(left_panel)), "left").otherwise("right")
    attributes = ["name_english", "name_abbrev", "region", "total_climate", "total_rec", "total_aware"]
    attributes += [*_COUNTS.values(), "name_rank"]
    spread = placed.select("plan_id", *attributes, panel.alias("panel"), _cells())
    level = F.coalesce("level", F.lit(NOT_INCLUDED))
    return spread.select(
        "plan_id",
        "category",
        *_TYPE_COLUMNS,
        level.alias("level"),
        level_rank(level, LEVELS).alias("level_rank"),
        *attributes,
        "panel",
    )


def region_count(plan_region: DataFrame) -> DataFrame:
    """Plans per region."""
    return plan_region.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


