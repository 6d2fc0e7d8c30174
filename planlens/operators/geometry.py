"""Areas with polygons: validity, size, size class, centroid, map frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions.geo import area_m2, centroid, m2_to_km2
from planlens.functions.levels import level_rank
from planlens.functions.nulls import first_match, strict_sum
from planlens.operators.joins import inner_join, left_join, semi_join
from planlens.operators.reshape import stat_rows
from planlens.operators.validity import checked

# Size classes from small to large, in square kilometres.
SIZE_CLASSES = ["Very Small", "Small", "Large", "Very Large"]

# Map classes, and the limits of the map.
MENTION_CLASSES = ["No", "Yes", "No plan located"]
LON_LIMITS = (-185.0, 185.0)
LAT_LIMITS = (-89.0, 89.0)


def ring_quality(geometry: DataFrame) -> DataFrame:
    """Each geometry with the reason why it cannot be measured, NULL if it can."""
    return checked(geometry, "*")


def usable(geometry: DataFrame) -> DataFrame:
    return ring_quality(geometry).where(F.col("problem").isNull()).drop("problem")


def quarantined(geometry: DataFrame) -> DataFrame:
    return ring_quality(geometry).where(F.col("problem").isNotNull())


def area_geometry(geometry: DataFrame, areas: DataFrame) -> DataFrame:
    """The usable geometries of listed areas."""
    return semi_join(usable(geometry), areas, "mpa_id")


def _measured(geometry: DataFrame, measure: Column) -> DataFrame:
    """mpa_id and ``_m`` of the usable geometries, measured where they are read."""
    safe = F.when(F.col("_rings").isNull(), measure).alias("_m")
    return checked(geometry, "mpa_id", safe).where(F.col("problem").isNull())


def polygon_area(geometry: DataFrame) -> DataFrame:
    """Square kilometres of the usable geometries."""
    return _measured(geometry, m2_to_km2(area_m2(F.col("geometry")))).select("mpa_id", F.col("_m").alias("area_calc"))


def polygon_centroid(geometry: DataFrame) -> DataFrame:
    """X and Y of the planar centroid of the usable geometries."""
    return _measured(geometry, centroid(F.col("geometry"))).select("mpa_id", F.col("_m.X").alias("X"), F.col("_m.Y").alias("Y"))


def size_class(area: Column) -> Column:
    """Class limits belong to the class named first here."""
    large, small = area.between(100, 100000), area.between(10, 100)
    names = SIZE_CLASSES
    return first_match([(area > 100000, names[3]), (large, names[2]), (small, names[1]), (area < 10, names[0])])


def with_size(rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """Area rows with size and size class, matched by area id.

    Polygons are measured where they are read: only ids and sizes are shuffled.
    """
    return with_size_class(left_join(rows, polygon_area(geometry), "mpa_id"))


def with_size_class(df: DataFrame, area: str = "area_calc") -> DataFrame:
    name = size_class(F.col(area))
    return df.select("*", name.alias("size_class"), level_rank(name, SIZE_CLASSES).alias("size_rank"))


def plan_area(sized: DataFrame, name: str = "total_plan_area") -> DataFrame:
    """Managed area per plan; NULL if an area of the plan could not be measured."""
    return sized.groupBy("plan_id").agg(strict_sum(F.col("area_calc")).alias(name))


def plan_size_class(sized: DataFrame) -> DataFrame:
    """Plans per size class of their total area."""
    totals = with_size_class(plan_area(sized, "area_calc"))
    return totals.groupBy("size_class", "size_rank").agg(F.count(F.lit(1)).alias("n"))


def plan_area_total(sized: DataFrame) -> DataFrame:
    """Area covered by all plans, NULL if it is not known of one, and the number of plans without a known area."""
    total = F.col("total_plan_area")
    return plan_area(sized).agg(
        strict_sum(total).alias("total_review_area"), F.count_if(total.isNull()).alias("n_unmeasured")
    )


def climate_mention(review: DataFrame) -> DataFrame:
    """Does the plan mention climate change? Yes, No, or NULL for other answers."""
    entry = F.col("entry")
    return stat_rows(review).where(F.col("q_code") == "climate_mention").select(
        "plan_id", first_match([(entry == "1", "Yes"), (entry == "0", "No")]).alias("climate_mention")
    )


def map_points(
    geometry: DataFrame,
    links: DataFrame,
    review: DataFrame,
) -> DataFrame:
    """Centroid and class of every area and plan, inside the limits of the map.

    ``links`` has the areas and plans to be drawn.  Polygons are measured where
    they are read and only ids and points are shuffled; points of other areas
    find no link.
    """
    points = inner_join(polygon_centroid(geometry), links.select("mpa_id", "plan_id"), "mpa_id")
    classed = left_join(points, climate_mention(review), "plan_id")
    label = F.coalesce(F.col("climate_mention"), F.lit(MENTION_CLASSES[2]))
    return classed.where(F.col("X").between(*LON_LIMITS) & F.col("Y").between(*LAT_LIMITS)).select(
        "mpa_id", "plan_id", "X", "Y", label.alias("climate_mention"), level_rank(label, MENTION_CLASSES).alias("class_rank")
    )
