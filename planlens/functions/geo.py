"""Polygon measures as higher-order column expressions.

A geometry is ``array<polygon>``, a polygon ``array<ring>`` (outer ring first,
then holes), a ring a closed ``array<struct<lon,lat>>`` in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

POINT = "struct<lon:double,lat:double>"
RING = f"array<{POINT}>"
GEOMETRY = f"array<array<{RING}>>"

# Mean earth radius of the spherical geometry library, and the
# square metres of a square kilometre.
EARTH_RADIUS_M = 6371010.0
M2_PER_KM2 = 1e6


def _edges(ring: Column, measure) -> Column:
    """``measure(start, end)`` for each edge of a ring."""
    n = F.size(ring)
    starts = F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))
    ends = F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(starts, ends, measure)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def ring_area_m2(ring: Column) -> Column:
    """Area of a ring with great-circle edges on the sphere.

    Each edge contributes the signed excess of the figure between it and the
    equator, its longitude difference taken the short way across the
    antimeridian.  If the ring winds round a pole, the sum measures the
    complement within the hemisphere.
    """

    def half_tan(point: Column) -> Column:
        return F.tan(F.radians(point["lat"]) / 2)

    steps = _edges(
        ring,
        lambda a, b: F.struct(
            F.radians(F.pmod(b["lon"] - a["lon"] + 180.0, F.lit(360.0)) - 180.0).alias("turn"),
            (half_tan(a) + half_tan(b)).alias("sum"),
            (half_tan(a) * half_tan(b)).alias("product"),
        ),
    )
    start = F.struct(F.lit(0.0).alias("excess"), F.lit(0.0).alias("turn"))

    def add(total: Column, edge: Column) -> Column:
        excess = 2 * F.atan2(F.tan(edge["turn"] / 2) * edge["sum"], 1 + edge["product"])
        return F.struct((total["excess"] + excess).alias("excess"), (total["turn"] + edge["turn"]).alias("turn"))

    def finish(total: Column) -> Column:
        area = F.abs(total["excess"])
        steradians = F.when(F.abs(total["turn"]) > math.pi, 2 * math.pi - area).otherwise(area)
        return steradians * (EARTH_RADIUS_M * EARTH_RADIUS_M)

    return F.aggregate(steps, start, add, finish)


def area_m2(geometry: Column) -> Column:
    """Outer rings minus holes, summed over the polygons of a geometry."""

    def polygon(rings: Column) -> Column:
        areas = F.transform(rings, lambda ring, i: F.when(i == 0, 1.0).otherwise(-1.0) * ring_area_m2(ring))
        return _total(areas)

    return _total(F.transform(geometry, polygon))


def m2_to_km2(value: Column) -> Column:
    return value / M2_PER_KM2


def _moments(area: Column, mx: Column, my: Column) -> Column:
    return F.struct(area.alias("a"), mx.alias("mx"), my.alias("my"))


def ring_moments(ring: Column, sign: Column) -> Column:
    """Signed planar area and first moments of a ring.

    They are taken about the first point of the ring, which keeps the products small.
    """
    origin = F.element_at(ring, 1)

    def step(p: Column, q: Column) -> Column:
        px, py = p["lon"] - origin["lon"], p["lat"] - origin["lat"]
        qx, qy = q["lon"] - origin["lon"], q["lat"] - origin["lat"]
        return F.struct((px * qy - qx * py).alias("cross"), (px + qx).alias("x"), (py + qy).alias("y"))

    edges = _edges(ring, step)

    def add(total: Column, edge: Column) -> Column:
        return _moments(
            total["a"] + edge["cross"],
            total["mx"] + edge["cross"] * edge["x"],
            total["my"] + edge["cross"] * edge["y"],
        )

    def finish(total: Column) -> Column:
        weight = sign * F.signum(total["a"])
        area = weight * total["a"] / 2
        return _moments(
            area,
            weight * total["mx"] / 6 + area * origin["lon"],
            weight * total["my"] / 6 + area * origin["lat"],
        )

    return F.aggregate(edges, _moments(F.lit(0.0), F.lit(0.0), F.lit(0.0)), add, finish)


def centroid(geometry: Column) -> Column:
    """Planar centroid ``struct<X,Y>`` of longitude/latitude rings; NULL without planar area."""
    rings = F.transform(
        geometry,
        lambda polygon: F.transform(
            polygon, lambda ring, i: ring_moments(ring, F.when(i == 0, 1.0).otherwise(-1.0))
        ),
    )

    def add(total: Column, ring: Column) -> Column:
        return _moments(total["a"] + ring["a"], total["mx"] + ring["mx"], total["my"] + ring["my"])

    def finish(total: Column) -> Column:
        return F.struct(
            F.try_divide(total["mx"], total["a"]).alias("X"), F.try_divide(total["my"], total["a"]).alias("Y")
        )

    return F.aggregate(F.flatten(rings), _moments(F.lit(0.0), F.lit(0.0), F.lit(0.0)), add, finish)


def ring_problem(ring: Column) -> Column:
    """Why a ring cannot be measured; NULL for a usable ring."""
    missing = F.exists(ring, lambda p: p.isNull() | p["lon"].isNull() | p["lat"].isNull())
    outside = F.exists(ring, lambda p: ~p["lon"].between(-180.0, 180.0) | ~p["lat"].between(-90.0, 90.0))
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "too few points")
        .when(missing, "missing coordinate")
        .when(outside, "coordinate out of range")
        .when((first["lon"] != last["lon"]) | (first["lat"] != last["lat"]), "not closed")
    )


def geometry_problem(geometry: Column) -> Column:
    """The first problem of any ring; NULL for a usable geometry."""
    rings = F.flatten(geometry)
    problems = F.filter(F.transform(rings, ring_problem), lambda p: p.isNotNull())
    return F.when(geometry.isNull() | (F.size(rings) == 0), "no ring").otherwise(F.get(problems, F.lit(0)))
