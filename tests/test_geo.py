"""Polygon measures against closed forms."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from planlens.functions import geo
from planlens.operators import geometry, validity

R = geo.EARTH_RADIUS_M


def box(lon, lat, width, height=None):
    height = width if height is None else height
    return [(lon, lat), (lon + width, lat), (lon + width, lat + height), (lon, lat + height), (lon, lat)]


@pytest.fixture
def shapes(spark):
    def build(**polygons):
        return spark.createDataFrame(list(polygons.items()), f"mpa_id string, geometry {geo.GEOMETRY}")

    return build


def measured(frame, column):
    return {r["mpa_id"]: r["v"] for r in frame.select("mpa_id", column.alias("v")).collect()}


def test_area(shapes):
    octant = [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)]
    cap = [(float(lon), 60.0) for lon in range(0, 360, 1)] + [(0.0, 60.0)]
    cap = [((lon + 180) % 360 - 180, lat) for lon, lat in cap]
    frame = shapes(
        octant=[[octant]],
        reverse=[[octant[::-1]]],
        holed=[[box(0.0, 0.0, 4.0), box(1.0, 1.0, 1.0)]],
        outer=[[box(0.0, 0.0, 4.0)]],
        hole=[[box(1.0, 1.0, 1.0)]],
        parts=[[box(0.0, 0.0, 4.0)], [box(10.0, 1.0, 1.0)]],
        across=[[[(179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0), (179.0, 0.0)]]],
        inside=[[box(10.0, 0.0, 2.0)]],
        cap=[[cap]],
    )
    area = measured(frame, geo.area_m2(F.col("geometry")))
    assert area["octant"] == pytest.approx(4 * math.pi * R * R / 8, rel=1e-12)
    assert area["reverse"] == pytest.approx(area["octant"], rel=1e-12)
    assert area["holed"] == pytest.approx(area["outer"] - area["hole"], rel=1e-12)
    assert area["parts"] == pytest.approx(area["outer"] + area["hole"], rel=1e-12)
    assert area["across"] == pytest.approx(area["inside"], rel=1e-12)
    assert area["cap"] == pytest.approx(2 * math.pi * R * R * (1 - math.sin(math.radians(60))), rel=2e-3)


def test_centroid(shapes):
    frame = shapes(
        square=[[box(10.0, 20.0, 2.0)]],
        clockwise=[[box(10.0, 20.0, 2.0)[::-1]]],
        holed=[[box(0.0, 0.0, 4.0), box(2.0, 1.0, 1.0)]],
        parts=[[box(0.0, 0.0, 2.0)], [box(10.0, 0.0, 1.0)]],
        line=[[[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]],
        triangle=[[[(0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (0.0, 0.0)]]],
    )
    centre = measured(frame, geo.centroid(F.col("geometry")))
    assert tuple(centre["square"]) == pytest.approx((11.0, 21.0))
    assert tuple(centre["clockwise"]) == pytest.approx((11.0, 21.0))
    assert tuple(centre["holed"]) == pytest.approx(((16 * 2 - 2.5) / 15, (16 * 2 - 1.5) / 15))
    assert tuple(centre["parts"]) == pytest.approx(((4 * 1 + 10.5) / 5, (4 * 1 + 0.5) / 5))
    assert tuple(centre["line"]) == (None, None)
    assert tuple(centre["triangle"]) == pytest.approx((1.0, 1.0))


def test_quality(shapes):
    square = box(0.0, 0.0, 1.0)
    frame = shapes(
        good=[[square]],
        open=[[square[:4]]],
        short=[[square[:3]]],
        outside=[[[(0.0, 95.0), *square[1:4], (0.0, 95.0)]]],
        missing=[[[*square[:2], (0.0, None), *square[3:]]]],
        null=None,
        empty=[],
        second=[[square], [square[:3]]],
    )
    problems = {r["mpa_id"]: r["problem"] for r in geometry.ring_quality(frame).collect()}
    assert problems == {
        "good": None,
        "open": "not closed",
        "short": "too few points",
        "outside": "coordinate out of range",
        "missing": "missing coordinate",
        "null": "no ring",
        "empty": "no ring",
        "second": "too few points",
    }
    assert geometry.usable(frame).count() + geometry.quarantined(frame).count() == frame.count()
    assert geometry.polygon_area(frame).count() == 1


def side(a, b, p):
    s = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    return (s > 0) - (s < 0)


def on(a, b, p):
    return side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def plain_problem(rings):
    """By comparing all pairs of edges in fractions; corners are whole thousandths here."""
    exact = [[(Fraction(round(x * 1000)), Fraction(round(y * 1000))) for x, y in r] for r in rings]
    exact = [[p for i, p in enumerate(r) if i == 0 or p != r[i - 1]] for r in exact]
    edges = [(r, i, len(c) - 1, c[i], c[i + 1]) for r, c in enumerate(exact) for i in range(len(c) - 1)]
    crossed = False
    for (r, i, n, a, b), (s, j, _, c, d) in itertools.combinations(edges, 2):
        proper = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
        if r != s:
            crossed |= proper
        elif abs(i - j) in (1, n - 1):
            v, p, q = (b, a, d) if b == c else (a, b, c)
            if side(v, p, q) == 0 and (p[0] - v[0]) * (q[0] - v[0]) + (p[1] - v[1]) * (q[1] - v[1]) > 0:
                return validity.CROSSES
        elif proper or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
            return validity.CROSSES
    shell = [(a, b) for r, _, _, a, b in edges if r == 0]
    for p in (a for r, _, _, a, _ in edges if r):
        rays = sum((a[1] > p[1]) != (b[1] > p[1]) and side(a, b, p) == (1 if b[1] > a[1] else -1) for a, b in shell)
        crossed |= rays % 2 == 0 and not any(on(a, b, p) for a, b in shell)
    return validity.OUTSIDE if crossed else None


def random_polygons(n):
    """Wavy rings with long and tiny edges, some with a pushed corner, a spike, a repeated point, holes inside, outside, across or touching."""
    draw = random.Random(11)
    found = []
    for k in range(n):
        corners = draw.choice([3, 5, 8, 30, 60])
        angles = sorted(draw.sample(range(3600), corners))
        radius = lambda: draw.choice([10, 10, 9, 8])
        shell = [(round(r * math.cos(t / 1800 * math.pi), 3), round(r * math.sin(t / 1800 * math.pi), 3)) for t in angles for r in [radius()]]
        kind = draw.randrange(6)
        if kind == 1:
            shell[draw.randrange(corners)] = (round(draw.uniform(-12, 12), 3), round(draw.uniform(-12, 12), 3))
        if kind == 2:
            i = draw.randrange(corners)
            shell[i:i] = [shell[i]]
        if kind == 3:
            i = draw.randrange(corners)
            shell[i + 1 : i + 1] = [(15.0, 15.0), shell[i]]
        rings = [[*shell, shell[0]]]
        for _ in range(draw.choice([0, 1, 2])):
            x, y, w = round(draw.uniform(-9, 9), 3), round(draw.uniform(-9, 9), 3), draw.choice([0.5, 2.0])
            rings.append(box(x, y, w) if draw.random() < 0.8 else [(x, y), shell[0], (x, y + w), (x, y)])
        found.append(rings)
    return found


@pytest.mark.parametrize("small", [0, 1000])
def test_crossings_against_all_pairs(spark, small):
    """In the row and through the grid."""
    rows = random_polygons(250)
    frame = spark.createDataFrame([(i, [r]) for i, r in enumerate(rows)], f"mpa_id int, geometry {geo.GEOMETRY}")
    got = {r["mpa_id"]: r["problem"] for r in validity.checked(frame, "mpa_id", small=small).collect()}
    want = {i: plain_problem(r) for i, r in enumerate(rows)}
    assert got == want
    assert min(list(want.values()).count(x) for x in (None, validity.CROSSES, validity.OUTSIDE)) > 20


@pytest.mark.parametrize("small", [0, 16])
def test_shapes_by_name(shapes, small):
    across = [(179.0, 0.0), (-179.0, 0.0), (-179.0, 2.0), (179.0, 2.0), (179.0, 0.0)]
    tie = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    cap = [(float((lon + 180) % 360 - 180), 60.0) for lon in range(0, 360, 10)] + [(0.0, 60.0)]
    frame = shapes(
        good=[[box(0.0, 0.0, 4.0), box(1.0, 1.0, 1.0)]],
        touching=[[box(0.0, 0.0, 4.0), [(0.0, 2.0), (1.0, 1.0), (1.0, 3.0), (0.0, 2.0)]]],
        tie=[[tie]],
        second=[[box(5.0, 5.0, 1.0)], [tie]],
        across=[[across]],
        across_tie=[[[across[0], across[2], across[1], across[3], across[0]]]],
        across_hole=[[across, [(-179.8, 0.5), (-179.5, 0.5), (-179.5, 1.0), (-179.8, 0.5)]]],
        across_outside=[[across, box(0.0, 0.5, 0.2)]],
        spike=[[[(0.0, 0.0), (2.0, 0.0), (5.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]]],
        corner_on_edge=[[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]],
        hole_below=[[box(0.0, 0.0, 1.0), box(0.0, -2.0, 0.5)]],
        hole_across=[[box(0.0, 0.0, 2.0), box(1.0, 1.0, 2.0)]],
        pole=[[cap]],
        short=[[tie[:3]]],
        nothing=None,
    )
    got = {r["mpa_id"]: r["problem"] for r in validity.checked(frame, "mpa_id", small=small).collect()}
    crossed, outside = validity.CROSSES, validity.OUTSIDE
    assert got == {
        "good": None, "touching": None, "tie": crossed, "second": crossed, "across": None, "across_tie": crossed, "across_hole": None,
        "across_outside": outside, "spike": crossed, "corner_on_edge": crossed, "hole_below": outside, "hole_across": outside,
        "pole": None, "short": "too few points", "nothing": "no ring",
    }


@pytest.mark.parametrize("small", [0, 16])
def test_equal_geometries_are_judged_alone(spark, small):
    """Two and three areas with the same holed polygon: the hole of each lies in its own shell."""
    inside, outside = [[box(0.0, 0.0, 4.0), box(1.0, 1.0, 1.0)]], [[box(0.0, 0.0, 1.0), box(0.0, -2.0, 0.5)]]
    kinds = [inside, inside, outside, outside, outside, [*inside, *inside], [*inside, *inside]]
    frame = spark.createDataFrame(list(enumerate(kinds)), f"mpa_id int, geometry {geo.GEOMETRY}")
    good = [0, 1, 5, 6]
    got = {r["mpa_id"]: r["problem"] for r in validity.checked(frame, "mpa_id", small=small).collect()}
    assert got == {i: None if i in good else validity.OUTSIDE for i in range(len(kinds))}
    assert sorted(r["mpa_id"] for r in geometry.polygon_area(frame).collect()) == good
    assert sorted(r["mpa_id"] for r in geometry.polygon_centroid(frame).collect()) == good


def test_measures_are_computed_once(shapes):
    """A filter on the centroid reads the stored one: the plan has no polygon expression left."""
    points = geometry.polygon_centroid(shapes(a=[[box(0.0, 0.0, 2.0)]], b=[[box(10.0, 0.0, 1.0)]])).where("X BETWEEN 0 AND 5 AND Y > 0")
    assert [tuple(r) for r in points.collect()] == [("a", 1.0, 1.0)]
    assert "zip_with" not in points._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_not_compared_with_all_others(spark):
    """A ring of 20,000 corners, half of them within a thousandth of its size: pairs that meet grow with the edges, not their square."""
    n = 20_000
    fine = [(10 + 1e-3 * math.cos(2 * math.pi * i / n), 10 + 1e-3 * math.sin(2 * math.pi * i / n)) for i in range(n // 2)]
    wide = [(10 + 5 * math.cos(2 * math.pi * i / n), 10 + 5 * math.sin(2 * math.pi * i / n)) for i in range(n // 2, n)]
    ring = [*fine, *wide, fine[0]]
    frame = spark.createDataFrame([(1, [[ring]]), (2, [[[*ring[:5000], ring[2], *ring[5000:]]]])], f"mpa_id int, geometry {geo.GEOMETRY}")
    assert {r["mpa_id"]: r["problem"] for r in geometry.ring_quality(frame).select("mpa_id", "problem").collect()} == {1: None, 2: validity.CROSSES}
    pairs = [r for r in validity.shape_problems(frame, 0)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Cartesian" in r]
    assert not pairs
