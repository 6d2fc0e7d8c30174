"""Polygons whose rings cross themselves, and holes outside their shell.

Corners are taken in billionths of a degree, as whole numbers, so that the side
of a line on which a point lies is decided exactly.  Longitudes are unrolled
along a ring, the short way across the antimeridian; a ring that winds round a
pole is tested along its unrolled course.

Pairs of edges of small polygons are formed where they are read.  The edges of larger ones go to
the cells of a grid whose size fits their length, so an edge lies in four
cells at most, and look up longer edges in the coarser grids that their
polygon has.  Only edges that share a cell are compared, and the edges of one
polygon, however many, are dealt out over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planlens.functions.geo import geometry_problem
from planlens.session import materialise

CROSSES, OUTSIDE = "crosses itself", "hole outside its shell"
#: The same as numbers, the first reason first; 0 is none.
_REASONS = [CROSSES, OUTSIDE]
UNITS = 1e9
#: Polygons with so many edges at most are tested without a join.
SMALL = 16
_POLYGON = ["_row", "_polygon"]


def _turns(ring: Column) -> Column:
    """(i, turn) of the points that lie across the antimeridian from the one before."""
    step = lambda p, i: p["lon"] - F.get(ring, i - 1)["lon"]
    turn = lambda p, i: F.when(step(p, i) > 180, -1).when(step(p, i) < -180, 1).otherwise(0)
    return F.filter(F.transform(ring, lambda p, i: F.struct(i.alias("i"), turn(p, i).alias("turn"))), lambda t: t["turn"] != 0)


def unrolled(ring: Column) -> Column:
    """Corners ``struct<x,y>`` in whole units along a ring, without repetitions one after another."""
    whole = lambda degrees: F.rint(degrees * UNITS).cast("bigint")

    def point(p: Column, i: Column, turns: Column) -> Column:
        rounds = F.aggregate(F.filter(turns, lambda t: t["i"] <= i), F.lit(0), lambda n, t: n + t["turn"])
        return F.struct(whole(p["lon"] + 360.0 * rounds).alias("x"), whole(p["lat"]).alias("y"))

    corners = _with(_turns(ring), lambda turns: F.transform(ring, lambda p, i: point(p, i, turns)))
    return _with(corners, lambda c: F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1))))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edges(corners: Column, ring: Column, shift: Column) -> Column:
    """Edges of a ring: ring, at, n (edges of the ring), x1, y1, x2, y2; x moved by ``shift``."""
    n = F.greatest(F.size(corners) - 1, F.lit(0))
    return F.transform(
        F.slice(corners, F.lit(1), n),
        lambda p, i: F.struct(
            ring.alias("ring"),
            i.alias("at"),
            n.alias("n"),
            (p["x"] + shift).alias("x1"),
            p["y"].alias("y1"),
            (F.get(corners, i + 1)["x"] + shift).alias("x2"),
            F.get(corners, i + 1)["y"].alias("y2"),
        ),
    )


def laid_out(geometry: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of each geometry, ``_rings``, why its rings are not usable, ``_shapes``, its polygons' edges, and ``_row``, its number.

    Stored, so that geometries are read and measured once, whatever follows, and
    equal ones keep numbers of their own.  ``columns`` may use ``_rings``.
    Generators instead of projections, which the optimizer would fold into later
    filters and with it compute the columns again for every mention.
    """
    judged = geometry.select("*", F.explode(F.array(geometry_problem(F.col("geometry")))).alias("_rings"))
    shapes = F.transform(F.when(F.col("_rings").isNull(), F.col("geometry")), _laid_polygon)
    every = [F.col(f"`{c}`") for c in geometry.columns]
    chosen = [x for c in columns for x in (every if isinstance(c, str) and c == "*" else [c])]
    rows = judged.select(F.inline(F.array(F.struct(*chosen, "_rings", shapes.alias("_shapes")))))
    return materialise(rows.withColumn("_row", F.monotonically_increasing_id()))


def _laid_polygon(rings: Column) -> Column:
    """``edges`` of all rings of a polygon, and ``closed``: does the shell's unrolled course end where it began?

    Holes are moved by whole turns next to the middle of the shell.  A shell
    that does not close winds round a pole.
    """
    turn = 360 * UNITS
    shift = lambda corners, m: (F.round((m - F.get(corners, F.lit(0))["x"]) / turn) * turn).cast("bigint")

    def made(rings: Column) -> Column:
        def laid(shell: Column) -> Column:
            middle = (F.array_min(F.transform(shell, lambda p: p["x"])) + F.array_max(F.transform(shell, lambda p: p["x"]))) / 2
            edges = _with(middle, lambda m: F.transform(rings, lambda c, i: _edges(c, i, F.when(i == 0, F.lit(0)).otherwise(shift(c, m)))))
            closed = F.get(shell, F.lit(0)) == F.get(shell, F.size(shell) - 1)
            return F.struct(F.flatten(edges).alias("edges"), closed.alias("closed"))

        return _with(F.get(rings, F.lit(0)), laid)

    return _with(F.transform(rings, unrolled), made)


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """1, 0, -1: the point lies left of, on or right of the line from a to b.

    Doubles decide where their rounding can't matter, as of products that are both zero, whole numbers of 38 digits where it can.
    """
    def products(kind: str) -> tuple[str, str]:
        one, other = f"CAST({bx} - {ax} AS {kind}) * CAST({py} - {ay} AS {kind})", f"CAST({by} - {ay} AS {kind}) * CAST({px} - {ax} AS {kind})"
        return one, other

    one, other = products("double")
    exact, less = products("decimal(15,0)")
    sure = f"abs(({one}) - ({other})) >= 1e-15D * (abs({one}) + abs({other}))"
    return f"CAST(CASE WHEN {sure} THEN signum(({one}) - ({other})) ELSE signum(({exact}) - ({less})) END AS int)"


#: The ranges of two edges ``_a`` and ``_b`` meet.
_MEET = " AND ".join(
    f"greatest(_a.{c}1, _a.{c}2) >= least(_b.{c}1, _b.{c}2) AND greatest(_b.{c}1, _b.{c}2) >= least(_a.{c}1, _a.{c}2)" for c in "xy"
)
_CORNERS = [f"{c}{k}" for c in "xy" for k in (1, 2)]
_AT_CORNER = ["_e.ring AS _ring", "_e.at AS _corner", "_e.x1 AS _x", "_e.y1 AS _y"]


def _pair_problem(pairs: DataFrame) -> DataFrame:
    """What is wrong with two edges ``_a`` and ``_b`` of a polygon, a before b: ``_wrong`` 1, 2, or 0 if nothing is.

    Edges of one ring share no point but the corner of neighbours, which do not
    fold back; edges of different rings may touch but not cross.
    """
    kind = "CASE WHEN _a.ring <> _b.ring THEN 2 WHEN abs(_a.at - _b.at) IN (1, _a.n - 1) THEN 0 ELSE 1 END AS _kind"
    flat = pairs.selectExpr("_row", kind, *[f"_{e}.{c} AS {e}{c}" for e in "ab" for c in _CORNERS])
    ends = [("ax1", "ay1", "ax2", "ay2", p, q) for p, q in (("bx1", "by1"), ("bx2", "by2"))]
    ends += [("bx1", "by1", "bx2", "by2", p, q) for p, q in (("ax1", "ay1"), ("ax2", "ay2"))]
    sides = flat.selectExpr("*", "bx1 = ax2 AND by1 = ay2 AS _next", *[f"{_side(*e)} AS _o{k}" for k, e in enumerate(ends)])
    # of neighbours: the way from the shared corner to the other end of each
    away = [f"sign(IF(_next, a{c}1 - a{c}2, a{c}2 - a{c}1)) = sign(IF(_next, b{c}2 - b{c}1, b{c}1 - b{c}2))" for c in "xy"]
    fold = f"IF(_next, _o1, _o0) = 0 AND {' AND '.join(away)}"
    wrong = f"""CASE _kind WHEN 0 THEN CAST({fold} AS int) WHEN 1 THEN CAST(_o0 * _o1 <= 0 AND _o2 * _o3 <= 0 AS int)
        ELSE 2 * CAST(_o0 * _o1 < 0 AND _o2 * _o3 < 0 AS int) END AS _wrong"""
    return sides.selectExpr("_row", wrong)


#: Does the ray from a corner ``_x, _y`` to the east cross the edge ``_s``, and does the corner lie on it?  ``_side`` is the corner's.
_RAY = "(_s.y1 > _y) <> (_s.y2 > _y) AND _side = IF(_s.y2 > _s.y1, 1, -1)"
_ON = "_side = 0 AND _x BETWEEN least(_s.x1, _s.x2) AND greatest(_s.x1, _s.x2) AND _y BETWEEN least(_s.y1, _s.y2) AND greatest(_s.y1, _s.y2)"
_HOLE_CORNER = ["_ring", "_corner", "_x", "_y"]


def _holes_outside(looked: DataFrame) -> DataFrame:
    """``_wrong`` of hole corners beside the shell's edges ``_s`` that lie at their height, if any: 2 where a corner is outside."""
    sided = looked.selectExpr(*_POLYGON, *_HOLE_CORNER, "_s", f"{_side('_s.x1', '_s.y1', '_s.x2', '_s.y2', '_x', '_y')} AS _side")
    per_corner = sided.groupBy(*_POLYGON, "_ring", "_corner").agg(F.count_if(F.expr(_RAY)).alias("_n"), F.count_if(F.expr(_ON)).alias("_on"))
    return per_corner.selectExpr("_row", "2 * CAST(_n % 2 = 0 AND _on = 0 AS int) AS _wrong")


def _small(found: DataFrame) -> DataFrame:
    """Problems of polygons with few edges: their pairs are rows of the task that reads the polygon."""
    first = found.select("_row", "_edges", F.posexplode("_edges").alias("_at", "_a"))
    pairs = first.select("_row", "_a", F.explode(F.slice("_edges", F.col("_at") + 2, F.size("_edges"))).alias("_b"))
    shell, holes = F.filter("_edges", lambda e: e["ring"] == 0), F.filter("_edges", lambda e: e["ring"] > 0)
    corners = found.where("_closed").select(*_POLYGON, shell.alias("_shell"), F.explode(holes).alias("_e"))
    looked = corners.selectExpr(*_POLYGON, *_AT_CORNER, "explode(_shell) AS _s")
    return _pair_problem(pairs.where(_MEET)).unionByName(_holes_outside(looked))


def _bits(value: Column) -> Column:
    """A power of two above the value, as its exponent."""
    return F.length(F.bin(value))


def _large(found: DataFrame) -> DataFrame:
    """Problems of polygons with many edges: pairs that share a cell, and holes' corners against the shell's edges of their height."""
    e = F.col("_e")
    size = lambda x: _bits(F.greatest(F.abs(x["x2"] - x["x1"]), F.abs(x["y2"] - x["y1"])))
    height = lambda x: _bits(F.abs(x["y2"] - x["y1"]))
    levels = F.array_distinct(F.transform("_edges", size))
    heights = F.array_distinct(F.transform(F.filter("_edges", lambda x: x["ring"] == 0), height))
    known = found.select(*_POLYGON, "_closed", levels.alias("_levels"), heights.alias("_heights"), "_edges")
    rows = known.select(*_POLYGON, "_closed", "_levels", "_heights", F.explode("_edges").alias("_e"))

    def cells(df: DataFrame, level: str) -> DataFrame:
        at = lambda pick, c: F.expr(f"shiftright({pick}(_e.{c}1, _e.{c}2), {level})")
        for c in ("x", "y"):
            df = df.withColumn(f"_c{c}", F.explode(F.sequence(at("least", c), at("greatest", c))))
        return df.select(*_POLYGON, F.col(level).alias("_level"), "_cx", "_cy", "_e")

    own = rows.withColumn("_own", size(e))
    residents = cells(own, "_own").withColumnRenamed("_e", "_b")
    coarser = own.withColumn("_at", F.explode(F.filter("_levels", lambda k: k >= F.col("_own"))))
    probes = cells(coarser, "_at").withColumnRenamed("_e", "_a")
    # of two edges of one level each looks up the other
    once = (size(F.col("_a")) < F.col("_level")) | F.expr("struct(_a.ring, _a.at) < struct(_b.ring, _b.at)")
    met = probes.join(residents, [*_POLYGON, "_level", "_cx", "_cy"]).where(once).where(_MEET)
    ordered = met.selectExpr("_row", "least(_a, _b) AS _a", "greatest(_a, _b) AS _b")

    shell = rows.where("_closed and _e.ring = 0").withColumn("_level", height(e))
    strips = shell.withColumn("_cy", F.explode(F.expr("sequence(shiftright(least(_e.y1, _e.y2), _level), shiftright(greatest(_e.y1, _e.y2), _level))")))
    strips = strips.select(*_POLYGON, "_level", "_cy", F.col("_e").alias("_s"))
    corners = rows.where("_closed and _e.ring > 0").selectExpr(*_POLYGON, *_AT_CORNER, "explode(_heights) AS _level")
    looked = corners.withColumn("_cy", F.expr("shiftright(_y, _level)")).join(strips, [*_POLYGON, "_level", "_cy"], "left")
    return _pair_problem(ordered).unionByName(_holes_outside(looked))


def _worst(stored: DataFrame, small: int) -> DataFrame:
    """``_row, _wrong`` of the rows of ``laid_out`` that cross themselves or have a hole outside."""
    found = stored.select("_row", F.posexplode("_shapes").alias("_polygon", "_shape"))
    found = found.select(*_POLYGON, F.col("_shape.edges").alias("_edges"), F.col("_shape.closed").alias("_closed"))
    few = F.size("_edges") <= small
    both = _small(found.where(few)).unionByName(_large(found.where(~few)))
    worst = both.groupBy("_row").agg(F.min(F.nullif("_wrong", F.lit(0))).alias("_wrong")).where("_wrong is not null")
    return worst.withColumn("_wrong", F.element_at(F.array(*map(F.lit, _REASONS)), F.col("_wrong")))


def shape_problems(geometry: DataFrame, small: int = SMALL) -> DataFrame:
    """Number and ``_wrong`` of the geometries with usable rings that cross themselves or have a hole outside."""
    return _worst(laid_out(geometry, F.lit(True).alias("_read")), small)


def checked(geometry: DataFrame, *columns: Column | str, small: int = SMALL) -> DataFrame:
    """``columns`` of each geometry, NULL where its rings are not usable, and ``problem``, NULL for a good geometry.

    Columns are computed where the polygons are read, which is once; only they
    and a number meet the problems.
    """
    stored = laid_out(geometry, *columns)
    wrong = _worst(stored, small).withColumnRenamed("_row", "_w")
    joined = stored.drop("_shapes").join(wrong, F.col("_row") == F.col("_w"), "left")
    return joined.withColumn("problem", F.coalesce("_rings", "_wrong")).drop("_rings", "_wrong", "_row", "_w")
