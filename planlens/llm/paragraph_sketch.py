"""Document fingerprints as invertible Bloom lookup sketches, by Spark expressions only.

A text is cut into paragraphs: its lines, long ones in runs of PIECE characters
from the line's start.  A paragraph's digest falls into one cell of each of
three parts; a cell holds the number of its paragraphs, the sum of their digests
and the sum of check values.  Two sketches are subtracted cell by cell, so what
both versions share cancels.  A cell whose numbers are those of one digest is
peeled: the digest is taken out of its three cells, which may leave others with
one digest.  If cells stay that hold several, the sketch was too small and a
larger one is tried; beyond the largest the digests are compared directly.

Cells are a sorted array of those that aren't empty, so work grows with the
paragraphs and not with the size of the sketch.  Counts make repeated
paragraphs exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.llm.common import whole_text
from planlens.llm.text_stats import let

#: Characters of a line that make a paragraph at most.
PIECE = 128
#: Cells in each of the three parts: of the fingerprint, and of the largest sketch (its places take PLACE bits).
SMALL, LARGEST = 8, 8192
ROUNDS = 16
#: Bits of a digest, of its place in each part and of its check value; sums of 2^23 paragraphs fit a long.
DIGEST, PLACE, CHECK = 40, 13, 20
#: Documents in one sorted group at least, and number of groups at most.
GROUP, GROUPS = 512, 1 << 17
CELLS = "array<struct<i:bigint,c:bigint,k:bigint,h:bigint>>"


def digests(text: Column, piece: int = PIECE) -> Column:
    """One number a paragraph, in order; the paragraphs with their line ends make up the whole text."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{piece}}}\\n?|\\n"), F.lit(0))
    return F.transform(pieces, lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << DIGEST) - 1)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << CHECK) - 1))


def _place(digest: Column, part: int, size: Column) -> Column:
    return F.shiftright(digest, PLACE * part).bitwiseAND(size - 1) + size * part


def _added(cells: Column) -> Column:
    """Cells in order with the sums of those that have the same place; empty ones go."""
    total = lambda group, name: F.aggregate(group, F.lit(0).cast("long"), lambda a, x: a + x[name])

    def sums(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda p: (p == 0) | (F.get(s, p)["i"] != F.get(s, p - 1)["i"]))
        groups = let(
            heads,
            lambda at: F.transform(
                at,
                lambda p, j: let(
                    F.slice(s, p + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - p),
                    lambda g: F.when(F.size(g) == 1, F.get(g, F.lit(0))).otherwise(
                        F.struct(
                            F.get(g, F.lit(0))["i"].alias("i"),
                            total(g, "c").alias("c"),
                            total(g, "k").alias("k"),
                            total(g, "h").alias("h"),
                        )
                    ),
                ),
            ),
        )
        return F.filter(groups, lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))

    return let(F.array_sort(cells), lambda s: F.when(F.size(s) == 0, s).otherwise(sums(s)))


def _cells(counted: Column, size: Column) -> Column:
    """Three cells for each (digest, times)."""
    return F.flatten(
        F.transform(
            counted,
            lambda x: F.array(
                *[
                    F.struct(
                        _place(x["d"], part, size).alias("i"),
                        x["n"].alias("c"),
                        (x["n"] * x["d"]).alias("k"),
                        (x["n"] * _check(x["d"])).alias("h"),
                    )
                    for part in range(3)
                ]
            ),
        )
    ).cast(CELLS)


def _times(found: Column, n: int) -> Column:
    return F.transform(found, lambda d: F.struct(d.alias("d"), F.lit(n).cast("long").alias("n")))


def sketch(found: Column, size: Column) -> Column:
    """The cells of digests ``found``."""
    return _added(_cells(_times(found, 1), size))


def subtract(one: Column, other: Column) -> Column:
    negative = F.transform(
        other, lambda x: F.struct(x["i"].alias("i"), (-x["c"]).alias("c"), (-x["k"]).alias("k"), (-x["h"]).alias("h"))
    )
    return _added(F.concat(one, negative.cast(CELLS)))


def peel(difference: Column, size: Column) -> Column:
    """The digests that differ as (d, n), n their surplus in the first sketch; NULL if the sketch is too small."""
    empty = "cast(array() as array<struct<d:bigint,n:bigint>>)"

    def pure(cells: Column) -> Column:
        candidates = F.filter(
            F.transform(
                F.filter(cells, lambda x: (x["c"] != 0) & (x["k"] % F.when(x["c"] != 0, x["c"]).otherwise(1) == 0)),
                lambda x: F.struct(x.alias("x"), F.call_function("div", x["k"], x["c"]).alias("d")),
            ),
            lambda y: (y["d"] >= 0) & (y["x"]["h"] == y["x"]["c"] * _check(y["d"])) & (
                y["x"]["i"]
                == F.when(y["x"]["i"] < size, _place(y["d"], 0, size))
                .when(y["x"]["i"] < 2 * size, _place(y["d"], 1, size))
                .otherwise(_place(y["d"], 2, size))
            ),
        )
        return F.array_distinct(F.transform(candidates, lambda y: F.struct(y["d"].alias("d"), y["x"]["c"].alias("n"))))

    def step(state: Column, _: Column) -> Column:
        def apply(out: Column) -> Column:
            gone = F.transform(out, lambda p: F.struct(p["d"].alias("d"), (-p["n"]).alias("n")))
            return F.when(F.size(out) == 0, state).otherwise(
                F.struct(
                    _added(F.concat(state["cells"], _cells(gone, size))).alias("cells"),
                    F.concat(state["out"], out).alias("out"),
                )
            )

        return F.when(F.size(state["cells"]) == 0, state).otherwise(let(pure(state["cells"]), apply))

    start = F.struct(difference.alias("cells"), F.expr(empty).alias("out"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(end, lambda e: F.when(F.size(e["cells"]) == 0, e["out"]))


def differing(one: Column, other: Column, small_one: Column, small_other: Column) -> Column:
    """The digests that differ between two arrays of digests, as (d, n); the small sketches are theirs of size SMALL.

    The small sketches are tried if their difference leaves a cell empty, which
    one that can be peeled does; then a sketch with more cells than both texts
    have paragraphs, one of four times that size, and the digests themselves.
    """
    small = F.lit(SMALL).cast("long")
    wanted = F.log2(F.greatest(F.size(one) + F.size(other), F.lit(6)) / 2.0)
    enough = F.least(F.pow(F.lit(2.0), F.ceil(wanted)), F.lit(LARGEST)).cast("long")
    first = let(subtract(small_one, small_other), lambda d: F.when(F.size(d) < 3 * SMALL, peel(d, small)))

    def at(size: Column) -> Column:
        return let(size, lambda n: peel(subtract(sketch(one, n), sketch(other, n)), n))

    plain = F.concat(
        F.transform(one, lambda d: F.struct(d.alias("i"), F.lit(1).alias("c"), F.lit(0).alias("k"), F.lit(0).alias("h"))),
        F.transform(other, lambda d: F.struct(d.alias("i"), F.lit(-1).alias("c"), F.lit(0).alias("k"), F.lit(0).alias("h"))),
    ).cast(CELLS)
    exact = F.transform(_added(plain), lambda x: F.struct(x["i"].alias("d"), x["c"].alias("n")))
    return F.coalesce(first, at(enough), at(F.least(4 * enough, F.lit(LARGEST).cast("long"))), exact)


def likeness(one: Column, other: Column, small_one: Column, small_other: Column) -> Column:
    """Share of the paragraphs of both texts that they have in common, 0 to 1; two texts without any are alike."""
    both = F.size(one) + F.size(other)
    apart = F.aggregate(differing(one, other, small_one, small_other), F.lit(0).cast("long"), lambda a, x: a + F.abs(x["n"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(1.0 - apart / both)


def small_sketch(found: Column) -> Column:
    return sketch(found, F.lit(SMALL).cast("long"))


def fingerprint(small: Column) -> Column:
    """The small sketch as text: place, count, digest sum and check sum of each cell in use."""
    parts = F.transform(
        small, lambda x: F.concat_ws(":", F.hex(x["i"]), x["c"].cast("string"), F.hex(x["k"]), F.hex(x["h"]))
    )
    return F.array_join(parts, ",")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text for rows of ``docs``, by ascending doc_id (missing first, ties by text); the last is followed by the first.

    Ids are cut into at most GROUPS equal ranges, which are sorted each for
    itself; the first document of a range goes to the range before as well.
    The table of ranges is bounded, so it is broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = max(GROUP, (high - low) // GROUPS + 1)
    group = F.coalesce(F.floor((F.col("doc_id").cast("double") - float(low)) / width), F.lit(-1)).cast("long")
    rows = rows.withColumn("_at", group)
    firsts = rows.groupBy("_at").agg(F.min("doc_id").alias("_first"))
    order, all_rows = Window.orderBy("_at"), Window.partitionBy()
    ranges = firsts.withColumn("_before", F.coalesce(F.lag("_at").over(order), F.max("_at").over(all_rows)))
    known = rows.join(F.broadcast(ranges), "_at")
    here = F.struct(F.col("_at").alias("at"), F.lit(False).alias("extra"))
    before = F.struct(F.col("_before").alias("at"), F.lit(True).alias("extra"))
    heads = F.col("doc_id").eqNullSafe(F.col("_first"))
    placed = known.select("doc_id", "text", F.explode(F.when(heads, F.array(here, before)).otherwise(F.array(here))).alias("_p"))
    placed = placed.select("doc_id", "text", F.col("_p.at").alias("_at"), F.col("_p.extra").alias("_extra"))
    along = Window.partitionBy("_at").orderBy("_extra", F.col("doc_id").asc_nulls_first(), "text")
    return placed.withColumn("next_text", F.lead("text").over(along)).where("not _extra").select("doc_id", "text", "next_text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edited text has its last quarter replaced by the start of the next
    document.  Missing texts are empty; a single row is its own next; repeated
    rows are rows of their own; other columns are ignored; an empty table gives
    an empty one.
    """
    rows = with_next(docs)
    quarter = F.expr("length(text) div 4").cast("int")
    rows = rows.withColumns(
        {
            "edited": F.concat(
                F.substr("text", F.lit(1), F.length("text") - quarter), F.substr("next_text", F.lit(1), quarter)
            ),
            "n_chars": F.length("text").cast("long"),
        }
    )
    own = F.col("_own")
    rows = rows.withColumns({"_own": digests(F.col("text")), "_edited": digests(F.col("edited")), "_next": digests(F.col("next_text"))})
    rows = rows.withColumns({f"{c}_small": small_sketch(F.col(c)) for c in ("_own", "_edited", "_next")})
    near = lambda c: likeness(own, F.col(c), F.col("_own_small"), F.col(f"{c}_small"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("_own_small")).alias("fingerprint"),
        fingerprint(F.col("_edited_small")).alias("edited_fingerprint"),
        near("_edited").alias("near_edited"),
        near("_next").alias("near_next"),
    )
