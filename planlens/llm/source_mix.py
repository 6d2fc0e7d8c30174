"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, shuffled, form one stream of words that repeats;
the mix takes the first ``target`` words of it in blocks of equal length.  All
blocks together are N slots.  Slot times follow the golden ratio: with g next
to N / phi and prime to N, the slot at time k has the point (k * g mod N) / N,
and the source whose part of the cumulative weights holds that point.  Every
point is hit once, so each source gets exactly its number of slots, evenly over
time.  The schedule is made per source from the inverse of g, so a source with
a third of all slots is spread over many tasks.

Everything is DataFrame operations.  The driver gets one row: the number of slots.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.llm.common import keyed, n_words, repeated, store, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block.
BLOCK = 1024
#: Slots of one source that one row stands for until it is spread, and slot times ranked together.
SPREAD, BAND = 4096, 1 << 16


def source_targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """source, idx, source_size, weight, target, take, first, slots: one row a source of ``sizes`` (source, size).

    Sources in code-point order, the missing one last, weigh 3, 1, 2,
    repeating, and share ``share`` of all words by weight.  A target stops at
    twice the source's size and the excess goes to the others by weight: in
    order of size per weight the level rises until the rest lies below it.
    A source without words has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = totals.withColumn("idx", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.get(weights, F.col("idx") % len(WEIGHTS)))
    rows = rows.withColumns({"cap": (MOST * F.col("source_size")).cast("double"), "ratio": MOST * F.col("source_size") / F.col("weight")})
    everything = Window.partitionBy()
    rising = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(share),
            "below": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("reached", (F.col("budget") - F.col("below")) / F.col("open"))
    # rises while sources stop at their cap and falls after the first that does not
    level = F.max("reached").over(everything)
    rows = rows.withColumn("target", F.least("cap", level * F.col("weight")))
    rows = rows.withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    rows = rows.withColumn("slots", F.ceil(F.col("take") / F.lit(BLOCK)).cast("long"))
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    return rows.select("source", "idx", "source_size", "weight", "target", "take", "first", "slots")


def golden_step(n: int, around: int = 64) -> int:
    """The number prime to ``n`` among those next to n / phi that spreads its multiples most evenly.

    The golden ratio's continued fraction is all ones; the largest term of the
    quotient's own tells how far it is from that.
    """
    if n < 3:
        return 1

    def largest_term(g: int) -> int:
        a, b, most = n, g, 0
        while b:
            most = max(most, a // b)
            a, b = b, a % b
        return most

    near = round(n * (5**0.5 - 1) / 2)
    prime = [g for d in range(around) for g in {near - d, near + d} if 0 < g < n and gcd(g, n) == 1]
    return min(prime, key=lambda g: (largest_term(g), abs(g - near), g))


def schedule(targets: DataFrame, n: int) -> DataFrame:
    """(idx, rank, slot): at time ``slot`` the mix takes block ``rank`` of source ``idx``; one row for each of n slots."""
    back = pow(golden_step(n), -1, n) if n > 1 else 0
    groups = targets.where("slots > 0").select(
        "idx", "first", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SPREAD})")).alias("_g")
    )
    spread = groups.repartition("idx", "_g").select(
        "idx",
        "first",
        F.explode(F.expr(f"sequence(_g * {SPREAD}, least(slots, (_g + 1) * {SPREAD}) - 1)")).alias("_j"),
    )
    point = (F.col("first") + F.col("_j")).cast("decimal(19,0)")
    time = (point * F.lit(back).cast("decimal(19,0)")) % F.lit(n).cast("decimal(19,0)")
    slots = spread.select("idx", time.cast("long").alias("slot")).withColumn("_band", F.expr(f"slot div {BAND}"))
    counts = slots.groupBy("idx", "_band").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("idx").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("idx", "_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("idx", "_band").orderBy("slot")
    ranked = slots.withColumn("_r", F.row_number().over(within) - 1).join(earlier, ["idx", "_band"])
    return ranked.select("idx", (F.col("_earlier") + F.col("_r")).alias("rank"), "slot")


def streams(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds idx, source_size, target, take and ``at``, the row's first word in its source's shuffled stream.

    The shuffle orders by a digest of doc_id; rows that repeat an id follow by
    size.  Offsets are added up per leading digits of the digest first, so a hot
    source is never one group.
    """
    small = targets.select(
        F.col("source").alias("_source"), "idx", "source_size", "target", "take"
    )
    keyed = rows.join(small, rows.source.eqNullSafe(small._source)).drop("_source")
    keyed = keyed.withColumn("_key", F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("_part", F.substring("_key", 1, 3))
    parts = keyed.groupBy("idx", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("idx").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select("idx", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy("idx", "_part").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(earlier, ["idx", "_part"])
    return placed.withColumn("at", F.col("_earlier") + F.col("_within")).drop("_key", "_part", "_within", "_earlier")


def pieces(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """(idx, at, size, epoch, slot, words): the words of each document that each slot takes."""
    epochs = placed.where("size > 0").select(
        "idx", "at", "size", "take", F.explode(F.array(*[F.lit(e) for e in range(MOST)])).alias("epoch"),
        "source_size",
    )
    ranged = epochs.withColumn("_from", F.col("at") + F.col("epoch") * F.col("source_size"))
    ranged = ranged.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("take"))).where("_from < _to")
    cut = ranged.select(
        "idx", "at", "size", "epoch", "_from", "_to",
        F.explode(F.expr(f"sequence(_from div {BLOCK}, (_to - 1) div {BLOCK})")).alias("rank"),
    )
    words = F.least("_to", (F.col("rank") + 1) * BLOCK) - F.greatest("_from", F.col("rank") * BLOCK)
    # both sides grow with the corpus, so neither is sent to all tasks whatever its compressed size suggests
    return cut.join(slots.hint("merge"), ["idx", "rank"]).select("idx", "at", "size", "epoch", "slot", words.alias("words"))


def _mixed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size and what else is carried) with their place in the stream, what the mix takes and when.

    For each pass through the stream: the words taken, and the first slot of the
    schedule that takes any, missing where none does.
    """
    sizes = store(rows, "sizes")
    targets = store(source_targets(sizes), "targets")
    n = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    placed = store(streams(sizes, targets), "placed")
    taken = pieces(placed, schedule(targets, n)).groupBy("idx", "at").agg(
        *[F.sum(F.when(F.col("epoch") == e, F.col("words")).otherwise(0)).alias(f"taken{e}") for e in range(MOST)],
        *[F.min(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"slot{e}") for e in range(MOST)],
    )
    some, none = placed.where("size > 0"), placed.where("size = 0")
    zero: dict[str, Column] = {f"taken{e}": F.lit(0).cast("long") for e in range(MOST)}
    never = {f"slot{e}": F.lit(None).cast("long") for e in range(MOST)}
    got = some.join(taken.hint("merge"), ["idx", "at"], "left").fillna(0, list(zero))
    return got.unionByName(none.withColumns(zero | never))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, second_slot for every row of ``docs`` (doc_id, source, text).

    ``first_slot`` and ``second_slot`` are the times of the schedule at which
    the mix begins to take the document, in the first and the second pass.  Other columns are ignored.

    A missing text has size 0 and is never taken; a missing source is a source
    of its own, the last; repeated rows are rows of their own; an empty table
    gives an empty one.  A document is taken at most twice.
    """
    rows = docs.select("doc_id", "source", n_words(whole_text(F.col("text"))).alias("size"))
    taken = sum((F.col(f"taken{e}") for e in range(1, MOST)), F.col("taken0"))
    slots = [F.col("slot0").alias("first_slot"), F.col("slot1").alias("second_slot")]
    return _mixed(rows).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *slots)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them: not, once or twice.

    A document that the end of its source's share cuts counts if at least half
    of it is inside.
    """
    row = F.col("_row")
    size = n_words(whole_text(row["text"])).alias("size")
    rows = keyed(docs).select("_h1", "_h2", row["doc_id"].alias("doc_id"), row["source"].alias("source"), size)
    copies = sum(((2 * F.col(f"taken{e}") >= F.col("size")).cast("int") for e in range(MOST)), F.lit(0))
    taken = _mixed(rows).where("size > 0").groupBy("_h1", "_h2").agg(F.sum(copies).alias("_n"))
    return repeated(docs, taken)
