"""Statistics of a text as Spark expressions, for the quality operators.

Each takes the words as an array, so that a text is split once.  Nothing here
compares all words with all words: repeats are found by sorting or by sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from planlens.llm.common import WORD

SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_with_a_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words inside windows of three words that occur twice or more; windows are compared by a 64-bit digest.

    The windows are sorted by digest, those with an equal neighbour kept, and
    each start counts up to the next one, three words at most.
    """

    def covered(windows: Column) -> Column:
        repeated = F.filter(
            windows,
            lambda x, i: (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]),
        )
        starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
    )
    return F.when(F.size(w) >= 4, let(windows, covered)).otherwise(F.lit(0).cast("long"))
