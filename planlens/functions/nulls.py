"""Column expressions for the NULL policies that live side by side in a review.

Each function states one policy, so that a reader of an operator sees which one
applies: three-valued flags, two-valued membership, strict and lenient sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, functions as F


def flag(condition: Column) -> Column:
    """1 if true, 0 if false, NULL if unknown (a boolean cast keeps NULL)."""
    return condition.cast("int")


def in_set(value: Column, members: Iterable, with_null: bool = False) -> Column:
    """Membership that is never NULL; ``with_null`` makes NULL itself a member."""
    hit = F.coalesce(value.isin(*members), F.lit(False))
    return hit | value.isNull() if with_null else hit


def not_in_set(value: Column, members: Iterable, with_null: bool = False) -> Column:
    """Negated membership; keeps NULL values unless NULL is a member."""
    return ~in_set(value, members, with_null)


def any_of(conditions: Iterable[Column]) -> Column:
    """Kleene OR: true beats NULL, NULL beats false."""
    return reduce(or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    """Kleene AND: false beats NULL, NULL beats true."""
    return reduce(and_, conditions)


def any_equal(columns: Iterable[str], value) -> Column:
    return any_of(F.col(c) == value for c in columns)


def any_nonzero(columns: Iterable[str]) -> Column:
    return any_of(F.col(c) != 0 for c in columns)


def all_nonzero(columns: Iterable[str]) -> Column:
    return all_of(F.col(c) != 0 for c in columns)


def row_total(columns: Iterable[str]) -> Column:
    """Sum across columns; one NULL makes the total NULL."""
    return reduce(add, (F.col(c) for c in columns))


def strict_sum(value: Column) -> Column:
    """Column sum that is NULL as soon as one row is NULL."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def lenient_sum(value: Column) -> Column:
    """Column sum that skips NULL; 0 where every row is NULL."""
    return F.coalesce(F.sum(value), F.lit(0))


def n_distinct(value: Column, na_rm: bool = True) -> Column:
    """Distinct values; with ``na_rm=False`` NULL counts as one more value."""
    count = F.count_distinct(value)
    if na_rm:
        return count
    return count + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))


def to_number(value: Column) -> Column:
    """Lenient text to number: text that is no number becomes NULL."""
    return value.try_cast("double")


#: What an answer can state, from the weakest to the strongest where a plan has several to one question.
STATUSES = ("missing", "other", "planned", "answered")


def answer_status(entry: Column) -> Column:
    """Place in ``STATUSES`` of a text answer: none, some other text, one that says it is planned, a number.

    The number that ``to_number`` makes of it is missing for the first three alike.
    """
    stated = F.lower(F.trim(entry)) == "planned"
    return F.when(to_number(entry).isNotNull(), 3).when(stated, 2).when(F.trim(entry) != "", 1).otherwise(0)


def cap(value: Column, limit) -> Column:
    """Upper limit that keeps NULL (``least`` would return the limit)."""
    return F.when(value > limit, F.lit(limit)).otherwise(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; NULL for a zero denominator instead of an error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole with half-even rounding."""
    return F.bround(ratio(part, whole) * 100, digits)


def replace_where(value: Column, condition: Column, new) -> Column:
    """Conditional update; rows with an unknown condition stay as they are."""
    return F.when(condition, F.lit(new)).otherwise(value)


def first_match(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first true branch; unknown conditions count as false."""
    (condition, value), *rest = branches
    result = F.when(condition, F.lit(value))
    for condition, value in rest:
        result = result.when(condition, F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))
