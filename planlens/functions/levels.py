"""Ordered categories as text plus an ordinal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F


def only_levels(value: Column, levels: Sequence[str]) -> Column:
    """The value if it is a level, else NULL."""
    return F.when(value.isin(*levels), value)


def level_rank(value: Column, levels: Sequence[str]) -> Column:
    """1-based position in the level list; NULL for anything else."""
    ranks = F.create_map(*chain.from_iterable((F.lit(x), F.lit(i)) for i, x in enumerate(levels, 1)))
    return ranks[value]


def recode(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace listed values by their label and keep the others."""
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    return F.coalesce(lookup[value], value)


def recode_rank(value: Column, labels: Mapping[str, str]) -> Column:
    """Position of a value in the label list; unlisted values sort after all of them."""
    rank = F.coalesce(level_rank(value, list(labels)), F.lit(len(labels) + 1))
    return F.when(value.isNotNull(), rank)
