"""Text expressions: first-match edits, trimming, case, splitting, clean names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def replace_first(value: Column, literal: str, new: str) -> Column:
    """Replace only the first occurrence of a literal.

    One regular expression that mentions ``value`` once, so that a chain of
    edits grows linearly (``locate`` plus ``overlay`` would triple per step).
    """
    pattern = r"(?s)^(.*?)\Q" + literal + r"\E"
    return F.regexp_replace(value, pattern, "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_first_chain(value: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply first-match replacements in the given order."""
    for literal, new in rules:
        value = replace_first(value, literal, new)
    return value


def remove_all(value: Column, literal: str) -> Column:
    return F.replace(value, F.lit(literal), F.lit(""))


def drop_parenthetical(value: Column) -> Column:
    """Drop every bracketed remark together with the blanks before it."""
    return F.regexp_replace(value, r"\s*\([^)]+\)", "")


def trim_space(value: Column) -> Column:
    """Trim all white space, tabs and line ends included."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def sentence_case(value: Column) -> Column:
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 2147483647)))


def split_parts(value: Column, separator: str, names: list[str]) -> list[Column]:
    """Fixed number of parts: surplus parts are dropped, missing ones are NULL."""
    parts = F.split(value, re.escape(separator))
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]


def clean_name(name: str) -> str:
    """A column name in snake case: letters, digits and single underscores."""
    name = name.replace("'", "").replace('"', "")
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    if not name:
        return "x"
    return "x" + name if name[0].isdigit() else name


def clean_names(names: Iterable[str]) -> list[str]:
    """Clean names, made unique by a counter from the second use on."""
    seen: dict[str, int] = {}
    cleaned = []
    for name in map(clean_name, names):
        seen[name] = seen.get(name, 0) + 1
        cleaned.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return cleaned
