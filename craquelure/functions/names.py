"""Specimen names: ``thickness.stress.boundary.number[-comment]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wildcard characters of the name filter.
WILDCARDS = "*[]^\\"


def _wild(text: str) -> str:
    return text.replace(".", "\\.").replace("*", ".*").replace("!", "|")


def prefix_match(col: Column, pattern: str) -> Column:
    """The pattern must match from the first character, not necessarily to the last."""
    return col.rlike(f"^(?:{pattern})")


def part_regex(text: str) -> str:
    """``4:8.*.A.*``: alternatives per part with ``:``, missing parts match anything."""
    parts = (text.split(".") + ["*"] * 4)[:4]
    return "\\.".join("(" + "|".join(p.split(":")) + ")" if ":" in p else _wild(p) for p in parts)


def name_filter(col: Column, text) -> Column:
    """The order of the rules matters: lists, exact name, part pattern, wildcard."""
    if text is None:
        return F.lit(True)
    if isinstance(text, (list, tuple)):
        return col.isin(list(text))
    for separator in (",", " "):
        if separator in text:
            return col.isin(text.split(separator))
    if not any(c in WILDCARDS for c in text):
        return col == text
    if ":" in text:
        return prefix_match(col, part_regex(text))
    return prefix_match(col, _wild(text))


def name_parts(col: Column) -> dict[str, Column]:
    """Typed parts of a name; parts 2 and 3 are swapped when part 2 holds the number."""
    parts = F.split(col, "\\.")
    b, n = parts.getItem(2), parts.getItem(3)
    swapped = b.rlike("^[0-9]+$")
    boundary = F.when(swapped, n).otherwise(b)
    last = F.when(swapped, b).otherwise(n)
    sections = F.split(last, "-")
    return {
        "thickness": parts.getItem(0).cast("int"),
        "nom_stress": parts.getItem(1).cast("int"),
        "boundary": boundary,
        "nbr": sections.getItem(0).cast("int"),
        "comment": F.when(F.size(sections) > 1, sections.getItem(1)).otherwise(F.lit("")),
    }


def name_from_path(path: Column) -> Column:
    """The specimen name inside a path, else the last path element."""
    found = F.regexp_extract(path, r"(\d+\.\d+\.[A-Za-z]\.\d+(?:-[^\s/]+)?)", 1)
    return F.when(found != "", found).otherwise(F.element_at(F.split(path, "/"), -1))


def scan_id(path: Column) -> Column:
    return F.substring(F.element_at(F.split(path, "/"), -1), 1, 4)


def scan_type(path: Column) -> Column:
    """Content of the last ``[...]``, empty when there is none."""
    found = F.regexp_extract_all(path, F.lit(r"\[(.*?)\]"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def two_digits(number: Column) -> Column:
    """At least two digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)


def normalised_name(col: Column) -> Column:
    """Four-part names get a two-digit number; a suffix after ``-`` stays."""
    parts = F.split(col, "\\.")
    tail = F.split(parts.getItem(3), "-")
    number = two_digits(tail.getItem(0).cast("int"))
    last = F.when(F.size(tail) > 1, F.concat_ws("-", number, tail.getItem(1))).otherwise(number)
    four = F.concat_ws(".", parts.getItem(0), parts.getItem(1), parts.getItem(2), last)
    return F.when(F.size(parts) == 4, four).otherwise(col)


def stress_range(text, delta: float = 10.0) -> tuple[float, float] | None:
    """``a-b``, ``all`` or a single value widened by ``delta`` (never below zero)."""
    if text is None:
        return None
    text = str(text)
    if "-" in text:
        low, high = (float(v) for v in text.split("-"))
        return low, high
    if text == "all":
        return 0.0, 1000.0
    value = float(text)
    return max(0.0, value - delta), value + delta

