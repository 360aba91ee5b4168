"""Ordered rules and small readers of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How descriptions number dwellings.
UNITS = r"(?i)(?<![\d-])(\d{2,4})\s*(?:no\.?\s*)?(?:new\s+)?(?:residential\s+)?(?:apartments?|dwellings?|units|houses|homes|bedspaces)"


def first_rule(rules: list[tuple[Column, dict[str, str]]]) -> Column:
    """The struct of the first rule whose condition holds; null if none does. A null condition doesn't hold."""
    (cond, val), *rest = rules
    made = lambda v: F.struct(*(F.lit(x).alias(k) for k, x in v.items()))
    out = F.when(cond, made(val))
    for c, v in rest:
        out = out.when(c, made(v))
    return out


def dwelling_count(text: Column, least: int = 80, most: int = 1200) -> Column:
    """The first number of dwellings a description names, if it lies within bounds; none where the same number is a year behind "pre-"."""
    t = F.coalesce(text, F.lit(""))
    digits = F.regexp_extract(t, UNITS, 1)
    year = F.regexp_like(t, F.concat(F.lit(r"(?i)pre-?\s*"), digits))
    return F.when(digits.try_cast("int").between(least, most) & ~year, digits.try_cast("int"))


def short_evidence(note: Column, counts: tuple[str, str] = ("osm_buildings_within_", "osm_buildings:"), bare: str = "dcc_gullies") -> Column:
    """A note without its detail in parentheses; a count's note keeps its number under a shorter name, a `bare` kind only its name."""
    head = F.substring_index(note, " (", 1)
    return F.when(head.startswith(counts[0]), F.concat(F.lit(counts[1]), F.substring_index(head, ":", -1))).when(head.startswith(f"{bare}:"), F.lit(bare)).otherwise(head)


def cut(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def prompt(template: str, *cols: Column) -> Column:
    """A printf template filled per row; nulls are empty."""
    return F.format_string(template, *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))


def valid_reading(r: Column, enums: dict[str, list[str]], counts: list[str]) -> Column:
    """Whether a reading has the form it must: it is there, each enumerated field has one of its values, each count is null or not negative."""
    ok = r.isNotNull()
    for f, values in enums.items():
        ok = ok & F.coalesce(r[f].isin(values), F.lit(False))
    for f in counts:
        ok = ok & F.coalesce(r[f] >= 0, F.lit(True))
    return ok
