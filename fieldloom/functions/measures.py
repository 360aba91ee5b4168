"""Arithmetic of demand, sizes and scores, with every rate a parameter."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_if_falsy(*cols: Column) -> Column:
    """The first that is neither null, NaN nor 0."""
    return F.coalesce(*(F.nullif(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols))


def residents(units: Column, per_household: Column, otherwise: float) -> Column:
    """Units times household size, half-even to a whole number; a size that is null, NaN or 0 gives way to `otherwise`."""
    return F.bround(units * F.coalesce(missing_if_falsy(per_household), F.lit(otherwise)), 0)


def peak_flow(units: Column, persons: float, litres_a_day: float, *factors: float) -> Column:
    """Litres a second."""
    return units * (persons * litres_a_day * math.prod(factors) / 86400.0)


def velocity(litres_s: Column, bore_mm: Column) -> Column:
    """Metres a second in a full pipe."""
    r = bore_mm / 2000.0
    return litres_s / 1000.0 / (math.pi * r * r)


def step(value: Column, bands: list[tuple[float, float]], beyond: Column) -> Column:
    """The result of the first band (limit, result) whose limit isn't below the value; else `beyond`."""
    return reduce(lambda w, b: w.when(value <= b[0], F.lit(b[1])), bands[1:], F.when(value <= bands[0][0], F.lit(bands[0][1]))).otherwise(beyond)


def least_not_below(value: Column, ladder: list[float]) -> Column:
    """The smallest rung that isn't below the value; the last rung if none is."""
    rungs = F.array(*(F.lit(float(x)) for x in ladder))
    return F.coalesce(F.array_min(F.filter(rungs, lambda r: r >= value)), F.lit(float(ladder[-1])))


def headway(demand: Column, capacity: float, least: float, most: float) -> Column:
    """Minutes between vehicles that carry the demand of an hour, within bounds."""
    need = F.greatest(F.lit(1.0), F.ceil(demand / capacity).cast("double"))
    return F.greatest(F.lit(least), F.least(F.lit(most), 60.0 / need))


def clipped(c: Column, otherwise: float = 100.0) -> Column:
    """Within 0 and 100, to one decimal; null is `otherwise`."""
    return F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)), 1), F.lit(otherwise))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, (c * w for c, w in parts)) / sum(w for _, w in parts)


def blended(parts: list[Column], top: float = 0.6) -> Column:
    """A share of the largest plus the rest of the mean, of the parts that aren't null."""
    a = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(a) > 0, top * F.array_max(a) + (1 - top) * F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def growth(added: Column, before: Column) -> Column:
    """Percent, null where nothing was before."""
    return F.when(before > 0, F.try_divide(added * 100.0, before))


def household_size(people: Column, households: Column) -> Column:
    """People to a household, to two decimals; null where there are no households."""
    return F.when(households > 0, F.round(F.try_divide(people, households), 2))
