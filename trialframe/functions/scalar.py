"""Scalar column expressions. All stay inside the JVM and whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Molar masses used to turn amounts of gas and starch into carbon.
CO2_MOLAR_MASS = 12 + 16 * 2
CARBON_SHARE_CO2 = 12 / (12 + 16 * 2)
CARBON_SHARE_GLUCAN = 12 * 6 / (12 * 6 + 1 * 10 + 16 * 5)


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def either(condition: Column, then, other) -> Column:
    """Three-valued choice: an unknown condition gives NULL, not ``other``."""
    return F.when(condition, then).when(~condition, other)


def days_since(when, origin) -> Column:
    """Whole days from ``origin`` (a date literal or a column) to ``when``."""
    start = F.lit(origin).cast("date") if isinstance(origin, str) else origin
    return F.datediff(col(when).cast("date"), start)


def phase_label(when, cutoff: str, before: str, after: str) -> Column:
    return either(col(when).cast("date") >= F.lit(cutoff).cast("date"), F.lit(after), F.lit(before))


def phase_substitute(condition: Column, replacement, original) -> Column:
    """Take ``replacement`` where the condition holds, keep ``original`` elsewhere."""
    return either(condition, col(replacement), col(original))


def relative_to(value, base) -> Column:
    """value / base; NULL where the base is zero."""
    return F.try_divide(col(value), col(base))


def split_regressor(x, group, level: str) -> Column:
    """x on rows of one level, zero on the others."""
    return either(col(group) == F.lit(level), col(x), F.lit(0).cast("double"))


def null_tolerant(value, test: Column) -> Column:
    """Keep a row when the value is missing or passes the test."""
    return col(value).isNull() | test


def time_varying_bounds(x, value, bounds: Sequence[tuple[float, float]]) -> Column:
    """Keep rows that break none of the (after x, at least value) bounds."""
    broken = F.lit(False)
    for after, least in bounds:
        broken = broken | ((col(x) > after) & (col(value) < least))
    return ~broken


def signif_code(p) -> Column:
    """``*`` below .05, ``.`` strictly between .05 and .1, NULL otherwise."""
    p = col(p)
    return F.when(p < 0.05, "*").when((p > 0.05) & (p < 0.1), ".")


def strip_spaces(text) -> Column:
    return F.regexp_replace(col(text), " ", "")


def q10(rate_low, rate_high, temp_low, temp_high) -> Column:
    """Factor by which a rate grows per ten degrees."""
    ratio = F.try_divide(col(rate_high), col(rate_low))
    return F.pow(ratio, F.try_divide(F.lit(10.0), col(temp_high) - col(temp_low)))


def relocation_estimate(biomass, starch_share, extra_share, tissue_carbon) -> Column:
    """Tissue (kg per area) that the carbon of the surplus starch could build.

    biomass is in Mg per area; the other arguments are shares of one.
    """
    carbon = col(biomass) * col(starch_share) * col(extra_share) * 1000 * CARBON_SHARE_GLUCAN
    return F.try_divide(carbon, col(tissue_carbon))
