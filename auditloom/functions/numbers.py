"""Reported numbers: parsing, rounding by decimals, comparison and severity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.names import strip

# Texts that stand for nothing (the last two are an em and an en dash).
NIL = ("", "-", "--", "---", "nil", "N/A", "n/a", "None", "none", "—", "–")
# Tolerances.
ABSOLUTE, PERCENT, SMALL, OVERSHOOT, DUPLICATE_SPREAD = 1.0, 0.01, 1000.0, 0.05, 0.02
#: Decimals that round_half_even tells apart; others are exact.
LOWEST, HIGHEST = -12, 12
#: Relative error of a scaled double, and the size from which doubles have no fraction.
ERROR, WHOLE = 2.0**-52, 2.0**52


def is_nil(c: Column) -> Column:
    return c.isNull() | strip(c.cast("string")).isin(*NIL)


def parse_number(c: Column) -> Column:
    """A double from a printed number. Nil texts are 0, commas and $ are dropped, parentheses mean minus; else null.

    Null for a null, for what is no number, and for nan and infinities.
    """
    t = strip(c.cast("string"))
    clean = F.translate(F.replace(F.translate(t, ",$)", ""), F.lit("("), F.lit("-")), " ", "")
    number = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("double"))
    return F.when(t.isin(*NIL), F.lit(0.0)).otherwise(number)


def parse_decimals(c: Column) -> Column:
    """The decimals attribute as an int; null for INF, for nothing and for what is no whole number."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.try_cast("int"))


def round_half_even(v: Column, decimals: Column) -> Column:
    """v rounded half-even to decimals (negative: tens, hundreds, ...); exact where decimals is null or beyond range.

    The number is scaled by a power of ten and rounded to a whole one. A number that lies halfway as printed may miss the
    half by an error of its binary form, hence the nearest half is taken where it is as near as that.
    """
    powers = [10.0**k for k in range(max(-LOWEST, HIGHEST) + 1)]
    of = lambda sign: F.get(F.array(*[F.lit(powers[max(sign * d, 0)]) for d in range(LOWEST, HIGHEST + 1)]), decimals - LOWEST)
    scaled = v * of(1) / of(-1)
    half = F.rint(scaled * 2) / 2
    whole = F.rint(F.when(F.abs(scaled - half) <= F.abs(scaled) * ERROR, half).otherwise(scaled))
    return F.when(F.abs(scaled) < WHOLE, whole * of(-1) / of(1)).otherwise(v) + F.lit(0.0)


def equal_at_precision(a: Column, b: Column, da: Column, db: Column) -> Column:
    """Equal when both are rounded to the lesser decimals, which one or both may lack.

    The allowance is half a unit of the last place, at most 0.5. Values without decimals are not rounded and may differ
    by 0.5.
    """
    d = F.least(da, db)
    allowance = F.when(d >= 0, 0.5 * F.pow(F.lit(10.0), -d)).otherwise(0.5)
    return F.when(d.isNull(), F.abs(a - b) <= 0.5).otherwise(F.abs(round_half_even(a, d) - round_half_even(b, d)) < allowance)


def within_tolerance(expected: Column, actual: Column, d_expected: Column, d_actual: Column, absolute: float = ABSOLUTE, percent: float = PERCENT) -> Column:
    """By decimals where either is known; else both zero, by absolute difference where either is small, or by percent."""
    gap, top = F.abs(expected - actual), F.greatest(F.abs(expected), F.abs(actual))
    return (
        F.when(d_expected.isNotNull() | d_actual.isNotNull(), equal_at_precision(expected, actual, d_expected, d_actual))
        .when((expected == 0) & (actual == 0), F.lit(True))
        .when((F.abs(expected) < SMALL) | (F.abs(actual) < SMALL), gap <= absolute)
        .otherwise(F.try_divide(gap, top) <= percent)
    )


def within_vertical(expected: Column, actual: Column, absolute: float = ABSOLUTE, percent: float = PERCENT) -> Column:
    """The variant that looks at the expected value alone to tell small from large."""
    gap = F.abs(expected - actual)
    return F.when((expected == 0) & (actual == 0), F.lit(True)).when(F.abs(expected) < SMALL, gap <= absolute).otherwise(F.try_divide(gap, F.abs(expected)) <= percent)


def signed(v: Column, sign: Column) -> Column:
    """A value whose markup carries a minus sign is negative; others stay as they are."""
    return F.when(sign == "-", -F.abs(v)).otherwise(v)


def severity(expected: Column, actual: Column, any_missing: Column) -> Column:
    """How grave a failed roll-up is. Opposite signs are critical; a sum beyond the total is a warning up to 5 %."""
    a, e = F.abs(actual), F.abs(expected)
    return (
        F.when((expected * actual) < 0, "critical")
        .when(e > a, F.when((a > 0) & (F.try_divide(e - a, a) <= OVERSHOOT), "warning").otherwise("critical"))
        .when(e < a, F.when(any_missing, "warning").otherwise("critical"))
        .otherwise("critical")
    )


def scale_by_decimals(v: Column, decimals: Column) -> Column:
    """The display value: v times 10 to the power of minus decimals; as it is where decimals is null."""
    return F.when(decimals.isNull(), v).otherwise(v * F.pow(F.lit(10.0), -decimals))


def scaling_factor(decimals: Column) -> Column:
    return F.when(decimals.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -decimals))


def decimals_from_precision(v: Column, precision: Column) -> Column:
    """Decimals that the given number of significant figures leaves; null for zero."""
    return F.when((v != 0) & (precision > 0), precision - F.floor(F.log10(F.abs(v))).cast("int") - 1)


def at_precision(v: Column, precision: Column) -> Column:
    return F.when(v == 0, v).otherwise(round_half_even(v, decimals_from_precision(v, precision)))


def mismatch_reasons(expected: Column, actual: Column) -> Column:
    """Likely causes of a mismatch: equal magnitude with the other sign, twice or half the value, a factor of 1000."""
    ratio = F.try_divide(F.abs(expected), F.abs(actual))
    return F.array_compact(
        F.array(
            F.when((F.abs(expected) == F.abs(actual)) & (expected != actual), "sign"),
            F.when((ratio - 2).between(-0.01, 0.01), "doubled"),
            F.when((ratio - 0.5).between(-0.0025, 0.0025), "halved"),
            F.when((ratio - 1000).between(-10, 10) | (ratio - 0.001).between(-0.00001, 0.00001), "scale"),
        )
    )


def mismatch_diagnosis(parent: Column, expected: Column, sign: Column) -> Column:
    """What may explain that a total is not its expected sum: an array of correction, magnitude, opposite; empty where they are equal.

    correction: the total's markup has a minus sign, and the negative total is nearer. magnitude: the sizes are within 1 % of the total,
    so that signs differ. opposite: the difference is twice the expected sum, within 1 % of the total.
    """
    gap, near = parent - expected, 0.01 * F.abs(parent)
    differ = gap != 0
    return F.array_compact(
        F.array(
            F.when((sign == "-") & (F.abs(-F.abs(parent) - expected) < F.abs(gap)), "correction"),
            F.when(differ & (F.abs(F.abs(parent) - F.abs(expected)) < near), "magnitude"),
            F.when(differ & (F.abs(gap - 2 * F.abs(expected)) < near), "opposite"),
        )
    )


def percent_done(done: Column, total: Column) -> Column:
    return F.round(F.least(F.greatest(F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0)), F.lit(0.0)), F.lit(100.0)), 2)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
