"""Number expressions.

Money and volume are fixed-point integers inside the jobs (hundredths), so sums are exact and do
not depend on row order, partitioning or retries. Ratios of sums come out as integer micro units.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's float() grammar without underscores, NaN and infinity.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Fixed values of the scoring rules.
PRICE_LADDER = ((0.85, 25), (0.95, 20), (1.0, 15), (1.05, 10), (1.15, 5))
VOLUME_LADDER = ((1.25, 15), (1.0, 12), (0.75, 8), (0.5, 4))
VOLATILITY_LADDER = ((0.10, 0), (0.20, -3), (0.30, -7))
VOLATILITY_FLOOR = -10

# Fixed value: tokens which mean "not reported" in monthly statistics.
BLANK_TOKENS = ("", "-", "—", "－", "–")


def exact_sum(value: Column) -> Column:
    """Sum of a BIGINT as a decimal: a hot group may pass the BIGINT range at full scale."""
    return F.sum(value.cast("decimal(20,0)")).cast("decimal(38,0)")


def int_div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def ratio_micro(numerator: Column, denominator: Column) -> Column:
    """num/den/100 in millionths, rounded half up, NULL when den is not positive.

    `numerator` is a sum of (hundredths of price x hundredths of volume), `denominator` a sum of
    hundredths of volume; both non-negative.
    """
    doubled = numerator.cast("decimal(38,0)") * F.lit(20000) + denominator
    return F.when(denominator > 0, int_div(doubled, denominator * F.lit(2)))


def ratio_micro_long(numerator: Column, denominator: Column) -> Column:
    """As ratio_micro, in BIGINT: for sums of a few single rows, where no decimal is needed.

    Quotient and remainder are scaled apart, so the numerator itself is never multiplied.
    """
    rest = (numerator % denominator) * F.lit(20000) + denominator
    return F.when(
        denominator > 0,
        int_div(numerator, denominator) * F.lit(10000) + int_div(rest, denominator * F.lit(2)),
    )


def micro_to_double(units: Column) -> Column:
    return units.cast("double") / F.lit(1e6)


def hundredths_to_double(units: Column) -> Column:
    return units.cast("double") / F.lit(100.0)


def round6(value: Column) -> Column:
    """Six digits, half up, with plain IEEE steps so every engine gives the same bits."""
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def change_pct(current: Column, reference: Column) -> Column:
    """Percent change; NULL when a side is NULL or the reference is zero."""
    return F.when(
        current.isNotNull() & (reference != 0), (current - reference) / reference * F.lit(100.0)
    )


def price_points(ratio: Column, ladder: Sequence[tuple[float, int]] = PRICE_LADDER) -> Column:
    """Points of the first ceiling the ratio does not pass; NULL and beyond score 0."""
    points = F.when(ratio.isNull(), 0)
    for ceiling, score in ladder:
        points = points.when(ratio <= F.lit(ceiling), score)
    return points.otherwise(0)


def volume_points(ratio: Column, ladder: Sequence[tuple[float, int]] = VOLUME_LADDER) -> Column:
    points = F.when(ratio.isNull(), 0)
    for floor, score in ladder:
        points = points.when(ratio >= F.lit(floor), score)
    return points.otherwise(0)


def volatility_points(
    value: Column,
    ladder: Sequence[tuple[float, int]] = VOLATILITY_LADDER,
    beyond: int = VOLATILITY_FLOOR,
) -> Column:
    points = F.when(value.isNull(), 0)
    for ceiling, score in ladder:
        points = points.when(value <= F.lit(ceiling), score)
    return points.otherwise(beyond)


def parse_number(text: Column) -> Column:
    """Finite non-negative number or NULL. The pattern keeps '12d', 'NaN' and 'Infinity' out."""
    value = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    # Named once, so that a filter that the number is inlined into reads the text once.
    return F.get(F.filter(F.array(value), lambda v: (v >= 0) & (v < F.lit(float("inf")))), F.lit(0)) + F.lit(0.0)


def parse_amount(text: Column) -> Column:
    """As parse_number, with thousands commas removed first."""
    return parse_number(F.replace(text, F.lit(","), F.lit("")))


def number_state(text: Column) -> Column:
    """'missing' for a blank token, 'zero_reported', 'valid', or 'unreadable' (to be rejected)."""
    cleaned = F.trim(F.regexp_replace(text, ",", ""))
    value = parse_number(cleaned)
    return (
        F.when(cleaned.isin(*BLANK_TOKENS), "missing")
        .when(value > 0, "valid")
        .when(value == 0, "zero_reported")
        .otherwise("unreadable")
    )


def per_kilogram(price_per_catty: Column) -> Column:
    """A catty is 0.6 kg; dividing keeps the published six digits."""
    return round6(price_per_catty / F.lit(0.6))


def direction(change: Column) -> Column:
    return (
        F.when(change > 0, "up").when(change < 0, "down").when(change.isNotNull(), "flat")
    )
