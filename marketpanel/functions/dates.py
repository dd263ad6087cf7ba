"""Date expressions: local-era dates, lenient and strict parsing, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: year 1 of the local era is Gregorian 1912.
ERA_OFFSET = 1911

_DOTTED = r"^([0-9]{1,4})\.([0-9]{1,2})\.([0-9]{1,2})$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
ZONED_TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})$"
)


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date or NULL; make_date raises under ANSI, a padded try_cast does not."""
    return F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")
    ).try_cast("date")


def era_date(text: Column) -> Column:
    """`115.08.25` (era year) and `2026.8.25` dotted forms, else the first ten ISO characters."""
    value = F.trim(text)
    year_text = F.regexp_extract(value, _DOTTED, 1)
    year = F.when(F.length(year_text) == 3, year_text.try_cast("int") + ERA_OFFSET).otherwise(
        year_text.try_cast("int")
    )
    dotted = _calendar_date(
        year, F.regexp_extract(value, _DOTTED, 2), F.regexp_extract(value, _DOTTED, 3)
    )
    iso = F.when(value.rlike(_ISO), F.substring(value, 1, 10).try_cast("date"))
    return F.when(value.rlike(_DOTTED), dotted).when(~value.contains("."), iso)


def to_era_text(date: Column) -> Column:
    """Zero-padded era text of a date."""
    return F.format_string(
        "%03d.%02d.%02d", F.year(date) - ERA_OFFSET, F.month(date), F.dayofmonth(date)
    )


def lenient_date(text: Column) -> Column:
    """First ten characters with `/` read as `-`; anything else is NULL."""
    value = F.translate(F.substring(F.trim(text), 1, 10), "/", "-")
    return F.when(value.rlike(_ISO + "$"), value.try_cast("date"))


def event_date(text: Column) -> Column:
    """`yyyymmdd` or the lenient form."""
    value = F.trim(text)
    compact = F.concat_ws(
        "-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)
    ).try_cast("date")
    return F.when(value.rlike(r"^[0-9]{8}$"), compact).otherwise(lenient_date(value))


def month_start(text: Column) -> Column:
    """Strict `yyyy-MM` as the first of the month, else NULL."""
    return F.when(
        text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.concat(text, F.lit("-01")).try_cast("date")
    )


def shift_months(month: Column, months: int) -> Column:
    return F.add_months(month, months)


def is_zoned_timestamp(text: Column) -> Column:
    """True when the text is a timestamp which names its zone."""
    return F.coalesce(
        text.rlike(ZONED_TIMESTAMP) & text.try_cast("timestamp").isNotNull(), F.lit(False)
    )


def named_period(name: Column) -> Column:
    """Month named in a resource title such as `114年12月`, first of month, else NULL."""
    pattern = r"([0-9]{2,3})年([0-9]{1,2})月"
    year = F.regexp_extract(name, pattern, 1).try_cast("int") + ERA_OFFSET
    return _calendar_date(year, F.regexp_extract(name, pattern, 2), F.lit("01"))


def day_sequence(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 day"))


def python_weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)
