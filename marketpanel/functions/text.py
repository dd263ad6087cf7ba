"""Text expressions: folding, trimming, coarsening, ordered rewriting, hashing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Full-width ASCII block and the ideographic space, by rule: U+FF01..U+FF5E are U+0021..U+007E.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "

FIELD_SEPARATOR = "\u001f"
NULL_MARK = "\\N"


def text_or_null(value: Column) -> Column:
    """Trimmed text; empty becomes NULL."""
    return F.nullif(F.trim(value), F.lit(""))


def fold_key(value: Column) -> Column:
    return F.lower(F.trim(value))


def market_name_key(name: Column) -> Column:
    """The one accepted spelling variant between feed and registry."""
    return F.translate(F.trim(name), "台", "臺")


def fold_width(value: Column) -> Column:
    """Full-width ASCII to ASCII inside codegen: the NFKC cases which occur in numbers and headers."""
    return F.translate(value, _WIDE, _NARROW)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Full NFKC; Spark has no normalise function. Arrow batches, one vectorised call per batch."""
    return values.str.normalize("NFKC")


def coarse_place(place: Column) -> Column:
    """Prefix up to the first county mark, else up to the first city mark, else NULL."""
    value = F.trim(place)
    county = F.regexp_extract(value, "^([^縣]*縣)", 1)
    city = F.regexp_extract(value, "^([^市]*市)", 1)
    return F.coalesce(F.nullif(county, F.lit("")), F.nullif(city, F.lit("")))


def rewrite(
    value: Column,
    replacements: Sequence[tuple[str, str]],
    patterns: Sequence[tuple[str, str]] = (),
) -> Column:
    """Ordered literal replacements, then ordered pattern replacements."""
    for old, new in replacements:
        value = F.replace(value, F.lit(old), F.lit(new))
    for pattern, new in patterns:
        value = F.regexp_replace(value, pattern, new)
    return value


def joined(values: Column) -> Column:
    """List cell of a CSV export; NULL list is an empty cell."""
    return F.coalesce(F.array_join(values, "|"), F.lit(""))


def hash_text(*parts: Column) -> Column:
    """sha256 of the separated parts; NULL has its own mark so that it differs from empty."""
    cells = [F.coalesce(part.cast("string"), F.lit(NULL_MARK)) for part in parts]
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, *cells), 256)


def row_hash(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), hash_text(*parts))


def reject_reason(*rules: tuple[str, Column]) -> Column:
    """First failing rule of an ordered cascade, NULL when none fails."""
    reason = None
    for name, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return reason


def flags_text(*flags: tuple[str, Column], limit: int | None = None) -> Column:
    """Names of the raised flags, in order, at most `limit` of them."""
    names = F.array_compact(F.array(*[F.when(raised, F.lit(name)) for name, raised in flags]))
    return F.slice(names, 1, limit) if limit else names
