"""Row predicates every price job starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpanel.functions.text import fold_key

SYNTHETIC_MARK = "fixture"


def is_synthetic() -> Column:
    """Marked as test data in either provenance field; a NULL mark is not a mark."""
    marks = [F.coalesce(fold_key(F.col(c)), F.lit("")) for c in ("fetched_at", "source_status")]
    return (marks[0] == SYNTHETIC_MARK) | (marks[1] == SYNTHETIC_MARK)


def is_synthetic_anywhere(columns: Sequence[str]) -> Column:
    """The wide form: the mark, exactly as written, in any of the provenance fields the rows carry."""
    marked = F.lit(False)
    for c in ("fetched_at", "source_status", "data_mode"):
        if c in columns:
            marked = marked | F.coalesce(F.col(c) == SYNTHETIC_MARK, F.lit(False))
    if "is_fixture" in columns:
        marked = marked | F.coalesce(F.col("is_fixture"), F.lit(False))
    return marked


def analysis_rows(observations: DataFrame, include_synthetic: bool = False) -> DataFrame:
    return observations if include_synthetic else observations.filter(~is_synthetic())


def is_trade() -> Column:
    """A row which may enter a price: positive price and positive volume."""
    return (F.col("price_c") > 0) & (F.col("volume_c") > 0)
