"""The (item, day) price panel.

Transactions collapse to one row per (item, day) first; everything after works on that small table
with one sort per item. Nothing is computed for a single as-of day: an as-of is a filter on the
panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.numeric import (
    change_pct, exact_sum, hundredths_to_double, micro_to_double, ratio_micro, round6,
)
from marketpanel.operators.filters import analysis_rows, is_trade
from marketpanel.schemas import TAIL_DAYS, WINDOWS

WARNING = "zero-price-or-volume-excluded"
ITEM = ("canonical_id",)


def market_cells(observations: DataFrame, by: Sequence[str] = ITEM, with_prices: bool = False) -> DataFrame:
    """Partial sums per (day, item, market), or per price level as well.

    The market is part of the first grouping key, so a hot (day, item) is spread over its markets,
    and counting markets afterwards needs no distinct aggregate.
    """
    trade = is_trade()
    keys = ["transaction_date", *by, "market_code", *(["price_c"] if with_prices else [])]
    return observations.filter(F.col("canonical_id").isNotNull()).groupBy(*keys).agg(
        exact_sum(F.when(trade, F.col("price_c") * F.col("volume_c"))).alias("value_c"),
        exact_sum(F.when(trade, F.col("volume_c"))).alias("traded_c"),
        F.count_if(trade).alias("valid_rows"),
        F.count_if(~trade).alias("excluded_rows"),
        F.min(F.when(trade, F.col("price_c"))).alias("low_c"),
        F.max(F.when(trade, F.col("price_c"))).alias("high_c"),
    )


def _day_measures() -> list[Column]:
    zero = F.lit(0).cast("decimal(38,0)")
    return [
        F.coalesce(F.sum("value_c").cast("decimal(38,0)"), zero).alias("value_c"),
        F.coalesce(F.sum("traded_c").cast("decimal(38,0)"), zero).alias("traded_c"),
        F.sum("valid_rows").alias("valid_rows"),
        F.sum("excluded_rows").alias("excluded_rows"),
        F.min("low_c").alias("low_c"),
        F.max("high_c").alias("high_c"),
    ]


def daily_prices(
    observations: DataFrame, by: Sequence[str] = ITEM, include_synthetic: bool = False
) -> DataFrame:
    """One row per (day, item): exact sums, traded markets, extremes, row counts, price in millionths.

    Days on which no row is a valid trade stay, with a NULL price.
    """
    return daily_from_cells(market_cells(analysis_rows(observations, include_synthetic), by), by)


def daily_from_cells(cells: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    return (
        cells.groupBy("transaction_date", *by)
        .agg(*_day_measures(), F.count_if(F.col("valid_rows") > 0).alias("market_count"))
        .withColumn("price_u6", ratio_micro(F.col("value_c"), F.col("traded_c")))
    )


def daily_vwap(observations: DataFrame, include_synthetic: bool = False) -> DataFrame:
    """Published daily aggregate, with the median over rows.

    The median comes from a histogram of whole-cent prices, so its state grows with the number of
    price levels of the day and item and not with the number of rows.
    """
    rows = analysis_rows(observations, include_synthetic)
    cells = market_cells(rows, with_prices=True)
    median = F.percentile(
        F.when(F.col("valid_rows") > 0, F.col("price_c")), 0.5, F.greatest("valid_rows", F.lit(1))
    )
    daily = cells.groupBy("transaction_date", "canonical_id").agg(
        *_day_measures(),
        F.count_distinct(F.when(F.col("valid_rows") > 0, F.col("market_code"))).alias("market_count"),
        median.alias("median_c"),
    )
    price = ratio_micro(F.col("value_c"), F.col("traded_c"))
    return daily.select(
        "transaction_date",
        "canonical_id",
        micro_to_double(price).alias("weighted_avg_price"),
        hundredths_to_double(F.col("traded_c")).alias("total_volume"),
        "market_count",
        hundredths_to_double(F.col("median_c")).alias("median_price"),
        hundredths_to_double(F.col("low_c")).alias("min_price"),
        hundredths_to_double(F.col("high_c")).alias("max_price"),
        F.col("valid_rows").alias("valid_row_count"),
        F.col("excluded_rows").alias("excluded_row_count"),
        F.when(F.col("excluded_rows") > 0, F.array(F.lit(WARNING)))
        .otherwise(F.array().cast("array<string>"))
        .alias("quality_warnings"),
    )


def _frames(by: Sequence[str]):
    ordered = Window.partitionBy(*by).orderBy("_day")
    return ordered, {
        name: (ordered.rangeBetween(-(days - 1), 0), minimum)
        for name, (days, minimum) in WINDOWS.items()
    }


def with_windows(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    """All trailing calendar-window measures of every (item, day), on one exchange and one sort."""
    ordered, frames = _frames(by)
    traded = F.col("traded_c") > 0
    price = F.when(traded, F.col("value_c").cast("double") / F.col("traded_c").cast("double"))
    out = daily.withColumn("_day", F.unix_date("transaction_date")).withColumn("_price", price)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    measures: dict[str, Column] = {
        "_prev": F.last(
            F.when(traded, F.struct("transaction_date", "price_u6", "_price")), ignorenulls=True
        ).over(before)
    }
    for name, (frame, _) in frames.items():
        measures[f"_value_{name}"] = F.sum("value_c").over(frame).cast("decimal(38,0)")
        measures[f"_traded_{name}"] = F.sum("traded_c").over(frame).cast("decimal(38,0)")
        measures[f"_days_{name}"] = F.count_if(traded).over(frame)
        measures[f"_low_{name}"] = F.min(F.when(traded, F.struct("_price", "_day", "price_u6"))).over(frame)
        measures[f"_high_{name}"] = F.max(
            F.when(traded, F.struct(F.col("_price"), (-F.col("_day")).alias("_back"), F.col("price_u6")))
        ).over(frame)
    week = frames["7d"][0]
    measures["_spread_7d"] = F.stddev_pop("_price").over(week)
    measures["_mean_7d"] = F.avg("_price").over(week)
    return out.withColumns(measures)


def with_prices(windows: DataFrame) -> DataFrame:
    """Window sums as published numbers; later columns refer to these by name."""
    sums: dict[str, Column] = {}
    for name in WINDOWS:
        days, traded = F.col(f"_days_{name}"), F.col(f"_traded_{name}")
        sums[f"price_{name}"] = micro_to_double(ratio_micro(F.col(f"_value_{name}"), traded))
        sums[f"volume_{name}"] = hundredths_to_double(traded)
        sums[f"avg_volume_{name}"] = round6(F.when(days > 0, hundredths_to_double(traded) / days))
    sums["volume"] = hundredths_to_double(F.col("traded_c"))
    sums["price"] = micro_to_double(F.col("price_u6"))
    return windows.withColumns(sums)


def _window_columns(name: str, minimum: int) -> list[Column]:
    days = F.col(f"_days_{name}")
    today = F.col("_price") / F.lit(100.0)
    return [
        F.col(f"price_{name}"),
        F.col(f"volume_{name}"),
        F.col(f"avg_volume_{name}"),
        days.alias(f"coverage_{name}"),
        F.when(days >= minimum, "valid").otherwise("insufficient").alias(f"status_{name}"),
        round6(change_pct(today, F.col(f"price_{name}"))).alias(f"price_change_{name}"),
        round6(change_pct(F.col("volume"), F.col(f"avg_volume_{name}"))).alias(f"volume_change_{name}"),
    ]


def _today_columns() -> list[Column]:
    return [
        F.col("price"),
        F.col("volume"),
        F.col("market_count"),
        (F.col("excluded_rows") > 0).alias("has_warning"),
    ]


def rolling_prices(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    columns = [c for name, (_, low) in WINDOWS.items() for c in _window_columns(name, low)]
    return with_prices(with_windows(daily, by)).select(
        "transaction_date", *by, *_today_columns(), *columns
    )


def _previous_columns() -> list[Column]:
    today = F.col("_price")
    return [
        F.col("_prev.transaction_date").alias("previous_date"),
        micro_to_double(F.col("_prev.price_u6")).alias("previous_price"),
        round6(change_pct(today, F.col("_prev._price"))).alias("previous_change"),
        F.when(F.col("_prev").isNull(), "insufficient").otherwise("valid").alias("previous_status"),
    ]


def previous_day(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    """Strict backward as-of: the last valid trading day before each day."""
    return with_windows(daily, by).select(
        "transaction_date", *by, micro_to_double(F.col("price_u6")).alias("price"), *_previous_columns()
    )


def range_stats(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    """Lowest and highest daily price per window, each with its earliest date."""
    columns = []
    for name, (_, minimum) in WINDOWS.items():
        low, high, days = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_days_{name}")
        columns += [
            days.alias(f"observed_{name}"),
            micro_to_double(low["price_u6"]).alias(f"min_price_{name}"),
            F.date_from_unix_date(low["_day"]).alias(f"min_date_{name}"),
            micro_to_double(high["price_u6"]).alias(f"max_price_{name}"),
            F.date_from_unix_date(-high["_back"]).alias(f"max_date_{name}"),
            F.when(days >= minimum, "valid").otherwise("insufficient").alias(f"range_status_{name}"),
        ]
    return with_windows(daily, by).select("transaction_date", *by, *columns)


def _volatility() -> Column:
    enough = (F.col("_days_7d") >= 3) & (F.col("_mean_7d") != 0)
    return round6(F.when(enough, F.col("_spread_7d") / F.col("_mean_7d")))


def volatility(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    return with_windows(daily, by).select(
        "transaction_date",
        *by,
        F.col("_days_7d").alias("observed_7d"),
        _volatility().alias("volatility_7d"),
        F.when(F.col("_days_7d") >= 3, "valid").otherwise("insufficient").alias("volatility_status"),
    )


def price_panel(daily: DataFrame, by: Sequence[str] = ITEM) -> DataFrame:
    """Everything a score or a page needs for each (item, day)."""
    columns = [c for name, (_, low) in WINDOWS.items() for c in _window_columns(name, low)]
    return with_prices(with_windows(daily, by)).select(
        "transaction_date", *by, *_today_columns(), *_previous_columns(), *columns,
        _volatility().alias("volatility_7d"),
        F.when(F.col("_days_7d") >= 3, "valid").otherwise("insufficient").alias("volatility_status"),
    )


def daily_tail(daily: DataFrame, by: Sequence[str] = ITEM, days: int = TAIL_DAYS) -> DataFrame:
    """The last `days` rows of each item as a chart list, oldest first, zero-volume days left out.

    The list is bounded by `days`, whatever the history length.
    """
    newest = Window.partitionBy(*by).orderBy(F.col("transaction_date").desc())
    tail = daily.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= days)
    point = F.struct(
        F.col("transaction_date").alias("date"),
        micro_to_double(F.col("price_u6")).alias("price"),
        hundredths_to_double(F.col("traded_c")).alias("volume"),
    )
    return tail.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("daily"))


def chart_points(tail: DataFrame) -> DataFrame:
    """Points with a price and a volume; missing days are dropped and never filled with zero."""
    return tail.withColumn(
        "points", F.filter("daily", lambda p: p["price"].isNotNull() & (p["volume"] > 0))
    )
