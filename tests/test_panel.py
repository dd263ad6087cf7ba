import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import panel, score
from marketpanel.schemas import OBSERVATION

DAY = dt.date(2026, 8, 1)


def rows(spark, data):
    """(day offset, market, price, volume[, mark]) for one item."""
    full = [
        (DAY + dt.timedelta(days=d), market, "A1", "apple", "apple", round(price * 100), round(volume * 100),
         mark[0] if mark else "2026-09-01T00:00:00Z", None)
        for d, market, price, volume, *mark in data
    ]
    return spark.createDataFrame(full, OBSERVATION)


def test_weighted_price_is_not_the_mean(spark):
    out = panel.daily_vwap(rows(spark, [(0, 104, 20, 1000), (0, 109, 40, 10)])).first()
    assert out.weighted_avg_price == pytest.approx(20.19801980198, abs=5e-7)
    assert (out.total_volume, out.market_count, out.median_price) == (1010.0, 2, 30.0)


def test_group_without_trade_is_kept_with_null_price(spark):
    out = panel.daily_vwap(rows(spark, [(0, 104, 0, 5), (0, 104, 3, 0)])).first()
    assert out.weighted_avg_price is None and out.total_volume == 0
    assert (out.valid_row_count, out.excluded_row_count) == (0, 2)
    assert out.quality_warnings == [panel.WARNING]


def test_median_is_over_rows(spark):
    data = [(0, 1, p, 1) for p in (1, 1, 1, 9)] + [(0, 2, 5, 1)]
    assert panel.daily_vwap(rows(spark, data)).first().median_price == 1.0


def test_synthetic_rows_never_count(spark):
    base = [(0, 104, 20, 10), (1, 104, 22, 10)]
    marked = base + [(0, 104, 9999, 10, " FIXTURE "), (1, 109, 1, 5000, "fixture")]
    def daily(data, **kw):
        return sorted(map(tuple, panel.daily_vwap(rows(spark, data), **kw).collect()))
    assert daily(marked) == daily(base)
    assert daily(marked, include_synthetic=True) != daily(base)


def test_order_and_partitioning_do_not_matter(spark):
    data = [(d, m, 10 + (d * 7 + m) % 5, 1 + (d + m) % 9) for d in range(60) for m in (1, 2, 3)]
    shuffled = data[:]
    random.Random(5).shuffle(shuffled)
    first = panel.price_panel(panel.daily_prices(rows(spark, data))).collect()
    second = panel.price_panel(panel.daily_prices(rows(spark, shuffled).repartition(7))).collect()
    assert sorted(map(str, first)) == sorted(map(str, second))


def test_calendar_windows_and_ranges(spark):
    data = [(d, m, 30 - 0.2 * d, 100 + d) for d in range(35) for m in (1, 2)]
    daily = panel.daily_prices(rows(spark, data))
    last = DAY + dt.timedelta(days=34)
    out = panel.rolling_prices(daily).filter(F.col("transaction_date") == last).first()
    assert (out.coverage_7d, out.coverage_30d, out.coverage_90d) == (7, 30, 35)
    assert out.status_90d == "valid"
    span = panel.range_stats(daily).filter(F.col("transaction_date") == last).first()
    assert span.max_date_7d == DAY + dt.timedelta(days=28) and span.min_date_7d == last
    assert (span.max_price_7d, span.min_price_7d) == (24.4, 23.2)


def test_windows_count_days_not_rows(spark):
    daily = panel.daily_prices(rows(spark, [(0, 1, 10, 1), (6, 1, 20, 1), (7, 1, 30, 1)]))
    out = {r.transaction_date: r for r in panel.rolling_prices(daily).collect()}
    assert out[DAY + dt.timedelta(days=6)].coverage_7d == 2
    assert out[DAY + dt.timedelta(days=7)].coverage_7d == 2
    assert out[DAY + dt.timedelta(days=7)].price_7d == 25.0


def test_flat_series_has_earliest_dates(spark):
    daily = panel.daily_prices(rows(spark, [(d, 1, 10, 5) for d in range(9)]))
    out = panel.range_stats(daily).orderBy(F.desc("transaction_date")).first()
    assert out.min_date_7d == out.max_date_7d == DAY + dt.timedelta(days=2)
    steady = panel.volatility(daily).orderBy(F.desc("transaction_date")).first()
    assert steady.volatility_7d == 0.0


def test_previous_day_skips_days_without_trade(spark):
    daily = panel.daily_prices(rows(spark, [(0, 1, 10, 1), (1, 1, 0, 1), (2, 1, 11, 1)]))
    out = {r.transaction_date: r for r in panel.previous_day(daily).collect()}
    assert out[DAY].previous_status == "insufficient"
    third = out[DAY + dt.timedelta(days=2)]
    assert third.previous_date == DAY and third.previous_change == 10.0


def test_sums_pass_the_bigint_range(spark):
    big = [(0, m, 9e9, 9e9) for m in range(40)]
    out = panel.daily_vwap(
        rows(spark, big).withColumn("price_c", F.lit(2_000_000_000).cast("bigint")).withColumn("volume_c", F.lit(2_000_000_000).cast("bigint"))
    ).first()
    assert out.weighted_avg_price == 20_000_000.0


def test_tail_is_bounded(spark):
    daily = panel.daily_prices(rows(spark, [(d, 1, 0 if d % 50 == 0 else 10, 1) for d in range(200)]))
    out = panel.chart_points(panel.daily_tail(daily)).first()
    assert len(out.daily) == 120 and out.daily[-1].date == DAY + dt.timedelta(days=199)
    assert len(out.points) == 118


def _scored(spark, **over):
    row = dict(
        transaction_date=DAY, canonical_id="apple", price=80.0, volume=130.0, market_count=2, has_warning=False,
        previous_change=-5.0, price_7d=100.0, price_30d=100.0, avg_volume_7d=100.0, status_7d="valid",
        status_30d="valid", volatility_7d=0.05, coverage_7d=7, coverage_30d=30, coverage_90d=90,
    ) | over
    schema = (
        "transaction_date date, canonical_id string, price double, volume double, market_count bigint, has_warning boolean,"
        "previous_change double, price_7d double, price_30d double, avg_volume_7d double, status_7d string,"
        "status_30d string, volatility_7d double, coverage_7d bigint, coverage_30d bigint, coverage_90d bigint"
    )
    frame = spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(",") if c.strip())], schema)
    seasons = spark.sql("SELECT * FROM VALUES ('apple', array(8)), ('pear', array(1)) AS t(canonical_id, months)")
    return score.score_panel(frame, seasons).first()


def test_score_of_a_cheap_item_in_season(spark):
    out = _scored(spark)
    assert (out.score, out.verdict, out.eligible) == (100, "priority", True)
    assert out.reason_codes == ["IN_SEASON", "PRICE_AT_OR_BELOW_7D", "PRICE_AT_OR_BELOW_30D", "VOLUME_HEALTHY"]


@pytest.mark.parametrize("over, verdict", [
    ({"status_7d": "insufficient"}, "insufficient"),
    ({"market_count": 1}, "insufficient"),
    ({"has_warning": True}, "insufficient"),
    ({"canonical_id": "pear"}, "not_ranked"),
    ({"canonical_id": "fig"}, "not_ranked"),
    ({"price": None}, "insufficient"),
])
def test_gates(spark, over, verdict):
    assert _scored(spark, **over).verdict == verdict


def test_unknown_season_is_not_out_of_season(spark):
    assert _scored(spark, canonical_id="fig").season_status == "unknown"
    assert _scored(spark, canonical_id="pear").season_status == "out_of_season"
