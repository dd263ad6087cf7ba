import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import monthly


def month(n):
    return dt.date(2025 + (n // 12), n % 12 + 1, 1)


def months(spark, values, item="cabbage"):
    rows = [(item, month(i), None if v is None else float(v), "missing" if v is None else "valid" if v > 0 else "zero_reported")
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "item string, period date, value double, value_status string")


def test_thirteen_months(spark):
    out = monthly.describe(months(spark, range(100, 113)), "item").first()
    assert (out.median, out.q1, out.q3) == (106, 103, 109)
    assert out.mom_pct == pytest.approx(100 / 111, abs=1e-6) and out.yoy_pct == 12
    assert (out.latest_vs_history, out.valid_month_count, out.stats_status) == ("above_q3", 13, "valid")


def test_few_months(spark):
    out = monthly.describe(months(spark, [10, 20]), "item").first()
    assert (out.median, out.q1, out.latest_vs_history, out.stats_status) == (None, None, None, "insufficient")
    four = monthly.describe(months(spark, [10, 20, 30, 40]), "item").first()
    assert four.q1 == 17.5 and four.latest_vs_history is None


def test_change_needs_the_calendar_month(spark):
    out = monthly.describe(months(spark, [10, None, 30]), "item").first()
    assert out.mom_pct is None and out.latest == 30
    rows = {r.period: r.mom_pct for r in monthly.month_changes(months(spark, [10, 0, 30, 33]), "item").collect()}
    assert rows == {month(0): None, month(2): None, month(3): 10.0}


def submissions(spark, rows):
    return spark.createDataFrame(
        [("retail", dt.date(2026, 1, 1), i, h, dt.date.fromisoformat(k)) for i, (h, k) in enumerate(rows)],
        "source string, period date, arrival int, raw_hash string, known_at date")


def test_revisions_and_knowledge_time(spark):
    given = submissions(spark, [("a", "2026-02-01"), ("a", "2026-02-02"), ("b", "2026-02-10"), ("a", "2026-03-01")])
    log = monthly.revision_log(given, ["source", "period"], ["arrival"], F.floor(F.col("arrival") / 2))
    assert sorted((r.revision, r.arrival, r.outcome) for r in log.collect()) == [(1, 0, "added"), (2, 2, "revised"), (3, 3, "revised")]
    seen = {day: monthly.known_revisions(log, ["source", "period"], day).first() for day in ("2026-02-05", "2026-02-10", "2026-04-01")}
    assert [(r.revision, r.raw_hash) for r in seen.values()] == [(1, "a"), (2, "b"), (3, "a")]
    assert monthly.known_revisions(log, ["source", "period"], "2026-01-31").count() == 0
    assert monthly.revision_gaps(log, ["source", "period"]).count() == 0
    assert monthly.revision_gaps(log.filter("revision <> 2"), ["source", "period"]).count() == 1


def test_period_evidence(spark):
    rows = [("2025-12-01", "114年12月份行情"), ("2025-11-01", "114年12月份行情"), ("2025-12-01", "行情")]
    frame = spark.createDataFrame(rows, "p string, n string")
    out = [r[0] for r in frame.select(monthly.period_evidence(F.col("p").cast("date"), F.col("n"))).collect()]
    assert out == ["resource_name", "conflict", "operator"]


def test_trend_needs_the_same_latest_month(spark):
    volume = monthly.describe(months(spark, [10, 20]), "item")
    assert monthly.supply_trend(volume, monthly.describe(months(spark, [5, 4]), "item"), "item").first().price_trend == "down"
    later = monthly.describe(months(spark, [5, 4, 3]), "item")
    assert monthly.supply_trend(volume, later, "item").first().volume_trend is None


def test_retail_mapping(spark):
    described = monthly.describe(months(spark, range(60, 73)).unionByName(months(spark, range(60, 73), "eggs")), "item")
    mapping = spark.sql("SELECT 'eggs' AS item, 'livestock' AS commodity_family, NULL AS canonical_id, false AS mass_basis")
    out = {r.item: r for r in monthly.retail_items(described, mapping, "item").collect()}
    assert (out["cabbage"].mapping_status, out["cabbage"].latest_price_per_kg) == ("unmapped", 120.0)
    assert (out["eggs"].mapping_status, out["eggs"].latest_price_per_kg, out["eggs"].advice_status) == ("reviewed", None, "historical_reference")
