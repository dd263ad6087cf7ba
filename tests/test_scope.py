import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import calendars, scope

DAY = dt.date(2026, 8, 1)
NAMES = "transaction_date date, market_code int, market_name string, crop_code string, crop_name_raw string, canonical_id string, price_c bigint, volume_c bigint, fetched_at string, source_status string, source_role string"


def rows(spark, data):
    """(day, market, name, price, volume)"""
    return spark.createDataFrame([
        (DAY + dt.timedelta(days=d), m, name, "LA1", "甘藍", "cabbage", round(p * 100), round(v * 100), "2026-09-01T00:00:00Z", None, "authoritative_final")
        for d, m, name, p, v in data], NAMES)


def markets(spark):
    return spark.sql("SELECT * FROM VALUES (104, 'taipei', '臺北二'), (109, 'taipei', '臺北一') AS t(market_code, scope, registry_name)")


def panel_of(spark, data):
    kept = scope.scoped_rows(rows(spark, data), markets(spark)).filter("NOT name_drift")
    return scope.scope_panel(kept, markets(spark)).collect()


def test_scope_price_and_outside_rows(spark):
    base = [(0, 104, "台北二", 100, 10), (0, 109, "臺北一", 200, 30)]
    out = panel_of(spark, base)
    assert (out[0].price, out[0].volume, out[0].scope_status) == (175.0, 40.0, "all_markets_observed")
    assert out[0].market_codes == [104, 109] and out[0].gate_status == "insufficient"
    assert panel_of(spark, base + [(0, 400, "x", 99999, 99999), (0, 241, "y", 0.01, 9)]) == out


def test_name_drift_is_kept_apart(spark):
    scoped = scope.scoped_rows(rows(spark, [(0, 104, "台北二", 1, 1), (0, 104, "別處", 1, 1)]), markets(spark))
    assert sorted(r.name_drift for r in scoped.collect()) == [False, True]


def test_item_statuses(spark):
    out = {r.transaction_date: r.status for r in panel_of(spark, [(0, 104, "台北二", 1, 1), (1, 104, "台北二", 0, 1)])}
    assert out == {DAY: "observed", DAY + dt.timedelta(days=1): "no_valid_trade"}


def test_market_day_statuses(spark):
    calendar = spark.createDataFrame(
        [(DAY + dt.timedelta(days=d), 104, s, "") for d, s in enumerate(["expected_open", "expected_open", "scheduled_closed", "scheduled_closed", "expected_open", None])],
        "calendar_date date, market_code int, schedule_status string, schedule_reason string")
    data = rows(spark, [(0, 104, "台北二", 1, 1), (3, 104, "台北二", 1, 1), (4, 104, "台北二", 0, 1)])
    out = [r.day_status for r in scope.market_days(data, calendar).orderBy("transaction_date").collect()]
    assert out == ["traded", "missing", "scheduled_closed", "calendar_feed_discrepancy", "no_valid_trade", "missing"]


def manifests(spark, end=3):
    return spark.createDataFrame(
        [("m2", DAY, DAY + dt.timedelta(days=end), "success", 200, "authoritative_final", "sha256:" + "0" * 64),
         ("m1", DAY, DAY, "success", 200, "authoritative_final", "sha256:" + "0" * 64),
         ("m0", DAY, DAY + dt.timedelta(days=99), "failed", 500, "authoritative_final", "sha256:" + "0" * 64)],
        "path string, start_date date, end_date date, status string, http_status int, source_role string, content_hash string")


def test_first_manifest_covers_a_day(spark):
    out = {r.transaction_date: r.manifest for r in scope.manifest_days(scope.eligible_manifests(manifests(spark))).collect()}
    assert out[DAY] == "m1" and out[DAY + dt.timedelta(days=1)] == "m2" and len(out) == 4


def test_grid_says_why_a_cell_is_empty(spark):
    data = rows(spark, [(0, 104, "台北二", 10, 1), (1, 104, "台北二", 0, 1), (2, 104, "台北二", 10, 0), (0, 109, "台北一", 5, 1)])
    data = data.unionByName(rows(spark, [(3, 104, "台北二", 9, 9)]).withColumn("source_role", F.lit("provisional")))
    checked = scope.with_provenance(scope.scoped_rows(data, markets(spark)), manifests(spark))
    calendar = spark.createDataFrame(
        [(DAY + dt.timedelta(days=d), m, "expected_open", "") for d in range(6) for m in (104, 109)],
        "calendar_date date, market_code int, schedule_status string, schedule_reason string")
    grid = scope.dense_grid(scope.grid_cells(checked), calendar, manifests(spark))
    found = {(r.market_code, (r.transaction_date - DAY).days): r.observation_status for r in grid.collect()}
    assert [found[104, d] for d in range(6)] == ["observed", "zero_price", "zero_volume", "provenance_unknown", "source_unavailable", "source_unavailable"]
    assert [found[109, d] for d in range(4)] == ["observed", "missing", "missing", "missing"]
    assert len(found) == 12
    stats = {(r.market_code, (r.transaction_date - DAY).days): r for r in scope.grid_stats(grid).collect()}
    assert (stats[104, 5].coverage_7d, stats[104, 5].price_7d, stats[104, 5].status_7d) == (1, 10.0, "insufficient")
    quality = {(r.market_code, (r.transaction_date - DAY).days): r for r in scope.quality_by_market_day(checked).collect()}
    assert quality[104, 1].reasons == {"zero_price": 1} and quality[104, 3].provenance_unknown_rows == 1


def test_running_sums_equal_frames(spark):
    data = [(d, 104, "台北二", 10 + d % 7, 1 + d % 5) for d in range(0, 100, 3)]
    checked = scope.with_provenance(scope.scoped_rows(rows(spark, data), markets(spark)), manifests(spark, 200))
    calendar = spark.createDataFrame(
        [(DAY + dt.timedelta(days=d), 104, "expected_open", "") for d in range(100)], "calendar_date date, market_code int, schedule_status string, schedule_reason string")
    stats = {(r.transaction_date - DAY).days: r for r in scope.grid_stats(scope.dense_grid(scope.grid_cells(checked), calendar, manifests(spark, 200))).collect()}
    for day in range(100):
        seen = [(p, v) for d, _, _, p, v in data if day - 29 <= d <= day]
        assert stats[day].coverage_30d == len(seen)
        assert stats[day].price_30d == pytest.approx(sum(p * v for p, v in seen) / sum(v for _, v in seen), abs=1e-6)


def test_pairs_and_gap(spark):
    data = rows(spark, [(0, 104, "台北二", 100, 1), (40, 104, "台北二", 150, 1), (0, 109, "台北一", 150, 1), (200, 104, "台北二", 1, 1)])
    single = data.select("transaction_date", "market_code", "crop_code", "price_c", "volume_c")
    pairs = {(r.market_code, (r.transaction_date - DAY).days): r for r in scope.observation_pairs(single).collect()}
    assert (pairs[104, 40].interval_days, pairs[104, 40].change_pct) == (40, 50.0)
    assert pairs[104, 200].previous_date is None
    gap = {(r.transaction_date - DAY).days: r for r in scope.market_gap(single, 109, 104).collect()}
    assert (gap[0].absolute_gap, gap[0].relative_gap_pct) == (50.0, 50.0)
    assert gap[40].comparison_status == "not_comparable"


def test_copies_with_unequal_payload_are_marked(spark):
    data = rows(spark, [(0, 104, "台北二", 10, 1), (0, 104, "台北二", 10, 1), (1, 104, "台北二", 10, 1), (1, 104, "台北二", 12, 1)])
    checked = scope.with_provenance(scope.scoped_rows(data, markets(spark)), manifests(spark))
    out = {(r.transaction_date - DAY).days: (r.price_c, r.has_conflict) for r in scope.single_rows(checked).collect()}
    assert out == {0: (1000, False), 1: (1000, True)}


def test_calendar_rules(spark):
    days = calendars.year_days(spark.sql("SELECT 2026 AS year")).drop("year")
    rules = spark.sql("""SELECT CAST(d AS date) AS calendar_date, kind, reason FROM VALUES ('2026-02-23', 'exceptional', 'x'), ('2026-02-24', 'makeup', 'make-up'),
      ('2026-02-17', 'special', 'new year'), ('2026-03-12', 'thursday', 'added'), ('2026-03-13', 'thursday', 'wrong') AS t(d, kind, reason)""")
    calendar = calendars.expand_calendar(days, rules)
    out = {str(r.calendar_date): (r.schedule_status, r.schedule_reason) for r in calendar.collect()}
    assert len(out) == 365
    assert out["2026-02-23"][0] == "exceptional_open" and out["2026-02-16"] == ("scheduled_closed", "monday")
    assert out["2026-02-24"] == ("scheduled_closed", "make-up") and out["2026-02-18"] == ("expected_open", "trading_day")
    expected = spark.sql("SELECT 2026 AS year, 55 AS expected_closed_days")
    found = {r.rule for r in calendars.calendar_violations(calendar, rules, expected).collect()}
    assert found == {"added_closure_not_thursday"}
    wrong = spark.sql("SELECT 2026 AS year, 50 AS expected_closed_days")
    assert "closed_day_count" in {r.rule for r in calendars.calendar_violations(calendar, rules, wrong).collect()}


def test_publication_matrix(spark):
    days = ["complete", "closed", "empty", "partial", "closed-trading"]
    schedule = ["expected_open", "scheduled_closed", "expected_open", "expected_open", "scheduled_closed"]
    requested = spark.createDataFrame(
        [("s", DAY + dt.timedelta(days=i), s) for i, s in enumerate(schedule)], "scope string, transaction_date date, schedule_status string")
    observed = spark.createDataFrame([
        ("s", DAY, 104, "LA1", "甘藍", "a"), ("s", DAY, 104, "LA2", "甘藍", "b"), ("s", DAY + dt.timedelta(days=1), 104, " Rest", "休市", None),
        ("s", DAY + dt.timedelta(days=3), 104, "LA1", "甘藍", "a"), ("s", DAY + dt.timedelta(days=4), 104, "LA1", "甘藍", "a")],
        "scope string, transaction_date date, market_code int, crop_code string, crop_name_raw string, canonical_id string")
    expected = spark.sql("SELECT explode(array('a', 'b')) AS canonical_id")
    out = calendars.resolve_dates(calendars.market_status(requested, observed, expected, [104])).orderBy("transaction_date").collect()
    assert dict(zip(days, [r.status for r in out])) == {
        "complete": "complete", "closed": "market_closed", "empty": "pending", "partial": "incomplete", "closed-trading": "calendar_feed_discrepancy"}
    assert {str(r.resolved_date) for r in out} == {str(DAY)}


def test_missed_slots(spark):
    runs = spark.sql("SELECT CAST(t AS timestamp_ntz) AS ts FROM VALUES ('2026-08-01 09:15:30'), ('2026-08-01 18:50:00'), ('2026-08-02 09:49:00') AS x(t)")
    out = {str(r.slot): r.action for r in calendars.missed_slots(runs, "ts", ("09:17:00", "18:17:00")).collect()}
    assert out == {"2026-08-01 09:17:00": "skip", "2026-08-01 18:17:00": "dispatch", "2026-08-02 09:17:00": "skip", "2026-08-02 18:17:00": "dispatch"}


def test_backfill_covers_every_day_once(spark):
    ranges = spark.sql("SELECT 's' AS k, DATE '2026-08-01' AS start_date, DATE '2026-08-10' AS end_date")
    out = calendars.backfill_chunks(ranges).orderBy("chunk_no").collect()
    assert [(str(r.chunk_start), str(r.chunk_end)) for r in out] == [
        ("2026-08-01", "2026-08-04"), ("2026-08-05", "2026-08-08"), ("2026-08-09", "2026-08-10")]
