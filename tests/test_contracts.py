import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import contracts, documents, quality

DAY = dt.date(2026, 8, 1)
GOOD = "sha256:" + "a" * 64
LOT = "feed string, tracecode string, org_id string, canonical_id string, place string, certification_status string, source_id string"
LOT_PROFILE = "feed string, published_record_count bigint, active_record_count bigint, operator_count bigint, mapped_item_count bigint, source_id string, source_status string, content_hash string"


def found(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_lot_snapshots(spark):
    rows = [("a", "T1", "o1", "i", "屏東縣", "active", "r"), ("a", "T2", "o1", "i", None, "expired", "r"), ("b", "T1", "o", "i", "x", "lapsed", "q"), ("b", "T1", "o", "i", "", "active", "r"), ("c", None, "o", "i", "臺北市", "unknown", "r")]
    profile = [("a", 2, 1, 1, 1, "r", "live", GOOD), ("b", 3, 1, None, 1, "q", "late", "x"), ("d", 0, 0, 0, 0, "r", "stale", GOOD), ("e", 1, 0, 0, 0, "r", "live", None)]
    out = found(contracts.lot_snapshot_violations(spark.createDataFrame(rows, LOT), spark.createDataFrame(profile, LOT_PROFILE), ["feed"], "r"), "feed", "rule", "rows")
    assert out == [
        ("b", "certification_status", 1), ("b", "place_not_coarse", 1), ("b", "profile_hash", 1), ("b", "profile_operator_count", 1), ("b", "profile_published_record_count", 1),
        ("b", "profile_source", 1), ("b", "profile_status", 1), ("b", "repeated_tracecode", 1), ("b", "row_source", 1), ("c", "missing_profile", 1), ("c", "missing_tracecode", 1),
        ("e", "profile_hash", 1), ("e", "profile_published_record_count", 1)]
    clean = contracts.lot_snapshot_violations(spark.createDataFrame(rows[:2], LOT), spark.createDataFrame(profile[:1], LOT_PROFILE), ["feed"], "r")
    quality.require_clean(clean)
    assert clean.count() == 0


def test_event_snapshots(spark):
    schema = "day string, event_id string, source_id string, eligible_for_market_aggregate boolean, affects_buy_score boolean, transaction_date string, amount double, volume double, canonical_id string, market_code string"
    row = ("1", "h44:1", "e", False, False, "1", 1.0, 0.0, "i", "m")
    bad = [("1", "x", "q", True, True, "2", -1.0, 1.0, "i", "m"), ("1", "h44:3", "e", None, False, "1", 1.0, None, "j", "n")]
    profile = spark.createDataFrame([("1", 3, 2, 2, "e", "live", GOOD, False, True)], "day string, published_record_count bigint, mapped_item_count bigint, market_count bigint, source_id string, source_status string, content_hash string, eligible_for_market_aggregate boolean, affects_buy_score boolean")
    out = found(contracts.event_snapshot_violations(spark.createDataFrame([row, *bad], schema), profile, "day", "e", "h44:"), "rule", "rows", "first_key")
    assert out == [("event_identity", 1, "x"), ("profile_in_score", 1, "1"), ("row_date", 1, "x"), ("row_in_aggregate", 2, "h44:3"), ("row_in_score", 1, "x"), ("row_number", 2, "h44:3"), ("row_source", 1, "x")]


RUN = "document string, run_id string, source_id string, source_role string, source_precedence int, http_status int, content_hash string, raw_count bigint, normalized_count bigint, eligible_count bigint, suppressed_count bigint"
CANDIDATE = "document string, identity string, run_id string, source_id string, source_role string, source_precedence int, row_hash string, observation_id string, is_eligible boolean, selected string, supersedes string"
SUMMARY = "document string, observation_count bigint, eligible_total bigint, suppressed_total bigint, decision_count bigint"


def run_of(**changes):
    base = dict(document="d", run_id=GOOD, source_id="s", source_role="authoritative_final", source_precedence=10, http_status=200, content_hash=GOOD, raw_count=3, normalized_count=3, eligible_count=1, suppressed_count=2)
    return tuple((base | changes).values())


def candidate_of(n, **changes):
    own = "sha256:" + f"{n:064x}"
    base = dict(document="d", identity="x", run_id=GOOD, source_id="s", source_role="authoritative_final", source_precedence=10, row_hash=GOOD, observation_id=own, is_eligible=n == 1, selected="sha256:" + f"{1:064x}", supersedes=None)
    return tuple((base | changes).values())


@pytest.mark.parametrize("run, candidates, summary, rules", [
    ({}, [{}, {}], (3, 1, 2, 1), set()),
    ({"run_id": "x"}, [], (3, 1, 2, 0), {"run_id"}),
    ({"source_id": "A B"}, [], (3, 1, 2, 0), {"run_source_id"}),
    ({"source_role": "guess"}, [], (3, 1, 2, 0), {"run_role", "run_not_final_eligible"}),
    ({"content_hash": None}, [], (3, 1, 2, 0), {"run_content_hash"}),
    ({"source_precedence": -1}, [], (3, 1, 2, 0), {"run_precedence"}),
    ({"http_status": 600}, [], (3, 1, 2, 0), {"run_http_status"}),
    ({"suppressed_count": -2}, [], (3, 1, -2, 0), {"run_count_negative", "run_counts_do_not_add"}),
    ({"raw_count": 4}, [], (3, 1, 2, 0), {"run_raw_not_accounted"}),
    ({}, [{}, {"is_eligible": True}], (3, 1, 2, 1), {"several_eligible", "run_has_fewer_rows"}),
    ({}, [{"selected": None}], (3, 1, 2, 1), {"selected_not_eligible"}),
    ({}, [{"source_role": "provisional"}], (3, 1, 2, 1), {"candidate_not_final_eligible"}),
    ({}, [{"run_id": "sha256:" + "b" * 64}], (3, 1, 2, 1), {"candidate_without_run"}),
    ({}, [{"supersedes": "x"}], (3, 1, 2, 1), {"candidate_supersedes"}),
    ({}, [{}, {"observation_id": "sha256:" + f"{1:064x}"}], (3, 1, 2, 1), {"observation_id_repeated"}),
    ({}, [{}, {}, {}, {}], (3, 1, 2, 1), {"run_has_fewer_rows"}),
    ({}, [{}], (3, 1, 1, 1), {"summary"}),
    ({}, [{}], (3, 1, 2, 2), {"summary"}),
])
def test_runs(spark, run, candidates, summary, rules):
    runs = spark.createDataFrame([run_of(**run)], RUN)
    rows = spark.createDataFrame([candidate_of(n, **c) for n, c in enumerate(candidates, 1)], CANDIDATE)
    out = contracts.run_violations(runs, rows, spark.createDataFrame([("d", *summary)], SUMMARY))
    assert {r.rule for r in out.collect()} == rules


def test_runs_repeat(spark):
    runs = spark.createDataFrame([run_of(), run_of(source_id="t")], RUN)
    out = contracts.run_violations(runs, spark.createDataFrame([], CANDIDATE), spark.createDataFrame([("d", 6, 2, 4, 0), ("e", 0, 0, 0, 0)], SUMMARY))
    assert found(out, "document", "rule") == [("d", "run_id_repeated"), ("e", "summary")]


def grid_rows(spark, days=90):
    """Two markets and one crop, observed on every third day; all else is missing."""
    rows = []
    for m in (1, 2):
        for k in range(days):
            seen = k % 3 == m - 1 or k == days - 1
            rows.append((DAY + dt.timedelta(days=k), m, "c", "observed" if seen else "missing", "expected_open", False, 100 + k if seen else None, 200 if seen else None, GOOD if seen else None))
    schema = "transaction_date date, market_code int, crop_code string, observation_status string, schedule_status string, calendar_conflict boolean, price_c bigint, volume_c bigint, row_hash string"
    return spark.createDataFrame(rows, schema)


def test_grid_documents(spark):
    grid = grid_rows(spark)
    ends = grid.agg(F.max("transaction_date").alias("as_of_date"))
    series = documents.grid_series(grid, ends)
    stats = documents.derived_statistics(series)
    first = {r.market_code: r for r in stats.collect()}[1]
    seen = [(100 + k) for k in range(90) if k % 3 == 0 or k == 89]
    assert first.coverage_90d == len(seen) and first.price_90d == pytest.approx(sum(seen) / len(seen) / 100, abs=1e-6)
    assert (first.latest_date - first.previous_date).days == first.interval_days == 2
    comparisons = spark.sql("SELECT DATE '2026-10-29' AS as_of_date, 'c' AS crop_code, 1.89D AS price_a, 1.89D AS price_b, 2D AS volume_a, 2D AS volume_b, 0D AS absolute_gap, 0D AS relative_gap_pct, 'comparable' AS comparison_status")
    totals = spark.sql("SELECT DATE '2026-10-29' AS as_of_date, 0L AS calendar_conflicts, 2L AS observed_market_count, 1L AS observed_crop_count")
    check = lambda s=series, t=stats, c=comparisons, q=totals, e=series: {(r.rule, r.path) for r in documents.grid_violations(s, t, c, q, e, 1, 2).collect()}
    assert check() == set()
    broken = lambda f: check(s=series.withColumn("days", f))
    assert ("series.days", "1/c") in broken(F.filter("days", lambda d, i: i != 4))
    assert ("series.status", "days[2/c/2026-08-01]") in broken(F.transform("days", lambda d, i: F.when((i == 0), d.withField("observation_status", F.lit("odd"))).otherwise(d)))
    assert {r for r, _ in broken(F.transform("days", lambda d: d.withField("schedule_status", F.lit("closed"))))} == {"series.schedule"}
    assert {r for r, _ in broken(F.transform("days", lambda d: d.withField("row_hash", F.lit(GOOD))))} == {"series.hash"}
    assert "series.values" in {r for r, _ in broken(F.transform("days", lambda d: d.withField("price_c", F.lit(0).cast("bigint"))))}
    assert check(s=series.filter("market_code = 1"), e=series) >= {("series.missing", "2/c"), ("statistics.unknown", "2/c"), ("comparisons.comparison_status", "c"), ("quality.observed_market_count", "")}
    assert check(t=stats.withColumn("volume_7d", F.col("volume_7d") + 1)) == {("statistics.volume_7d", "1/c"), ("statistics.volume_7d", "2/c")}
    assert check(t=stats.filter("market_code = 2")) == {("statistics.missing", "1/c")} and check(t=stats.unionByName(stats)) == {("statistics.repeated", "1/c"), ("statistics.repeated", "2/c")}
    assert check(c=comparisons.withColumn("relative_gap_pct", F.lit(1.0))) == {("comparisons.relative_gap_pct", "c")} and check(c=comparisons.limit(0)) == {("comparisons.missing", "c")}


MARKETS = "array<struct<market_code:int,day_status:string,row_count:int,valid_rows:int,schedule_status:string>>"
ITEMS = ("array<struct<canonical_id:string,status:string,price:double,volume:double,market_count:int,market_codes:array<int>,previous_price:double,price_7d:double,price_30d:double,"
         "price_90d:double,volatility_7d:double,gate_status:string,reason_codes:array<string>>>")
OBSERVATIONS = "array<struct<market_code:int,observation_period:date,price:double,quantity:double,value_status:string>>"
SCOPE = ("scope string, as_of_date date, requested_date date, publication_status string, analysis_status string, failure_reason string, snapshot_hash string, expected_markets int, "
         f"observed_markets int, scope_status string, markets {MARKETS}, items {ITEMS}, observations {OBSERVATIONS}")
SEEN = ("a", "observed", 2.0, 1.0, 1, [1], None, None, None, None, None, "insufficient", ["X"])
UNSEEN = ("b", "no_scope_observation", *[None] * 9, "insufficient", ["Y"])


def scope_of(**changes):
    base = dict(scope="s", as_of_date=DAY, requested_date=DAY, publication_status="complete", analysis_status="published", failure_reason=None, snapshot_hash=GOOD, expected_markets=2, observed_markets=1,
                scope_status="partial_markets_observed", markets=[(1, "traded", 1, 1, "expected_open"), (2, "missing", 0, 0, "unknown")], items=[SEEN, UNSEEN], observations=[(1, DAY, 2.0, 1.0, "valid")])
    return tuple((base | changes).values())


FAILED = dict(analysis_status="failed", failure_reason="x", snapshot_hash=None, expected_markets=0, observed_markets=0, scope_status="analysis_failed", markets=[], items=[], observations=[])


@pytest.mark.parametrize("changes, rules", [
    ({}, set()), (FAILED, set()), (FAILED | {"failure_reason": None}, {"failed_without_reason"}), (FAILED | {"observed_markets": None}, {"failed_with_coverage"}),
    (FAILED | {"snapshot_hash": GOOD, "items": [SEEN]}, {"failed_with_hash", "failed_with_rows"}),
    ({"requested_date": DAY - dt.timedelta(days=1)}, {"dates"}), ({"publication_status": None}, {"publication_status"}), ({"analysis_status": "odd"}, {"analysis_status"}),
    ({"expected_markets": 3}, {"expected_markets"}), ({"observed_markets": 2}, {"observed_markets"}), ({"scope_status": "all_markets_observed"}, {"scope_status"}),
    ({"markets": [(1, "traded", 1, 1, "odd"), (1, "no_valid_trade", 0, 0, "unknown")]}, {"market_schedule", "market_day_status", "market_codes_unique"}),
    ({"items": []}, {"items_listed"}), ({"items": [SEEN, SEEN]}, {"item_ids_unique"}),
    ({"items": [(*SEEN[:2], None, *SEEN[3:])]}, {"observed_price"}), ({"items": [(*SEEN[:5], [1, 9], *SEEN[6:])]}, {"observed_markets_known", "item_market_count"}),
    ({"items": [(*SEEN[:11], "not_evaluated", ["X"])]}, {"few_markets_gate"}), ({"items": [(*UNSEEN[:2], 1.0, *UNSEEN[3:])]}, {"unobserved_with_values"}),
    ({"items": [(*UNSEEN[:11], "passed", [])]}, {"item_gate", "unobserved_gate"}), ({"items": [("a", "odd", *UNSEEN[2:])]}, {"item_status"}),
    ({"observations": [(9, DAY, 0.0, 1.0, "valid")]}, {"observation_scope", "observation_value"}),
])
def test_scope_documents(spark, changes, rules):
    out = documents.scope_violations(spark.createDataFrame([scope_of(**changes)], SCOPE))
    assert {r.rule for r in out.collect()} == rules
