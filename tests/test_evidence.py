import datetime as dt

from pyspark.sql import functions as F

from marketpanel.operators import evidence, season
from marketpanel.schemas import REGISTRY_FIELDS, REGISTRY_FORBIDDEN

ITEMS = """SELECT * FROM VALUES ('cabbage', '甘藍', 'vegetable', array('LA1'), array('高麗菜'), array('初秋甘藍'), array('甘藍', '高麗菜')),
  ('banana', '香蕉', 'fruit', array('A1'), CAST(array() AS array<string>), CAST(array() AS array<string>), CAST(array() AS array<string>))
  AS t(canonical_id, display_name, category, market_crop_codes, aliases, traceability_names, seasonality_names)"""
LOT = "Tracecode string, Producer string, OrgID string, ProductName string, Place string, PackDate string, CertificationName string, ValidDate string, Log_UpdateTime string, FarmerName string"


def lots(spark, rows, as_of="2026-08-25"):
    """(code, product, valid date, producer)"""
    raw = spark.createDataFrame([(c, p, "o1", n, "屏東縣內埔鄉1號", "2026/08/01", "cert", v, "2026-08-02", "secret") for c, n, v, p in rows], LOT)
    return evidence.minimized_lots(raw, spark.sql(ITEMS), as_of)


def test_lot_fields_and_validity(spark):
    out = lots(spark, [("T1", " 高麗菜 ", "2026-08-25", "p"), ("T2", "甘藍", "2026-08-24", "p"), ("T3", "甘藍", "soon", "p"), ("T4", "other", None, "p")])
    assert set(out.columns) == set(REGISTRY_FIELDS) and not set(out.columns) & set(REGISTRY_FORBIDDEN)
    rows = {r.tracecode: r for r in out.collect()}
    assert [rows[f"T{i}"].certification_status for i in (1, 2, 3, 4)] == ["active", "expired", "unknown", "unknown"]
    assert rows["T1"].place == "屏東縣" and rows["T1"].canonical_id == "cabbage" and rows["T4"].canonical_id is None


def test_copies_conflicts_and_profile(spark):
    given = lots(spark, [("T1", "甘藍", "2027-01-01", "p")] * 3 + [("T2", "甘藍", "2027-01-01", "p"), ("T2", "甘藍", "2027-01-01", "q"),
                         (" ", "甘藍", None, "p"), ("T9", "other", None, "p")])
    out = {r.tracecode: (r.copies, r.is_conflict) for r in evidence.published_lots(given).collect()}
    assert out == {"T1": (3, False), "T2": (2, True)}
    profile = evidence.lot_profile(given.withColumn("g", F.lit(1)), ["g"]).first()
    assert (profile.raw_record_count, profile.missing_tracecode_count, profile.unmapped_record_count) == (7, 1, 1)
    assert (profile.published_record_count, profile.duplicate_count, profile.conflict_count, profile.operator_count) == (2, 3, 1, 1)


def test_later_day_only_changes_validity(spark):
    out = evidence.stale_lots(lots(spark, [("T1", "甘藍", "2026-09-01", "p")]), "2026-10-01").first()
    assert (out.certification_status, out.source_status, str(out.valid_date)) == ("expired", "stale", "2026-09-01")


EVENT = "requested_date date, trade_date string, crop_code string, crop_name string, market_code string, market_name string, amount string, volume string, class_code string"
DAY = dt.date(2026, 8, 25)


def events(spark, rows):
    raw = spark.createDataFrame([(DAY, *r) for r in rows], EVENT)
    return evidence.normalized_events(raw, spark.sql(ITEMS))


def test_event_rules(spark):
    base = ("20260825", "LA1", "其他", "104", "台北二", "1,250", "42.5", "P1")
    def but(i, v):
        return (*base[:i], v, *base[i + 1:])
    out = events(spark, [base, base, but(1, "XX"), (*base[:1], "XX", "香蕉", *base[3:]), but(0, "20260824"), but(0, "20269999"), but(5, "-1"), but(6, "bad"), but(7, " ")])
    rows = sorted(((r.reject or "", r.canonical_id or "", r.copies, r.amount or 0) for r in out.collect()))
    assert rows == [
        ("", "", 1, 1250), ("", "banana", 1, 1250), ("", "cabbage", 2, 1250), ("bad_amount", "cabbage", 1, 0), ("bad_date", "cabbage", 1, 1250),
        ("bad_volume", "cabbage", 1, 1250), ("incomplete_identity", "cabbage", 1, 1250), ("outside_requested_date", "cabbage", 1, 1250)]
    profile = evidence.event_profile(out).first()
    assert (profile.raw_record_count, profile.published_record_count, profile.duplicate_count, profile.unmapped_record_count) == (9, 2, 1, 1)


def test_snapshot_is_never_borrowed(spark):
    snapshots = spark.sql("SELECT * FROM VALUES ('daily', DATE '2026-08-01', 1), ('current', DATE '2026-08-03', 2), ('current', DATE '2026-08-01', 9), ('fixture', NULL, 5) AS t(kind, as_of_date, records)")
    requested = spark.sql("SELECT explode(sequence(DATE '2026-08-01', DATE '2026-08-04', interval 1 day)) AS requested_date")
    out = [(r.kind, r.records) for r in evidence.choose_snapshot(requested, snapshots).orderBy("requested_date").collect()]
    assert out == [("daily", 1), ("fixture", 5), ("current", 2), ("fixture", 5)]


def test_guard_compares_with_the_last_accepted(spark):
    counts = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), n) for i, n in enumerate([100, 79, 80, 64, 63])], "k string, d date, n bigint")
    out = [(r.n, r.last_good_rows, r.is_accepted) for r in evidence.shrink_guard(counts, "k", "d", "n").orderBy("d").collect()]
    assert out == [(100, None, True), (79, 100, False), (80, 100, True), (64, 80, True), (63, 64, True)]


def test_names_map_to_one_item(spark):
    lookup = evidence.name_lookup(spark.sql(ITEMS))
    assert evidence.name_conflicts(lookup).count() == 0
    clash = lookup.unionByName(spark.sql("SELECT '甘藍' AS name, 'banana' AS canonical_id"))
    assert [r.name for r in evidence.name_conflicts(clash).collect()] == ["甘藍"]


def season_rows(spark):
    return spark.createDataFrame([
        (8, "vegetable", "甘藍", "雲林縣", "西螺鎮", "初秋"), (8, "vegetable", "甘藍", "雲林縣", "西螺鎮", "初秋"), (8, "vegetable", "甘藍", "彰化縣", "西螺鎮", "夏秋"),
        (8, "vegetable", "高麗菜", "雲林縣", "西螺鎮", " "), (8, "vegetable", "甘藍菜", "雲林縣", "二崙鄉", "x"), (8, "fruit", "香蕉", "屏東縣", "內埔鄉", "北蕉")],
        "month int, category string, display_name string, county string, district string, variety string")


def test_season_catalogue(spark):
    out = {r.display_name: r for r in season.catalog(season_rows(spark)).collect()}
    assert (out["甘藍"].county_count, out["甘藍"].district_count, out["甘藍"].variety_count) == (2, 1, 2)
    assert out["高麗菜"].varieties == []
    mapped = season.map_catalog(season.catalog(season_rows(spark)), spark.sql(ITEMS))
    rows = {r.display_name: r for r in mapped.collect()}
    assert rows["甘藍"].canonical_id == "cabbage" and rows["甘藍"].district_count == 2 and rows["甘藍"].county_count == 2
    assert rows["甘藍菜"].canonical_id is None
    watch = {(r.canonical_id, r.month): r.season_status for r in season.watchlist(mapped, spark.sql(ITEMS)).collect()}
    assert watch["banana", 8] == "in_season" and watch["banana", 9] == "unknown" and len(watch) == 24


def test_county_rollup(spark):
    aliases = spark.sql("SELECT * FROM VALUES ('雲林縣', 'yunlin'), ('屏東縣', 'pingtung') AS t(county, slug)")
    markets = spark.sql("SELECT 'yunlin' AS slug, 104 AS market_code UNION ALL SELECT 'yunlin', 9")
    rows = season.catalog(season_rows(spark))
    out = {r.slug: r for r in season.county_rollup(rows, aliases, markets).collect()}
    assert out["yunlin"].seasonal_count == 3 and out["yunlin"].markets == ["9", "104"]
    assert [r.county for r in season.unmapped_counties(rows, aliases).collect()] == ["彰化縣"]


def test_refresh_reasons(spark):
    requested = spark.createDataFrame([(i, "2026-08", i == 0) for i in range(6)], "k int, month string, is_forced boolean")
    good = [("2026-08", "fruit", "live"), ("2026-08", "vegetable", "live")]
    cached = {0: good, 1: [], 2: [("2026-07", "fruit", "live"), good[1]], 3: good[:1], 4: [("2026-08", "fruit", "stale"), good[1]], 5: good}
    frame = spark.createDataFrame([(k, *row) for k, rows in cached.items() for row in rows], "k int, cached_month string, category string, source_status string")
    out = [r.reason for r in season.refresh_decision(requested, frame, "k").orderBy("k").collect()]
    assert out == ["forced", "missing_snapshot", "month_mismatch", "incomplete_categories", "non_live_snapshot", "verified_live_snapshot"]
