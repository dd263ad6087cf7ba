import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import exports, monthly, season
from marketpanel.schemas import REGISTRY_FIELDS, REGISTRY_FORBIDDEN

DAY = dt.date(2026, 8, 1)


def test_observation_table_has_all_columns_in_order(spark):
    rows = spark.createDataFrame(
        [(DAY, "s", 104, "台北二", "src", "vegetable", "LA1", "甘藍", "cabbage", 2055, 0, "h", "2026-08-01T00:00:00Z")],
        "transaction_date date, scope string, market_code int, market_name string, source_id string, category string, crop_code string, crop_name_raw string, canonical_id string, price_c bigint, "
        "volume_c bigint, row_hash string, fetched_at string")
    out = exports.observation_table(rows, exports.Dataset("d", "https://d", "m", "p"))
    assert tuple(out.columns) == exports.OBSERVATION_COLUMNS and len(out.columns) == 35
    row = out.first()
    assert (row.price_raw, row.quantity_raw, row.value_status, row.origin_status, row.variant, row.observation_period) == (20.55, 0.0, "excluded_zero_price_or_volume", "unknown", None, "2026-08-01")


def test_registry_records_refuse_personal_fields(spark):
    lots = spark.createDataFrame([tuple(None for _ in REGISTRY_FIELDS)], ", ".join(f"{c} string" for c in REGISTRY_FIELDS))
    lineage = {c: "x" for c in exports.REGISTRY_LINEAGE}
    out = exports.registry_records(lots, lineage, "2026-08-01")
    assert len(out.columns) == 20 and not set(out.columns) & set(REGISTRY_FORBIDDEN) and len(REGISTRY_FORBIDDEN) == 12
    for name in REGISTRY_FORBIDDEN:
        with pytest.raises(ValueError, match=name):
            exports.registry_records(lots.withColumn(name, F.lit("x")), lineage, "2026-08-01")
    with pytest.raises(ValueError, match="semantic_warning"):
        exports.registry_records(lots, {c: "x" for c in exports.REGISTRY_LINEAGE[:-1]}, "2026-08-01")


def test_display_strings(spark):
    rows = spark.createDataFrame([(1234.565,), (0.0,), (-0.25,), (None,)], "v double")
    out = [tuple(r) for r in rows.select(exports.number_text(F.col("v")), exports.price_text(F.col("v")), exports.percent_text(F.col("v"))).collect()]
    assert out == [("1,235", "NT$ 1,234.57/kg", "+1234.6%"), ("0", "NT$ 0.00/kg", "0.0%"), ("0", "NT$ -0.25/kg", "-0.2%"), ("—", "—", "—")]


def test_references_need_evidence(spark):
    texts = spark.createDataFrame([("a", 1, "see obs-1 and obs-2, obs-1"), ("b", 2, "see obs-1"), ("c", 3, "none"), ("d", 4, None)], "k string, n int, text string")
    known = spark.createDataFrame([("a", "obs-1"), ("b", "obs-2")], "k string, id string")
    out = exports.unknown_references(texts, "text", known, "k", r"\b(obs-[0-9]+)\b")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, "obs-2"), ("b", 2, "obs-1")]


def test_season_states_are_closed(spark):
    rows = spark.range(2)
    assert {r.source_status for r in season.with_source_status(rows, "stale").collect()} == {"stale"}
    with pytest.raises(ValueError):
        season.with_source_status(rows, "odd")


def test_monthly_snapshots_are_read_again(spark):
    revisions = spark.createDataFrame([
        ("a", 1, DAY, "115年8月行情", "resource_name", "c", 2), ("a", 2, DAY, "115年7月行情", "resource_name", "c", 2), ("b", 1, DAY, "行情", "operator", "c", 3), ("b", 3, DAY, "行情", "operator", "x", 1)],
        "k string, revision bigint, period date, resource_name string, period_evidence string, contract string, row_count bigint")
    parsed = spark.createDataFrame([("a", 1, "c", 2), ("a", 2, "c", 2), ("b", 1, "c", 2), ("b", 9, "c", 1)], "k string, revision bigint, contract string, rows bigint")
    out = sorted(((r.k, r.rule, r.revision) for r in monthly.snapshot_violations(revisions, parsed, ["k"]).collect()), key=str)
    assert out == [("a", "period_evidence", 2), ("b", "not_read_again", 3), ("b", "numbering", None), ("b", "row_count", 1)]
