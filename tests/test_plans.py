"""Shape of the physical plans: what must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import panel
from marketpanel.plans.catalog import QUERIES
from marketpanel.sources import adapters
from marketpanel.sources.tables import Tables

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["daily_vwap", "rolling_vwap", "range_stats", "score_panel", "upsert", "resolve", "batch_manifest", "provenance", "season_catalog", "run_evidence", "normalize"])
def test_facts_are_scanned_once(spark, name):
    scans = re.findall(r"FileScan parquet.*?/(\w+)\.parquet", plan_of(QUERIES[name](spark, SF_DIR)))
    assert scans.count("lineitem") == 1


def test_columns_and_filters_reach_the_scan(spark):
    rows = panel.daily_prices(Tables(spark, SF_DIR).observations)
    early = rows.filter(F.col("transaction_date") < F.lit("1996-01-01").cast("date"))
    scan = next(x for x in plan_of(early).split("\n") if "FileScan" in x and "l_partkey" in x)
    assert "l_tax" not in scan and "l_linestatus" not in scan
    lines = early._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filtered = next(i for i, x in enumerate(lines) if "Filter" in x and "l_shipdate" in x)
    assert filtered > max(i for i, x in enumerate(lines) if "Join Inner" in x and i < filtered)
    assert "l_discount" in lines[filtered] and "Relation" in lines[filtered + 1]


def test_panel_windows_share_one_exchange_and_sort(spark):
    daily = panel.daily_prices(Tables(spark, SF_DIR).observations)
    plan = plan_of(panel.price_panel(daily))
    assert len(re.findall(r"[+-] Window ", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(canonical_id", plan)) == 1


def test_sources_are_registered_once_and_carry_lineage(spark):
    registry = adapters.SourceRegistry()
    spec = adapters.SourceSpec("feed", "https://feed.example", "authoritative_final", "daily", 10, "1.0", "v1")

    @registry.register(spec)
    def normalise(rows):
        return rows.withColumn("row_hash", F.lit("h")).withColumn("source_id", F.lit("feed"))

    with pytest.raises(ValueError):
        registry.register(spec)
    with pytest.raises(ValueError):
        adapters.SourceSpec("x", "u", "guess", "daily", 1, "1", "v1")
    landed = spark.sql("SELECT DATE '2026-08-01' AS transaction_date, 104 AS market_code, 'A1' AS crop_code")
    row = registry.observations({"feed": landed}).first()
    assert (row.source_role, row.source_precedence, row.dataset_semantics) == ("authoritative_final", 10, "daily")
    legacy = spark.sql("SELECT s AS source_id, CAST(NULL AS string) AS source_role, CAST(NULL AS int) AS source_precedence, CAST(NULL AS string) AS dataset_semantics FROM VALUES ('feed'), ('other') AS t(s)")
    out = {r.source_id: r.source_role for r in adapters.with_default_provenance(legacy, spec).collect()}
    assert out == {"feed": "authoritative_final", "other": None}
