"""Closed schemas and enumerations of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values: (calendar days, minimum observed days) per window.
WINDOWS = {"7d": (7, 3), "30d": (30, 10), "90d": (90, 30)}
TAIL_DAYS = 120
MINIMUM_MARKETS = 2

# Fixed values of the closed enumerations.
FINAL_ROLE = "authoritative_final"
SOURCE_ROLES = ("authoritative_final", "provisional", "validation", "contextual")
MARKET_STATES = (
    "complete", "market_closed", "incomplete", "pending", "source_unavailable",
    "calendar_feed_discrepancy",
)
FEED_STATES = ("available", "empty", "delayed", "failed", "not_checked")
SEASON_SOURCE_STATES = ("live", "stale", "fallback")
VERDICTS = ("priority", "consider", "watch", "hold", "insufficient", "not_ranked")

OBSERVATION = T.StructType([
    T.StructField("transaction_date", T.DateType()),
    T.StructField("market_code", T.IntegerType()),
    T.StructField("crop_code", T.StringType()),
    T.StructField("crop_name_raw", T.StringType()),
    T.StructField("canonical_id", T.StringType()),
    T.StructField("price_c", T.LongType()),
    T.StructField("volume_c", T.LongType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("source_status", T.StringType()),
])

LANDED_ROW = T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("k", T.LongType()),
]))

REGISTRY_FIELDS = (
    "tracecode", "producer", "org_id", "product_name_raw", "canonical_id", "place", "pack_date",
    "certification_name", "valid_date", "certification_status", "source_updated_date",
)
# Personal or unneeded fields which a published lot must not carry.
REGISTRY_FORBIDDEN = (
    "FarmerName", "StoreInfo", "OperationDetail", "ResumeDetail", "ProcessDetail",
    "CertificateDetail", "LandSecNO", "ParentTraceCode", "TraceCodelist", "farmer_name", "store_info",
    "land_section_number",
)
