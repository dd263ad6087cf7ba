"""Flat tables and text lines that others read: the observation table, registry records, report lines."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpanel.functions.numeric import hundredths_to_double
from marketpanel.operators.filters import is_trade
from marketpanel.schemas import REGISTRY_FIELDS, REGISTRY_FORBIDDEN

# The columns of the observation table, in their order.
OBSERVATION_COLUMNS = (
    "observation_period", "frequency", "scope_id", "market_namespace", "market_code", "market_name_raw",
    "geography_role", "source_id", "dataset_id", "source_url", "commodity_family", "product_namespace",
    "product_code_raw", "product_name_raw", "canonical_id", "variant", "grade", "cut", "production_method",
    "market_level", "price_raw", "price_unit_raw", "price_twd_per_kg", "quantity_raw", "quantity_unit",
    "value_status", "origin_status", "origin_evidence_type", "origin_value", "origin_granularity",
    "evidence_ref", "join_key_type", "join_key_value", "row_hash", "retrieved_at",
)
# Units of the feed.
PRICE_UNIT, QUANTITY_UNIT = "元/公斤", "公斤"
DASH = "—"


@dataclass(frozen=True)
class Dataset:
    """What all observations of a feed have in common."""

    dataset_id: str
    source_url: str
    market_namespace: str
    product_namespace: str


def observation_table(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """All columns of OBSERVATION_COLUMNS. A feed of market prices tells nothing of origin, method, variant, grade or
    cut, so these are null or unknown, never guessed."""
    price, volume = hundredths_to_double(F.col("price_c")), hundredths_to_double(F.col("volume_c"))
    values: dict[str, Column] = {
        "observation_period": F.col("transaction_date").cast("string"), "frequency": F.lit("daily"), "scope_id": F.col("scope").cast("string"),
        "market_namespace": F.lit(dataset.market_namespace), "market_code": F.col("market_code").cast("string"), "market_name_raw": F.col("market_name"),
        "geography_role": F.lit("market_location"), "source_id": F.col("source_id"), "dataset_id": F.lit(dataset.dataset_id), "source_url": F.lit(dataset.source_url),
        "commodity_family": F.col("category"), "product_namespace": F.lit(dataset.product_namespace), "product_code_raw": F.col("crop_code"),
        "product_name_raw": F.col("crop_name_raw"), "canonical_id": F.col("canonical_id"), "production_method": F.lit("unknown"), "market_level": F.lit("wholesale"),
        "price_raw": price, "price_unit_raw": F.lit(PRICE_UNIT), "price_twd_per_kg": price, "quantity_raw": volume, "quantity_unit": F.lit(QUANTITY_UNIT),
        "value_status": F.when(is_trade(), "valid").otherwise("excluded_zero_price_or_volume"), "origin_status": F.lit("unknown"),
        "row_hash": F.col("row_hash"), "retrieved_at": F.col("fetched_at"),
    }
    return rows.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in OBSERVATION_COLUMNS])


# What a published registry record says of its source, in the order of the record.
REGISTRY_LINEAGE = ("source_id", "source_role", "source_status", "retrieved_at", "source_url", "semantic_warning")


def registry_records(lots: DataFrame, lineage: Mapping[str, str], as_of: str) -> DataFrame:
    """Whole registry records of minimised lots. A column that a record must not carry stops the job, whoever added it."""
    leaked = sorted({c for c in lots.columns if c in REGISTRY_FORBIDDEN})
    if leaked:
        raise ValueError(f"forbidden fields in a published lot: {leaked}")
    missing = sorted(set(REGISTRY_LINEAGE) - set(lineage))
    if missing:
        raise ValueError(f"lineage lacks {missing}")
    others = [c for c in lots.columns if c not in REGISTRY_FIELDS]
    return lots.select(
        *others, F.lit("2.0").alias("schema_version"), F.lit("traceability_registry_lot").alias("record_type"), *REGISTRY_FIELDS,
        *[F.lit(lineage[c]).alias(c) for c in REGISTRY_LINEAGE], F.lit(as_of).cast("date").alias("as_of_date"),
    )


def number_text(value: Column, digits: int = 0) -> Column:
    """A number with thousands commas, half up; a dash if there is none."""
    scale = float(10**digits)
    return F.when(value.isNull(), F.lit(DASH)).otherwise(F.format_string(f"%,.{digits}f", F.floor(value * scale + 0.5) / F.lit(scale)))


def price_text(price: Column) -> Column:
    return F.when(price.isNull(), F.lit(DASH)).otherwise(F.concat(F.lit("NT$ "), number_text(price, 2), F.lit("/kg")))


def percent_text(change: Column) -> Column:
    """A change with its sign, to one digit."""
    plus = F.when(change > 0, "+").otherwise("")
    return F.when(change.isNull(), F.lit(DASH)).otherwise(F.concat(plus, F.format_string("%.1f", F.floor(change * 10.0 + 0.5) / F.lit(10.0)), F.lit("%")))


def category_lines(prices: DataFrame, items: DataFrame) -> DataFrame:
    """Price lines of a day by category, in the order of the items' names: (transaction_date, category, canonical_id,
    line). An item without a price has a line with a dash."""
    named = prices.join(items.select("canonical_id", "display_name", "category"), "canonical_id")
    line = F.concat(F.lit("- "), "display_name", F.lit(": "), price_text(F.col("price")), F.lit(", "), number_text(F.col("volume")), F.lit(" kg"))
    return named.select("transaction_date", "category", "canonical_id", line.alias("line"))


def unknown_references(texts: DataFrame, body: str, known: DataFrame, key: str, pattern: str) -> DataFrame:
    """Ids that a text names and its evidence does not have: (the texts' other columns, id). `known` has the ids of each
    `key`, one of the texts' columns; ids are what the first group of `pattern` matches."""
    rest = [c for c in texts.columns if c != body]
    named = texts.select(*rest, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))).alias("id"))
    return named.join(known.select(key, "id").distinct(), [key, "id"], "left_anti").select(*rest, "id")
