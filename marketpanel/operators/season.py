"""Season catalogue, item mapping, county roll-up, lookups and refresh decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpanel.schemas import SEASON_SOURCE_STATES

# Fixed value: categories the season source covers.
SEASON_CATEGORIES = ("fruit", "vegetable")


def catalog(raw: DataFrame, period: str = "month") -> DataFrame:
    """Distinct counties, districts and varieties per (period, category, name).

    Copies collapse before the sets are built; set sizes are bounded by the place and variety
    registries, and districts are only counted.
    """
    keys = [period, "category", "display_name"]
    rows = raw.select(*keys, "county", "district", "variety").distinct()
    cleaned = [F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("county", "variety")]
    return rows.select(*keys, *cleaned, "district").groupBy(*keys).agg(
        F.array_sort(F.collect_set("county")).alias("counties"),
        F.array_sort(F.collect_set("variety")).alias("varieties"),
        F.count_distinct("district").alias("district_count"),
    ).select(
        *keys, "counties", F.size("counties").alias("county_count"), "district_count",
        "varieties", F.size("varieties").alias("variety_count"),
    )


def season_lookup(items: DataFrame) -> DataFrame:
    names = F.when(F.size("seasonality_names") > 0, F.col("seasonality_names")).otherwise(F.array("display_name"))
    return items.select(
        "canonical_id", F.col("display_name").alias("item_name"), "category",
        F.explode(names).alias("display_name"),
    )


def map_catalog(rows: DataFrame, items: DataFrame, period: str = "month") -> DataFrame:
    """Catalogue rows merged onto items by exact (category, name); the others stay as they are.

    The district count of an item is the sum over its names, as published; it is not distinct.
    """
    joined = rows.join(season_lookup(items), ["category", "display_name"], "left")
    own = F.col("canonical_id").isNotNull()
    named = joined.withColumn("_name", F.when(own, F.col("item_name")).otherwise(F.col("display_name")))
    merged = named.groupBy(period, "category", "canonical_id", F.col("_name").alias("display_name")).agg(
        F.array_sort(F.collect_set(F.col("display_name"))).alias("source_display_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("counties")))).alias("counties"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("varieties")))).alias("varieties"),
        F.sum("district_count").alias("district_count"),
    )
    return merged.withColumns({
        "county_count": F.size("counties"), "variety_count": F.size("varieties"),
    })


def watchlist(mapped: DataFrame, items: DataFrame, period: str = "month") -> DataFrame:
    """Season status of every item and month: in season when the catalogue lists it, else unknown."""
    months = items.select("canonical_id", "display_name", "category", F.explode(F.sequence(F.lit(1), F.lit(12))).alias(period))
    found = mapped.filter(F.col("canonical_id").isNotNull()).select(period, "canonical_id", "counties")
    return months.join(found, [period, "canonical_id"], "left").withColumns({
        "season_status": F.when(F.col("counties").isNull(), "unknown").otherwise("in_season"),
        "county_count": F.coalesce(F.size("counties"), F.lit(0)),
    }).drop("counties")


def catalog_from_status(status: DataFrame) -> DataFrame:
    """Fallback catalogue rows: items which are in season, without varieties or districts."""
    return status.filter(F.col("season_status") == "in_season").select(
        "month", "canonical_id", "display_name", "category", "county_count",
        F.lit(0).alias("district_count"), F.lit(0).alias("variety_count"),
    )


def with_source_status(rows: DataFrame, status: str) -> DataFrame:
    """All rows under one state of their source, whatever they said before."""
    if status not in SEASON_SOURCE_STATES:
        raise ValueError(f"unknown season source status {status}")
    return rows.withColumn("source_status", F.lit(status))


def merge_catalogs(base: DataFrame, extension: DataFrame) -> DataFrame:
    return base.unionByName(extension)


def county_rows(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Catalogue exploded to county slugs; a county without alias keeps a NULL slug."""
    exploded = rows.select("month", "category", "display_name", F.explode("counties").alias("county"))
    return exploded.join(aliases, "county", "left")


def county_rollup(rows: DataFrame, aliases: DataFrame, markets: DataFrame) -> DataFrame:
    """Local produce and official markets per (month, county). Lists are bounded by the catalogue
    of one month and by the market registry."""
    local = county_rows(rows, aliases).filter(F.col("slug").isNotNull()).select(
        "month", "slug", "category", "display_name"
    ).distinct()
    produce = F.concat_ws(":", "category", "display_name")
    grouped = local.groupBy("month", "slug").agg(
        F.count(F.lit(1)).alias("seasonal_count"),
        F.array_sort(F.collect_list(produce)).alias("local_produce"),
    )
    places = markets.groupBy("slug").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("market_code"))), lambda m: m["market_code"].cast("string")
        ).alias("markets")
    )
    return grouped.join(places, "slug", "left")


def unmapped_counties(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    names = rows.select(F.explode("counties").alias("county")).groupBy("county").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(aliases, "county", "left_anti")


def category_summary(rows: DataFrame) -> DataFrame:
    """Row count and source status per (month, category); more than one status is a violation."""
    return rows.groupBy("month", "category").agg(
        F.count(F.lit(1)).alias("catalog_rows"),
        F.min("source_status").alias("source_status"),
        (F.min("source_status") != F.max("source_status")).alias("is_mixed"),
    )


def season_violations(base: DataFrame, extension: DataFrame, aliases: DataFrame) -> DataFrame:
    """Broken rules of a season payload: (rule, key).

    `base` and `extension` have (month, category, display_name, counties, county_count, source_status). A row is there
    once, the extension neither repeats the base nor enters its categories, months are real, counties are registered and
    counted right, states are known, and each category of a month has one state.
    """
    name = F.concat_ws("|", "month", "category", "display_name")
    both = base.withColumn("_own", F.lit(True)).unionByName(extension.withColumn("_own", F.lit(False)))
    rules = [
        ("unknown_month", ~F.col("month").between(1, 12)),
        ("unknown_status", ~F.col("source_status").isin(*SEASON_SOURCE_STATES)),
        ("county_count", F.col("county_count") != F.size("counties")),
        ("base_category", F.col("_own") & ~F.col("category").isin(*SEASON_CATEGORIES)),
        ("extension_category", ~F.col("_own") & F.col("category").isin(*SEASON_CATEGORIES)),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(rule)) for rule, bad in rules]))
    rows = both.select(F.explode(broken).alias("rule"), name.alias("key"))
    repeated = both.groupBy("month", "category", "display_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_row").alias("rule"), name.alias("key"))
    mixed = category_summary(both).filter("is_mixed").select(F.lit("mixed_status").alias("rule"), F.concat_ws("|", "month", "category").alias("key"))
    foreign = unmapped_counties(both, aliases).select(F.lit("unknown_county").alias("rule"), F.col("county").alias("key"))
    return rows.unionByName(repeated).unionByName(mixed).unionByName(foreign)


def status_groups(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Source notices: one row per (status, url), ordered by the lowest category rank in it."""
    cells = rows.groupBy("source_status", "source_url", "category").agg(F.count(F.lit(1)).alias("rows"))
    beyond = ranks.select(F.count(F.lit(1))).scalar()
    ranked = cells.join(ranks, "category", "left").withColumn("rank", F.coalesce("rank", beyond))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "category")))
    return ranked.groupBy("source_status", "source_url").agg(
        F.min("rank").alias("anchor_rank"),
        F.transform(ordered, lambda c: c["category"]).alias("categories"),
        F.sum("rows").alias("rows"),
    )


def lookup_with_default(rows: DataFrame, exact: DataFrame, defaults: DataFrame) -> DataFrame:
    """Symbol of the exact (category, name), else the category default."""
    joined = rows.join(exact, ["category", "display_name"], "left").join(defaults, "category", "left")
    return joined.select(
        *rows.columns,
        F.coalesce("symbol", "default_symbol").alias("symbol"),
        F.when(F.col("symbol").isNotNull(), "exact").otherwise("category_fallback").alias("fidelity"),
    )


def names_without_entry(rows: DataFrame, exact: DataFrame) -> DataFrame:
    return rows.select("category", "display_name").distinct().join(exact, ["category", "display_name"], "left_anti")


def refresh_decision(
    requested: DataFrame, cached: DataFrame, key: str, categories: Sequence[str] = SEASON_CATEGORIES
) -> DataFrame:
    """Reuse or refresh each cached snapshot, with the first reason that applies.

    `requested` has (key, month, is_forced); `cached` has (key, cached_month, category,
    source_status). Sets are folded by the closed category and status lists.
    """
    state = cached.join(requested.select(key, "month"), key).groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("cached_month") != F.col("month")).alias("_other"),
        F.count_if(~F.col("category").isin(*categories)).alias("_foreign"),
        *[F.count_if(F.col("category") == c).alias(f"_has_{c}") for c in categories],
        F.count_if(F.col("source_status") != "live").alias("_not_live"),
    )
    missing = F.lit(False)
    for c in categories:
        missing = missing | (F.col(f"_has_{c}") == 0)
    reason = (
        F.when(F.col("is_forced"), "forced")
        .when(F.col("_rows").isNull(), "missing_snapshot")
        .when(F.col("_other") > 0, "month_mismatch")
        .when(missing | (F.col("_foreign") > 0), "incomplete_categories")
        .when(F.col("_not_live") > 0, "non_live_snapshot")
        .otherwise("verified_live_snapshot")
    )
    out = requested.join(state, key, "left").withColumn("reason", reason)
    return out.select(
        key, "month", "reason",
        F.when(F.col("reason") == "verified_live_snapshot", "reuse").otherwise("refresh").alias("action"),
        F.coalesce("_rows", F.lit(0)).alias("cached_rows"),
    )
