"""Scoped analysis: verified markets, market days, the dense grid, provenance and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.dates import day_sequence, is_zoned_timestamp
from marketpanel.functions.numeric import hundredths_to_double, micro_to_double, ratio_micro_long, round6
from marketpanel.functions.text import flags_text, market_name_key, reject_reason
from marketpanel.operators import panel
from marketpanel.operators.filters import analysis_rows, is_synthetic_anywhere, is_trade
from marketpanel.schemas import FINAL_ROLE, MINIMUM_MARKETS, WINDOWS
from marketpanel.sources.sinks import materialize
from marketpanel.sources.tables import SEMANTICS

SCOPE_ITEM = ("scope", "canonical_id")
MARKET_CROP = ("market_code", "crop_code")


def scoped_rows(observations: DataFrame, markets: DataFrame) -> DataFrame:
    """Rows of verified markets with their scope, and whether the market name drifted.

    The filter sits before every aggregate, so rows outside the scope cannot reach a statistic.
    """
    verified = markets.select("market_code", "scope", "registry_name")
    return observations.join(verified, "market_code").withColumn(
        "name_drift", market_name_key(F.col("market_name")) != market_name_key(F.col("registry_name"))
    )


def day_status(rows: Column, valid: Column, schedule: Column) -> Column:
    return (
        F.when((valid > 0) & (schedule == "scheduled_closed"), "calendar_feed_discrepancy")
        .when(valid > 0, "traded")
        .when(rows > 0, "no_valid_trade")
        .when(schedule == "scheduled_closed", "scheduled_closed")
        .otherwise("missing")
    )


def market_days(scoped: DataFrame, calendar: DataFrame) -> DataFrame:
    """Status of every (market, day) of the calendar; a market without calendar stays unknown."""
    counts = scoped.groupBy("market_code", "transaction_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(is_trade()).alias("valid_row_count")
    )
    grid = calendar.withColumnRenamed("calendar_date", "transaction_date")
    joined = grid.join(counts, ["market_code", "transaction_date"], "left").withColumns({
        "row_count": F.coalesce("row_count", F.lit(0)),
        "valid_row_count": F.coalesce("valid_row_count", F.lit(0)),
        "schedule_status": F.coalesce("schedule_status", F.lit("unknown")),
    })
    return joined.withColumn(
        "day_status", day_status(F.col("row_count"), F.col("valid_row_count"), F.col("schedule_status"))
    )


def scope_panel(scoped: DataFrame, markets: DataFrame) -> DataFrame:
    """Panel per (scope, item, day) with item status, market list, scope status and gate reasons.

    Days on which the scope reported anything are completed with the scope's items, through an
    equi-join on the scope. Transactions are read once, into the (day, scope, item, market) cells.
    """
    cells = materialize(panel.market_cells(analysis_rows(scoped), SCOPE_ITEM), "scope-cells")
    prices = panel.price_panel(panel.daily_from_cells(cells, SCOPE_ITEM), SCOPE_ITEM)
    traded = F.when(F.col("valid_rows") > 0, F.col("market_code"))
    codes = cells.groupBy("transaction_date", *SCOPE_ITEM).agg(
        F.array_sort(F.collect_list(traded)).alias("market_codes")
    )
    expected = markets.groupBy("scope").agg(F.count_distinct("market_code").alias("expected_markets"))
    days = (
        cells.groupBy("scope", "transaction_date", "market_code")
        .agg(F.sum("valid_rows").alias("_valid"))
        .groupBy("scope", "transaction_date")
        .agg(F.count_if(F.col("_valid") > 0).alias("observed_markets"))
        .join(expected, "scope")
    )
    items = cells.select("scope", "canonical_id").distinct()
    keys = ["scope", "canonical_id", "transaction_date"]
    full = days.join(items, "scope").join(prices, keys, "left").join(codes, keys, "left")
    status = (
        F.when(F.col("price").isNotNull(), "observed")
        .when(F.col("market_count").isNotNull(), "no_valid_trade")
        .otherwise("no_scope_observation")
    )
    full = full.withColumn("status", status)
    observed = F.col("status") == "observed"
    reasons = flags_text(
        ("NO_SCOPE_OBSERVATION", F.col("status") == "no_scope_observation"),
        ("NO_VALID_TRADE", F.col("status") == "no_valid_trade"),
        ("COVERAGE_INSUFFICIENT", observed & ~((F.col("status_7d") == "valid") & (F.col("status_30d") == "valid"))),
        ("MARKET_COUNT_INSUFFICIENT", observed & (F.col("market_count") < MINIMUM_MARKETS)),
        ("DATA_QUALITY_WARNING", observed & F.col("has_warning")),
    )
    full = full.withColumn("_reasons", reasons)
    gated = F.size("_reasons") > 0
    measures = [
        F.when(observed, F.col(c)).alias(c)
        for c in ("price", "volume", "market_count", "previous_price", "previous_change",
                  "price_7d", "price_30d", "price_90d", "volatility_7d")
    ]
    return full.select(
        "transaction_date", "scope", "canonical_id", "status", *measures,
        F.when(observed, F.col("market_codes")).alias("market_codes"),
        F.when(F.col("observed_markets") == 0, "no_scope_observation")
        .when(F.col("observed_markets") == F.col("expected_markets"), "all_markets_observed")
        .otherwise("partial_markets_observed").alias("scope_status"),
        F.when(gated, "insufficient").otherwise("not_evaluated").alias("gate_status"),
        F.when(gated, F.col("_reasons")).otherwise(F.array(F.lit("SCOPE_SCORE_NOT_DEFINED"))).alias("reason_codes"),
    )


def manifest_days(manifests: DataFrame) -> DataFrame:
    """First eligible manifest (by path) of each covered day.

    Ranges become days, so the range join of rows with manifests is an equi-join on the date, with
    at most one row per calendar day on the small side.
    """
    days = manifests.select("path", F.explode(day_sequence(F.col("start_date"), F.col("end_date"))).alias("transaction_date"))
    return days.groupBy("transaction_date").agg(F.min("path").alias("manifest"))


HASH = "^sha256:[0-9a-f]{64}$"


def eligible_manifests(manifests: DataFrame, semantics: str = SEMANTICS) -> DataFrame:
    """Successful 2xx batches of an authoritative source with a well-formed hash and a real range, and, where the
    manifests carry them, the right semantics and a zoned time of retrieval."""
    right = (
        (F.col("status") == "success")
        & F.col("http_status").between(200, 299)
        & (F.col("source_role") == FINAL_ROLE)
        & F.col("content_hash").rlike(HASH)
        & (F.col("start_date") <= F.col("end_date"))
    )
    if "dataset_semantics" in manifests.columns:
        right = right & (F.col("dataset_semantics") == semantics)
    if "retrieved_at" in manifests.columns:
        right = right & is_zoned_timestamp(F.col("retrieved_at"))
    return manifests.filter(right)


def with_provenance(scoped: DataFrame, manifests: DataFrame, semantics: str = SEMANTICS) -> DataFrame:
    """Reject reason of every scoped row, first match wins, and its manifest.

    Tests of columns that rows need not carry apply where they do: a `row_hash` that is no hash and an item other than
    `expected_item` (that of the crop's code) make a row invalid, a `fetched_at` that is no zoned time and other
    `dataset_semantics` (null: stored before there were any) make its provenance unknown.
    """
    covered = manifest_days(eligible_manifests(manifests, semantics))
    # At most a row a calendar day; as a plain join the facts could be exchanged by day before this side is counted.
    joined = scoped.join(F.broadcast(covered), "transaction_date", "left")
    has = scoped.columns
    invalid = F.col("canonical_id").isNull() | F.coalesce(F.length(F.trim("crop_name_raw")) == 0, F.lit(True))
    if "row_hash" in has:
        invalid = invalid | ~F.coalesce(F.col("row_hash").rlike(HASH), F.lit(False))
    if "expected_item" in has:
        invalid = invalid | ~F.col("canonical_id").eqNullSafe(F.col("expected_item"))
    unknown = (F.col("source_role") != FINAL_ROLE) | F.col("manifest").isNull()
    if "fetched_at" in has:
        unknown = unknown | ~is_zoned_timestamp(F.col("fetched_at"))
    if "dataset_semantics" in has:
        unknown = unknown | F.coalesce(F.col("dataset_semantics") != semantics, F.lit(False))
    return joined.withColumn(
        "reason",
        reject_reason(
            ("fixture", is_synthetic_anywhere(has)),
            ("invalid_market_identity", F.col("name_drift")),
            ("invalid_row", invalid),
            ("invalid_value", (F.col("price_c") < 0) | (F.col("volume_c") < 0)),
            ("provenance_unknown", unknown),
        ),
    )


def quality_by_market_day(checked: DataFrame) -> DataFrame:
    """Counts per (day, market) with a histogram of reasons; zero prices and volumes are invalid."""
    zero = F.when(F.col("price_c") <= 0, "zero_price").when(F.col("volume_c") <= 0, "zero_volume")
    outcome = F.coalesce("reason", zero, F.lit("observed"))
    counted = checked.groupBy("transaction_date", "market_code", outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bucket = F.when(F.col("outcome").isin("observed", "fixture", "provenance_unknown"), F.col("outcome")).otherwise("invalid")
    entry = F.when(F.col("outcome") != "observed", F.struct("outcome", "n"))
    return counted.withColumn("bucket", bucket).groupBy("transaction_date", "market_code").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(f"{b}_rows")
            for b in ("observed", "fixture", "provenance_unknown", "invalid")
        ],
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("reasons"),
    )


def merge_reasons(quality: DataFrame) -> DataFrame:
    """Reason totals over all groups."""
    return quality.select(F.explode("reasons").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("rows"))


# What copies of an observation must agree in; its fetch time and provenance may differ.
_PAYLOAD = ("price_c", "volume_c", "crop_name_raw", "canonical_id", "source_id", "row_hash")


def _scale() -> Column:
    return F.lit("1" + 19 * "0").cast("decimal(20,0)")


def _rank(price: Column, volume: Column) -> Column:
    """One number in the order of (price, volume), nulls first; none of both is negative."""
    part = lambda c: F.coalesce(c.cast("decimal(20,0)"), F.lit(-1)) + F.lit(1)
    return (part(price).cast("decimal(19,0)") * _scale() + part(volume)).cast("decimal(38,0)")


def grid_cells(checked: DataFrame) -> DataFrame:
    """All the grid needs of one (day, market, crop): the stable accepted row, whether accepted copies differ in any
    of their payload, and whether rows of unknown provenance were there.

    The state of a cell is a few numbers, so facts are hashed into cells without being sorted or carrying texts: the
    row of the lowest price and volume as one number, and two 64-bit hashes of the payload under different seeds,
    which are equal for all copies if the copies are.
    """
    accepted = F.col("reason").isNull()
    payload = [F.col(c) for c in _PAYLOAD if c in checked.columns]
    hashes = [F.when(accepted, F.xxhash64(F.lit(seed), *[c.isNull() for c in payload], *payload)) for seed in (1, 2)]
    cells = checked.groupBy("transaction_date", *MARKET_CROP).agg(
        F.min(F.when(accepted, _rank(F.col("price_c"), F.col("volume_c")))).alias("_kept"),
        F.coalesce((F.min(hashes[0]) != F.max(hashes[0])) | (F.min(hashes[1]) != F.max(hashes[1])), F.lit(False)).alias("has_conflict"),
        F.max(F.coalesce(F.col("reason") == "provenance_unknown", F.lit(False))).alias("has_unknown"),
    )
    amount = lambda c: F.when(c > 0, (c - F.lit(1)).cast("bigint"))
    return cells.select(
        "transaction_date", *MARKET_CROP, amount(F.call_function("div", F.col("_kept"), _scale())).alias("price_c"),
        amount(F.col("_kept") % _scale()).alias("volume_c"), "has_conflict", "has_unknown",
    )


def single_rows(checked: DataFrame) -> DataFrame:
    """One eligible row per (day, market, crop), with a conflict mark when its copies differ."""
    return grid_cells(checked).filter(F.col("price_c").isNotNull()).drop("has_unknown")


def dense_grid(cells: DataFrame, calendar: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every (market, crop, day) of the calendar with an observation status.

    The day list of a market is its calendar, its crops come from an equi-join on the market; a
    missing cell says why it is missing.
    """
    rows = cells.filter(F.col("price_c").isNotNull()).drop("has_unknown")
    crops = rows.select(*MARKET_CROP).distinct()
    covered = manifest_days(eligible_manifests(manifests))
    unknown = cells.filter("has_unknown").select("market_code", "transaction_date").distinct().withColumn(
        "_unknown", F.lit(True)
    )
    days = calendar.withColumnRenamed("calendar_date", "transaction_date").join(
        unknown, ["market_code", "transaction_date"], "left"
    ).join(covered, "transaction_date", "left")
    grid = days.join(crops, "market_code").join(rows, ["transaction_date", *MARKET_CROP], "left")
    status = (
        F.when(is_trade(), "observed")
        .when(F.col("price_c") <= 0, "zero_price")
        .when(F.col("volume_c") <= 0, "zero_volume")
        .when(F.col("_unknown"), "provenance_unknown")
        .when(F.col("manifest").isNull(), "source_unavailable")
        .otherwise("missing")
    )
    grid = grid.withColumn("observation_status", status)
    seen = F.col("observation_status") == "observed"
    return grid.select(
        "transaction_date", *MARKET_CROP, "observation_status", "schedule_status",
        F.when(seen, F.col("price_c")).alias("price_c"),
        F.when(seen, F.col("volume_c")).alias("volume_c"),
        (seen & (F.col("schedule_status") == "scheduled_closed")).alias("calendar_conflict"),
        F.coalesce("has_conflict", F.lit(False)).alias("has_conflict"),
    )


def grid_stats(grid: DataFrame) -> DataFrame:
    """Trailing windows of every grid day.

    The grid is dense, so n days are n rows, and a window sum is the difference of two running
    sums: constant work per row instead of re-adding up to 90 rows for each.
    """
    ordered = Window.partitionBy(*MARKET_CROP).orderBy("transaction_date")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    running = {
        "_value": F.sum(F.coalesce(F.col("price_c") * F.col("volume_c"), zero)).over(upto),
        "_volume": F.sum(F.coalesce("volume_c", zero)).over(upto),
        "_seen": F.count("price_c").over(upto),
    }
    rows = grid.select("transaction_date", *MARKET_CROP, "price_c", "volume_c").withColumns(running)

    def trailing(total: str, days: int) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, days).over(ordered), zero)

    sums = {
        f"{total}_{name}": trailing(total, days)
        for name, (days, _) in WINDOWS.items() for total in running
    }
    columns = []
    for name, (_, minimum) in WINDOWS.items():
        value, volume, count = (F.col(f"{total}_{name}") for total in ("_value", "_volume", "_seen"))
        columns += [
            micro_to_double(ratio_micro_long(value, volume)).alias(f"price_{name}"),
            F.when(count > 0, hundredths_to_double(volume)).alias(f"volume_{name}"),
            count.alias(f"coverage_{name}"),
            F.when(count >= minimum, "valid").otherwise("insufficient").alias(f"status_{name}"),
        ]
    return rows.withColumns(sums).select("transaction_date", *MARKET_CROP, *columns)


def observation_pairs(rows: DataFrame, days: int = 90) -> DataFrame:
    """Each observed day with the observation before it inside the trailing window."""
    traded = rows.filter(is_trade())
    ordered = Window.partitionBy(*MARKET_CROP).orderBy("transaction_date")
    pair = F.lag(F.struct("transaction_date", "price_c")).over(ordered)
    out = traded.withColumn("_before", pair)
    interval = F.datediff("transaction_date", F.col("_before.transaction_date"))
    near = interval < days
    price = hundredths_to_double(F.col("price_c"))
    before = hundredths_to_double(F.col("_before.price_c"))
    return out.select(
        "transaction_date", *MARKET_CROP, price.alias("price"),
        F.when(near, F.col("_before.transaction_date")).alias("previous_date"),
        F.when(near, before).alias("previous_price"),
        F.when(near, interval).alias("interval_days"),
        F.when(near, round6((price / before - F.lit(1.0)) * F.lit(100.0))).alias("change_pct"),
    )


def market_gap(rows: DataFrame, first: int, second: int) -> DataFrame:
    """Same-day, same-crop gap of two named markets, by one conditional aggregate."""
    pair = rows.filter(F.col("market_code").isin(first, second) & is_trade())

    def of(market: int, column: str) -> Column:
        return F.max(F.when(F.col("market_code") == market, hundredths_to_double(F.col(column))))

    sides = pair.groupBy("transaction_date", "crop_code").agg(
        of(first, "price_c").alias("price_a"), of(second, "price_c").alias("price_b"),
        of(first, "volume_c").alias("volume_a"), of(second, "volume_c").alias("volume_b"),
    )
    both = F.col("price_a").isNotNull() & F.col("price_b").isNotNull()
    return sides.select(
        "*",
        F.when(both, round6(F.col("price_a") - F.col("price_b"))).alias("absolute_gap"),
        F.when(both, round6((F.col("price_a") / F.col("price_b") - F.lit(1.0)) * F.lit(100.0))).alias("relative_gap_pct"),
        F.when(both, "comparable").otherwise("not_comparable").alias("comparison_status"),
    )


def market_coverage(rows: DataFrame) -> DataFrame:
    """Distinct valid days and crops per market."""
    return rows.filter(is_trade()).groupBy("market_code").agg(
        F.count_distinct("transaction_date").alias("valid_days"),
        F.count_distinct("crop_code").alias("observed_crops"),
        F.max("transaction_date").alias("last_valid_date"),
    )


def scaled_marks(daily: DataFrame, group: str) -> DataFrame:
    """Price on 0..1 between the group's extremes (0.5 when equal), square-root scaled volume.

    Extremes come from a combinable aggregate joined back, so a hot group is not gathered.
    """
    from marketpanel.operators.skew import attach

    extremes = daily.groupBy(group).agg(
        F.min("price").alias("_low"), F.max("price").alias("_high"), F.max("volume").alias("_most")
    )
    joined = attach(daily, extremes, [group])
    span = F.col("_high") - F.col("_low")
    return joined.withColumns({
        "price_scaled": round6(F.when(span > 0, (F.col("price") - F.col("_low")) / span).otherwise(F.lit(0.5))),
        "volume_scaled": round6(F.sqrt(F.col("volume") / F.col("_most"))),
    }).drop("_low", "_high", "_most")
