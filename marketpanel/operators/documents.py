"""Published documents: nested rows a scope or a grid is published as, and contracts that derive them again.

A contract unnests a document, derives what follows from its own rows and reports every path that differs. Nested
lists are bounded by what a document is: the items and markets of a scope, the days of a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.numeric import round6
from marketpanel.operators.contracts import HASH, broken
from marketpanel.operators.scope import MARKET_CROP
from marketpanel.schemas import MARKET_STATES, MINIMUM_MARKETS, WINDOWS

GRID_DAYS = 90
# Fixed values of the closed enumerations.
OBSERVATION_STATES = ("observed", "zero_price", "zero_volume", "provenance_unknown", "source_unavailable", "missing")
SCHEDULE_STATES = ("expected_open", "exceptional_open", "scheduled_closed", "unknown")
DAY_STATES = ("traded", "no_valid_trade", "scheduled_closed", "missing", "calendar_feed_discrepancy")
ITEM_STATES = ("observed", "no_valid_trade", "no_scope_observation")
GATE_STATES = ("insufficient", "not_evaluated")
_PATHS = "array<struct<rule:string,path:string>>"


def _one(rule: str, path: Column | str, bad: Column) -> Column:
    held = F.lit(path) if isinstance(path, str) else path
    entry = F.array(F.struct(F.lit(rule).alias("rule"), held.alias("path")))
    return F.when(broken(bad), entry).otherwise(F.array().cast(_PATHS))


def _each(rule: str, rows: str, label, bad) -> Column:
    """One entry a nested row that breaks a rule."""
    found = F.filter(rows, lambda r: broken(bad(r)))
    return F.transform(found, lambda r: F.struct(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rows}["), F.coalesce(label(r).cast("string"), F.lit("null")), F.lit("]")).alias("path")))


def _paths(documents: DataFrame, keys: Sequence[str], entries: Sequence[Column]) -> DataFrame:
    return documents.select(*keys, F.explode(F.concat(*entries)).alias("v")).select(*keys, "v.*")


def scope_violations(documents: DataFrame, keys: Sequence[str] = ("scope", "as_of_date")) -> DataFrame:
    """Broken rules of scope documents, one row a rule and path: (keys, rule, path).

    A document has as_of_date, requested_date, publication_status, analysis_status, failure_reason, snapshot_hash,
    expected_markets, observed_markets, scope_status and the lists markets (market_code, day_status, row_count,
    valid_rows, schedule_status), items (canonical_id, status, price, volume, market_count, market_codes,
    previous_price, price_7d, price_30d, price_90d, volatility_7d, gate_status, reason_codes) and observations
    (market_code, observation_period, price, quantity, value_status). States must follow from counts, and nulls from
    states; a failed document claims nothing. An unknown value breaks its rule.
    """
    failed = F.col("analysis_status") == "failed"
    empty = lambda c: F.size(c) == 0
    codes = F.transform("markets", lambda m: m["market_code"])
    seen = F.size(F.filter("markets", lambda m: m["valid_rows"] > 0))
    named = F.transform("items", lambda i: i["canonical_id"])
    scope_status = F.when(seen == 0, "no_scope_observation").when(seen == F.size("markets"), "all_markets_observed").otherwise("partial_markets_observed")
    day = lambda m: (
        F.when((m["valid_rows"] > 0) & (m["schedule_status"] == "scheduled_closed"), "calendar_feed_discrepancy").when(m["valid_rows"] > 0, "traded")
        .when(m["row_count"] > 0, "no_valid_trade").when(m["schedule_status"] == "scheduled_closed", "scheduled_closed").otherwise("missing")
    )
    observed = lambda i: i["status"] == "observed"
    measures = ("price", "volume", "market_count", "market_codes", "previous_price", "price_7d", "price_30d", "price_90d", "volatility_7d")

    def claims(i: Column) -> Column:
        any_of = F.lit(False)
        for c in measures:
            any_of = any_of | i[c].isNotNull()
        return any_of

    market, item, place = (lambda m: m["market_code"]), (lambda i: i["canonical_id"]), (lambda x: x["market_code"])
    both = [
        _one("dates", "as_of_date", F.col("as_of_date") > F.col("requested_date")),
        _one("publication_status", "publication_status", ~F.col("publication_status").isin(*MARKET_STATES)),
        _one("analysis_status", "analysis_status", ~F.col("analysis_status").isin("published", "failed")),
    ]
    if_failed = [
        _one("failed_without_reason", "failure_reason", F.length(F.trim("failure_reason")) == 0),
        _one("failed_with_hash", "snapshot_hash", F.col("snapshot_hash").isNotNull()),
        _one("failed_with_coverage", "scope_status", ~((F.col("expected_markets") == 0) & (F.col("observed_markets") == 0) & (F.col("scope_status") == "analysis_failed"))),
        _one("failed_with_rows", "items", ~(empty("markets") & empty("items") & empty("observations"))),
    ]
    if_published = [
        _one("published_with_failure", "failure_reason", F.col("failure_reason").isNotNull()),
        _one("snapshot_hash", "snapshot_hash", ~F.col("snapshot_hash").rlike(HASH)),
        _one("expected_markets", "expected_markets", empty("markets") | (F.size("markets") != F.col("expected_markets"))),
        _one("market_codes_unique", "markets", F.size(F.array_distinct(codes)) != F.size("markets")),
        _one("observed_markets", "observed_markets", F.col("observed_markets") != seen),
        _one("scope_status", "scope_status", F.col("scope_status") != scope_status),
        _each("market_schedule", "markets", market, lambda m: ~m["schedule_status"].isin(*SCHEDULE_STATES)),
        _each("market_day_status", "markets", market, lambda m: ~m["day_status"].isin(*DAY_STATES) | (m["day_status"] != day(m))),
        _one("items_listed", "items", empty("items")),
        _one("item_ids_unique", "items", F.size(F.array_distinct(named)) != F.size("items")),
        _each("item_status", "items", item, lambda i: ~i["status"].isin(*ITEM_STATES)),
        _each("item_gate", "items", item, lambda i: ~i["gate_status"].isin(*GATE_STATES) | (F.size(i["reason_codes"]) < 1)),
        _each("observed_price", "items", item, lambda i: observed(i) & broken(~(i["price"] > 0))),
        _each("observed_markets_known", "items", item, lambda i: observed(i) & broken(F.size(F.array_except(i["market_codes"], codes)) > 0)),
        _each("item_market_count", "items", item, lambda i: observed(i) & broken(i["market_count"] != F.size(i["market_codes"]))),
        _each("few_markets_gate", "items", item, lambda i: observed(i) & (i["market_count"] < MINIMUM_MARKETS) & (i["gate_status"] != "insufficient")),
        _each("unobserved_with_values", "items", item, lambda i: ~observed(i) & claims(i)),
        _each("unobserved_gate", "items", item, lambda i: ~observed(i) & (i["gate_status"] != "insufficient")),
        _each("observation_scope", "observations", place, lambda x: (x["observation_period"] != F.col("as_of_date")) | ~F.array_contains(codes, x["market_code"])),
        _each("observation_value", "observations", place, lambda x: x["value_status"] != F.when((x["price"] > 0) & (x["quantity"] > 0), "valid").otherwise("excluded_zero_price_or_volume")),
    ]
    of_state = F.when(failed, F.concat(*if_failed)).otherwise(F.concat(*if_published))
    return _paths(documents, keys, [*both, of_state])


def as_of_days(dates: DataFrame, days: int = GRID_DAYS) -> DataFrame:
    """(as_of_date, transaction_date) of all days of each document, so that rows join by equality."""
    window = F.sequence(F.date_sub("as_of_date", days - 1), F.col("as_of_date"))
    return dates.select("as_of_date", F.explode(window).alias("transaction_date"))


def grid_series(grid: DataFrame, dates: DataFrame) -> DataFrame:
    """Series documents (as_of_date, market_code, crop_code, days): the grid's last 90 days up to each date."""
    fields = ("transaction_date", "observation_status", "schedule_status", "calendar_conflict", "price_c", "volume_c", "row_hash")
    return grid.join(as_of_days(dates), "transaction_date").groupBy("as_of_date", *MARKET_CROP).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("days")
    )


def _window(days: int) -> tuple[Column, Column, Column]:
    """Volume-weighted price, volume and number of observed days of the last `days` of a series."""
    late = F.filter("days", lambda d, i: i >= F.size("days") - days)
    seen = F.filter(late, lambda d: d["observation_status"] == "observed")
    total = lambda of: F.aggregate(F.transform(seen, of), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    value = total(lambda d: d["price_c"].cast("decimal(19,0)") * d["volume_c"].cast("decimal(19,0)"))
    volume = total(lambda d: d["volume_c"].cast("decimal(19,0)"))
    # Half up to six digits, as hundredths become millionths by 10,000.
    micro = F.floor((2 * value * 10000 + volume) / F.nullif(2 * volume, F.lit(0).cast("decimal(38,0)")))
    return F.when(volume > 0, micro.cast("double") / 1e6), volume.cast("double") / 100.0, F.size(seen).cast("bigint")


def derived_statistics(series: DataFrame) -> DataFrame:
    """Windows and last two observed days of each series document, from its own days."""
    columns = []
    for name, (days, least) in WINDOWS.items():
        price, volume, count = _window(days)
        columns += [
            price.alias(f"price_{name}"), F.when(count > 0, volume).alias(f"volume_{name}"), count.alias(f"coverage_{name}"),
            F.when(count >= least, "valid").otherwise("insufficient").alias(f"status_{name}"),
        ]
    seen = F.filter("days", lambda d: d["observation_status"] == "observed")
    last, before = F.try_element_at(seen, F.lit(-1)), F.try_element_at(seen, F.lit(-2))
    # A price of zero is a violation of its own and must not stop the job.
    ratio = (last["price_c"].cast("double") / 100.0) / F.nullif(before["price_c"].cast("double") / 100.0, F.lit(0.0))
    columns += [
        last["transaction_date"].alias("latest_date"), before["transaction_date"].alias("previous_date"), (before["price_c"].cast("double") / 100.0).alias("previous_price"),
        F.datediff(last["transaction_date"], before["transaction_date"]).cast("bigint").alias("interval_days"),
        round6((ratio - F.lit(1.0)) * F.lit(100.0)).alias("change_pct"),
    ]
    return series.select("as_of_date", *MARKET_CROP, *columns)


def _keyed_paths(stored: DataFrame, derived: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(as_of_date, rule, path) of stored rows that are missing, repeated, unknown or differ from the derived ones."""
    fields = [c for c in derived.columns if c not in keys]
    counted = stored.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    left = counted.select(*keys, F.struct(*fields).alias("_s"), "_n")
    right = derived.select(*keys, F.struct(*fields).alias("_d"))
    path = F.concat_ws("/", *[F.col(k).cast("string") for k in keys if k != "as_of_date"])
    entries = [
        _one(f"{label}.missing", path, F.col("_s").isNull()), _one(f"{label}.unknown", path, F.col("_d").isNull()), _one(f"{label}.repeated", path, F.coalesce("_n", F.lit(1)) > 1),
        *[_one(f"{label}.{c}", path, F.col("_s").isNotNull() & F.col("_d").isNotNull() & ~F.col(f"_s.{c}").eqNullSafe(F.col(f"_d.{c}"))) for c in fields],
    ]
    return _paths(left.join(right, list(keys), "full"), ["as_of_date"], entries)


def grid_violations(series: DataFrame, statistics: DataFrame, comparisons: DataFrame, quality: DataFrame, expected: DataFrame, first: int, second: int) -> DataFrame:
    """Broken rules of grid documents: (as_of_date, rule, path).

    `series` (as_of_date, market_code, crop_code, days) must be there for every `expected` row, hold each of the 90 days
    once and in order, with values where a day is observed and none elsewhere. `statistics` (windows and last two
    observed days a series), `comparisons` (the markets `first` and `second` on the last day, by crop) and `quality`
    (counts a document) are derived again from the series, and every field that differs is named.
    """
    identity = ["as_of_date", *MARKET_CROP]
    observed = lambda d: d["observation_status"] == "observed"
    valued = lambda d: (d["price_c"] > 0) & (d["volume_c"] > 0)
    hashed = lambda d: d["observation_status"].isin("observed", "zero_price", "zero_volume")
    day = lambda d: F.concat_ws("/", F.col("market_code").cast("string"), "crop_code", d["transaction_date"].cast("string"))
    whole = F.sequence(F.date_sub("as_of_date", GRID_DAYS - 1), F.col("as_of_date"))
    name = F.concat_ws("/", F.col("market_code").cast("string"), "crop_code")
    of_days = _paths(series, ["as_of_date"], [
        _one("series.days", name, ~F.transform("days", lambda d: d["transaction_date"]).eqNullSafe(whole)),
        _each("series.status", "days", day, lambda d: ~d["observation_status"].isin(*OBSERVATION_STATES)),
        _each("series.schedule", "days", day, lambda d: ~d["schedule_status"].isin(*SCHEDULE_STATES)),
        _each("series.conflict", "days", day, lambda d: d["calendar_conflict"] != (observed(d) & (d["schedule_status"] == "scheduled_closed"))),
        _each("series.values", "days", day, lambda d: F.when(observed(d), ~F.coalesce(valued(d), F.lit(False))).otherwise(d["price_c"].isNotNull() | d["volume_c"].isNotNull())),
        _each("series.hash", "days", day, lambda d: F.when(hashed(d), ~F.coalesce(d["row_hash"].rlike(HASH), F.lit(False))).otherwise(d["row_hash"].isNotNull())),
    ])
    there = _keyed_paths(series.select(*identity), expected.select(*identity), identity, "series")
    of_statistics = _keyed_paths(statistics, derived_statistics(series), identity, "statistics")

    last = F.element_at("days", -1)
    side = lambda market, field: F.max(F.when(F.col("market_code") == market, last[field]))
    pairs = series.groupBy("as_of_date", "crop_code").agg(
        *[side(m, f).alias(f"{f}_{k}") for k, m in (("a", first), ("b", second)) for f in ("price_c", "volume_c", "observation_status")])
    both = (F.col("observation_status_a") == "observed") & (F.col("observation_status_b") == "observed")
    money = lambda c: F.col(c).cast("double") / 100.0
    derived = pairs.select(
        "as_of_date", "crop_code", money("price_c_a").alias("price_a"), money("price_c_b").alias("price_b"), money("volume_c_a").alias("volume_a"), money("volume_c_b").alias("volume_b"),
        F.when(both, round6(money("price_c_a") - money("price_c_b"))).alias("absolute_gap"),
        F.when(both, round6((money("price_c_a") / F.nullif(money("price_c_b"), F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0))).alias("relative_gap_pct"),
        F.when(F.coalesce(both, F.lit(False)), "comparable").otherwise("not_comparable").alias("comparison_status"),
    )
    of_comparisons = _keyed_paths(comparisons, derived, ["as_of_date", "crop_code"], "comparisons")
    seen = last["observation_status"] == "observed"
    counts = series.groupBy("as_of_date").agg(
        F.sum(F.size(F.filter("days", lambda d: d["calendar_conflict"]))).alias("calendar_conflicts"),
        F.count_distinct(F.when(seen, F.col("market_code"))).alias("observed_market_count"), F.count_distinct(F.when(seen, F.col("crop_code"))).alias("observed_crop_count"),
    )
    of_quality = _keyed_paths(quality, counts, ["as_of_date"], "quality")
    return of_days.unionByName(there).unionByName(of_statistics).unionByName(of_comparisons).unionByName(of_quality)
