"""Trading calendars, publication status, completeness, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.dates import day_sequence

# Reasons by falling priority, after an exceptional opening.
CLOSING_KINDS = ("special", "makeup", "thursday")
REST_CODE, REST_NAME = "rest", "休市"


def year_days(years: DataFrame) -> DataFrame:
    """Every day of each listed year; other columns are kept."""
    first = F.make_date("year", F.lit(1), F.lit(1))
    last = F.make_date("year", F.lit(12), F.lit(31))
    return years.withColumn("calendar_date", F.explode(day_sequence(first, last)))


def expand_calendar(days: DataFrame, rules: DataFrame) -> DataFrame:
    """Schedule status and reason of each day from rule rows (calendar_date, kind, reason).

    Mondays are closed unless exceptionally open; special, make-up and added days are closed. The
    rule table has at most a few rows per date and is folded to one before the join.
    """
    folded = rules.groupBy("calendar_date").agg(
        F.max(F.col("kind") == "exceptional").alias("_exceptional"),
        *[F.min(F.when(F.col("kind") == k, F.col("reason"))).alias(f"_{k}") for k in CLOSING_KINDS],
    )
    joined = days.join(folded, "calendar_date", "left")
    exceptional = F.coalesce("_exceptional", F.lit(False))
    closing = F.coalesce(*[F.col(f"_{k}") for k in CLOSING_KINDS], F.when(F.weekday("calendar_date") == 0, "monday"))
    status = (
        F.when(exceptional, "exceptional_open")
        .when(closing.isNotNull(), "scheduled_closed")
        .otherwise("expected_open")
    )
    reason = F.when(exceptional, "exceptional_open").otherwise(F.coalesce(closing, F.lit("trading_day")))
    return joined.select(*days.columns, status.alias("schedule_status"), reason.alias("schedule_reason"))


def calendar_violations(calendar: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """Rule dates on the wrong weekday, years whose closed-day count is not the approved one, dates that occur twice and
    years that lack some."""
    weekday = F.weekday("calendar_date")
    wrong = (
        F.when((F.col("kind") == "exceptional") & (weekday != 0), "exceptional_not_monday")
        .when((F.col("kind") == "thursday") & (weekday != 3), "added_closure_not_thursday")
    )
    dates = rules.withColumn("rule", wrong).filter(F.col("rule").isNotNull()).select(
        "rule", F.col("calendar_date").cast("string").alias("key")
    )
    counts = calendar.groupBy(F.year("calendar_date").alias("year")).agg(
        F.count_if(F.col("schedule_status") == "scheduled_closed").alias("closed_days"),
        F.count_distinct("calendar_date").alias("days"),
    ).join(expected, "year").filter("closed_days <> expected_closed_days").select(
        F.lit("closed_day_count").alias("rule"), F.col("year").cast("string").alias("key")
    )
    repeated = calendar.groupBy("calendar_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("date_repeated").alias("rule"), F.col("calendar_date").cast("string").alias("key"))
    year = F.year("calendar_date")
    lacking = calendar.groupBy(year.alias("year")).agg(F.count_distinct("calendar_date").alias("days")).filter(
        F.col("days") != F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    ).select(F.lit("year_incomplete").alias("rule"), F.col("year").cast("string").alias("key"))
    return dates.unionByName(counts).unionByName(repeated).unionByName(lacking)


def is_rest_row() -> Column:
    """Marker row of a closed market."""
    return (F.lower(F.trim("crop_code")) == REST_CODE) & (F.trim("crop_name_raw") == REST_NAME)


def market_status(
    requested: DataFrame,
    observed: DataFrame,
    expected: DataFrame,
    calendar_markets: Sequence[int],
    by: Sequence[str] = ("scope",),
    sources: DataFrame | None = None,
) -> DataFrame:
    """Publication status of every requested day.

    `sources`, if given, has (by, transaction_date, source_status) of the feed itself: a day without rows is then
    failed, delayed or not_checked as its source says, and one that failed is source_unavailable.

    `requested` has (by, transaction_date, schedule_status), `expected` the configured ids. Rows
    are reduced per (day, item) before per day, so the item count never needs a distinct sort of a
    hot day. An unknown schedule leaves the feed decision alone.
    """
    keys = [*by, "transaction_date"]
    rest = is_rest_row()
    cells = observed.groupBy(*keys, "canonical_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(rest).alias("_rest"),
        F.count_if(~rest & F.col("market_code").isin(*calendar_markets)).alias("_calendar"),
    )
    known = expected.select("canonical_id", F.lit(True).alias("_known"))
    seen = F.col("canonical_id").isNotNull()
    days = cells.join(known, "canonical_id", "left").groupBy(*keys).agg(
        F.sum("_rows").alias("observed_record_count"),
        (F.sum("_rows") == F.sum("_rest")).alias("_closed"),
        F.count_if(F.col("_known")).alias("covered_count"),
        F.count_if(seen & F.col("_known").isNull()).alias("_unexpected"),
        (F.sum("_calendar") > 0).alias("_calendar_traded"),
    )
    size = expected.select(F.count(F.lit(1))).scalar()
    rows = requested.join(days, keys, "left").withColumns({
        "observed_record_count": F.coalesce("observed_record_count", F.lit(0)),
        "covered_count": F.coalesce("covered_count", F.lit(0)),
        "expected_count": size,
        "_closed": F.coalesce("_closed", F.lit(False)),
        "calendar_feed_status": F.when(F.col("_calendar_traded"), "available").otherwise("empty"),
    })
    complete = (F.col("covered_count") == F.col("expected_count")) & (F.coalesce("_unexpected", F.lit(0)) == 0)
    has_rows = F.col("observed_record_count") > 0
    rows = rows.withColumns({
        "feed_status": F.when(has_rows & ~F.col("_closed"), "available").otherwise("empty"),
        "feed_state": F.when(complete, "complete").when(F.col("_closed"), "market_closed")
        .when(has_rows, "incomplete").otherwise("pending"),
    })
    if sources is not None:
        silent = F.col("feed_status") == "empty"
        said = F.when(silent & F.col("source_status").isin("failed", "delayed", "not_checked"), F.col("source_status"))
        rows = rows.join(sources.select(*keys, "source_status"), keys, "left").withColumns({
            "feed_status": F.coalesce(said, F.col("feed_status")),
            "calendar_feed_status": F.when(F.col("calendar_feed_status") == "empty", F.coalesce(said, F.lit("empty"))).otherwise(F.col("calendar_feed_status")),
            "feed_state": F.when(~has_rows & (said == "failed"), "source_unavailable").otherwise(F.col("feed_state")),
        }).drop("source_status")
    return rows.withColumn("status", scheduled_state()).drop("_closed", "_unexpected", "_calendar_traded")


def scheduled_state() -> Column:
    """Decision matrix of the feed state against the schedule."""
    closed_day = F.col("schedule_status") == "scheduled_closed"
    open_day = F.col("schedule_status").isin("expected_open", "exceptional_open")
    state, feed = F.col("feed_state"), F.col("feed_status")
    return (
        F.when(closed_day & (F.col("calendar_feed_status") == "available"), "calendar_feed_discrepancy")
        .when(closed_day & state.isin("market_closed", "pending", "source_unavailable"), "market_closed")
        .when(open_day & (feed == "failed"), "source_unavailable")
        .when(open_day & ((state == "market_closed") | feed.isin("empty", "delayed", "not_checked")), "pending")
        .otherwise(state)
    )


def resolve_dates(status: DataFrame, by: Sequence[str] = ("scope",)) -> DataFrame:
    """Newest complete day at or before each requested day (inclusive backward as-of)."""
    upto = Window.partitionBy(*by).orderBy("transaction_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    complete = F.when(F.col("feed_state") == "complete", F.col("transaction_date"))
    return status.withColumn("resolved_date", F.last(complete, ignorenulls=True).over(upto))


def backfill_chunks(ranges: DataFrame, days: int = 4) -> DataFrame:
    """Cut [start_date, end_date] into consecutive requests of at most `days` days."""
    starts = F.sequence("start_date", "end_date", F.expr(f"interval {days} day"))
    keep = [c for c in ranges.columns if c not in ("start_date", "end_date")]
    return ranges.select(*keep, "end_date", F.posexplode(starts).alias("chunk_no", "chunk_start")).select(
        *keep, "chunk_no", "chunk_start",
        F.least(F.date_add("chunk_start", days - 1), "end_date").alias("chunk_end"),
    )


def slot_of(ts: Column, slots: Sequence[str], lead_minutes: int = 2) -> Column:
    """Start of the schedule slot a run belongs to.

    Slots do not overlap, so the owning slot follows from the time itself and the range join of
    runs with slots becomes an equi-join; a hot slot is counted map-side.
    """
    moved = ts + F.expr(f"interval {lead_minutes} minutes")
    day = moved.cast("date")
    owner = None
    for time in sorted(slots, reverse=True):
        start = F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.lit(time)))
        owner = F.when(moved >= start, start) if owner is None else owner.when(moved >= start, start)
    last = F.to_timestamp_ntz(F.concat_ws(" ", F.date_sub(day, 1).cast("string"), F.lit(max(slots))))
    return owner.otherwise(last)


def missed_slots(
    runs: DataFrame, ts: str, slots: Sequence[str], grace_minutes: int = 32, lead_minutes: int = 2
) -> DataFrame:
    """Expected slots with their runs inside [slot - lead, min(slot + grace, next slot - 1 s)]; a
    slot without one asks for a recovery."""
    owned = runs.select(F.col(ts).alias("_ts"), slot_of(F.col(ts), slots, lead_minutes).alias("slot"))
    in_time = F.col("_ts") <= F.col("slot") + F.expr(f"interval {grace_minutes} minutes")
    counted = owned.groupBy("slot").agg(
        F.count_if(in_time).alias("matching_runs"),
        F.max(F.when(in_time, F.col("_ts"))).alias("latest_run"),
    )
    bounds = runs.agg(F.min(F.col(ts).cast("date")).alias("lo"), F.max(F.col(ts).cast("date")).alias("hi"))
    times = F.array(*[F.lit(s) for s in sorted(slots)])
    expected = bounds.select(F.explode(day_sequence(F.col("lo"), F.col("hi"))).alias("day")).select(
        "day", F.explode(times).alias("time")
    ).select(F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), "time")).alias("slot"))
    return expected.join(counted, "slot", "left").select(
        "slot",
        F.coalesce("matching_runs", F.lit(0)).alias("matching_runs"),
        "latest_run",
        F.when(F.col("matching_runs") > 0, "skip").otherwise("dispatch").alias("action"),
    )
