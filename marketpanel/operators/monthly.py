"""Monthly statistics: revisions, knowledge cut-off, description, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.dates import named_period, shift_months
from marketpanel.functions.numeric import change_pct, direction, per_kilogram, round6
from marketpanel.operators.skew import sequence_runs

# Months needed for a median, and for quartiles.
MEDIAN_MONTHS, QUARTILE_MONTHS = 3, 4


def revision_log(
    submissions: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str = "raw_hash"
) -> DataFrame:
    """Append-only revisions: a submission with the hash of the one before changes nothing, any
    other gets the next number."""
    starts = sequence_runs(submissions, keys, order, value, chunk).filter("is_start")
    return starts.withColumnRenamed("run_no", "revision").drop("is_start").withColumn(
        "outcome", F.when(F.col("revision") > 1, "revised").otherwise("added")
    )


def known_revisions(revisions: DataFrame, keys: Sequence[str], cutoff: str) -> DataFrame:
    """Latest revision known on the cut-off day; a later one is invisible. Combinable, so a period
    with very many revisions is reduced before the shuffle."""
    visible = revisions.filter(F.col("known_at") <= F.lit(cutoff).cast("date"))
    rest = [c for c in revisions.columns if c not in (*keys, "revision")]
    return visible.groupBy(*keys).agg(
        F.max("revision").alias("revision"),
        F.max_by(F.struct(*rest), F.col("revision")).alias("_row"),
        F.count(F.lit(1)).alias("revision_count"),
    ).select(*keys, "revision", "revision_count", "_row.*")


def revision_gaps(revisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose numbers are not 1..n, each once."""
    return revisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("revision").alias("first"), F.max("revision").alias("last"),
        F.count_distinct("revision").alias("numbers"),
    ).filter("first <> 1 OR last <> rows OR numbers <> rows")


def period_evidence(period: Column, name: Column) -> Column:
    """Where a period rests: the resource name, the operator, or a conflict between both."""
    named = named_period(name)
    return (
        F.when(named.isNull(), "operator").when(named == period, "resource_name").otherwise("conflict")
    )


def snapshot_violations(revisions: DataFrame, parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Broken rules of monthly snapshots: (keys, rule, revision).

    `revisions` has (keys, revision, period, resource_name, period_evidence, contract, row_count), `parsed` what the raw
    text of each (keys, revision) gives when it is read again: (keys, revision, contract, rows). Numbers must be 1..n, and
    what was recorded must be what the raw text says.
    """
    again = parsed.select(*keys, "revision", F.col("contract").alias("_contract"), F.col("rows").alias("_rows"), F.lit(True).alias("_read"))
    joined = revisions.join(again, [*keys, "revision"], "left")
    rules = [
        ("not_read_again", F.col("_read").isNull()),
        ("contract", F.col("_read") & ~F.col("contract").eqNullSafe(F.col("_contract"))),
        ("row_count", F.col("_read") & ~F.col("row_count").eqNullSafe(F.col("_rows"))),
        ("period_evidence", ~F.col("period_evidence").eqNullSafe(period_evidence(F.col("period"), F.col("resource_name")))),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    rows = joined.select(*keys, F.explode(broken).alias("rule"), "revision")
    gaps = revision_gaps(revisions, keys).select(*keys, F.lit("numbering").alias("rule"), F.lit(None).cast("bigint").alias("revision"))
    return rows.unionByName(gaps)


def describe(months: DataFrame, item: str, value: str = "value", status: str = "value_status") -> DataFrame:
    """Description of the valid months of each item.

    Position compares the latest month with the quartiles of the months before it. Every group is
    one item's months.
    """
    valid = months.filter(F.col(status) == "valid").select(item, "period", F.col(value).alias("_v"))
    latest = F.max("period").over(Window.partitionBy(item))
    marked = valid.withColumn("_latest", latest)
    is_last = F.col("period") == F.col("_latest")
    parts = [0.25, 0.75]
    stats = marked.groupBy(item).agg(
        F.count(F.lit(1)).alias("valid_month_count"),
        F.max("_latest").alias("latest_valid_period"),
        F.max(F.when(is_last, F.col("_v"))).alias("_now"),
        F.median("_v").alias("_median"),
        F.percentile("_v", parts).alias("_quartiles"),
        F.percentile(F.when(~is_last, F.col("_v")), parts).alias("_earlier"),
        F.max(F.when(F.col("period") == shift_months(F.col("_latest"), -1), F.col("_v"))).alias("_month_ago"),
        F.max(F.when(F.col("period") == shift_months(F.col("_latest"), -12), F.col("_v"))).alias("_year_ago"),
    )
    n, now = F.col("valid_month_count"), F.col("_now")
    enough = n - 1 >= QUARTILE_MONTHS
    return stats.select(
        item, "valid_month_count", "latest_valid_period",
        round6(now).alias("latest"),
        round6(F.when(n >= MEDIAN_MONTHS, F.col("_median"))).alias("median"),
        round6(F.when(n >= QUARTILE_MONTHS, F.col("_quartiles")[0])).alias("q1"),
        round6(F.when(n >= QUARTILE_MONTHS, F.col("_quartiles")[1])).alias("q3"),
        round6(change_pct(now, F.col("_month_ago"))).alias("mom_pct"),
        round6(change_pct(now, F.col("_year_ago"))).alias("yoy_pct"),
        F.when(enough & (now < F.col("_earlier")[0]), "below_q1")
        .when(enough & (now > F.col("_earlier")[1]), "above_q3")
        .when(enough, "within_iqr").alias("latest_vs_history"),
        F.when(n >= MEDIAN_MONTHS, "valid").otherwise("insufficient").alias("stats_status"),
    )


def month_changes(months: DataFrame, item: str, value: str = "value", status: str = "value_status") -> DataFrame:
    """Change of each valid month against one and twelve calendar months before.

    Calendar months, not rows: a range frame of exactly that month on a month counter finds it or
    nothing, on one sort and without a self-join.
    """
    valid = months.filter(F.col(status) == "valid").select(item, "period", F.col(value).alias("value"))
    counted = valid.withColumn("_month", F.year("period") * 12 + F.month("period"))
    by_month = Window.partitionBy(item).orderBy("_month")
    out = counted.withColumns({
        name: F.max("value").over(by_month.rangeBetween(-back, -back))
        for back, name in ((1, "month_ago"), (12, "year_ago"))
    })
    return out.withColumns({
        "mom_pct": round6(change_pct(F.col("value"), F.col("month_ago"))),
        "yoy_pct": round6(change_pct(F.col("value"), F.col("year_ago"))),
    }).drop("_month")


def retail_items(described: DataFrame, mapping: DataFrame, item: str = "item_raw") -> DataFrame:
    """Description with the reviewed mapping; an item without one is unmapped and taken by mass."""
    joined = described.join(mapping, item, "left")
    by_mass = F.coalesce("mass_basis", F.lit(True))
    return joined.select(
        item,
        F.when(F.col("commodity_family").isNull(), "unmapped").otherwise("reviewed").alias("mapping_status"),
        F.coalesce("commodity_family", F.lit("unknown")).alias("commodity_family"),
        "canonical_id", by_mass.alias("mass_basis"), "valid_month_count", "latest_valid_period",
        F.col("latest").alias("latest_price_raw"),
        F.when(by_mass, per_kilogram(F.col("latest"))).alias("latest_price_per_kg"),
        "mom_pct", "yoy_pct", "latest_vs_history",
        F.when(F.col("latest_vs_history").isNotNull(), "historical_reference").otherwise("insufficient").alias("advice_status"),
    )


def supply_trend(volume: DataFrame, price: DataFrame, item: str = "category") -> DataFrame:
    """Volume and price directions, only when both measures share the latest month and have the
    month before."""
    keep = ("latest_valid_period", "latest", "mom_pct")
    joined = volume.select(item, *[F.col(c).alias(f"volume_{c}") for c in keep]).join(
        price.select(item, *[F.col(c).alias(f"price_{c}") for c in keep]), item, "full"
    )
    both = (
        (F.col("volume_latest_valid_period") == F.col("price_latest_valid_period"))
        & F.col("volume_mom_pct").isNotNull() & F.col("price_mom_pct").isNotNull()
    )
    return joined.withColumns({
        "volume_trend": F.when(both, direction(F.col("volume_mom_pct"))),
        "price_trend": F.when(both, direction(F.col("price_mom_pct"))),
    })


def source_summary(sources: DataFrame, revisions: DataFrame) -> DataFrame:
    """Ingestion status per source: none, the single status, or mixed."""
    state = revisions.groupBy("source").agg(
        F.min("source_status").alias("_low"), F.max("source_status").alias("_high"),
        F.max("period").alias("latest_period"), F.count_distinct("period").alias("periods"),
        F.max("revision").alias("most_revisions"),
    )
    return sources.join(state, "source", "left").select(
        "source",
        F.when(F.col("_low").isNull(), "not_ingested").when(F.col("_low") == F.col("_high"), F.col("_low"))
        .otherwise("mixed").alias("status"),
        "latest_period", F.coalesce("periods", F.lit(0)).alias("periods"),
        F.coalesce("most_revisions", F.lit(0)).alias("most_revisions"),
    )
