"""Certified lots, independent market events, snapshot choice and row-count guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.dates import event_date, lenient_date
from marketpanel.functions.numeric import parse_amount
from marketpanel.functions.text import coarse_place, hash_text, reject_reason, text_or_null
from marketpanel.schemas import REGISTRY_FIELDS, REGISTRY_FORBIDDEN

# Fixed value: prefix of published event ids.
EVENT_PREFIX = "h44:"


def name_lookup(items: DataFrame) -> DataFrame:
    """Exact product names of an item: display name, aliases and registry names."""
    names = F.array_distinct(F.concat(F.array("display_name"), "aliases", "traceability_names"))
    return items.select(F.explode(names).alias("name"), "canonical_id")


def name_conflicts(lookup: DataFrame, key: str = "name") -> DataFrame:
    """Names or codes which map to several items."""
    return lookup.groupBy(key).agg(
        F.min("canonical_id").alias("first_item"), F.max("canonical_id").alias("last_item")
    ).filter("first_item <> last_item")


def validity(valid_date: Column, as_of: Column) -> Column:
    return (
        F.when(valid_date.isNull(), "unknown").when(valid_date >= as_of, "active").otherwise("expired")
    )


def minimized_lots(raw: DataFrame, items: DataFrame, as_of: str, extra: Sequence[str] = ()) -> DataFrame:
    """Whitelisted fields of registry lots; personal fields never leave this select."""
    lookup = name_lookup(items).withColumnRenamed("canonical_id", "_item")
    name = text_or_null(F.col("ProductName"))
    joined = raw.withColumn("name", name).join(lookup, "name", "left")
    valid = lenient_date(F.col("ValidDate"))
    out = joined.select(
        *extra,
        text_or_null(F.col("Tracecode")).alias("tracecode"),
        text_or_null(F.col("Producer")).alias("producer"),
        text_or_null(F.col("OrgID")).alias("org_id"),
        F.col("name").alias("product_name_raw"),
        F.col("_item").alias("canonical_id"),
        coarse_place(F.col("Place")).alias("place"),
        lenient_date(F.col("PackDate")).alias("pack_date"),
        text_or_null(F.col("CertificationName")).alias("certification_name"),
        valid.alias("valid_date"),
        validity(valid, F.lit(as_of).cast("date")).alias("certification_status"),
        lenient_date(F.col("Log_UpdateTime")).alias("source_updated_date"),
    )
    leaked = set(out.columns) & set(REGISTRY_FORBIDDEN)
    if leaked:
        raise ValueError(f"forbidden fields in a published lot: {sorted(leaked)}")
    return out


def published_lots(lots: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per tracecode: exact copies collapse and are counted, unequal ones are marked.

    The state per tracecode is one payload and two hashes, however many copies arrive.
    """
    payload = [c for c in REGISTRY_FIELDS if c != "tracecode"]
    kept = lots.filter(F.col("tracecode").isNotNull() & F.col("canonical_id").isNotNull())
    hashed = kept.withColumn("_hash", hash_text(*[F.col(c) for c in payload]))
    return hashed.groupBy(*group, "tracecode").agg(
        F.count(F.lit(1)).alias("copies"),
        (F.min("_hash") != F.max("_hash")).alias("is_conflict"),
        F.min(F.struct("_hash", *payload)).alias("_row"),
    ).select(*group, "tracecode", *[F.col(f"_row.{c}").alias(c) for c in payload], "copies", "is_conflict")


def lot_profile(lots: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of one snapshot, from one pass: lots fold per tracecode, tracecodes per snapshot."""
    payload = [c for c in REGISTRY_FIELDS if c != "tracecode"]
    coded, mapped = F.col("tracecode").isNotNull(), F.col("canonical_id").isNotNull()
    digest = F.when(coded & mapped, hash_text(*[F.col(c) for c in payload]))
    kept = ("certification_status", "org_id", "canonical_id")
    cells = lots.withColumn("_hash", digest).groupBy(*group, "tracecode").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_hash").alias("_copies"),
        (F.min("_hash") != F.max("_hash")).alias("_conflict"),
        F.min(F.when(F.col("_hash").isNotNull(), F.struct("_hash", *kept))).alias("_row"),
    ).select(*group, "tracecode", "_rows", "_copies", "_conflict", "_row.*")
    published = F.col("_copies") > 0
    status = F.col("certification_status")
    return cells.groupBy(*group).agg(
        F.sum("_rows").alias("raw_record_count"),
        F.sum(F.when(coded, 0).otherwise(F.col("_rows"))).alias("missing_tracecode_count"),
        F.sum(F.when(coded, F.col("_rows") - F.col("_copies")).otherwise(0)).alias("unmapped_record_count"),
        F.count_if(published).alias("published_record_count"),
        F.count_if(status == "active").alias("active_record_count"),
        F.count_if(status == "expired").alias("expired_record_count"),
        F.count_if(status == "unknown").alias("unknown_validity_count"),
        F.count_distinct("org_id").alias("operator_count"),
        F.count_distinct("canonical_id").alias("mapped_item_count"),
        F.sum(F.when(published, F.col("_copies") - 1).otherwise(0)).alias("duplicate_count"),
        F.count_if("_conflict").alias("conflict_count"),
    )


def normalized_events(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Typed market events, one row per content id, item by code and else by exact name.

    `requested_date` is the day a batch asked for; an event of another day is rejected.
    """
    fields = ["trade_date", "crop_code", "crop_name", "market_code", "market_name", "amount", "volume", "class_code"]
    identified = raw.withColumn(
        "event_id", F.concat(F.lit(EVENT_PREFIX), hash_text(*[F.col(c) for c in fields]))
    )
    unique = identified.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("requested_date", *fields)).alias("r")
    ).select("event_id", "copies", "r.*")
    codes = items.select(F.explode("market_crop_codes").alias("crop_code"), F.col("canonical_id").alias("_by_code"))
    names = name_lookup(items).select(F.col("name").alias("crop_name"), F.col("canonical_id").alias("_by_name"))
    cleaned = unique.withColumns(
        {c: text_or_null(F.col(c)) for c in ("crop_code", "crop_name", "market_code", "market_name", "class_code")}
    )
    mapped = cleaned.join(codes, "crop_code", "left").join(names, "crop_name", "left")
    day = event_date(F.col("trade_date"))
    amount, volume = parse_amount(F.col("amount")), parse_amount(F.col("volume"))
    incomplete = F.coalesce(*[F.when(F.col(c).isNull(), True) for c in
                              ("crop_code", "crop_name", "market_code", "market_name", "class_code")])
    return mapped.select(
        "event_id", "copies", "requested_date", day.alias("transaction_date"), "market_code", "market_name",
        "crop_code", F.col("crop_name").alias("crop_name_raw"),
        F.coalesce("_by_code", "_by_name").alias("canonical_id"),
        amount.alias("amount"), volume.alias("volume"), "class_code",
        reject_reason(
            ("incomplete_identity", incomplete),
            ("bad_date", day.isNull()),
            ("outside_requested_date", day != F.col("requested_date")),
            ("bad_amount", amount.isNull()),
            ("bad_volume", volume.isNull()),
        ).alias("reject"),
    )


def event_profile(events: DataFrame) -> DataFrame:
    accepted = F.col("reject").isNull()
    published = accepted & F.col("canonical_id").isNotNull()
    cells = events.groupBy("requested_date", "canonical_id", "market_code").agg(
        F.sum("copies").alias("raw"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(published).alias("published"),
        F.count_if(accepted & F.col("canonical_id").isNull()).alias("unmapped"),
        F.count_if(~accepted).alias("rejected"),
    )
    has = F.col("published") > 0
    return cells.groupBy("requested_date").agg(
        F.sum("raw").alias("raw_record_count"),
        F.sum("published").alias("published_record_count"),
        F.count_distinct(F.when(has, F.col("canonical_id"))).alias("mapped_item_count"),
        F.count_distinct(F.when(has, F.col("market_code"))).alias("market_count"),
        F.sum("unmapped").alias("unmapped_record_count"),
        F.sum(F.col("raw") - F.col("rows")).alias("duplicate_count"),
        F.sum("rejected").alias("rejected_record_count"),
    )


def choose_snapshot(requested: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshot per requested day: its own dated one, else the current one when it carries the same
    date, else the fixture; a snapshot of another day is never borrowed.

    `snapshots` has (kind, as_of_date, records) with kind daily, current or fixture (no date).
    """
    rank = F.when(F.col("kind") == "daily", 1).when(F.col("kind") == "current", 2)
    dated = snapshots.filter(F.col("kind") != "fixture").groupBy(
        F.col("as_of_date").alias("requested_date")
    ).agg(F.min_by(F.struct("kind", "records"), rank).alias("s"))
    fallback = snapshots.filter(F.col("kind") == "fixture").select(F.max("records")).scalar()
    return requested.join(dated, "requested_date", "left").select(
        "requested_date",
        F.coalesce("s.kind", F.lit("fixture")).alias("kind"),
        F.coalesce("s.records", fallback).alias("records"),
    )


def stale_lots(lots: DataFrame, as_of: str) -> DataFrame:
    """Last good lots for a later day: validity is judged again, the rows are marked stale."""
    return lots.withColumns({
        "certification_status": validity(F.col("valid_date"), F.lit(as_of).cast("date")),
        "source_status": F.lit("stale"),
    })


def stale_profile(profile: DataFrame, lots: DataFrame, group: Sequence[str], as_of: str) -> DataFrame:
    """A stored profile carried on to a later day: lots whose status changes are taken from its old count and added to
    the new one. Of the published `lots` only those that change are counted, so no snapshot is profiled again."""
    later = validity(F.col("valid_date"), F.lit(as_of).cast("date"))
    changed = lots.withColumn("_later", later).filter(F.col("certification_status") != F.col("_later"))
    names = {"active": "active_record_count", "expired": "expired_record_count", "unknown": "unknown_validity_count"}
    moved = changed.groupBy(*group).agg(*[
        (F.count_if(F.col("_later") == s) - F.count_if(F.col("certification_status") == s)).alias(f"_d_{s}") for s in names
    ])
    joined = profile.join(moved, list(group), "left")
    return joined.withColumns({
        **{c: F.col(c) + F.coalesce(f"_d_{s}", F.lit(0)) for s, c in names.items()}, "as_of_date": F.lit(as_of).cast("date"), "source_status": F.lit("stale"),
    }).drop(*[f"_d_{s}" for s in names])


def shrink_guard(counts: DataFrame, by: str, snapshot: str, rows: str, percent: int = 80) -> DataFrame:
    """Accept a snapshot unless it falls below `percent` of the last accepted one.

    The last accepted count depends on earlier verdicts, so the snapshots of a source are folded in
    order; a source has one entry per snapshot day, never one per record.
    """
    entry = F.struct(F.col(snapshot).alias("s"), F.col(rows).alias("n"))
    history = counts.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_h"))
    verdict_type = "array<struct<s:date,n:bigint,last_good:bigint,accepted:boolean>>"
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(verdict_type).alias("out"))

    def step(state: Column, item: Column) -> Column:
        ok = state["last"].isNull() | (item["n"] * 100 >= state["last"] * percent)
        row = F.struct(item["s"].alias("s"), item["n"].alias("n"), state["last"].alias("last_good"), ok.alias("accepted"))
        return F.struct(
            F.when(ok, item["n"]).otherwise(state["last"]).alias("last"),
            F.concat(state["out"], F.array(row)).alias("out"),
        )

    folded = history.select(by, F.explode(F.aggregate("_h", start, step, lambda s: s["out"])).alias("v"))
    return folded.select(
        by, F.col("v.s").alias(snapshot), F.col("v.n").alias(rows),
        F.col("v.last_good").alias("last_good_rows"), F.col("v.accepted").alias("is_accepted"),
    )


def category_shrink(counts: DataFrame, by: str, snapshot: str, rows: str) -> DataFrame:
    """Categories with fewer rows than in the snapshot before."""
    order = Window.partitionBy(by).orderBy(snapshot)
    return counts.withColumn("previous_rows", F.lag(rows).over(order)).withColumn(
        "has_shrunk", F.coalesce(F.col(rows) < F.col("previous_rows"), F.lit(False))
    )


def availability(items: DataFrame, market: DataFrame, lots: DataFrame, events: DataFrame) -> DataFrame:
    """Per item: market rows, active lots, events, and what is absent."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("canonical_id").agg(F.count(F.lit(1)).alias(name))

    per_lot = lots.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("lots"), F.count_if(F.col("certification_status") == "active").alias("active_lots")
    )
    out = items.select("canonical_id", "display_name")
    for df in (counted(market, "market_rows"), per_lot, counted(events, "events")):
        out = out.join(df, "canonical_id", "left")
    out = out.fillna(0, ["market_rows", "lots", "active_lots", "events"])
    return out.withColumns({
        "has_market": F.col("market_rows") > 0, "has_active_lot": F.col("active_lots") > 0,
    })
