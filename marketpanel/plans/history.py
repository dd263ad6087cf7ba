"""Dated history, snapshots and what is carried on from them."""

import datetime as dt

from pyspark.sql import functions as F

from marketpanel.operators import evidence
from marketpanel.plans import oracle as o
from marketpanel.plans.evidence import LATER, LOTS_SQL, lots
from marketpanel.plans.registry import query
from marketpanel.sources import history
from marketpanel.sources.adapters import SourceSpec
from marketpanel.sources.sinks import materialize, work_folder
from marketpanel.sources.tables import SEMANTICS

FIRST, LAST = dt.date(1997, 3, 17), dt.date(1997, 6, 4)
LEGACY = SourceSpec("src_1", "https://feed.example", "authoritative_final", SEMANTICS, 10, "1.0", "v1")


@query("history_slice", o.with_ctes(o.OBS) + f"""
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, market_code::BIGINT AS market_code, crop_code, price_c, volume_c, source_id,
  CASE WHEN month(transaction_date) % 2 = 0 THEN source_role WHEN source_id = 'src_1' THEN 'authoritative_final' END AS source_role,
  CASE WHEN month(transaction_date) % 2 = 0 THEN source_precedence::BIGINT WHEN source_id = 'src_1' THEN 10 END AS source_precedence
FROM obs WHERE transaction_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""")
def history_slice(t):
    """History of which odd months were written before there were roles; a slice of it with defaults of one source."""
    folder = work_folder(t.spark, "history")
    rows = t.observations.withColumn("dataset_semantics", F.lit(SEMANTICS))
    odd = F.month("transaction_date") % 2 == 1
    history.write_history(rows.filter(odd).drop("source_role", "source_precedence", "dataset_semantics"), folder)
    history.write_history(rows.filter(~odd), folder)
    out = history.history_slice(t.spark, folder, FIRST, LAST, LEGACY)
    return out.select("transaction_date", "market_code", "crop_code", "price_c", "volume_c", "source_id", "source_role", "source_precedence")


@query("snapshot_append", """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders ORDER BY 1 LIMIT 3)
SELECT CAST(make_date(y, 12, 31) AS VARCHAR) AS snapshot_date, CASE WHEN y % 2 = 0 THEN 'written|unchanged|revised' ELSE 'written|unchanged|refused' END AS outcomes,
  count(*) AS records, sum(o_custkey + CASE WHEN y % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS total
FROM orders JOIN y ON year(o_orderdate) = y GROUP BY y""")
def snapshot_append(t):
    """Three yearly snapshots, each appended, appended again in another order, and then with other content, which may
    replace an even year's."""
    folder = work_folder(t.spark, "snapshots")
    orders = t.read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    years = sorted(r.y for r in orders.select("y").distinct().orderBy("y").limit(3).collect())
    said = []
    for year in years:
        rows, day = orders.filter(F.col("y") == year).drop("y"), dt.date(year, 12, 31)
        out = [history.append_snapshot(rows, folder, day), history.append_snapshot(rows.orderBy(F.desc("o_orderkey")), folder, day)]
        try:
            out.append(history.append_snapshot(rows.withColumn("o_custkey", F.col("o_custkey") + 1), folder, day, revise=year % 2 == 0))
        except history.SnapshotChanged:
            out.append("refused")
        said.append((day, "|".join(out)))
    outcomes = t.spark.createDataFrame(said, "snapshot_date date, outcomes string")
    held = history.snapshots(t.spark, folder, "o_orderkey bigint, o_custkey bigint")
    return held.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("records"), F.sum("o_custkey").alias("total")).join(outcomes, "snapshot_date")


@query("stale_profile", LOTS_SQL + f""",
r AS (SELECT feed, tracecode, min({{'h': h, 'v': valid_date, 'o': org_id, 'i': canonical_id}}) AS k FROM lots WHERE tracecode IS NOT NULL AND canonical_id IS NOT NULL GROUP BY ALL)
SELECT feed, '{LATER}' AS as_of_date, 'stale' AS source_status, count(*) AS published_record_count, count(*) FILTER (k.v >= DATE '{LATER}') AS active_record_count,
  count(*) FILTER (k.v < DATE '{LATER}') AS expired_record_count, count(*) FILTER (k.v IS NULL) AS unknown_validity_count, count(DISTINCT k.o) AS operator_count, count(DISTINCT k.i) AS mapped_item_count
FROM r GROUP BY feed""")
def stale_profile(t):
    """The profile of the first day, carried on to the later one by what changes."""
    published = materialize(evidence.published_lots(lots(t), ["feed"]), "stale-lots")
    status = F.col("certification_status")
    profile = published.groupBy("feed").agg(
        F.count(F.lit(1)).alias("published_record_count"), F.count_if(status == "active").alias("active_record_count"), F.count_if(status == "expired").alias("expired_record_count"),
        F.count_if(status == "unknown").alias("unknown_validity_count"), F.count_distinct("org_id").alias("operator_count"), F.count_distinct("canonical_id").alias("mapped_item_count"),
    )
    return evidence.stale_profile(profile, published, ["feed"], LATER)
