"""Monthly statistics, revisions and knowledge time."""

from pyspark.sql import functions as F

from marketpanel.functions import dates, numeric
from marketpanel.operators import monthly
from marketpanel.plans import oracle as o
from marketpanel.plans.registry import query
from marketpanel.sources.sinks import materialize

CUTOFF = "1998-06-30"
CHUNK_BATCHES = 4096
# Fixed values of the test binding: reviewed retail mapping.
MAPPING = (("small ring", "fruit", "ring", True), ("blue bolt", "vegetable", "bolt", False), ("red gear", "vegetable", "gear", True))


def retail_months(t):
    """Mean price per (part name, month) in whole cents; some months are blank or zero."""
    rows = t.observations.filter(F.col("price_c") > 0).groupBy(
        F.col("crop_name_raw").alias("item_raw"), F.trunc("transaction_date", "month").alias("period")
    ).agg(numeric.exact_sum(F.col("price_c")).alias("s"), F.count(F.lit(1)).alias("n"))
    cents = numeric.int_div(F.col("s") * 2 + F.col("n"), F.col("n") * 2)
    m = F.month("period") + F.year("period")
    return rows.select(
        "item_raw", "period",
        F.when(m % 11 == 0, None).when(m % 13 == 0, F.lit(0.0)).otherwise(numeric.hundredths_to_double(cents)).alias("value"),
        F.when(m % 11 == 0, "missing").when(m % 13 == 0, "zero_reported").otherwise("valid").alias("value_status"),
    )


RETAIL = """ret AS (
  SELECT crop_name_raw AS item_raw, CAST(date_trunc('month', transaction_date) AS DATE) AS period,
    CASE WHEN (month(min(transaction_date)) + year(min(transaction_date))) % 11 = 0 THEN NULL WHEN (month(min(transaction_date)) + year(min(transaction_date))) % 13 = 0 THEN 0.0
      ELSE CAST((2 * sum(price_c) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 END AS value
  FROM obs WHERE price_c > 0 GROUP BY crop_name_raw, date_trunc('month', transaction_date)),
val AS (SELECT item_raw AS item, period, value FROM ret WHERE value > 0)"""


def describe_cte(source: str, name: str) -> str:
    return f"""{name}l AS (SELECT *, max(period) OVER (PARTITION BY item) AS lp FROM {source}),
{name}a AS (
  SELECT item, count(*) AS n, max(lp) AS lp, max(value) FILTER (period = lp) AS latest, median(value) AS med,
    quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.25) FILTER (period <> lp) AS e1,
    quantile_cont(value, 0.75) FILTER (period <> lp) AS e3, max(value) FILTER (period = lp - INTERVAL 1 MONTH) AS ma, max(value) FILTER (period = lp - INTERVAL 12 MONTH) AS ya
  FROM {name}l GROUP BY item),
{name} AS (
  SELECT item, n AS valid_month_count, CAST(lp AS VARCHAR) AS latest_valid_period, {o.r6('latest')} AS latest, CASE WHEN n >= 3 THEN {o.r6('med')} END AS median,
    CASE WHEN n >= 4 THEN {o.r6('q1')} END AS q1, CASE WHEN n >= 4 THEN {o.r6('q3')} END AS q3, {o.r6(o.pct('latest', 'ma'))} AS mom_pct, {o.r6(o.pct('latest', 'ya'))} AS yoy_pct,
    CASE WHEN n >= 5 THEN CASE WHEN latest < e1 THEN 'below_q1' WHEN latest > e3 THEN 'above_q3' ELSE 'within_iqr' END END AS latest_vs_history,
    CASE WHEN n >= 3 THEN 'valid' ELSE 'insufficient' END AS stats_status
  FROM {name}a)"""


_DESCRIBED = o.with_ctes(o.OBS, RETAIL, describe_cte("val", "des"))


@query("monthly_describe", _DESCRIBED + "SELECT item AS item_raw, * EXCLUDE (item) FROM des")
def monthly_describe(t):
    return monthly.describe(retail_months(t), "item_raw")


@query("mom_yoy", o.with_ctes(o.OBS, RETAIL) + f"""
SELECT a.item AS item_raw, CAST(a.period AS VARCHAR) AS period, a.value, m.value AS month_ago, y.value AS year_ago,
  {o.r6(o.pct('a.value', 'm.value'))} AS mom_pct, {o.r6(o.pct('a.value', 'y.value'))} AS yoy_pct
FROM val a LEFT JOIN val m ON m.item = a.item AND m.period = a.period - INTERVAL 1 MONTH LEFT JOIN val y ON y.item = a.item AND y.period = a.period - INTERVAL 12 MONTH""")
def mom_yoy(t):
    return monthly.month_changes(retail_months(t), "item_raw")


_MAPPING = "map(item_raw, commodity_family, canonical_id, mass_basis) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in MAPPING
) + ")"


@query("retail_items", _DESCRIBED + f", {_MAPPING}" + f"""
SELECT item AS item_raw, CASE WHEN commodity_family IS NULL THEN 'unmapped' ELSE 'reviewed' END AS mapping_status, coalesce(commodity_family, 'unknown') AS commodity_family,
  canonical_id, coalesce(mass_basis, true) AS mass_basis, valid_month_count, latest_valid_period, latest AS latest_price_raw,
  CASE WHEN coalesce(mass_basis, true) THEN {o.r6('latest / 0.6')} END AS latest_price_per_kg, mom_pct, yoy_pct, latest_vs_history,
  CASE WHEN latest_vs_history IS NOT NULL THEN 'historical_reference' ELSE 'insufficient' END AS advice_status
FROM des LEFT JOIN map ON item_raw = item""")
def retail_items(t):
    text = ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in MAPPING)
    mapping = t.spark.sql(f"SELECT * FROM VALUES {text} AS t(item_raw, commodity_family, canonical_id, mass_basis)")
    return monthly.retail_items(monthly.describe(retail_months(t), "item_raw"), mapping)


@query("unit_convert", o.with_ctes(o.OBS, RETAIL) + f"""
SELECT item_raw, CAST(period AS VARCHAR) AS period, value, CASE WHEN value IS NULL THEN 'missing' WHEN value = 0 THEN 'zero_reported' ELSE 'valid' END AS value_status,
  {o.r6('value / 0.6')} AS price_per_kg, CASE WHEN value > 0 THEN 'up' WHEN value = 0 THEN 'flat' END AS direction FROM ret""")
def unit_convert(t):
    return retail_months(t).withColumns({
        "price_per_kg": numeric.per_kilogram(F.col("value")), "direction": numeric.direction(F.col("value")),
    })


@query("supply_trend", o.with_ctes(o.OBS, """sup AS (SELECT coalesce(canonical_id, 'OTHER') AS item, CAST(date_trunc('month', transaction_date) AS DATE) AS period,
    CAST(sum(volume_c) AS DOUBLE) / 100.0 AS volume, CAST(max(price_c) AS DOUBLE) / 100.0 AS price FROM obs GROUP BY 1, 2),
  sv AS (SELECT item, period, volume AS value FROM sup WHERE volume > 0), sp AS (SELECT item, period, price AS value FROM sup WHERE price > 0 AND (item <> 'LARGE' OR month(period) <> 7))""",
    describe_cte("sv", "dv"), describe_cte("sp", "dp")) + """
SELECT item AS category, dv.latest_valid_period AS volume_latest_valid_period, dv.latest AS volume_latest, dv.mom_pct AS volume_mom_pct,
  dp.latest_valid_period AS price_latest_valid_period, dp.latest AS price_latest, dp.mom_pct AS price_mom_pct,
  CASE WHEN dv.latest_valid_period = dp.latest_valid_period AND dv.mom_pct IS NOT NULL AND dp.mom_pct IS NOT NULL
    THEN CASE sign(dv.mom_pct) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'flat' END END AS volume_trend,
  CASE WHEN dv.latest_valid_period = dp.latest_valid_period AND dv.mom_pct IS NOT NULL AND dp.mom_pct IS NOT NULL
    THEN CASE sign(dp.mom_pct) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'flat' END END AS price_trend
FROM dv FULL JOIN dp USING (item)""")
def supply_trend(t):
    months = t.observations.groupBy(
        F.coalesce("canonical_id", F.lit("OTHER")).alias("category"), F.trunc("transaction_date", "month").alias("period")
    ).agg(
        numeric.hundredths_to_double(numeric.exact_sum(F.col("volume_c"))).alias("volume"),
        numeric.hundredths_to_double(F.max("price_c")).alias("price"),
    )
    blank = (F.col("category") == "LARGE") & (F.month("period") == 7)
    months = materialize(months.withColumns({
        "volume_status": F.when(F.col("volume") > 0, "valid").otherwise("zero_reported"),
        "price_status": F.when(blank, "missing").when(F.col("price") > 0, "valid").otherwise("zero_reported"),
    }), "supply-months")
    return monthly.supply_trend(
        monthly.describe(months, "category", "volume", "volume_status"),
        monthly.describe(months, "category", "price", "price_status"),
    )


def submissions(t):
    """Orders as monthly submissions of a source; the payload is the priority."""
    day = F.col("o_orderdate").cast("date")
    status = (
        F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "P", "manual")
        .when(F.col("o_orderpriority") == "5-LOW", "fixture").otherwise("manual")
    )
    return t.read("orders").select(
        F.col("o_orderstatus").alias("source"), F.trunc(day, "month").alias("period"), F.col("o_orderkey").alias("arrival"),
        F.sha2("o_orderpriority", 256).alias("raw_hash"),
        F.date_add(F.last_day(day), (F.col("o_orderkey") % 60).cast("int")).alias("known_at"), status.alias("source_status"),
    )


def revisions(t):
    return monthly.revision_log(submissions(t), ["source", "period"], ["arrival"], F.floor(F.col("arrival") / CHUNK_BATCHES))


REVISIONS = """sub AS (
  SELECT o_orderstatus AS source, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey AS arrival, sha256(o_orderpriority) AS raw_hash,
    last_day(CAST(o_orderdate AS DATE)) + CAST(o_orderkey % 60 AS INT) AS known_at, CASE WHEN o_orderstatus = 'F' THEN 'live' WHEN o_orderstatus = 'P' THEN 'manual'
      WHEN o_orderpriority = '5-LOW' THEN 'fixture' ELSE 'manual' END AS source_status FROM orders),
st AS (SELECT *, lag(raw_hash) OVER (PARTITION BY source, period ORDER BY arrival) IS DISTINCT FROM raw_hash AS starts FROM sub),
rev AS (SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY arrival) AS revision FROM st WHERE starts)"""
_REVISIONS = o.with_ctes(REVISIONS)


@query("revision_log", _REVISIONS + """
SELECT source, CAST(period AS VARCHAR) AS period, arrival, raw_hash, CAST(known_at AS VARCHAR) AS known_at, source_status, revision,
  CASE WHEN revision > 1 THEN 'revised' ELSE 'added' END AS outcome FROM rev""")
def revision_log(t):
    return revisions(t)


@query("revision_contract", _REVISIONS + """
SELECT source, CAST(period AS VARCHAR) AS period, count(*) AS rows, min(revision)::BIGINT AS first, max(revision)::BIGINT AS last, count(DISTINCT revision) AS numbers
FROM rev WHERE NOT (revision = 2 AND arrival % 3 = 0) GROUP BY source, period
HAVING min(revision) <> 1 OR max(revision) <> count(*) OR count(DISTINCT revision) <> count(*)""")
def revision_contract(t):
    """Groups with a hole after some second revisions were taken out."""
    holed = revisions(t).filter(~((F.col("revision") == 2) & (F.col("arrival") % 3 == 0)))
    return monthly.revision_gaps(holed, ["source", "period"])


@query("known_at", _REVISIONS + f""",
k AS (SELECT *, count(*) OVER (PARTITION BY source, period) AS revision_count, row_number() OVER (PARTITION BY source, period ORDER BY revision DESC) AS n
  FROM rev WHERE known_at <= DATE '{CUTOFF}')
SELECT source, CAST(period AS VARCHAR) AS period, revision, revision_count, arrival, raw_hash, CAST(known_at AS VARCHAR) AS known_at FROM k WHERE n = 1""")
def known_at(t):
    known = monthly.known_revisions(revisions(t), ["source", "period"], CUTOFF)
    return known.select("source", "period", "revision", "revision_count", "arrival", "raw_hash", "known_at")


@query("source_summary", _REVISIONS + """,
ds AS (SELECT DISTINCT o_orderstatus AS source FROM orders UNION ALL SELECT 'X-' || r_name FROM region)
SELECT ds.source, CASE WHEN count(DISTINCT source_status) = 0 THEN 'not_ingested' WHEN count(DISTINCT source_status) = 1 THEN min(source_status) ELSE 'mixed' END AS status,
  CAST(max(period) AS VARCHAR) AS latest_period, count(DISTINCT period) AS periods, coalesce(max(revision), 0) AS most_revisions
FROM ds LEFT JOIN rev ON rev.source = ds.source GROUP BY ds.source""")
def source_summary(t):
    known = t.read("orders").select(F.col("o_orderstatus").alias("source")).distinct()
    absent = t.read("region").select(F.concat(F.lit("X-"), F.col("r_name")).alias("source"))
    return monthly.source_summary(known.unionByName(absent), revisions(t))


@query("period_evidence", """WITH n AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey % 7 AS k, CAST(date_trunc('month', o_orderdate) AS DATE) - CASE WHEN o_orderkey % 7 = 0 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END AS named FROM orders)
SELECT CAST(period AS VARCHAR) AS period, CASE WHEN k = 1 THEN '行情' ELSE CAST(year(named) - 1911 AS VARCHAR) || '年' || CAST(month(named) AS VARCHAR) || '月份行情' END AS resource_name,
  CASE k WHEN 1 THEN 'operator' WHEN 0 THEN 'conflict' ELSE 'resource_name' END AS evidence, count(*) AS submissions
FROM n GROUP BY ALL""")
def period_evidence(t):
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 7
    named = F.add_months(F.trunc(day, "month"), F.when(k == 0, -1).otherwise(0))
    name = F.when(k == 1, "行情").otherwise(F.concat(
        (F.year(named) - dates.ERA_OFFSET).cast("string"), F.lit("年"), F.month(named).cast("string"), F.lit("月份行情")
    ))
    grouped = t.read("orders").groupBy(F.trunc(day, "month").alias("period"), name.alias("resource_name")).agg(
        F.count(F.lit(1)).alias("submissions")
    )
    return grouped.withColumn("evidence", monthly.period_evidence(F.col("period"), F.col("resource_name")))
