"""Certified lots, market events, snapshots and guards."""

from pyspark.sql import functions as F

from marketpanel.functions import text
from marketpanel.operators import evidence
from marketpanel.plans import oracle as o
from marketpanel.plans.registry import query
from marketpanel.schemas import REGISTRY_FIELDS
from marketpanel.sources import landing

AS_OF, LATER = "1998-06-30", "1999-06-30"


def raw_lots(t):
    """Orders as registry lots; some codes are blank or reused, every 25th lot arrives twice."""
    rows = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, ordered = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    place = (
        F.when(F.col("c_custkey") % 5 == 0, " 屏東縣內埔鄉1號").when(F.col("c_custkey") % 5 == 1, "台北市大安區2號")
        .when(F.col("c_custkey") % 5 == 2, "市區3號縣").when(F.col("c_custkey") % 5 == 3, "unknown").otherwise("  ")
    )
    valid = F.date_format(F.date_add(ordered, 365), "yyyy/MM/dd")
    lots = rows.select(
        F.col("o_orderstatus").alias("feed"),
        F.trunc(ordered, "month").alias("snapshot_month"),
        F.when(key % 40 == 0, " ").otherwise(F.concat(F.lit("T"), (key - F.when(key % 30 == 1, 1).otherwise(0)).cast("string"))).alias("Tracecode"),
        F.col("c_name").alias("Producer"),
        F.when(F.col("c_nationkey") != 5, F.concat(F.lit("org"), F.col("c_nationkey").cast("string"))).alias("OrgID"),
        F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("ProductName"),
        place.alias("Place"),
        F.date_format(ordered, "yyyy-MM-dd'T'00:00:00").alias("PackDate"),
        F.col("o_orderpriority").alias("CertificationName"),
        F.when(key % 17 == 0, "2020/13/01").when(key % 19 != 0, valid).alias("ValidDate"),
        F.date_format(ordered, "yyyy-MM-dd").alias("Log_UpdateTime"),
        F.lit("personal").alias("FarmerName"), F.lit("personal").alias("LandSecNO"),
        (key % 25 == 0).alias("_again"),
    )
    return lots.withColumn("_copy", F.explode(F.when(F.col("_again"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_again", "_copy")


def lots(t):
    return evidence.minimized_lots(raw_lots(t), t.items, AS_OF, ["feed", "snapshot_month"])


def raw_events(t):
    """Events as landed market events of the day they happened; every 20th arrives twice."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    whole = F.floor(F.col("value") * 100).cast("bigint")
    rows = t.read("events").select(
        F.col("ts").cast("date").alias("requested_date"),
        F.when(key % 3 == 0, F.date_format("ts", "yyyyMMdd")).when(key % 41 == 1, "20241301")
        .when(key % 43 == 1, "2023-12-31").otherwise(F.date_format("ts", "yyyy/MM/dd")).alias("trade_date"),
        F.concat(F.lit("E"), (k % 12).cast("string")).alias("crop_code"),
        F.col("event_type").alias("crop_name"),
        F.col("user_id").cast("string").alias("market_code"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("market_name"),
        F.when(key % 29 == 1, "bad").otherwise(F.concat(F.lit("1,"), F.lpad(F.least(whole, F.lit(999)).cast("string"), 3, "0"))).alias("amount"),
        F.when(key % 31 == 1, "-1").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("volume"),
        F.when(key % 37 == 1, " ").otherwise(F.concat(F.lit("P"), key.cast("string"))).alias("class_code"),
        (key % 20 == 0).alias("_again"),
    )
    return rows.withColumn("_copy", F.explode(F.when(F.col("_again"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_again", "_copy")


def events(t):
    return evidence.normalized_events(raw_events(t), t.items)


LOTS = o.ITEM_DIM + f""",
names AS (SELECT DISTINCT unnest([display_name] || aliases || traces) AS product_name_raw, canonical_id FROM items),
raw AS (
  SELECT o_orderkey AS key, o_orderstatus AS feed, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_month, c_custkey,
    CASE WHEN o_orderkey % 40 <> 0 THEN 'T' || CAST(o_orderkey - CASE WHEN o_orderkey % 30 = 1 THEN 1 ELSE 0 END AS VARCHAR) END AS tracecode,
    c_name AS producer, CASE WHEN c_nationkey <> 5 THEN 'org' || CAST(c_nationkey AS VARCHAR) END AS org_id, c_mktsegment AS product_name_raw,
    CASE c_custkey % 5 WHEN 0 THEN '屏東縣' WHEN 1 THEN '台北市' WHEN 2 THEN '市區3號縣' END AS place, CAST(o_orderdate AS DATE) AS pack_date,
    o_orderpriority AS certification_name,
    CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) + 365 END AS valid_date,
    unnest(CASE WHEN o_orderkey % 25 = 0 THEN [1, 2] ELSE [1] END) AS copy
  FROM orders JOIN customer ON o_custkey = c_custkey),
lots AS (
  SELECT raw.*, canonical_id, CASE WHEN valid_date IS NULL THEN 'unknown' WHEN valid_date >= DATE '{AS_OF}' THEN 'active' ELSE 'expired' END AS certification_status,
    sha256(concat_ws(chr(31), producer, coalesce(org_id, '\\N'), product_name_raw, coalesce(canonical_id, '\\N'), coalesce(place, '\\N'),
      CAST(pack_date AS VARCHAR), certification_name, coalesce(CAST(valid_date AS VARCHAR), '\\N'),
      CASE WHEN valid_date IS NULL THEN 'unknown' WHEN valid_date >= DATE '{AS_OF}' THEN 'active' ELSE 'expired' END, CAST(pack_date AS VARCHAR))) AS h
  FROM raw LEFT JOIN names USING (product_name_raw))"""
LOTS_SQL = o.with_ctes(LOTS)
_LOT_COLUMNS = """tracecode, producer, org_id, product_name_raw, canonical_id, place, CAST(pack_date AS VARCHAR) AS pack_date, certification_name,
  CAST(valid_date AS VARCHAR) AS valid_date, certification_status, CAST(pack_date AS VARCHAR) AS source_updated_date"""


@query("name_conflicts", """SELECT p_name AS name, min(p_type) AS first_item, max(p_type) AS last_item FROM part
WHERE p_type IS NOT NULL GROUP BY p_name HAVING min(p_type) <> max(p_type)""")
def name_conflicts(t):
    """Part names as product names: which of them lead to several items."""
    lookup = t.read("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("canonical_id"))
    return evidence.name_conflicts(lookup)


@query("minimize", LOTS_SQL + f"SELECT feed, {_LOT_COLUMNS} FROM lots")
def minimize(t):
    return lots(t).select("feed", *REGISTRY_FIELDS)


@query("registry_norm", LOTS_SQL + f""",
r AS (SELECT *, count(*) OVER (PARTITION BY tracecode) AS copies, min(h) OVER (PARTITION BY tracecode) <> max(h) OVER (PARTITION BY tracecode) AS is_conflict,
    row_number() OVER (PARTITION BY tracecode ORDER BY h) AS n FROM lots WHERE tracecode IS NOT NULL AND canonical_id IS NOT NULL)
SELECT {_LOT_COLUMNS}, copies, is_conflict FROM r WHERE n = 1""")
def registry_norm(t):
    return evidence.published_lots(lots(t))


@query("registry_profile", LOTS_SQL + """,
r AS (SELECT feed, tracecode, count(*) AS copies, count(DISTINCT h) > 1 AS conflict, min({'h': h, 's': certification_status, 'o': org_id, 'i': canonical_id}) AS k
  FROM lots WHERE tracecode IS NOT NULL AND canonical_id IS NOT NULL GROUP BY ALL),
p AS (SELECT feed, count(*) AS published_record_count, count(*) FILTER (k.s = 'active') AS active_record_count, count(*) FILTER (k.s = 'expired') AS expired_record_count,
    count(*) FILTER (k.s = 'unknown') AS unknown_validity_count, count(DISTINCT k.o) AS operator_count, count(DISTINCT k.i) AS mapped_item_count,
    sum(copies - 1)::BIGINT AS duplicate_count, count(*) FILTER (conflict) AS conflict_count FROM r GROUP BY feed),
q AS (SELECT feed, count(*) AS raw_record_count, count(*) FILTER (tracecode IS NULL) AS missing_tracecode_count,
    count(*) FILTER (tracecode IS NOT NULL AND canonical_id IS NULL) AS unmapped_record_count FROM lots GROUP BY feed)
SELECT * FROM q LEFT JOIN p USING (feed)""")
def registry_profile(t):
    return evidence.lot_profile(lots(t), ["feed"])


@query("coarse_place", """WITH p AS (SELECT c_custkey % 5 AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CASE k WHEN 0 THEN ' 屏東縣內埔鄉1號' WHEN 1 THEN '台北市大安區2號' WHEN 2 THEN '市區3號縣' WHEN 3 THEN 'unknown' ELSE '  ' END AS place,
  CASE k WHEN 0 THEN '屏東縣' WHEN 1 THEN '台北市' WHEN 2 THEN '市區3號縣' END AS coarse, count(*) AS lots FROM p GROUP BY k""")
def coarse_place(t):
    places = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("c_custkey") % 5
    place = F.when(k == 0, " 屏東縣內埔鄉1號").when(k == 1, "台北市大安區2號").when(k == 2, "市區3號縣").when(k == 3, "unknown").otherwise("  ")
    return places.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("lots")).withColumn("coarse", text.coarse_place(F.col("place")))


@query("lot_validity", LOTS_SQL + f"""
SELECT CAST(valid_date AS VARCHAR) AS valid_date, certification_status, CASE WHEN valid_date IS NULL THEN 'unknown'
    WHEN valid_date >= DATE '{LATER}' THEN 'active' ELSE 'expired' END AS later_status, count(*) AS lots
FROM lots GROUP BY valid_date, certification_status""")
def lot_validity(t):
    counts = lots(t).groupBy("valid_date", "certification_status").agg(F.count(F.lit(1)).alias("lots"))
    later = evidence.stale_lots(counts.withColumn("as_published", F.col("certification_status")), LATER)
    return later.select(
        "valid_date", F.col("as_published").alias("certification_status"),
        F.col("certification_status").alias("later_status"), "lots",
    )


EVENTS = o.ITEM_DIM + """,
names AS (SELECT DISTINCT unnest([display_name] || aliases || traces) AS crop_name, canonical_id AS by_name FROM items),
codes AS (SELECT unnest(codes) AS crop_code, canonical_id AS by_code FROM items),
raw AS (
  SELECT event_id AS key, CAST(ts AS DATE) AS requested_date, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d') WHEN event_id % 41 = 1 THEN '20241301'
      WHEN event_id % 43 = 1 THEN '2023-12-31' ELSE strftime(ts, '%Y/%m/%d') END AS trade_date,
    'E' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS VARCHAR) AS crop_code, event_type AS crop_name, CAST(user_id AS VARCHAR) AS market_code,
    'user ' || CAST(user_id AS VARCHAR) AS market_name,
    CASE WHEN event_id % 29 = 1 THEN 'bad' ELSE '1,' || lpad(CAST(least(CAST(floor(value * 100) AS BIGINT), 999) AS VARCHAR), 3, '0') END AS amount_text,
    CASE WHEN event_id % 31 = 1 THEN '-1' ELSE CAST(json_extract(props, '$.k') AS VARCHAR) || '.5' END AS volume_text,
    CASE WHEN event_id % 37 = 1 THEN ' ' ELSE 'P' || CAST(event_id AS VARCHAR) END AS class_text, CASE WHEN event_id % 20 = 0 THEN 2 ELSE 1 END AS copies
  FROM events),
ids AS (SELECT *, 'h44:' || sha256(concat_ws(chr(31), trade_date, crop_code, crop_name, market_code, market_name, amount_text, volume_text, class_text)) AS event_id FROM raw),
uni AS (SELECT event_id, sum(copies)::BIGINT AS copies, min(requested_date) AS requested_date, min(trade_date) AS trade_date, min(crop_code) AS crop_code,
  min(crop_name) AS crop_name, min(market_code) AS market_code, min(market_name) AS market_name, min(amount_text) AS amount_text, min(volume_text) AS volume_text,
  nullif(trim(min(class_text)), '') AS class_code FROM ids GROUP BY event_id),
ev AS (
  SELECT uni.*, coalesce(by_code, by_name) AS canonical_id, CASE WHEN length(trade_date) = 8 THEN TRY_CAST(substr(trade_date, 1, 4) || '-' || substr(trade_date, 5, 2) || '-' || substr(trade_date, 7, 2) AS DATE)
      ELSE TRY_CAST(replace(trade_date, '/', '-') AS DATE) END AS d,
    CASE WHEN amount_text <> 'bad' THEN CAST(replace(amount_text, ',', '') AS DOUBLE) END AS amount, CASE WHEN volume_text <> '-1' THEN CAST(volume_text AS DOUBLE) END AS volume
  FROM uni LEFT JOIN names USING (crop_name) LEFT JOIN codes USING (crop_code)),
evr AS (SELECT *, CASE WHEN class_code IS NULL THEN 'incomplete_identity' WHEN d IS NULL THEN 'bad_date' WHEN d <> requested_date THEN 'outside_requested_date'
  WHEN amount IS NULL THEN 'bad_amount' WHEN volume IS NULL THEN 'bad_volume' END AS reject FROM ev)"""
_EVENTS = o.with_ctes(EVENTS)


@query("event_norm", _EVENTS + """
SELECT event_id, copies, CAST(requested_date AS VARCHAR) AS requested_date, CAST(d AS VARCHAR) AS transaction_date, market_code, market_name, crop_code,
  crop_name AS crop_name_raw, canonical_id, amount, volume, class_code, reject FROM evr""")
def event_norm(t):
    return events(t)


@query("event_profile", _EVENTS + """
SELECT CAST(requested_date AS VARCHAR) AS requested_date, sum(copies)::BIGINT AS raw_record_count,
  count(*) FILTER (reject IS NULL AND canonical_id IS NOT NULL) AS published_record_count,
  count(DISTINCT canonical_id) FILTER (reject IS NULL) AS mapped_item_count,
  count(DISTINCT market_code) FILTER (reject IS NULL AND canonical_id IS NOT NULL) AS market_count,
  count(*) FILTER (reject IS NULL AND canonical_id IS NULL) AS unmapped_record_count,
  sum(copies - 1)::BIGINT AS duplicate_count, count(*) FILTER (reject IS NOT NULL) AS rejected_record_count
FROM evr GROUP BY requested_date""")
def event_profile(t):
    return evidence.event_profile(events(t))


@query("snapshot_asof", """WITH req AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
daily AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL),
cur AS (SELECT CAST(max(o_orderdate) AS DATE) AS d, (SELECT count(*) FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS n FROM orders)
SELECT CAST(req.d AS VARCHAR) AS requested_date, CASE WHEN daily.d IS NOT NULL THEN 'daily' WHEN cur.d IS NOT NULL THEN 'current' ELSE 'fixture' END AS kind,
  coalesce(daily.n, cur.n, (SELECT count(*) FROM region)) AS records
FROM req LEFT JOIN daily USING (d) LEFT JOIN cur ON cur.d = req.d""")
def snapshot_asof(t):
    orders = t.read("orders").withColumn("as_of_date", F.col("o_orderdate").cast("date"))
    dated = orders.filter("o_orderpriority <> '5-LOW'").groupBy("as_of_date").agg(F.count(F.lit(1)).alias("records"))
    newest = orders.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("records")).agg(
        F.max("as_of_date").alias("as_of_date"), F.max_by("records", "as_of_date").alias("records")
    )
    fixture = t.read("region").agg(F.count(F.lit(1)).alias("records")).withColumn("as_of_date", F.lit(None).cast("date"))
    named = [df.select(F.lit(kind).alias("kind"), "as_of_date", "records") for kind, df in
             (("daily", dated), ("current", newest), ("fixture", fixture))]
    requested = t.read("lineitem").select(F.col("l_shipdate").cast("date").alias("requested_date")).distinct()
    return evidence.choose_snapshot(requested, named[0].unionByName(named[1]).unionByName(named[2]))


@query("count_guard", """WITH RECURSIVE c AS (
  SELECT o_orderstatus AS feed, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY m) AS k FROM c),
g AS (SELECT feed, m, n, k, CAST(NULL AS BIGINT) AS last_good, true AS ok, n AS good FROM i WHERE k = 1
  UNION ALL SELECT i.feed, i.m, i.n, i.k, g.good, i.n * 100 >= g.good * 95, CASE WHEN i.n * 100 >= g.good * 95 THEN i.n ELSE g.good END
  FROM g JOIN i ON i.feed = g.feed AND i.k = g.k + 1)
SELECT feed, CAST(m AS VARCHAR) AS snapshot_month, n AS record_count, last_good AS last_good_rows, ok AS is_accepted FROM g""")
def count_guard(t):
    counts = t.read("orders").groupBy(
        F.col("o_orderstatus").alias("feed"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_month")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    return evidence.shrink_guard(counts, "feed", "snapshot_month", "record_count", percent=95)


@query("category_guard", """WITH c AS (
  SELECT o_orderpriority AS category, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL)
SELECT category, CAST(m AS VARCHAR) AS snapshot_month, n AS record_count, lag(n) OVER (PARTITION BY category ORDER BY m) AS previous_rows,
  coalesce(n < lag(n) OVER (PARTITION BY category ORDER BY m), false) AS has_shrunk FROM c""")
def category_guard(t):
    counts = t.read("orders").groupBy(
        F.col("o_orderpriority").alias("category"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_month")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    return evidence.category_shrink(counts, "category", "snapshot_month", "record_count")


@query("availability", o.with_ctes(o.OBS, LOTS) + """,
mk AS (SELECT unnest(codes) AS crop_code, canonical_id AS item FROM items WHERE enabled),
m AS (SELECT item, count(*) AS n FROM obs JOIN mk USING (crop_code) GROUP BY ALL),
l AS (SELECT canonical_id AS item, count(DISTINCT tracecode) AS n FROM lots WHERE tracecode IS NOT NULL AND canonical_id IS NOT NULL GROUP BY ALL),
lk AS (SELECT tracecode, min({'h': h, 'i': canonical_id, 's': certification_status}) AS k FROM lots WHERE tracecode IS NOT NULL AND canonical_id IS NOT NULL GROUP BY ALL),
la AS (SELECT k.i AS item, count(*) AS n, count(*) FILTER (k.s = 'active') AS a FROM lk GROUP BY ALL),
e0 AS (SELECT event_id, coalesce(c.canonical_id, n.canonical_id) AS item FROM events
  LEFT JOIN (SELECT unnest(codes) AS code, canonical_id FROM items) c ON code = 'E' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS VARCHAR)
  LEFT JOIN (SELECT DISTINCT unnest([display_name] || aliases || traces) AS nm, canonical_id FROM items) n ON nm = event_type
  WHERE event_id % 37 <> 1 AND event_id % 29 <> 1 AND event_id % 31 <> 1 AND (event_id % 3 = 0 OR (event_id % 41 <> 1 AND event_id % 43 <> 1))),
e AS (SELECT item, count(*) AS n FROM e0 GROUP BY ALL)
SELECT canonical_id, display_name, coalesce(m.n, 0) AS market_rows, coalesce(la.a, 0) AS active_lots, coalesce(la.n, 0) AS lots, coalesce(e.n, 0) AS events,
  coalesce(m.n, 0) > 0 AS has_market, coalesce(la.a, 0) > 0 AS has_active_lot
FROM items LEFT JOIN m ON m.item = canonical_id LEFT JOIN la ON la.item = canonical_id LEFT JOIN e ON e.item = canonical_id""")
def availability(t):
    market = t.observations.drop("canonical_id").join(landing.code_lookup(t.items), "crop_code")
    accepted = events(t).filter(F.col("reject").isNull())
    return evidence.availability(t.items, market, evidence.published_lots(lots(t)), accepted)
