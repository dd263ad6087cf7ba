"""Published tables and lines, sources read through their adapters, and the contract of monthly snapshots."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketpanel.functions import dates
from marketpanel.operators import exports, monthly, panel, season
from marketpanel.plans import ingest
from marketpanel.plans import oracle as o
from marketpanel.plans import scope as scope_plans
from marketpanel.plans.evidence import AS_OF, LOTS_SQL, lots
from marketpanel.plans.registry import query
from marketpanel.sources import adapters, landing
from marketpanel.sources.sinks import materialize
from marketpanel.sources.tables import SEMANTICS
from marketpanel.streaming.upserts import with_stale_fallback

DATASET = exports.Dataset("8066", "https://feed.example/8066", "feed:market", "feed:crop")
LINEAGE = {
    "source_id": "registry", "source_role": "validation", "source_status": "live", "retrieved_at": "2002-01-01T00:00:00Z",
    "source_url": "https://registry.example", "semantic_warning": "no trade",
}
_NULLS = ("variant", "grade", "cut", "origin_evidence_type", "origin_value", "origin_granularity", "evidence_ref", "join_key_type", "join_key_value")


@query("observation_table", o.with_ctes(o.OBS, scope_plans.SCOPED, o.ITEM_DIM) + f""",
codes AS (SELECT unnest(codes) AS crop_code, canonical_id AS item, category FROM items WHERE enabled)
SELECT CAST(transaction_date AS VARCHAR) AS observation_period, 'daily' AS frequency, CAST(scope AS VARCHAR) AS scope_id, 'feed:market' AS market_namespace, CAST(market_code AS VARCHAR) AS market_code,
  CASE WHEN row_b % 50 = 7 THEN 'x' WHEN row_b % 2 = 0 THEN '台' ELSE '臺' END || n_name AS market_name_raw, 'market_location' AS geography_role, source_id, '8066' AS dataset_id,
  'https://feed.example/8066' AS source_url, category AS commodity_family, 'feed:crop' AS product_namespace, crop_code AS product_code_raw, crop_name_raw AS product_name_raw, item AS canonical_id,
  {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in _NULLS)}, 'unknown' AS production_method, 'wholesale' AS market_level, price_c / 100.0 AS price_raw, '元/公斤' AS price_unit_raw,
  price_c / 100.0 AS price_twd_per_kg, volume_c / 100.0 AS quantity_raw, '公斤' AS quantity_unit, CASE WHEN trade THEN 'valid' ELSE 'excluded_zero_price_or_volume' END AS value_status,
  'unknown' AS origin_status, 'sha256:' || sha256(concat_ws(chr(31), CAST(transaction_date AS VARCHAR), CAST(market_code AS VARCHAR), crop_code, CAST(price_c AS VARCHAR), CAST(volume_c AS VARCHAR))) AS row_hash,
  fetched_at AS retrieved_at
FROM scoped JOIN nation ON n_nationkey = market_code JOIN codes USING (crop_code) WHERE transaction_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def observation_table(t):
    """A year of scoped observations of configured crops, as others read them."""
    from marketpanel.functions.text import row_hash

    rows = scope_plans.scoped(t).filter(F.year("transaction_date") == 1997).drop("canonical_id").join(landing.code_lookup(t.items), "crop_code")
    fields = ("transaction_date", "market_code", "crop_code", "price_c", "volume_c")
    return exports.observation_table(rows.withColumn("row_hash", row_hash(*[F.col(c) for c in fields])), DATASET)


_RECORD = ", ".join(f"'{v}' AS {k}" for k, v in LINEAGE.items())


@query("registry_records", LOTS_SQL + f"""
SELECT feed, '2.0' AS schema_version, 'traceability_registry_lot' AS record_type, tracecode, producer, org_id, product_name_raw, canonical_id, place, CAST(pack_date AS VARCHAR) AS pack_date,
  certification_name, CAST(valid_date AS VARCHAR) AS valid_date, certification_status, CAST(pack_date AS VARCHAR) AS source_updated_date, {_RECORD}, '{AS_OF}' AS as_of_date FROM lots""")
def registry_records(t):
    return exports.registry_records(lots(t).drop("snapshot_month"), LINEAGE, AS_OF)


def _registry():
    """Two sources: landed market text, and market events counted as validation."""
    known = adapters.SourceRegistry()
    market = adapters.SourceSpec("market", "https://feed.example", "authoritative_final", SEMANTICS, 20, "1.1", "v1")
    events = adapters.SourceSpec("events", "https://events.example", "validation", SEMANTICS, 5, "2.0", "v3")

    def normal_market(items):
        def normalise(raw):
            rows = landing.normalize_rows(raw, items).filter("reject IS NULL")
            return rows.select("transaction_date", F.col("market_code").try_cast("int").alias("market_code"), "crop_code", "row_hash", F.lit("market").alias("source_id"))
        return normalise

    def normal_events(raw):
        key = F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256))
        return raw.select(F.col("ts").cast("date").alias("transaction_date"), F.col("user_id").cast("int").alias("market_code"), F.col("event_type").alias("crop_code"),
                          key.alias("row_hash"), F.when(F.col("event_id") % 101 == 7, "stray").otherwise("events").alias("source_id"))

    return known, market, events, normal_market, normal_events


@query("source_union", o.with_ctes(o.OBS) + """,
m AS (SELECT 'market' AS source_id, transaction_date FROM obs WHERE row_a % 97 NOT IN (1, 2, 3, 4, 5, 6)),
e AS (SELECT CASE WHEN event_id % 101 = 7 THEN 'stray' ELSE 'events' END AS source_id, CAST(ts AS DATE) AS transaction_date FROM events),
u AS (SELECT *, 'authoritative_final' AS source_role, 20 AS source_precedence, '1.1' AS adapter_version FROM m UNION ALL SELECT *, 'validation', 5, '2.0' FROM e)
SELECT source_id, source_role, source_precedence::BIGINT AS source_precedence, adapter_version, count(*) AS rows,
  count(*) FILTER (source_id NOT IN ('market', 'events')) AS foreign_source, count(*) FILTER (transaction_date > DATE '1999-12-31') AS outside_requested_range FROM u GROUP BY ALL""")
def source_union(t):
    """Both sources through their registered normalisers, in one table with their lineage, and the rules of a batch."""
    known, market, events, normal_market, normal_events = _registry()
    known.register(market)(normal_market(t.items))
    known.register(events)(normal_events)
    rows = known.observations({"market": t.raw_market, "events": t.read("events")})
    own = F.when(F.col("source_role") == "validation", "events").otherwise("market")
    _, outside = adapters.lineage_rules(market, F.lit("1900-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return rows.groupBy("source_id", "source_role", "source_precedence", "adapter_version").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("source_id") != own).alias("foreign_source"), F.count_if(outside[1]).alias("outside_requested_range"))


@query("stale_fallback", """WITH d AS (SELECT s_nationkey AS market_code, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
l AS (SELECT market_code, max(d) AS last FROM d WHERE market_code % 5 <> 4 GROUP BY ALL)
SELECT n_nationkey::BIGINT AS market_code, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::BIGINT ELSE d.n END AS value,
  CASE WHEN n_nationkey % 3 <> 0 THEN '2002-01-01' ELSE CAST(last AS VARCHAR) END AS as_of_date,
  CASE WHEN n_nationkey % 3 <> 0 THEN 'live' WHEN last IS NOT NULL THEN 'stale' ELSE 'unavailable' END AS source_status
FROM nation LEFT JOIN l ON l.market_code = n_nationkey LEFT JOIN d ON d.market_code = l.market_code AND d.d = l.last""")
def stale_fallback(t):
    """Every third market's fetch failed; its last good count stands under its own date, if it has one."""
    days = t.observations.groupBy("market_code", F.col("transaction_date").alias("as_of_date")).agg(F.count(F.lit(1)).alias("n"))
    good = days.filter(F.col("market_code") % 5 != 4).groupBy("market_code").agg(F.max("as_of_date").alias("as_of_date"), F.max_by("n", "as_of_date").alias("value"))
    live = t.read("nation").select(
        F.col("n_nationkey").alias("market_code"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).cast("bigint").alias("value"), F.lit("2002-01-01").cast("date").alias("as_of_date"))
    return with_stale_fallback(live, good, ["market_code"])


@query("category_report", o.with_ctes(o.CLEAN, o.daily(), o.panel()) + """,
named AS (SELECT DISTINCT p_type AS canonical_id, 'item ' || lower(p_type) AS display_name, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'fruit' ELSE 'vegetable' END AS category FROM part)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, category, canonical_id, '- ' || display_name || ': ' || CASE WHEN price IS NULL THEN '—' ELSE 'NT$ ' || format('{:,.2f}', floor(price * 100 + 0.5) / 100) || '/kg' END ||
  ', ' || format('{:,.0f}', floor(volume + 0.5)) || ' kg' AS line FROM pan JOIN named USING (canonical_id)""")
def category_report(t):
    kinds = t.read("part").select(F.col("p_type").alias("canonical_id")).distinct()
    items = kinds.select("canonical_id", F.concat(F.lit("item "), F.lower("canonical_id")).alias("display_name"),
                         F.when(F.col("canonical_id").isin("SMALL", "LARGE"), "fruit").otherwise("vegetable").alias("category"))
    return exports.category_lines(panel.price_panel(panel.daily_prices(t.observations)), items)


@query("display_text", """SELECT l_quantity, format('{:,.0f}', floor(l_quantity * 1000 + 0.5)) AS volume, 'NT$ ' || format('{:,.2f}', floor(l_quantity / 7.0 * 100.0 + 0.5) / 100.0) || '/kg' AS price,
  CASE WHEN l_quantity - 25 > 0 THEN '+' ELSE '' END || format('{:.1f}', floor((l_quantity - 25) / 3.0 * 10.0 + 0.5) / 10.0) || '%' AS change, count(*) AS rows FROM lineitem GROUP BY l_quantity""")
def display_text(t):
    q = F.col("l_quantity")
    return t.read("lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("rows")).select(
        "l_quantity", exports.number_text(q * 1000).alias("volume"), exports.price_text(q / 7.0).alias("price"), exports.percent_text((q - 25) / 3.0).alias("change"), "rows")


@query("evidence_ids", """WITH x AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '\\b(th[a-z]+)\\b', 1))) AS id FROM conversations),
k AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '\\b(th[a-z]+)\\b', 1)) AS id FROM conversations WHERE role = 'user')
SELECT conv_id, turn, id FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = x.conv_id AND k.id = x.id)""")
def evidence_ids(t):
    """Names that an answer uses and the questions of its conversation do not have."""
    turns, pattern = t.read("conversations"), r"\b(th[a-z]+)\b"
    known = turns.filter("role = 'user'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("id"))
    return exports.unknown_references(turns.select("conv_id", "turn", "text"), "text", known, "conv_id", pattern)


@query("season_override", """SELECT status, count(*) AS rows, min(p_size)::BIGINT AS smallest FROM (SELECT p_size, unnest(['live', 'stale', 'fallback']) AS status FROM part WHERE p_size <= 12) GROUP BY status""")
def season_override(t):
    rows = t.read("part").filter("p_size <= 12").select("p_size", F.lit("odd").alias("source_status"))
    parts = [season.with_source_status(rows, s) for s in ("live", "stale", "fallback")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("source_status").alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.min("p_size").alias("smallest"))


@query("monthly_contract", """WITH f AS (SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CASE o_orderpriority WHEN '1-URGENT' THEN 'retail-3col' WHEN '2-HIGH' THEN 'retail-5col'
    WHEN '3-MEDIUM' THEN 'supply-v0' WHEN '5-LOW' THEN 'supply-v0' END AS parsed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT *, n + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS revision, CASE WHEN o_orderkey % 40 = 2 THEN 'supply-v9' ELSE parsed END AS contract,
  2 + CASE WHEN o_orderkey % 30 = 3 THEN 1 ELSE 0 END AS row_count, o_orderkey % 7 = 5 AS wrong_name FROM f),
v AS (SELECT o_custkey, 'contract' AS rule FROM r WHERE contract IS DISTINCT FROM parsed UNION ALL SELECT o_custkey, 'row_count' FROM r WHERE row_count <> 2
  UNION ALL SELECT o_custkey, 'period_evidence' FROM r WHERE wrong_name
  UNION ALL SELECT o_custkey, 'numbering' FROM r GROUP BY o_custkey HAVING min(revision) <> 1 OR max(revision) <> count(*) OR count(DISTINCT revision) <> count(*))
SELECT rule, count(*) AS rows, min(o_custkey) AS first_snapshot FROM v GROUP BY rule""")
def monthly_contract(t):
    """Landed files as revisions of a customer's snapshot, read again and compared with what was recorded."""
    files = t.read("orders").select("o_orderkey", "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period")).join(ingest.landed_files(t), "o_orderkey")
    key = F.col("o_orderkey")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    files = materialize(files.withColumn("revision", number + F.when(key % 50 == 1, 1).otherwise(0)), "monthly-files")
    parsed = materialize(landing.csv_rows(files.select("o_custkey", "o_orderkey", "revision", "raw_text")).groupBy("o_custkey", "o_orderkey", "revision").agg(
        F.first("contract").alias("contract"), F.count(F.lit(1)).alias("rows")), "monthly-parsed")
    name = F.concat((F.year("period") - dates.ERA_OFFSET).cast("string"), F.lit("年"), F.month("period").cast("string"), F.lit("月份行情"))
    recorded = files.join(parsed.select("o_orderkey", "contract"), "o_orderkey").select(
        "o_custkey", "o_orderkey", "revision", "period", name.alias("resource_name"), F.when(key % 7 == 5, "operator").otherwise("resource_name").alias("period_evidence"),
        F.when(key % 40 == 2, "supply-v9").otherwise(F.col("contract")).alias("contract"), (F.lit(2) + F.when(key % 30 == 3, 1).otherwise(0)).cast("bigint").alias("row_count"))
    # Numbers may repeat here, so the file's key goes with them; numbering is that of the customer.
    found = monthly.snapshot_violations(recorded, parsed, ["o_custkey", "o_orderkey"]).filter("rule <> 'numbering'").select("o_custkey", "rule")
    numbering = monthly.revision_gaps(recorded, ["o_custkey"]).select("o_custkey", F.lit("numbering").alias("rule"))
    return found.unionByName(numbering).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("o_custkey").alias("first_snapshot"))
