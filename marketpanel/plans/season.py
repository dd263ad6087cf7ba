"""Season catalogue, mapping, county roll-up, lookups and refresh decisions."""

from pyspark.sql import functions as F

from marketpanel.operators import season
from marketpanel.plans import oracle as o
from marketpanel.plans.registry import query
from marketpanel.sources.sinks import materialize

# Fixed values of the test binding: authored symbols and category ranks.
SYMBOLS = (("fruit", "small ring", "ring"), ("fruit", "red ring", "ring"), ("vegetable", "blue bolt", "bolt"))
DEFAULTS = (("fruit", "fruit-default"), ("vegetable", "vegetable-default"))
RANKS = (("fruit", 0), ("vegetable", 1))


def _values(t, rows, names):
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return t.spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def raw_season(t):
    """Line items as season rows: part names grown by the supplier's nation in the shipping month."""
    rows = (
        t.read("lineitem").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.select(
        F.month("l_shipdate").alias("month"),
        F.when(F.col("p_size") % 2 == 0, "fruit").otherwise("vegetable").alias("category"),
        F.col("p_name").alias("display_name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise(" ").alias("variety"),
        F.col("n_name").alias("county"),
        F.col("s_name").alias("district"),
    )


RAW = """raw AS (
  SELECT month(l_shipdate) AS month, CASE WHEN p_size % 2 = 0 THEN 'fruit' ELSE 'vegetable' END AS category, p_name AS display_name,
    CASE WHEN p_size % 5 <> 0 THEN p_brand END AS variety, n_name AS county, s_name AS district
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
cat AS (
  SELECT month, category, display_name, list_sort(list(DISTINCT county)) AS counties, count(DISTINCT district) AS district_count,
    coalesce(list_sort(list(DISTINCT variety) FILTER (variety IS NOT NULL)), []) AS varieties
  FROM raw GROUP BY ALL)"""
MAPPED = o.ITEM_DIM + """,
lk AS (SELECT canonical_id, display_name AS item_name, category, unnest(season_names) AS display_name FROM items),
mapped AS (
  SELECT month, category, canonical_id, coalesce(item_name, display_name) AS display_name, list_sort(list(DISTINCT display_name)) AS source_display_names,
    list_sort(list_distinct(flatten(list(counties)))) AS counties, list_sort(list_distinct(flatten(list(varieties)))) AS varieties, sum(district_count)::BIGINT AS district_count
  FROM cat LEFT JOIN lk USING (category, display_name) GROUP BY month, category, canonical_id, coalesce(item_name, display_name))"""


def _catalog(t):
    return season.catalog(raw_season(t))


@query("season_catalog", o.with_ctes(RAW) + """
SELECT month, category, display_name, array_to_string(counties, '|') AS counties, len(counties) AS county_count, district_count,
  array_to_string(varieties, '|') AS varieties, len(varieties) AS variety_count FROM cat""")
def season_catalog(t):
    return _catalog(t)


@query("season_map_catalog", o.with_ctes(RAW, MAPPED) + """
SELECT month, category, canonical_id, display_name, array_to_string(source_display_names, '|') AS source_display_names, array_to_string(counties, '|') AS counties,
  array_to_string(varieties, '|') AS varieties, district_count, len(counties) AS county_count, len(varieties) AS variety_count FROM mapped""")
def season_map_catalog(t):
    return season.map_catalog(_catalog(t), t.items)


_WATCH = """,
watch AS (SELECT i.canonical_id, i.display_name, i.category, CAST(m AS BIGINT) AS month, CASE WHEN mapped.canonical_id IS NULL THEN 'unknown' ELSE 'in_season' END AS season_status,
    coalesce(len(mapped.counties), 0) AS county_count
  FROM (SELECT *, unnest(range(1, 13)) AS m FROM items) i LEFT JOIN mapped ON mapped.canonical_id = i.canonical_id AND mapped.month = m)"""


@query("season_watchlist", o.with_ctes(RAW, MAPPED) + _WATCH + " SELECT * FROM watch")
def season_watchlist(t):
    return season.watchlist(season.map_catalog(_catalog(t), t.items), t.items)


@query("season_fallback", o.with_ctes(RAW, MAPPED) + _WATCH + """
SELECT month, canonical_id, display_name, category, county_count, CAST(0 AS BIGINT) AS district_count, CAST(0 AS BIGINT) AS variety_count
FROM watch WHERE season_status = 'in_season'""")
def season_fallback(t):
    return season.catalog_from_status(season.watchlist(season.map_catalog(_catalog(t), t.items), t.items))


def _aliases(t):
    """Nations as source county names; the last ones have no registry entry."""
    return t.read("nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("county"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("slug")
    )


@query("county_rollup", o.with_ctes(RAW) + """,
al AS (SELECT n_name AS county, 'c' || CAST(n_regionkey AS VARCHAR) AS slug FROM nation WHERE n_nationkey < 20),
loc AS (SELECT DISTINCT month, slug, category, display_name FROM (SELECT month, category, display_name, unnest(counties) AS county FROM cat) JOIN al USING (county)),
mk AS (SELECT 'c' || CAST(n_regionkey AS VARCHAR) AS slug, array_to_string(list(n_nationkey ORDER BY n_nationkey), '|') AS markets FROM nation GROUP BY n_regionkey)
SELECT month, slug, count(*) AS seasonal_count, string_agg(category || ':' || display_name, '|' ORDER BY category || ':' || display_name) AS local_produce, any_value(markets) AS markets
FROM loc LEFT JOIN mk USING (slug) GROUP BY month, slug""")
def county_rollup(t):
    places = t.read("nation").select(
        F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("slug"), F.col("n_nationkey").alias("market_code")
    )
    return season.county_rollup(_catalog(t), _aliases(t), places)


@query("county_unmapped", o.with_ctes(RAW) + """
SELECT county, count(*) AS rows FROM (SELECT unnest(counties) AS county FROM cat) WHERE county NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20) GROUP BY county""")
def county_unmapped(t):
    return season.unmapped_counties(_catalog(t), _aliases(t))


def _with_source(rows):
    stale = F.col("month") % 3 == 0
    mixed = (F.col("month") == 7) & F.col("display_name").startswith("red")
    return rows.withColumns({
        "source_status": F.when(mixed, "fallback").when(stale, "stale").otherwise("live"),
        "source_url": F.concat(F.lit("https://source.example/"), F.col("category")),
    })


_SOURCE = """,
src AS (SELECT *, CASE WHEN month = 7 AND display_name LIKE 'red%' THEN 'fallback' WHEN month % 3 = 0 THEN 'stale' ELSE 'live' END AS source_status,
  'https://source.example/' || category AS source_url FROM cat)"""


@query("season_categories", o.with_ctes(RAW) + _SOURCE + """
SELECT month, category, count(*) AS catalog_rows, min(source_status) AS source_status, count(DISTINCT source_status) > 1 AS is_mixed FROM src GROUP BY ALL""")
def season_categories(t):
    return season.category_summary(_with_source(_catalog(t)))


@query("status_groups", o.with_ctes(RAW) + _SOURCE + """
SELECT source_status, source_url, min(CASE category WHEN 'fruit' THEN 0 ELSE 1 END)::BIGINT AS anchor_rank, string_agg(DISTINCT category, '|' ORDER BY category) AS categories,
  count(*) AS rows FROM src GROUP BY source_status, source_url""")
def status_groups(t):
    return season.status_groups(_with_source(_catalog(t)), _values(t, RANKS, "category, rank"))


@query("catalog_merge", o.with_ctes(RAW) + """
SELECT month, category, display_name, array_to_string(counties, '|') AS counties, district_count FROM cat
UNION ALL SELECT c_custkey % 12 + 1 AS month, 'livestock' AS category, c_mktsegment AS display_name, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS counties,
  count(DISTINCT c_name) AS district_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey % 12 + 1, c_mktsegment""")
def catalog_merge(t):
    extension = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("c_custkey") % 12 + 1).alias("month"), F.lit("livestock").alias("category"), F.col("c_mktsegment").alias("display_name"),
        F.lit("").alias("variety"), F.col("n_name").alias("county"), F.col("c_name").alias("district"),
    )
    columns = ["month", "category", "display_name", "counties", "district_count"]
    base = _catalog(t).select(F.col("month").cast("bigint").alias("month"), *columns[1:])
    return season.merge_catalogs(base, season.catalog(extension).select(*columns))


_NAMES = "nm AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'fruit' ELSE 'vegetable' END AS category, p_name AS display_name, count(*) AS parts FROM part GROUP BY ALL)"
_SYMBOLS = "sy(category, display_name, symbol) AS (VALUES " + ", ".join(str(s) for s in SYMBOLS) + ")"


def _names(t):
    return t.read("part").groupBy(
        F.when(F.col("p_size") % 2 == 0, "fruit").otherwise("vegetable").alias("category"), F.col("p_name").alias("display_name")
    ).agg(F.count(F.lit(1)).alias("parts"))


@query("lookup_fallback", o.with_ctes(_NAMES, _SYMBOLS) + """
SELECT category, display_name, parts, coalesce(symbol, category || '-default') AS symbol, CASE WHEN symbol IS NOT NULL THEN 'exact' ELSE 'category_fallback' END AS fidelity
FROM nm LEFT JOIN sy USING (category, display_name)""")
def lookup_fallback(t):
    exact = _values(t, SYMBOLS, "category, display_name, symbol")
    return season.lookup_with_default(_names(t), exact, _values(t, DEFAULTS, "category, default_symbol"))


@query("unmapped_names", o.with_ctes(_NAMES, _SYMBOLS) + "SELECT category, display_name FROM nm EXCEPT SELECT category, display_name FROM sy")
def unmapped_names(t):
    return season.names_without_entry(_names(t), _values(t, SYMBOLS, "category, display_name, symbol"))


def _month(n, shift=0):
    return F.date_format(F.add_months(n, shift), "yyyy-MM")


@query("refresh_decision", """WITH c AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot, month(l_shipdate) AS m, CASE WHEN month(l_shipdate) = 5 THEN 'fruit' WHEN l_linenumber % 2 = 0 THEN 'fruit' ELSE 'vegetable' END AS category,
    CASE WHEN month(l_shipdate) = 8 AND l_linenumber = 3 THEN 'stale' ELSE 'live' END AS st FROM lineitem),
r AS (SELECT DISTINCT snapshot, m FROM c UNION SELECT DISTINCT snapshot - INTERVAL 100 YEAR, m FROM c),
s AS (SELECT snapshot, count(*) AS n, count(DISTINCT category) AS k, count(*) FILTER (st <> 'live') AS nl FROM c GROUP BY ALL)
SELECT CAST(CAST(r.snapshot AS DATE) AS VARCHAR) AS snapshot, strftime(r.snapshot, '%Y-%m') AS month,
  CASE WHEN m = 2 THEN 'forced' WHEN n IS NULL THEN 'missing_snapshot' WHEN m = 11 THEN 'month_mismatch' WHEN k < 2 THEN 'incomplete_categories'
    WHEN nl > 0 THEN 'non_live_snapshot' ELSE 'verified_live_snapshot' END AS reason,
  CASE WHEN m <> 2 AND n IS NOT NULL AND m <> 11 AND k = 2 AND nl = 0 THEN 'reuse' ELSE 'refresh' END AS action, coalesce(n, 0) AS cached_rows
FROM r LEFT JOIN s ON s.snapshot = r.snapshot""")
def refresh_decision(t):
    """Cached rows of every shipping month; requests also name months without any cached row."""
    snapshot = F.trunc(F.col("l_shipdate").cast("date"), "month")
    m = F.month("snapshot")
    rows = t.read("lineitem").select(snapshot.alias("snapshot"), "l_linenumber")
    cached = rows.select(
        "snapshot",
        F.when(m == 11, _month("snapshot", -1)).otherwise(_month("snapshot")).alias("cached_month"),
        F.when((m == 5) | (F.col("l_linenumber") % 2 == 0), "fruit").otherwise("vegetable").alias("category"),
        F.when((m == 8) & (F.col("l_linenumber") == 3), "stale").otherwise("live").alias("source_status"),
    )
    seen = materialize(rows.select("snapshot").distinct(), "snapshots")
    absent = seen.select(F.add_months("snapshot", -1200).alias("snapshot"))
    requested = seen.unionByName(absent).select("snapshot", _month("snapshot").alias("month"), (m == 2).alias("is_forced"))
    return season.refresh_decision(requested, cached, "snapshot")


@query("season_contract", o.with_ctes(RAW) + """,
base AS (SELECT CASE WHEN display_name LIKE 'small%' AND month = 12 THEN 13 ELSE month END AS month, category, display_name, counties, len(counties) + CASE WHEN month = 2 AND category = 'fruit' THEN 1 ELSE 0 END AS county_count,
    CASE WHEN month = 3 AND display_name LIKE 'red%' THEN 'stale' WHEN month = 4 THEN 'odd' ELSE 'live' END AS source_status, true AS own FROM cat),
ext AS (SELECT CAST(c_custkey % 12 + 1 AS BIGINT) AS month, CASE WHEN c_mktsegment = 'BUILDING' THEN 'fruit' ELSE 'livestock' END AS category, c_mktsegment AS display_name, list_sort(list(DISTINCT n_name)) AS counties
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
pay AS (SELECT * FROM base UNION ALL SELECT month, category, display_name, counties, len(counties), 'fallback', false FROM ext
  UNION ALL SELECT month, category, display_name, counties, len(counties), 'fallback', false FROM ext WHERE month = 7),
v AS (SELECT unnest(list_filter([CASE WHEN month > 12 THEN 'unknown_month' END, CASE WHEN source_status = 'odd' THEN 'unknown_status' END, CASE WHEN county_count <> len(counties) THEN 'county_count' END,
    CASE WHEN NOT own AND category IN ('fruit', 'vegetable') THEN 'extension_category' END], lambda x: x IS NOT NULL)) AS rule, concat_ws('|', month, category, display_name) AS key FROM pay
  UNION ALL SELECT 'repeated_row', concat_ws('|', month, category, display_name) FROM pay GROUP BY month, category, display_name HAVING count(*) > 1
  UNION ALL SELECT 'mixed_status', concat_ws('|', month, category) FROM pay GROUP BY month, category HAVING count(DISTINCT source_status) > 1
  UNION ALL SELECT DISTINCT 'unknown_county', county FROM (SELECT unnest(counties) AS county FROM pay) WHERE county NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20))
SELECT rule, count(*) AS rows, min(key) AS first_key FROM v GROUP BY rule""")
def season_contract(t):
    """The catalogue and its extension with a fault of every kind."""
    month = F.col("month")
    base = materialize(_catalog(t), "season-rows").select(
        F.when(F.col("display_name").startswith("small") & (month == 12), 13).otherwise(month).cast("bigint").alias("month"), "category", "display_name", "counties",
        (F.col("county_count") + F.when((month == 2) & (F.col("category") == "fruit"), 1).otherwise(0)).alias("county_count"),
        F.when((month == 3) & F.col("display_name").startswith("red"), "stale").when(month == 4, "odd").otherwise("live").alias("source_status"))
    extension = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        (F.col("c_custkey") % 12 + 1).alias("month"), F.when(F.col("c_mktsegment") == "BUILDING", "fruit").otherwise("livestock").alias("category"), F.col("c_mktsegment").alias("display_name"),
    ).agg(F.array_sort(F.collect_set("n_name")).alias("counties")).withColumns({"county_count": F.size("counties"), "source_status": F.lit("fallback")})
    extension = extension.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("month") == 7, 2).otherwise(1)))).drop("_again")
    found = season.season_violations(base, extension, _aliases(t))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"))
