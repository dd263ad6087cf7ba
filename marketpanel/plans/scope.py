"""Scoped analysis, dense grid, calendars, publication status and schedules."""

from pyspark.sql import functions as F

from marketpanel.operators import calendars, filters, scope
from marketpanel.plans import oracle as o
from marketpanel.plans.registry import query
from marketpanel.schemas import WINDOWS
from marketpanel.sources.sinks import materialize
from marketpanel.sources.tables import SEMANTICS

# Fixed values of the test binding.
CALENDAR_MARKETS = tuple(range(0, 25, 2))
GAP_MARKETS = (3, 7)
SLOTS = ("09:17:00", "18:17:00")


def markets(t):
    return t.read("nation").filter("n_regionkey < 4").select(
        F.col("n_nationkey").alias("market_code"), F.col("n_regionkey").alias("scope"),
        F.concat(F.lit("臺"), F.col("n_name")).alias("registry_name"),
    )


def named_rows(t):
    """Observations with the market name as the feed spells it; some names drift."""
    nation = t.read("nation").select(F.col("n_nationkey").alias("market_code"), "n_name")
    prefix = F.when(F.col("row_b") % 50 == 7, "x").when(F.col("row_b") % 2 == 0, "台").otherwise("臺")
    return t.observations.join(nation, "market_code").withColumn("market_name", F.concat(prefix, F.col("n_name"))).drop("n_name")


def scoped(t):
    return scope.scoped_rows(named_rows(t), markets(t))


def accepted(t):
    return filters.analysis_rows(scoped(t).filter(~F.col("name_drift")))


def rules(years):
    """Yearly rule rows of the binding."""
    d = F.col("calendar_date")
    month, day, weekday = F.month(d), F.dayofmonth(d), F.weekday(d)

    def rule(raised, kind, reason):
        return F.when(raised, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))

    found = F.array_compact(F.array(
        rule((month == 1) & (day <= 5), "special", "new_year"),
        rule((month == 9) & (day == 28), "special", "festival"),
        rule((weekday == 0) & month.isin(1, 6) & day.between(22, 28), "exceptional", "before_festival"),
        rule((weekday == 1) & (month == 2) & (day <= 7), "makeup", "makeup"),
        rule((weekday == 3) & month.isin(3, 10) & day.between(8, 14), "thursday", "added_thursday"),
    ))
    return calendars.year_days(years).select("calendar_date", F.explode(found).alias("r")).select("calendar_date", "r.*")


def market_calendar(rows):
    """Calendar of every market and year which occurs in `rows`."""
    years = materialize(rows.select("market_code", F.year("transaction_date").alias("year")).distinct(), "years")
    days = calendars.year_days(years).drop("year")
    return calendars.expand_calendar(days, rules(years.select("year").distinct()))


def manifests(t):
    day = F.col("o_orderdate").cast("date")
    grouped = t.read("orders").groupBy(F.trunc(day, "month").alias("month"), "o_orderstatus").agg(
        F.min(day).alias("start_date"), F.max(day).alias("_last")
    )
    path = F.concat_ws("-", F.lit("m"), F.col("month").cast("string"), F.col("o_orderstatus"))
    return grouped.select(
        path.alias("path"), "start_date",
        F.least(F.col("_last"), F.date_add("month", 19)).alias("end_date"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"),
        F.when(F.col("o_orderstatus") == "O", 204).otherwise(200).alias("http_status"),
        F.lit("authoritative_final").alias("source_role"),
        F.concat(F.lit("sha256:"), F.sha2(path, 256)).alias("content_hash"),
        F.when(F.month("month") == 8, "other").otherwise(SEMANTICS).alias("dataset_semantics"),
        F.concat(F.col("month").cast("string"), F.when(F.month("month") == 9, " 08:00").otherwise("T08:00:00Z")).alias("retrieved_at"),
    )


def checked(t):
    """Scoped rows with their reject reasons; every reason is planted somewhere."""
    a, b = F.col("row_a"), F.col("row_b")
    rows = scoped(t).withColumns({
        "fetched_at": F.when((a % 3 == 0) & (F.col("fetched_at") == " Fixture "), "fixture").when(a % 239 == 4, "2002-01-01").otherwise(F.col("fetched_at")),
        "row_hash": F.concat(F.when(a % 227 == 1, "md5:").otherwise("sha256:"), F.sha2(F.concat_ws("|", "crop_code", "price_c", "volume_c"), 256)),
        "expected_item": F.when(a % 233 != 5, F.col("canonical_id")).otherwise("other"),
        "dataset_semantics": F.when(b % 37 == 2, "other").when(b % 3 != 0, SEMANTICS),
        "data_mode": F.when(F.col("row_a") % 211 == 0, "fixture").when(F.col("row_a") % 2 == 0, "observed"),
        "is_fixture": F.when(F.col("row_b") % 2 == 0, F.col("row_a") % 223 == 0),
    })
    return scope.with_provenance(rows, manifests(t))


MARKETS = "markets AS (SELECT n_nationkey AS market_code, n_regionkey AS scope, '臺' || n_name AS registry_name FROM nation WHERE n_regionkey < 4)"
SCOPED = MARKETS + """,
scoped AS (
  SELECT obs.*, scope, price_c > 0 AND volume_c > 0 AS trade,
    replace(CASE WHEN row_b % 50 = 7 THEN 'x' WHEN row_b % 2 = 0 THEN '台' ELSE '臺' END || n_name, '台', '臺') <> registry_name AS drift,
    lower(trim(fetched_at)) = 'fixture' AS fixture
  FROM obs JOIN markets USING (market_code) JOIN nation ON n_nationkey = market_code)"""
ACCEPTED = SCOPED + ", accepted AS (SELECT * FROM scoped WHERE NOT drift AND NOT fixture)"
_STATUS = """CASE WHEN exceptional THEN 'exceptional_open' WHEN closing IS NOT NULL THEN 'scheduled_closed' ELSE 'expected_open' END AS schedule_status,
    CASE WHEN exceptional THEN 'exceptional_open' ELSE coalesce(closing, 'trading_day') END AS schedule_reason"""


def calendar_cte(source: str = "obs", key: str = "market_code", name: str = "cal") -> str:
    return f"""{name} AS (
  SELECT {key}, d AS calendar_date, {_STATUS} FROM (
    SELECT {key}, d, isodow(d) = 1 AND month(d) IN (1, 6) AND day(d) BETWEEN 22 AND 28 AS exceptional,
      CASE WHEN month(d) = 1 AND day(d) <= 5 THEN 'new_year' WHEN month(d) = 9 AND day(d) = 28 THEN 'festival'
        WHEN isodow(d) = 2 AND month(d) = 2 AND day(d) <= 7 THEN 'makeup'
        WHEN isodow(d) = 4 AND month(d) IN (3, 10) AND day(d) BETWEEN 8 AND 14 THEN 'added_thursday'
        WHEN isodow(d) = 1 THEN 'monday' END AS closing
    FROM (SELECT {key}, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT DISTINCT {key}, CAST(year(transaction_date) AS INT) AS y FROM {source}))))"""


MANIFESTS = """man AS (
  SELECT 'm-' || CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) || '-' || o_orderstatus AS path,
    CAST(min(o_orderdate) AS DATE) AS s, least(CAST(max(o_orderdate) AS DATE), CAST(date_trunc('month', min(o_orderdate)) AS DATE) + 19) AS e
  FROM orders WHERE o_orderstatus <> 'P' AND month(o_orderdate) NOT IN (8, 9) GROUP BY date_trunc('month', o_orderdate), o_orderstatus)"""
CHECKED = MANIFESTS + """,
days AS (SELECT DISTINCT transaction_date FROM obs UNION SELECT DISTINCT calendar_date FROM cal),
mday AS (SELECT transaction_date, min(path) AS manifest FROM days JOIN man ON transaction_date BETWEEN s AND e GROUP BY ALL),
checked AS (
  SELECT scoped.*, manifest, CASE WHEN (fixture AND row_a % 3 = 0) OR row_a % 211 = 0 OR (row_b % 2 = 0 AND row_a % 223 = 0) THEN 'fixture' WHEN drift THEN 'invalid_market_identity'
    WHEN canonical_id IS NULL OR trim(crop_name_raw) = '' OR row_a % 227 = 1 OR row_a % 233 = 5 THEN 'invalid_row' WHEN price_c < 0 OR volume_c < 0 THEN 'invalid_value'
    WHEN source_role <> 'authoritative_final' OR manifest IS NULL OR row_a % 239 = 4 OR fixture OR row_b % 37 = 2 THEN 'provenance_unknown' END AS reason
  FROM scoped LEFT JOIN mday USING (transaction_date)),
kept AS (SELECT transaction_date, market_code, crop_code, min({'p': price_c, 'v': volume_c}) AS k, count(DISTINCT (price_c, volume_c, crop_name_raw, canonical_id, source_id)) > 1 AS has_conflict
  FROM checked WHERE reason IS NULL GROUP BY ALL),
single AS (SELECT transaction_date, market_code, crop_code, k.p AS price_c, k.v AS volume_c, has_conflict, k.p > 0 AND k.v > 0 AS trade FROM kept)"""
_CHECKED = (o.OBS, SCOPED, calendar_cte(), CHECKED)


@query("scope_filter", o.with_ctes(o.OBS, SCOPED) + """
SELECT scope::BIGINT AS scope, market_code::BIGINT AS market_code, CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS month,
  count(*) AS scoped_rows, count(*) FILTER (drift) AS drifted_rows
FROM scoped GROUP BY scope, market_code, date_trunc('month', transaction_date)""")
def scope_filter(t):
    return scoped(t).groupBy("scope", "market_code", F.trunc("transaction_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("scoped_rows"), F.count_if("name_drift").alias("drifted_rows")
    )


@query("scope_panel", o.with_ctes(
    o.OBS, ACCEPTED, o.daily("scope, canonical_id", "accepted"), o.panel("scope, canonical_id")) + """,
codes AS (SELECT transaction_date, scope, canonical_id, array_to_string(list_sort(list(DISTINCT market_code) FILTER (trade)), '|') AS market_codes
  FROM accepted WHERE canonical_id IS NOT NULL GROUP BY ALL),
om AS (SELECT scope, transaction_date, count(DISTINCT market_code) FILTER (trade) AS observed FROM accepted WHERE canonical_id IS NOT NULL GROUP BY ALL),
em AS (SELECT scope, count(*) AS expected FROM markets GROUP BY ALL),
its AS (SELECT DISTINCT scope, canonical_id FROM accepted WHERE canonical_id IS NOT NULL),
g AS (
  SELECT om.transaction_date, om.scope, its.canonical_id, observed, expected, pan.* EXCLUDE (transaction_date, scope, canonical_id), market_codes,
    CASE WHEN pan.price IS NOT NULL THEN 'observed' WHEN pan.market_count IS NOT NULL THEN 'no_valid_trade' ELSE 'no_scope_observation' END AS status
  FROM om JOIN em USING (scope) JOIN its USING (scope) LEFT JOIN pan USING (transaction_date, scope, canonical_id)
    LEFT JOIN codes USING (transaction_date, scope, canonical_id)),
h AS (SELECT *, list_filter([CASE WHEN status = 'no_scope_observation' THEN 'NO_SCOPE_OBSERVATION' END,
    CASE WHEN status = 'no_valid_trade' THEN 'NO_VALID_TRADE' END,
    CASE WHEN status = 'observed' AND (status_7d <> 'valid' OR status_30d <> 'valid') THEN 'COVERAGE_INSUFFICIENT' END,
    CASE WHEN status = 'observed' AND market_count < 2 THEN 'MARKET_COUNT_INSUFFICIENT' END,
    CASE WHEN status = 'observed' AND has_warning THEN 'DATA_QUALITY_WARNING' END], lambda x: x IS NOT NULL) AS rs FROM g)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, scope::BIGINT AS scope, canonical_id, status,
  CASE WHEN status = 'observed' THEN price END AS price, CASE WHEN status = 'observed' THEN volume END AS volume,
  CASE WHEN status = 'observed' THEN market_count END AS market_count, CASE WHEN status = 'observed' THEN previous_price END AS previous_price,
  CASE WHEN status = 'observed' THEN previous_change END AS previous_change, CASE WHEN status = 'observed' THEN price_7d END AS price_7d,
  CASE WHEN status = 'observed' THEN price_30d END AS price_30d, CASE WHEN status = 'observed' THEN price_90d END AS price_90d,
  CASE WHEN status = 'observed' THEN volatility_7d END AS volatility_7d, CASE WHEN status = 'observed' THEN market_codes END AS market_codes,
  CASE WHEN observed = 0 THEN 'no_scope_observation' WHEN observed = expected THEN 'all_markets_observed' ELSE 'partial_markets_observed' END AS scope_status,
  CASE WHEN len(rs) > 0 THEN 'insufficient' ELSE 'not_evaluated' END AS gate_status,
  CASE WHEN len(rs) > 0 THEN array_to_string(rs, '|') ELSE 'SCOPE_SCORE_NOT_DEFINED' END AS reason_codes
FROM h""")
def scope_panel(t):
    return scope.scope_panel(accepted(t), markets(t))


@query("market_days", o.with_ctes(o.OBS, ACCEPTED, calendar_cte()) + """,
c AS (SELECT market_code, transaction_date, count(*) AS n, count(*) FILTER (trade) AS v FROM accepted GROUP BY ALL)
SELECT cal.market_code::BIGINT AS market_code, CAST(calendar_date AS VARCHAR) AS transaction_date, schedule_status, schedule_reason,
  coalesce(n, 0) AS row_count, coalesce(v, 0) AS valid_row_count,
  CASE WHEN coalesce(v, 0) > 0 THEN CASE WHEN schedule_status = 'scheduled_closed' THEN 'calendar_feed_discrepancy' ELSE 'traded' END
    WHEN coalesce(n, 0) > 0 THEN 'no_valid_trade' WHEN schedule_status = 'scheduled_closed' THEN 'scheduled_closed' ELSE 'missing' END AS day_status
FROM cal LEFT JOIN c ON cal.market_code = c.market_code AND calendar_date = transaction_date""")
def market_days(t):
    return scope.market_days(accepted(t), market_calendar(t.observations))


@query("provenance", o.with_ctes(*_CHECKED) + """,
n AS (SELECT transaction_date, market_code, coalesce(reason, CASE WHEN price_c <= 0 THEN 'zero_price' WHEN volume_c <= 0 THEN 'zero_volume' END, 'observed') AS r,
  count(*) AS n FROM checked GROUP BY ALL)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, market_code::BIGINT AS market_code,
  coalesce(sum(n) FILTER (r = 'observed'), 0)::BIGINT AS observed_rows, coalesce(sum(n) FILTER (r = 'fixture'), 0)::BIGINT AS fixture_rows,
  coalesce(sum(n) FILTER (r = 'provenance_unknown'), 0)::BIGINT AS provenance_unknown_rows,
  coalesce(sum(n) FILTER (r NOT IN ('observed', 'fixture', 'provenance_unknown')), 0)::BIGINT AS invalid_rows,
  coalesce(string_agg(r || '=' || CAST(n AS VARCHAR), '|' ORDER BY r) FILTER (r <> 'observed'), '') AS reasons
FROM n GROUP BY transaction_date, market_code""")
def provenance(t):
    quality = scope.quality_by_market_day(checked(t))
    text = F.array_join(
        F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|"
    )
    return quality.withColumn("reasons", text)


@query("reason_totals", o.with_ctes(*_CHECKED) + """,
n AS (SELECT coalesce(reason, CASE WHEN price_c <= 0 THEN 'zero_price' WHEN volume_c <= 0 THEN 'zero_volume' END) AS reason FROM checked)
SELECT reason, count(*) AS rows FROM n WHERE reason IS NOT NULL GROUP BY ALL""")
def reason_totals(t):
    return scope.merge_reasons(scope.quality_by_market_day(checked(t)))


GRID = o.with_ctes(*_CHECKED) + """,
crops AS (SELECT DISTINCT market_code, crop_code FROM single),
unk AS (SELECT DISTINCT market_code, transaction_date FROM checked WHERE reason = 'provenance_unknown'),
grid AS (
  SELECT calendar_date AS transaction_date, cal.market_code, crops.crop_code, schedule_status,
    CASE WHEN s.trade THEN 'observed' WHEN s.price_c <= 0 THEN 'zero_price' WHEN s.volume_c <= 0 THEN 'zero_volume'
      WHEN unk.market_code IS NOT NULL THEN 'provenance_unknown' WHEN mday.manifest IS NULL THEN 'source_unavailable' ELSE 'missing' END AS observation_status,
    CASE WHEN s.trade THEN s.price_c END AS price_c, CASE WHEN s.trade THEN s.volume_c END AS volume_c,
    coalesce(has_conflict, false) AS has_conflict
  FROM cal JOIN crops ON crops.market_code = cal.market_code
    LEFT JOIN single s ON s.transaction_date = calendar_date AND s.market_code = cal.market_code AND s.crop_code = crops.crop_code
    LEFT JOIN unk ON unk.market_code = cal.market_code AND unk.transaction_date = calendar_date
    LEFT JOIN mday ON mday.transaction_date = calendar_date)"""


def grid(t):
    """Facts are read once into cells; calendar, crops and gaps come from those."""
    cells = materialize(scope.grid_cells(checked(t)), "grid-cells")
    return scope.dense_grid(cells, market_calendar(cells), manifests(t))


@query("grid_status", GRID + """
SELECT market_code::BIGINT AS market_code, crop_code, observation_status, schedule_status, count(*) AS days,
  count(*) FILTER (observation_status = 'observed' AND schedule_status = 'scheduled_closed') AS conflict_days,
  count(*) FILTER (has_conflict) AS duplicate_conflicts, sum(price_c)::BIGINT AS price_total_c
FROM grid GROUP BY market_code, crop_code, observation_status, schedule_status""")
def grid_status(t):
    return grid(t).groupBy("market_code", "crop_code", "observation_status", "schedule_status").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if("calendar_conflict").alias("conflict_days"),
        F.count_if("has_conflict").alias("duplicate_conflicts"),
        F.sum("price_c").alias("price_total_c"),
    )


_STATS = ", ".join(
    f"CASE WHEN sum(volume_c) OVER w{w} > 0 THEN CAST((20000 * sum(price_c * volume_c) OVER w{w} + sum(volume_c) OVER w{w}) // (2 * sum(volume_c) OVER w{w}) AS BIGINT) / 1e6 END AS price_{w}, "
    f"CAST(sum(volume_c) OVER w{w} AS DOUBLE) / 100.0 AS volume_{w}, count(price_c) OVER w{w} AS coverage_{w}"
    for w in ("7d", "30d", "90d")
)
_GRID_WINDOWS = ", ".join(
    f"w{w} AS (PARTITION BY market_code, crop_code ORDER BY transaction_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    for w, n in (("7d", 6), ("30d", 29), ("90d", 89))
)
_STAT_REPORT = ", ".join(
    f"min(price_{w}) AS low_price_{w}, max(price_{w}) AS high_price_{w}, max(volume_{w}) AS most_volume_{w}, "
    f"sum(coverage_{w})::BIGINT AS covered_{w}, count(*) FILTER (coverage_{w} >= {low}) AS valid_{w}"
    for w, low in (("7d", 3), ("30d", 10), ("90d", 30))
)


@query("grid_stats", GRID + f""",
st AS (SELECT transaction_date, market_code, crop_code, {_STATS} FROM grid WINDOW {_GRID_WINDOWS})
SELECT market_code::BIGINT AS market_code, crop_code, CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS month, {_STAT_REPORT}
FROM st GROUP BY market_code, crop_code, date_trunc('month', transaction_date)""")
def grid_stats(t):
    """Windows of every grid day, reported per market, crop and month."""
    stats = scope.grid_stats(grid(t))
    columns = []
    for w in WINDOWS:
        columns += [
            F.min(f"price_{w}").alias(f"low_price_{w}"), F.max(f"price_{w}").alias(f"high_price_{w}"),
            F.max(f"volume_{w}").alias(f"most_volume_{w}"), F.sum(f"coverage_{w}").alias(f"covered_{w}"),
            F.count_if(F.col(f"status_{w}") == "valid").alias(f"valid_{w}"),
        ]
    return stats.groupBy("market_code", "crop_code", F.trunc("transaction_date", "month").alias("month")).agg(*columns)


@query("obs_pairs", o.with_ctes(*_CHECKED) + f""",
l AS (SELECT *, lag(transaction_date) OVER w AS pd, lag(price_c) OVER w AS pp FROM single WHERE trade
  WINDOW w AS (PARTITION BY market_code, crop_code ORDER BY transaction_date)),
f AS (SELECT *, transaction_date - pd < 90 AS near FROM l)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, market_code::BIGINT AS market_code, crop_code, CAST(price_c AS DOUBLE) / 100.0 AS price,
  CASE WHEN near THEN CAST(pd AS VARCHAR) END AS previous_date, CASE WHEN near THEN CAST(pp AS DOUBLE) / 100.0 END AS previous_price,
  CASE WHEN near THEN transaction_date - pd END AS interval_days,
  CASE WHEN near THEN {o.r6('((CAST(price_c AS DOUBLE) / 100.0) / (CAST(pp AS DOUBLE) / 100.0) - 1.0) * 100.0')} END AS change_pct
FROM f""")
def obs_pairs(t):
    return scope.observation_pairs(scope.single_rows(checked(t)))


@query("market_gap", o.with_ctes(*_CHECKED) + f""",
a AS (SELECT * FROM single WHERE market_code = 3 AND trade), b AS (SELECT * FROM single WHERE market_code = 7 AND trade),
j AS (SELECT coalesce(a.transaction_date, b.transaction_date) AS d, coalesce(a.crop_code, b.crop_code) AS crop_code,
    CAST(a.price_c AS DOUBLE) / 100.0 AS pa, CAST(b.price_c AS DOUBLE) / 100.0 AS pb, CAST(a.volume_c AS DOUBLE) / 100.0 AS va, CAST(b.volume_c AS DOUBLE) / 100.0 AS vb
  FROM a FULL JOIN b ON a.transaction_date = b.transaction_date AND a.crop_code = b.crop_code)
SELECT CAST(d AS VARCHAR) AS transaction_date, crop_code, pa AS price_a, pb AS price_b, va AS volume_a, vb AS volume_b,
  {o.r6('pa - pb')} AS absolute_gap, {o.r6('(pa / pb - 1.0) * 100.0')} AS relative_gap_pct,
  CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 'comparable' ELSE 'not_comparable' END AS comparison_status
FROM j""")
def market_gap(t):
    return scope.market_gap(scope.single_rows(checked(t)), *GAP_MARKETS)


@query("market_coverage", o.with_ctes(*_CHECKED) + """,
pd AS (SELECT * FROM single WHERE trade)
SELECT market_code::BIGINT AS market_code, count(DISTINCT transaction_date) AS valid_days, count(DISTINCT crop_code) AS observed_crops,
  CAST(max(transaction_date) AS VARCHAR) AS last_valid_date
FROM pd GROUP BY market_code""")
def market_coverage(t):
    return scope.market_coverage(scope.single_rows(checked(t)))


@query("scaled_marks", o.with_ctes(*_CHECKED) + f""",
d AS (SELECT transaction_date, market_code, crop_code, CAST(price_c AS DOUBLE) / 100.0 AS price, CAST(volume_c AS DOUBLE) / 100.0 AS volume FROM single WHERE trade),
m AS (SELECT *, min(price) OVER w AS lo, max(price) OVER w AS hi, max(volume) OVER w AS mv FROM d WINDOW w AS (PARTITION BY crop_code))
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, market_code::BIGINT AS market_code, crop_code, price, volume,
  {o.r6('CASE WHEN hi > lo THEN (price - lo) / (hi - lo) ELSE 0.5 END')} AS price_scaled, {o.r6('sqrt(volume / mv)')} AS volume_scaled
FROM m""")
def scaled_marks(t):
    rows = scope.single_rows(checked(t)).filter(filters.is_trade()).select(
        "transaction_date", "market_code", "crop_code",
        (F.col("price_c").cast("double") / 100.0).alias("price"),
        (F.col("volume_c").cast("double") / 100.0).alias("volume"),
    )
    return scope.scaled_marks(materialize(rows, "marks"), "crop_code")


@query("calendar_year", o.with_ctes(o.OBS, calendar_cte()) + """,
n AS (SELECT market_code, transaction_date, count(*) AS n FROM obs GROUP BY ALL)
SELECT CAST(calendar_date AS VARCHAR) AS calendar_date, schedule_status, schedule_reason, isodow(calendar_date) - 1 AS weekday,
  count(*) AS market_entries, coalesce(sum(n), 0)::BIGINT AS observed_rows
FROM cal LEFT JOIN n ON n.market_code = cal.market_code AND transaction_date = calendar_date
GROUP BY calendar_date, schedule_status, schedule_reason""")
def calendar_year(t):
    counts = t.observations.groupBy("market_code", F.col("transaction_date").alias("calendar_date")).agg(F.count(F.lit(1)).alias("n"))
    days = market_calendar(t.observations).join(counts, ["market_code", "calendar_date"], "left")
    return days.groupBy("calendar_date", "schedule_status", "schedule_reason").agg(
        F.weekday("calendar_date").alias("weekday"),
        F.count(F.lit(1)).alias("market_entries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observed_rows"),
    )


def _requested(t):
    years = materialize(scoped(t).select("scope", F.year("transaction_date").alias("year")).distinct(), "years")
    days = calendars.year_days(years).drop("year")
    out = calendars.expand_calendar(days, rules(years.select("year").distinct()))
    return out.select("scope", F.col("calendar_date").alias("transaction_date"), "schedule_status")


def _with_rest_rows(rows):
    """The binding turns the 13th of every month into a reported closing."""
    rest = F.dayofmonth("transaction_date") == 13
    return rows.withColumns({
        "crop_code": F.when(rest, "REST ").otherwise(F.col("crop_code")),
        "crop_name_raw": F.when(rest, "休市").otherwise(F.col("crop_name_raw")),
        "canonical_id": F.when(~rest, F.col("canonical_id")),
    })


def publication(t, sources=None):
    expected = t.read("part").select(F.nullif(F.col("p_type"), F.lit("PROMO")).alias("canonical_id")).filter(
        "canonical_id IS NOT NULL"
    ).distinct()
    rows = _with_rest_rows(accepted(t))
    return calendars.resolve_dates(calendars.market_status(_requested(t), rows, expected, CALENDAR_MARKETS, sources=sources))


PUBLICATION = o.with_ctes(o.OBS, ACCEPTED, calendar_cte("scoped", "scope", "cal")) + """,
rows0 AS (SELECT scope, transaction_date, market_code, day(transaction_date) = 13 AS rest, CASE WHEN day(transaction_date) <> 13 THEN canonical_id END AS item FROM accepted),
ex AS (SELECT DISTINCT p_type AS item FROM part WHERE p_type <> 'PROMO'),
dd AS (SELECT scope, transaction_date, count(*) AS n, bool_and(rest) AS closed, count(DISTINCT item) AS covered,
  count(*) FILTER (NOT rest AND market_code % 2 = 0) AS caln FROM rows0 GROUP BY ALL),
p0 AS (SELECT cal.scope, calendar_date AS d, schedule_status, coalesce(n, 0) AS n, coalesce(closed, false) AS closed, coalesce(covered, 0) AS covered,
  (SELECT count(*) FROM ex) AS expected, CASE WHEN coalesce(caln, 0) > 0 THEN 'available' ELSE 'empty' END AS cfs
  FROM cal LEFT JOIN dd ON dd.scope = cal.scope AND transaction_date = calendar_date),
p1 AS (SELECT *, CASE WHEN n > 0 AND NOT closed THEN 'available' ELSE 'empty' END AS fs,
  CASE WHEN covered = expected THEN 'complete' WHEN closed THEN 'market_closed' WHEN n > 0 THEN 'incomplete' ELSE 'pending' END AS st FROM p0),
p2 AS (SELECT *, CASE WHEN schedule_status = 'scheduled_closed' AND cfs = 'available' THEN 'calendar_feed_discrepancy'
    WHEN schedule_status = 'scheduled_closed' AND st IN ('market_closed', 'pending') THEN 'market_closed'
    WHEN schedule_status <> 'scheduled_closed' AND (st = 'market_closed' OR fs = 'empty') THEN 'pending' ELSE st END AS status,
  max(CASE WHEN st = 'complete' THEN d END) OVER (PARTITION BY scope ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resolved FROM p1)"""


@query("market_status", PUBLICATION + """
SELECT scope::BIGINT AS scope, CAST(d AS VARCHAR) AS transaction_date, schedule_status, n AS observed_record_count, covered AS covered_count,
  expected AS expected_count, fs AS feed_status, cfs AS calendar_feed_status, st AS feed_state, status, CAST(resolved AS VARCHAR) AS resolved_date
FROM p2""")
def market_status(t):
    return publication(t)


@query("latest_complete", PUBLICATION + """
SELECT scope::BIGINT AS scope, CAST(resolved AS VARCHAR) AS resolved_date, count(*) AS requested_days, CAST(min(d) AS VARCHAR) AS first_requested,
  CAST(max(d) AS VARCHAR) AS last_requested
FROM p2 GROUP BY scope, resolved""")
def latest_complete(t):
    """Requested days per resolved day; a NULL resolved day means no complete day so far."""
    return publication(t).groupBy("scope", "resolved_date").agg(
        F.count(F.lit(1)).alias("requested_days"),
        F.min("transaction_date").alias("first_requested"),
        F.max("transaction_date").alias("last_requested"),
    )


_SAID = "CASE day(d) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'delayed' WHEN 2 THEN 'not_checked' END"


@query("feed_matrix", PUBLICATION + f""",
q1 AS (SELECT scope, d, schedule_status, n, resolved, CASE WHEN fs = 'empty' THEN coalesce({_SAID}, 'empty') ELSE fs END AS fs,
  CASE WHEN cfs = 'available' THEN cfs WHEN fs = 'empty' THEN coalesce({_SAID}, 'empty') ELSE 'empty' END AS cfs,
  CASE WHEN n = 0 AND fs = 'empty' AND day(d) % 4 = 0 THEN 'source_unavailable' ELSE st END AS st FROM p2)
SELECT scope::BIGINT AS scope, schedule_status, fs AS feed_status, cfs AS calendar_feed_status, st AS feed_state,
  CASE WHEN schedule_status = 'scheduled_closed' THEN CASE WHEN cfs = 'available' THEN 'calendar_feed_discrepancy' WHEN st IN ('market_closed', 'pending', 'source_unavailable') THEN 'market_closed' ELSE st END
    WHEN fs = 'failed' THEN 'source_unavailable' WHEN st = 'market_closed' OR fs IN ('empty', 'delayed', 'not_checked') THEN 'pending' ELSE st END AS status,
  count(*) AS days
FROM q1 GROUP BY ALL""")
def feed_matrix(t):
    """All feed states against the schedule: the sources of silent days failed, were late or were not asked."""
    day = F.dayofmonth("transaction_date") % 4
    said = F.when(day == 0, "failed").when(day == 1, "delayed").when(day == 2, "not_checked").otherwise("available")
    sources = _requested(t).select("scope", "transaction_date", said.alias("source_status"))
    return publication(t, sources).groupBy("scope", "schedule_status", "feed_status", "calendar_feed_status", "feed_state", "status").agg(F.count(F.lit(1)).alias("days"))


@query("calendar_contract", o.with_ctes(o.OBS, calendar_cte()) + """,
one AS (SELECT * FROM cal WHERE market_code = (SELECT min(market_code) FROM obs) AND NOT (month(calendar_date) = 3 AND day(calendar_date) = 3 AND year(calendar_date) % 2 = 0)),
twice AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE month(calendar_date) = 7 AND day(calendar_date) = 7)
SELECT 'closed_day_count' AS rule, CAST(year(calendar_date) AS VARCHAR) AS key FROM twice GROUP BY year(calendar_date) HAVING count(*) FILTER (schedule_status = 'scheduled_closed') <> 58
UNION ALL SELECT 'date_repeated', CAST(calendar_date AS VARCHAR) FROM twice GROUP BY calendar_date HAVING count(*) > 1
UNION ALL SELECT 'year_incomplete', CAST(year(calendar_date) AS VARCHAR) FROM twice GROUP BY year(calendar_date) HAVING count(DISTINCT calendar_date) <> make_date(year(calendar_date) + 1, 1, 1) - make_date(year(calendar_date), 1, 1)
UNION ALL SELECT 'exceptional_not_monday', CAST(calendar_date AS VARCHAR) FROM one WHERE month(calendar_date) = 5 AND day(calendar_date) = 1 AND isodow(calendar_date) <> 1""")
def calendar_contract(t):
    """The calendar of the first market against its rules, with days lost, doubled and wrongly excepted."""
    first = t.observations.filter(F.col("market_code") == t.observations.select(F.min("market_code")).scalar())
    d = F.col("calendar_date")
    calendar = materialize(market_calendar(first), "calendar").filter(~((F.month(d) == 3) & (F.dayofmonth(d) == 3) & (F.year(d) % 2 == 0)))
    doubled = calendar.unionByName(calendar.filter((F.month(d) == 7) & (F.dayofmonth(d) == 7)))
    years = calendar.select(F.year(d).alias("year")).distinct()
    wrong = calendar.filter((F.month(d) == 5) & (F.dayofmonth(d) == 1)).select("calendar_date", F.lit("exceptional").alias("kind"), F.lit("planted").alias("reason"))
    return calendars.calendar_violations(doubled, rules(years).unionByName(wrong), years.withColumn("expected_closed_days", F.lit(58)))


@query("backfill_chunks", o.with_ctes(o.OBS) + """,
r AS (SELECT source_id, market_code, min(transaction_date) AS s, max(transaction_date) AS e FROM obs GROUP BY ALL),
c AS (SELECT source_id, market_code, s, e, unnest(range(0, CAST(ceil((e - s + 1) / 4.0) AS BIGINT))) AS i FROM r)
SELECT source_id, market_code::BIGINT AS market_code, i AS chunk_no, CAST(s + CAST(4 * i AS INT) AS VARCHAR) AS chunk_start,
  CAST(least(s + CAST(4 * i + 3 AS INT), e) AS VARCHAR) AS chunk_end
FROM c""")
def backfill_chunks(t):
    ranges = t.observations.groupBy("source_id", "market_code").agg(
        F.min("transaction_date").alias("start_date"), F.max("transaction_date").alias("end_date")
    )
    return calendars.backfill_chunks(ranges)


@query("sla_gap", """WITH b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM b),
slots AS (SELECT CAST(d AS TIMESTAMP) + INTERVAL 557 MINUTE AS slot, CAST(d AS TIMESTAMP) + INTERVAL 1097 MINUTE AS nxt FROM days
  UNION ALL SELECT CAST(d AS TIMESTAMP) + INTERVAL 1097 MINUTE, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY + INTERVAL 557 MINUTE FROM days)
SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, count(ts) AS matching_runs, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_run,
  CASE WHEN count(ts) > 0 THEN 'skip' ELSE 'dispatch' END AS action
FROM slots LEFT JOIN events ON ts >= slot - INTERVAL 2 MINUTE AND ts <= least(slot + INTERVAL 32 MINUTE, nxt - INTERVAL 1 SECOND)
GROUP BY slot""")
def sla_gap(t):
    out = calendars.missed_slots(t.read("events"), "ts", SLOTS)
    form = "yyyy-MM-dd HH:mm:ss"
    return out.withColumns({
        "slot": F.date_format("slot", form), "latest_run": F.date_format("latest_run", form)
    })
