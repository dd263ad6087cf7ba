"""Common table expressions of the SQL oracles, written apart from the Spark jobs."""

from marketpanel.sources.tables import ITEMS, SEASON_MONTHS

OBS = """obs AS (
  SELECT l_orderkey AS batch_no, l_linenumber AS page_no, l_partkey AS row_a, l_suppkey AS row_b,
    CAST(l_shipdate AS DATE) AS transaction_date, s_nationkey AS market_code, p_brand AS crop_code,
    p_name AS crop_name_raw, NULLIF(p_type, 'PROMO') AS canonical_id,
    CASE WHEN l_returnflag = 'A' AND l_quantity = 2 THEN 0
         ELSE CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) END AS price_c,
    CASE WHEN l_returnflag = 'R' AND l_quantity = 1 THEN 0
         ELSE CAST(l_quantity AS BIGINT) * 100 END AS volume_c,
    CASE WHEN l_discount = 0.1 THEN ' Fixture ' ELSE '2002-01-01T00:00:00Z' END AS fetched_at,
    CASE WHEN l_linenumber < 7 THEN 'success' END AS source_status,
    CASE WHEN l_linestatus = 'F' THEN 'authoritative_final'
         WHEN l_returnflag = 'N' THEN 'provisional' ELSE 'validation' END AS source_role,
    'src_' || CAST(l_suppkey % 4 AS VARCHAR) AS source_id,
    CASE WHEN l_suppkey % 4 = 3 THEN 20 ELSE 10 END AS source_precedence
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

CLEAN = OBS + """,
clean AS (SELECT *, price_c > 0 AND volume_c > 0 AS trade FROM obs
  WHERE lower(trim(fetched_at)) <> 'fixture' AND coalesce(lower(trim(source_status)), '') <> 'fixture')"""


def daily(by: str = "canonical_id", source: str = "clean") -> str:
    return f"""daily AS (
  SELECT transaction_date, {by},
    coalesce(sum(price_c * volume_c) FILTER (trade), 0) AS v,
    coalesce(sum(volume_c) FILTER (trade), 0) AS d,
    count(DISTINCT market_code) FILTER (trade) AS market_count,
    count(*) FILTER (trade) AS valid_rows, count(*) FILTER (NOT trade) AS excluded_rows,
    min(price_c) FILTER (trade) AS low_c, max(price_c) FILTER (trade) AS high_c,
    median(price_c) FILTER (trade) AS median_c
  FROM {source} WHERE canonical_id IS NOT NULL GROUP BY ALL),
dayp AS (
  SELECT *, CASE WHEN d > 0 THEN CAST((20000 * v + d) // (2 * d) AS BIGINT) END AS u6,
    CASE WHEN d > 0 THEN CAST(v AS DOUBLE) / CAST(d AS DOUBLE) END AS p
  FROM daily)"""


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def pct(cur: str, ref: str) -> str:
    return f"(CASE WHEN ({cur}) IS NOT NULL AND ({ref}) <> 0 THEN (({cur}) - ({ref})) / ({ref}) * 100.0 END)"


def panel(by: str = "canonical_id") -> str:
    frames, cols, out = [], [], []
    for name, days, low in (("7d", 7, 3), ("30d", 30, 10), ("90d", 90, 30)):
        frames.append(
            f"w{name} AS (PARTITION BY {by} ORDER BY transaction_date "
            f"RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING AND CURRENT ROW)"
        )
        cols.append(
            f"sum(v) OVER w{name} AS v{name}, sum(d) OVER w{name} AS d{name}, "
            f"count(p) OVER w{name} AS n{name}, "
            f"min(CASE WHEN p IS NOT NULL THEN {{'p': p, 'd': transaction_date, 'u': u6}} END) OVER w{name} AS lo{name}, "
            f"max(CASE WHEN p IS NOT NULL THEN {{'p': p, 'd': -(transaction_date - DATE '1970-01-01'), 'u': u6}} END) OVER w{name} AS hi{name}"
        )
        out.append(
            f"CASE WHEN d{name} > 0 THEN CAST((20000 * v{name} + d{name}) // (2 * d{name}) AS BIGINT) / 1e6 END AS price_{name}, "
            f"CAST(d{name} AS DOUBLE) / 100.0 AS volume_{name}, n{name} AS coverage_{name}, "
            f"CASE WHEN n{name} > 0 THEN {r6(f'CAST(d{name} AS DOUBLE) / 100.0 / n{name}')} END AS avg_volume_{name}, "
            f"CASE WHEN n{name} >= {low} THEN 'valid' ELSE 'insufficient' END AS status_{name}"
        )
    return f"""wins AS (
  SELECT *, {', '.join(cols)},
    stddev_pop(p) OVER w7d AS sd, avg(p) OVER w7d AS mean,
    last_value(CASE WHEN p IS NOT NULL THEN {{'d': transaction_date, 'p': p, 'u': u6}} END IGNORE NULLS)
      OVER (PARTITION BY {by} ORDER BY transaction_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM dayp WINDOW {', '.join(frames)}),
pan AS (
  SELECT *, u6 / 1e6 AS price, CAST(d AS DOUBLE) / 100.0 AS volume, excluded_rows > 0 AS has_warning,
    prev.d AS previous_date, prev.u / 1e6 AS previous_price, {r6(pct('p', 'prev.p'))} AS previous_change,
    CASE WHEN prev IS NULL THEN 'insufficient' ELSE 'valid' END AS previous_status,
    CASE WHEN n7d >= 3 AND mean <> 0 THEN {r6('sd / mean')} END AS volatility_7d,
    CASE WHEN n7d >= 3 THEN 'valid' ELSE 'insufficient' END AS volatility_status,
    {', '.join(out)}
  FROM wins)"""


SEASONS = "seasons(canonical_id, months) AS (VALUES " + ", ".join(
    f"('{item}', [{', '.join(map(str, months))}])" for item, months in SEASON_MONTHS.items()
) + ")"


def ladder(x: str, steps, compare: str, beyond: int = 0) -> str:
    cases = " ".join(f"WHEN {x} {compare} {limit} THEN {points}" for limit, points in steps)
    return f"(CASE WHEN {x} IS NULL THEN 0 {cases} ELSE {beyond} END)"


PRICE_STEPS = ((0.85, 25), (0.95, 20), (1.0, 15), (1.05, 10), (1.15, 5))
VOLUME_STEPS = ((1.25, 15), (1.0, 12), (0.75, 8), (0.5, 4))
VOLATILITY_STEPS = ((0.1, 0), (0.2, -3), (0.3, -7))

SCORES = f"""s0 AS (
  SELECT pan.*, CASE WHEN months IS NULL THEN 'unknown'
      WHEN list_contains(months, month(transaction_date)) THEN 'in_season' ELSE 'out_of_season' END AS season_status,
    CASE WHEN price_7d > 0 THEN price / price_7d END AS q7, CASE WHEN price_30d > 0 THEN price / price_30d END AS q30,
    CASE WHEN avg_volume_7d > 0 THEN volume / avg_volume_7d END AS qv
  FROM pan LEFT JOIN seasons USING (canonical_id)),
s1 AS (
  SELECT *, season_status = 'in_season' AND price IS NOT NULL AND volume > 0 AND status_7d = 'valid'
      AND status_30d = 'valid' AND market_count >= 2 AND NOT has_warning AS eligible FROM s0),
s2 AS (
  SELECT *, CASE WHEN season_status = 'in_season' THEN 30 ELSE 0 END AS points_season,
    CASE WHEN status_7d = 'valid' THEN {ladder('q7', PRICE_STEPS, '<=')} ELSE 0 END AS points_7d,
    CASE WHEN status_30d = 'valid' THEN {ladder('q30', PRICE_STEPS, '<=')} ELSE 0 END AS points_30d,
    CASE WHEN status_7d = 'valid' THEN {ladder('qv', VOLUME_STEPS, '>=')} ELSE 0 END AS points_volume,
    CASE WHEN eligible THEN 5 ELSE 0 END AS points_quality,
    {ladder('volatility_7d', VOLATILITY_STEPS, '<=', -10)} AS points_volatility FROM s1),
s3 AS (
  SELECT *, greatest(0, least(100, points_season + points_7d + points_30d + points_volume + points_quality
    + points_volatility)) AS score FROM s2),
scores AS (
  SELECT *, CASE WHEN season_status <> 'in_season' THEN 'not_ranked' WHEN NOT eligible THEN 'insufficient'
      WHEN score >= 80 THEN 'priority' WHEN score >= 65 THEN 'consider' WHEN score >= 50 THEN 'watch' ELSE 'hold' END AS verdict,
    list_slice(list_filter([
      CASE WHEN status_7d <> 'valid' OR status_30d <> 'valid' THEN 'COVERAGE_INSUFFICIENT' END,
      CASE WHEN market_count < 2 THEN 'MARKET_COUNT_INSUFFICIENT' END,
      CASE WHEN has_warning THEN 'DATA_QUALITY_WARNING' END,
      CASE WHEN season_status = 'in_season' THEN 'IN_SEASON' END,
      CASE WHEN q7 <= 1 THEN 'PRICE_AT_OR_BELOW_7D' END,
      CASE WHEN q30 <= 1 THEN 'PRICE_AT_OR_BELOW_30D' END,
      CASE WHEN qv >= 1 THEN 'VOLUME_HEALTHY' END], lambda x: x IS NOT NULL), 1, 4) AS codes,
    {r6(pct('price', 'price_7d'))} AS vs_7d, {r6(pct('price', 'price_30d'))} AS vs_30d,
    {r6(pct('volume', 'avg_volume_7d'))} AS volume_vs_7d
  FROM s3)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


PANEL = with_ctes(CLEAN, daily(), panel())
SCORED = with_ctes(CLEAN, daily(), panel(), SEASONS, SCORES)

FEED = OBS + """,
feed AS (
  SELECT batch_no, page_no, row_a, row_b, transaction_date AS observed_on,
    CAST(date_trunc('month', transaction_date) AS DATE) AS transaction_date, market_code, crop_code,
    'wholesale_market_daily_transaction' AS dataset_semantics, canonical_id, price_c, volume_c, source_role,
    source_id, source_precedence, price_c // 50000 AS level,
    'sha256:' || sha256(concat_ws(chr(31), CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR),
      CAST(market_code AS VARCHAR), crop_code, 'wholesale_market_daily_transaction',
      CAST(price_c // 50000 AS VARCHAR))) AS row_hash
  FROM obs)"""


def _list(values) -> str:
    inner = ", ".join(f"'{v}'" for v in values)
    return f"CAST([{inner}] AS VARCHAR[])"


ITEM_DIM = "items(canonical_id, display_name, category, enabled, codes, season_names, aliases, traces) AS (VALUES " + ", ".join(
    f"('{i}', '{name}', '{category}', {str(on).lower()}, {_list(codes)}, {_list(seasons)}, {_list(aliases)}, {_list(traces)})"
    for i, name, category, on, codes, seasons, aliases, traces in ITEMS
) + ")"

NUMBER = r"'^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def number(x: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({x}, {NUMBER}) AND TRY_CAST(trim({x}) AS DOUBLE) >= 0 "
        f"AND NOT isinf(TRY_CAST(trim({x}) AS DOUBLE)) THEN TRY_CAST(trim({x}) AS DOUBLE) END)"
    )
