"""Price panel, scores and daily lists."""

from pyspark.sql import functions as F

from marketpanel.operators import filters, panel, score
from marketpanel.plans import oracle as o
from marketpanel.plans.registry import query
from marketpanel.sources.tables import Tables


def daily(t: Tables):
    return panel.daily_prices(t.observations)


def scores(t: Tables):
    return score.score_panel(panel.price_panel(daily(t)), t.seasons)


@query("fixture_filter", o.with_ctes(o.CLEAN) + """
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, coalesce(source_status, 'none') AS source_status,
  count(*) AS kept_rows, CAST(count(*) FILTER (trade) AS BIGINT) AS trade_rows
FROM clean GROUP BY ALL""")
def fixture_filter(t):
    kept = filters.analysis_rows(t.observations)
    return kept.groupBy(
        "transaction_date", F.coalesce("source_status", F.lit("none")).alias("source_status")
    ).agg(
        F.count(F.lit(1)).alias("kept_rows"),
        F.count_if(filters.is_trade()).alias("trade_rows"),
    )


@query("daily_vwap", o.with_ctes(o.CLEAN, o.daily()) + """
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, u6 / 1e6 AS weighted_avg_price,
  CAST(d AS DOUBLE) / 100.0 AS total_volume, market_count, median_c / 100.0 AS median_price,
  CAST(low_c AS DOUBLE) / 100.0 AS min_price, CAST(high_c AS DOUBLE) / 100.0 AS max_price,
  valid_rows AS valid_row_count, excluded_rows AS excluded_row_count,
  CASE WHEN excluded_rows > 0 THEN 'zero-price-or-volume-excluded' ELSE '' END AS quality_warnings
FROM dayp""")
def daily_vwap(t):
    return panel.daily_vwap(t.observations)


_ROLLING = ", ".join(
    f"price_{w}, volume_{w}, avg_volume_{w}, coverage_{w}, status_{w}, "
    f"{o.r6(o.pct('p / 100.0', f'price_{w}'))} AS price_change_{w}, "
    f"{o.r6(o.pct('volume', f'avg_volume_{w}'))} AS volume_change_{w}"
    for w in ("7d", "30d", "90d")
)


@query("rolling_vwap", o.PANEL + f"""
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, price, volume, market_count, has_warning,
  {_ROLLING} FROM pan""")
def rolling_vwap(t):
    return panel.rolling_prices(daily(t))


@query("prev_day", o.PANEL + """
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, price,
  CAST(previous_date AS VARCHAR) AS previous_date, previous_price, previous_change, previous_status FROM pan""")
def prev_day(t):
    return panel.previous_day(daily(t))


_RANGES = ", ".join(
    f"n{w} AS observed_{w}, lo{w}.u / 1e6 AS min_price_{w}, CAST(lo{w}.d AS VARCHAR) AS min_date_{w}, "
    f"hi{w}.u / 1e6 AS max_price_{w}, CAST(DATE '1970-01-01' + CAST(-(hi{w}.d) AS INTEGER) AS VARCHAR) AS max_date_{w}, "
    f"CASE WHEN n{w} >= {low} THEN 'valid' ELSE 'insufficient' END AS range_status_{w}"
    for w, low in (("7d", 3), ("30d", 10), ("90d", 30))
)


@query("range_stats", o.PANEL + f"""
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, {_RANGES} FROM pan""")
def range_stats(t):
    return panel.range_stats(daily(t))


@query("volatility", o.PANEL + """
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, n7d AS observed_7d, volatility_7d,
  volatility_status FROM pan""")
def volatility(t):
    return panel.volatility(daily(t))


@query("daily_tail", o.with_ctes(o.CLEAN, o.daily()) + """,
tail AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY transaction_date DESC) AS n FROM dayp)
SELECT canonical_id, CAST(transaction_date AS VARCHAR) AS date, u6 / 1e6 AS price, CAST(d AS DOUBLE) / 100.0 AS volume,
  d > 0 AS charted, n <= 14 AS in_table
FROM tail WHERE n <= 120""")
def daily_tail(t):
    tail = panel.chart_points(panel.daily_tail(daily(t)))
    rows = tail.select("canonical_id", "points", F.posexplode("daily").alias("pos", "d"), F.size("daily").alias("n"))
    return rows.select(
        "canonical_id", F.col("d.date").alias("date"), F.col("d.price").alias("price"),
        F.col("d.volume").alias("volume"),
        F.exists("points", lambda p: p["date"] == F.col("d.date")).alias("charted"),
        (F.col("pos") >= F.col("n") - 14).alias("in_table"),
    )


@query("season_status", o.with_ctes(o.CLEAN, o.daily(), o.SEASONS) + """
SELECT canonical_id, CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS month,
  CASE WHEN max(months) IS NULL THEN 'unknown' WHEN list_contains(max(months), month(max(transaction_date))) THEN 'in_season'
    ELSE 'out_of_season' END AS season_status,
  count(*) AS days
FROM dayp LEFT JOIN seasons USING (canonical_id) GROUP BY canonical_id, date_trunc('month', transaction_date)""")
def season_status(t):
    months = daily(t).groupBy("canonical_id", F.trunc("transaction_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("days")
    )
    out = score.season_status(months.withColumn("month_no", F.month("month")), t.seasons)
    return out.select("canonical_id", "month", "season_status", "days")


_SCORE_COLUMNS = """CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, CAST(score AS BIGINT) AS score, verdict,
  eligible, season_status, price, volume, previous_change, vs_7d, vs_30d, volume_vs_7d, volatility_7d, market_count,
  coverage_7d, coverage_30d, coverage_90d"""


@query("buy_score", o.SCORED + f"""
SELECT {_SCORE_COLUMNS}, CAST(points_season AS BIGINT) AS points_season, CAST(points_7d AS BIGINT) AS points_7d,
  CAST(points_30d AS BIGINT) AS points_30d, CAST(points_volume AS BIGINT) AS points_volume,
  CAST(points_quality AS BIGINT) AS points_quality, CAST(points_volatility AS BIGINT) AS points_volatility,
  array_to_string(codes, '|') AS reason_codes
FROM scores""")
def buy_score(t):
    return scores(t)


_RANK = "eligible DESC, score DESC, canonical_id"


@query("score_panel", o.SCORED + f"""
SELECT {_SCORE_COLUMNS}, array_to_string(codes, '|') AS reason_codes,
  row_number() OVER (PARTITION BY transaction_date ORDER BY {_RANK}) AS rank FROM scores""")
def score_panel(t):
    points = [f"points_{p}" for p in ("season", "7d", "30d", "volume", "quality", "volatility")]
    return score.ranked(scores(t)).drop(*points)


@query("top_picks", o.SCORED + f""", r AS (
SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY {_RANK}) AS rank FROM scores)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, CAST(score AS BIGINT) AS score, verdict, rank
FROM r WHERE eligible AND rank <= 6""")
def top_picks(t):
    return score.top_picks(scores(t)).select("transaction_date", "canonical_id", "score", "verdict", "rank")


@query("movers", o.SCORED + f""", m AS (
SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY previous_change, {_RANK}) AS f,
  row_number() OVER (PARTITION BY transaction_date ORDER BY previous_change DESC, {_RANK}) AS r
FROM scores WHERE previous_change IS NOT NULL)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, previous_change,
  CASE WHEN f <= 5 THEN f END AS fall_rank, CASE WHEN r <= 5 THEN r END AS rise_rank
FROM m WHERE f <= 5 OR r <= 5""")
def movers(t):
    return score.movers(scores(t))


_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in score.VERDICT_LABELS.items())
_REASON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in score.REASON_LABELS.items())


@query("advice", o.SCORED + f""", a AS (
SELECT *, CASE WHEN verdict IN ('priority', 'consider') THEN 'priority' ELSE 'watch' END AS list
FROM scores WHERE verdict IN ('priority', 'consider', 'hold', 'insufficient')),
b AS (SELECT *, row_number() OVER (PARTITION BY transaction_date, list ORDER BY {_RANK}) AS place FROM a)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, list, place, canonical_id, CAST(score AS BIGINT) AS score, verdict,
  CASE verdict {_LABEL} END || '：' || CASE WHEN len(codes) > 0
    THEN array_to_string(list_transform(codes, lambda c: CASE c {_REASON} END), '、') ELSE '依決定性規則判定' END || '。' AS text,
  CAST(transaction_date AS VARCHAR) || ': what to buy' AS headline
FROM b WHERE place <= CASE WHEN list = 'priority' THEN 5 ELSE 3 END""")
def advice(t):
    return score.advice(scores(t))


@query("advice_evidence", o.SCORED + f""", e AS (
SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY {_RANK}) AS place
FROM scores WHERE verdict IN ('priority', 'consider', 'hold', 'insufficient'))
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, place, canonical_id, CAST(score AS BIGINT) AS score, verdict,
  season_status, price, previous_change, vs_7d, vs_30d, volume_vs_7d, market_count, coverage_7d, coverage_30d, coverage_90d,
  array_to_string(codes, '|') AS reason_codes
FROM e WHERE place <= 8""")
def advice_evidence(t):
    return score.evidence_rows(scores(t))


@query("advice_summary", o.SCORED + f""",
c AS (SELECT transaction_date, least(count(*) FILTER (verdict IN ('priority', 'consider')), 5) AS n FROM scores GROUP BY ALL)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, n AS priority_count, CAST(transaction_date AS VARCHAR) || ': what to buy' AS headline,
  CAST(n AS VARCHAR) || ' on the list. Decided by fixed rules.' AS summary FROM c""")
def advice_summary(t):
    return score.advice_summary(scores(t))


NUL = "\\N"  # what the hash takes for a null
_EVIDENCE_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("evidence_hash", o.SCORED + f""", e AS (
SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY {_RANK}) AS place
FROM scores WHERE verdict IN ('priority', 'consider', 'hold', 'insufficient')),
g AS (SELECT transaction_date, sha256(concat_ws(chr(31), CAST(place AS VARCHAR), canonical_id, CAST(CAST(score AS BIGINT) AS VARCHAR), verdict, season_status,
    {', '.join(f"coalesce(CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR), '{NUL}')" for c in ('price', 'previous_change', 'vs_7d', 'vs_30d', 'volume_vs_7d'))},
    {', '.join(f"coalesce(CAST({c} AS VARCHAR), '{NUL}')" for c in ('market_count', 'coverage_7d', 'coverage_30d', 'coverage_90d'))}, array_to_string(codes, '|'))) AS h
  FROM e WHERE place <= 8)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, count(*) AS record_count,
  'sha256:' || sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_EVIDENCE_LANES})) AS content_hash
FROM g GROUP BY transaction_date""")
def evidence_hash(t):
    return score.evidence_digest(score.evidence_rows(scores(t)))
