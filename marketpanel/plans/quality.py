"""Contracts, text policy, link checks, reconciliation, reports and scalar surfaces."""

from pyspark.sql import functions as F

from marketpanel.functions import dates, numeric, text
from marketpanel.operators import panel, quality, score, spatial
from marketpanel.plans import oracle as o
from marketpanel.plans import prices
from marketpanel.plans.evidence import LOTS_SQL, lots
from marketpanel.plans.registry import query
from marketpanel.plans import scope as scope_plans
from marketpanel.plans.scope import PUBLICATION, publication
from marketpanel.schemas import SOURCE_ROLES
from marketpanel.sources.sinks import is_complete, work_folder

# Fixed values of the test binding.
HOSTS = ("thther.example.org", "m.ththth.example.net")
JSON_FIELDS = ("schema_version", "run_id", "trigger", "status", "analysis")
CLAIMS = ("token", "%%%", "###")


@query("contract_checks", r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages),
a AS (SELECT CASE WHEN url NOT LIKE 'https://%' THEN 'url_not_https' WHEN host NOT IN ('thther.example.org', 'm.ththth.example.net') THEN 'url_host_not_allowed'
    WHEN url LIKE '%#%' THEN 'url_fragment' END AS rule, CAST(page_id AS VARCHAR) AS key FROM u),
b AS (SELECT unnest(list_filter([CASE WHEN value < 0 THEN 'event_negative_amount' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type_not_listed' END,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) IS NULL THEN 'event_without_class' END], lambda x: x IS NOT NULL)) AS rule, CAST(event_id AS VARCHAR) AS key FROM events),
c AS (SELECT unnest(list_filter([CASE WHEN l_tax > 0.075 THEN 'tax_above_limit' END, CASE WHEN l_shipdate > TIMESTAMP '2001-10-01' THEN 'outside_batch_range' END],
    lambda x: x IS NOT NULL)) AS rule, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key FROM lineitem),
d AS (SELECT 'duplicate_line' AS rule, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
SELECT rule, key FROM (SELECT * FROM a WHERE rule IS NOT NULL UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d)""")
def contract_checks(t):
    problem = quality.https_url_problem(F.col("url"), HOSTS)
    urls = t.read("pages").select(F.concat(F.lit("url_"), problem).alias("rule"), F.col("page_id").cast("string").alias("key")).filter("rule IS NOT NULL")
    events = quality.violations(t.read("events"), F.col("event_id"), [
        ("event_negative_amount", F.col("value") < 0),
        ("event_type_not_listed", ~F.col("event_type").isin("click", "view", "purchase", "signup")),
        ("event_without_class", F.get_json_object("props", "$.k").try_cast("bigint").isNull()),
    ])
    lines = t.read("lineitem")
    ranged = quality.violations(lines, F.concat_ws("-", "l_orderkey", "l_linenumber"), [
        ("tax_above_limit", F.col("l_tax") > 0.075),
        ("outside_batch_range", ~F.col("l_shipdate").cast("date").between(F.lit("1990-01-01").cast("date"), F.lit("2001-10-01").cast("date"))),
    ])
    duplicated = quality.duplicate_keys(lines, "duplicate_line", ["l_orderkey", "l_linenumber"])
    return urls.unionByName(events).unionByName(ranged).unionByName(duplicated)


@query("source_contract", o.with_ctes(o.FEED) + """
SELECT rule, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN source_role <> 'authoritative_final' THEN 'role_not_final' END, CASE WHEN source_precedence < 20 THEN 'low_precedence' END,
    CASE WHEN observed_on > transaction_date + 27 THEN 'outside_requested_range' END], lambda x: x IS NOT NULL)) AS rule FROM feed) GROUP BY rule""")
def source_contract(t):
    found = quality.violations(t.feed, F.col("batch_no"), [
        ("unknown_role", ~F.col("source_role").isin(*SOURCE_ROLES)),
        ("role_not_final", F.col("source_role") != "authoritative_final"),
        ("bad_hash", ~F.col("row_hash").rlike("^sha256:[0-9a-f]{64}$")),
        ("bad_source_id", ~F.col("source_id").rlike("^[a-z0-9][a-z0-9._-]*$")),
        ("low_precedence", F.col("source_precedence") < 20),
        ("outside_requested_range", ~F.col("observed_on").between(F.col("transaction_date"), F.date_add("transaction_date", 27))),
    ])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("status_contract", PUBLICATION + """
SELECT scope::BIGINT AS scope, unnest(list_filter([CASE WHEN resolved IS NULL THEN 'no_complete_day_yet' END, CASE WHEN status <> st THEN 'schedule_overrides_feed' END,
  CASE WHEN covered > expected THEN 'covered_above_expected' END], lambda x: x IS NOT NULL)) AS rule, CAST(d AS VARCHAR) AS key FROM p2""")
def status_contract(t):
    """Publication rows against the status contract; the last two rules report, they do not block."""
    rows = publication(t)
    found = quality.violations(rows, F.struct("scope", "transaction_date"), [
        *quality.status_rules(),
        ("no_complete_day_yet", F.col("resolved_date").isNull()),
        ("schedule_overrides_feed", F.col("status") != F.col("feed_state")),
    ])
    key = r"^\{([0-9]+), ([0-9-]+)\}$"
    return found.select(F.regexp_extract("key", key, 1).cast("bigint").alias("scope"), "rule", F.regexp_extract("key", key, 2).alias("key"))


@query("registry_contract", LOTS_SQL + """
SELECT rule, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN tracecode IS NULL THEN 'missing_tracecode' END, CASE WHEN place IS NULL THEN 'no_coarse_place' END,
  CASE WHEN canonical_id IS NULL THEN 'unmapped_product' END, CASE WHEN valid_date IS NULL THEN 'unknown_validity' END], lambda x: x IS NOT NULL)) AS rule FROM lots) GROUP BY rule""")
def registry_contract(t):
    found = quality.violations(lots(t), F.col("tracecode"), quality.registry_rules())
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("dim_checks", """WITH c AS (SELECT 'code_maps_to_many_items' AS rule, p_brand AS key, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1),
d AS (SELECT 'duplicate_category_name' AS rule, CASE WHEN p_size % 2 = 0 THEN 'fruit' ELSE 'vegetable' END || '|' || p_name AS key, count(*) AS n FROM part
  GROUP BY p_size % 2, p_name HAVING count(*) > 1),
e AS (SELECT 'category_not_allowed' AS rule, p_type AS key, count(*) AS n FROM part WHERE p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD') GROUP BY p_type)
SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e""")
def dim_checks(t):
    part = t.read("part")
    count = F.count(F.lit(1)).alias("n")
    codes = part.select("p_brand", "p_type").distinct().groupBy(F.col("p_brand").alias("key")).agg(count).filter("n > 1")
    category = F.when(F.col("p_size") % 2 == 0, "fruit").otherwise("vegetable")
    names = part.groupBy(F.concat_ws("|", category, "p_name").alias("key")).agg(count).filter("n > 1")
    foreign = part.filter(~F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD")).groupBy(F.col("p_type").alias("key")).agg(count)
    named = (("code_maps_to_many_items", codes), ("duplicate_category_name", names), ("category_not_allowed", foreign))
    parts = [df.select(F.lit(rule).alias("rule"), "key", "n") for rule, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _run_documents(t):
    """Events as JSON run documents; some lack a field, add one, repeat a key or carry NaN."""
    key, q = F.col("event_id"), '"'
    return t.read("events").select("event_id", F.concat(
        F.lit('{"schema_version":"1.0","run_id":"'), F.when(key % 13 == 5, "RUN ").otherwise("run-"), key.cast("string"),
        F.lit('","trigger":"'), F.when(F.col("event_type") == "view", "manual").when(F.col("event_type") == "click", "schedule").otherwise(F.col("event_type")), F.lit(q),
        F.when(key % 7 != 3, F.lit(',"status":"proposed"')).otherwise(""),
        F.when(key % 11 == 4, F.lit(',"extra":1')).otherwise(""),
        F.when(key % 17 == 6, F.lit(',"run_id":"run-2"')).otherwise(""),
        F.when(key % 19 == 7, F.lit(',"analysis":{"v":NaN}}')).when(key % 23 == 8, F.lit(',"analysis":')).otherwise(F.concat(F.lit(',"analysis":'), F.col("props"), F.lit("}"))),
    ).alias("document"))


@query("json_contract", """SELECT event_id, CASE WHEN event_id % 17 = 6 AND event_id % 19 <> 7 AND event_id % 23 = 8 THEN 'not_json'
  WHEN event_id % 19 = 7 THEN 'constant' WHEN event_id % 23 = 8 THEN 'not_json' WHEN event_id % 17 = 6 THEN 'duplicate_key'
  WHEN event_id % 7 = 3 THEN 'missing_field' WHEN event_id % 11 = 4 THEN 'unknown_field' WHEN event_id % 13 = 5 THEN 'bad_run_id'
  WHEN event_type NOT IN ('view', 'click') THEN 'bad_trigger' END AS problem FROM events""")
def json_contract(t):
    return quality.json_contract(_run_documents(t), "document", JSON_FIELDS, [
        ("bad_version", "$.schema_version", r"^1\.0$"),
        ("bad_run_id", "$.run_id", "^[a-z0-9][a-z0-9._-]{2,127}$"),
        ("bad_trigger", "$.trigger", "^(schedule|manual|agent-request)$"),
        ("bad_status", "$.status", "^proposed$"),
    ]).select("event_id", "problem")


@query("text_policy", """SELECT source, id, unnest(list_filter([CASE WHEN contains(text, 'token') THEN 'prohibited:token' END, CASE WHEN contains(text, '%%%') THEN 'prohibited:%%%' END,
  CASE WHEN contains(text, '###') THEN 'prohibited:###' END, CASE WHEN length(text) > 1200 THEN 'too_long' END, CASE WHEN contains(text, '$$$') AND NOT contains(text, '***') THEN 'missing_disclaimer' END],
  lambda x: x IS NOT NULL)) AS rule
FROM (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations)""")
def text_policy(t):
    documents = t.read("documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("id"), "text")
    turns = t.read("conversations").select(F.lit("conversations").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return quality.text_policy(documents.unionByName(turns), "text", CLAIMS, trigger="$$$", disclaimer="***")


_MARKS = ", ".join(f"CASE WHEN contains(lower(text), '{m.lower()}') THEN '{m}' END" for m in quality.SECRET_MARKS)


@query("secret_scan", f"""SELECT source, id, unnest(list_filter([{_MARKS}, CASE WHEN regexp_matches(text, 'token = "[0-9a-f]{{40}}"') THEN 'token_assignment' END],
  lambda x: x IS NOT NULL)) AS hit
FROM (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id, text FROM conversations UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)""")
def secret_scan(t):
    parts = [
        t.read(name).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(body).alias("text"))
        for name, key, body in (("documents", "doc_id", "text"), ("pages", "page_id", "html"),
                                ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text"))
    ]
    return quality.secret_hits(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "text")


def _linked_pages(t):
    """The given pages; site links become relative ones in a third of them, in single quotes, and ./ in another."""
    html = (
        F.when(F.col("page_id") % 3 == 1, F.regexp_replace("html", r'href="/([^"]*)"', "href='../$1'"))
        .when(F.col("page_id") % 3 == 2, F.replace("html", F.lit('href="/'), F.lit('href="./'))).otherwise(F.col("html"))
    )
    return t.read("pages").withColumn("html", html)


@query("link_check", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
    regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS own, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT page_id, site, regexp_replace(own, '[^/]*$', '') AS folder, regexp_replace(href, '[?#].*$', '') AS href FROM p WHERE NOT regexp_matches(href, '^(https:|http:|#|mailto:)')),
t AS (SELECT site || CASE page_id % 3 WHEN 0 THEN href WHEN 1 THEN regexp_replace(folder, '[^/]+/$', '') || substr(href, 2) ELSE folder || substr(href, 2) END AS target, count(*) AS links FROM l GROUP BY 1)
SELECT * FROM t WHERE target NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages)""")
def link_check(t):
    return quality.broken_links(_linked_pages(t))


@query("repeated_attributes", r"""SELECT page_id, value, count(*) AS occurrences
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)"', 1)) AS value FROM pages) GROUP BY page_id, value HAVING count(*) > 1""")
def repeated_attributes(t):
    """Element ids that occur twice in a page; the given pages' list links carry their target as an id."""
    marked = F.regexp_replace("html", r'<li><a href="/([^"]*)"', '<li id="$1"><a href="/$1"')
    return quality.repeated_attributes(t.read("pages").withColumn("html", marked), "id")


@query("reconcile", o.with_ctes(o.CLEAN, o.daily()) + """
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, canonical_id, 'market_count' AS field, CAST(market_count + 1 AS VARCHAR) AS published, CAST(market_count AS VARCHAR) AS recomputed
FROM dayp WHERE day(transaction_date) = 17
UNION ALL SELECT CAST(transaction_date AS VARCHAR), canonical_id, 'price_u6', CAST(u6 + 1 AS VARCHAR), CAST(u6 AS VARCHAR) FROM dayp WHERE day(transaction_date) = 23 AND u6 IS NOT NULL""")
def reconcile(t):
    """A published copy with planted differences against the recomputation."""
    fresh = panel.daily_prices(t.observations).select("transaction_date", "canonical_id", "price_u6", "market_count")
    day = F.dayofmonth("transaction_date")
    published = fresh.withColumns({
        "market_count": F.col("market_count") + F.when(day == 17, 1).otherwise(0),
        "price_u6": F.col("price_u6") + F.when(day == 23, 1).otherwise(0),
    })
    return quality.reconcile(published, fresh, ["transaction_date", "canonical_id"])


@query("build_gate", o.with_ctes(o.CLEAN, o.daily()) + """,
ex AS (SELECT DISTINCT p_type AS item FROM part WHERE p_type <> 'PROMO'),
st AS (SELECT transaction_date, CASE WHEN bool_and(lower(trim(fetched_at)) = 'fixture') THEN 'fixture' ELSE 'live' END AS ms FROM obs GROUP BY ALL)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, count(DISTINCT canonical_id) AS covered_items, (SELECT count(*) FROM ex) AS expected_items,
  count(DISTINCT canonical_id) = (SELECT count(*) FROM ex) AS is_complete,
  CASE WHEN any_value(ms) = 'fixture' THEN 'market data is a fixture|' ELSE '' END || CASE month(transaction_date) % 3 WHEN 0 THEN 'seasonality uses stale last-known-good data|'
    WHEN 1 THEN 'seasonality uses manual fallback|' ELSE '' END || 'advice uses deterministic fallback' AS warnings
FROM dayp JOIN ex ON item = canonical_id LEFT JOIN st USING (transaction_date) GROUP BY transaction_date""")
def build_gate(t):
    expected = t.read("part").select(F.nullif(F.col("p_type"), F.lit("PROMO")).alias("canonical_id")).filter("canonical_id IS NOT NULL").distinct()
    synthetic = F.lower(F.trim("fetched_at")) == "fixture"
    k = F.month("transaction_date") % 3
    statuses = t.observations.groupBy("transaction_date").agg(F.min(synthetic).alias("_all")).select(
        "transaction_date", F.when(F.col("_all"), "fixture").otherwise("live").alias("market_status"),
        F.when(k == 0, "stale").when(k == 1, "fallback").otherwise("live").alias("season_status"),
    )
    return quality.build_gate(prices.daily(t), expected, statuses)


_PRICE = "CASE WHEN price IS NULL THEN '—' ELSE 'NT$ ' || format('{:,.2f}', floor(price * 100 + 0.5) / 100) || '/kg' END"


@query("report_lines", o.SCORED + f""", r AS (SELECT *, row_number() OVER (PARTITION BY transaction_date ORDER BY eligible DESC, score DESC, canonical_id) AS rank FROM scores)
, x AS (
SELECT *, 'recommendations' AS section, rank AS line_no FROM r WHERE eligible AND rank <= 5
UNION ALL SELECT * FROM (SELECT *, 'watch' AS section, row_number() OVER (PARTITION BY transaction_date ORDER BY rank) AS line_no FROM r WHERE verdict IN ('hold', 'insufficient')) WHERE line_no <= 5
UNION ALL SELECT *, 'prices' AS section, rank AS line_no FROM r)
SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, section, line_no, '- ' || canonical_id || ': ' || CAST(score AS VARCHAR) || ' / ' || verdict || ', ' || {_PRICE} || ', ' ||
  format('{{:,.0f}}', volume) || ' kg, ' || CASE WHEN previous_change IS NULL THEN '—' ELSE CASE WHEN previous_change > 0 THEN '+' ELSE '' END || format('{{:.1f}}', floor(previous_change * 10 + 0.5) / 10) || '%' END AS line
FROM x""")
def report_lines(t):
    rows = score.report_sections(prices.scores(t))
    dash = F.lit("—")
    digits = {n: F.floor(F.col(c) * f + 0.5) / F.lit(f) for n, c, f in (("p", "price", 100.0), ("c", "previous_change", 10.0))}
    price = F.when(F.col("price").isNull(), dash).otherwise(
        F.concat(F.lit("NT$ "), F.format_string("%,.2f", digits["p"]), F.lit("/kg"))
    )
    change = F.when(F.col("previous_change").isNull(), dash).otherwise(F.concat(
        F.when(F.col("previous_change") > 0, "+").otherwise(""), F.format_string("%.1f", digits["c"]), F.lit("%")
    ))
    line = F.concat(
        F.lit("- "), F.col("canonical_id"), F.lit(": "), F.col("score").cast("string"), F.lit(" / "), F.col("verdict"), F.lit(", "), price,
        F.lit(", "), F.format_string("%,.0f", F.col("volume")), F.lit(" kg, "), change,
    )
    return rows.select("transaction_date", "section", "line_no", line.alias("line"))


_RATIO = "CAST(l_quantity AS DOUBLE) / 25.0"


@query("ladders", f"""SELECT l_quantity, {o.ladder(_RATIO, o.PRICE_STEPS, '<=')}::BIGINT AS price_points, {o.ladder(_RATIO, o.VOLUME_STEPS, '>=')}::BIGINT AS volume_points,
  {o.ladder('l_quantity / 100.0', o.VOLATILITY_STEPS, '<=', -10)}::BIGINT AS volatility_points, count(*) AS rows FROM lineitem GROUP BY l_quantity""")
def ladders(t):
    counts = t.read("lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("rows"))
    ratio = F.col("l_quantity") / F.lit(25.0)
    return counts.select(
        "l_quantity", numeric.price_points(ratio).alias("price_points"), numeric.volume_points(ratio).alias("volume_points"),
        numeric.volatility_points(F.col("l_quantity") / F.lit(100.0)).alias("volatility_points"), "rows",
    )


@query("change_pct", f"""SELECT c_custkey, {o.r6(o.pct('c_acctbal', 'CAST(c_custkey % 7 AS DOUBLE)'))} AS change FROM customer""")
def change_pct(t):
    return t.read("customer").select(
        "c_custkey", numeric.round6(numeric.change_pct(F.col("c_acctbal"), (F.col("c_custkey") % 7).cast("double"))).alias("change")
    )


@query("scalars_string", """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE trim(' ' || p_name || ' ') END AS cleaned, lower(trim(' ' || p_brand || ' ')) AS folded,
  replace('台' || p_name || '台', '台', '臺') AS market_key, translate(p_brand, 'Bn#', 'Bn#') AS narrow, translate(p_brand, 'Bn#', 'Bn#') AS normalized,
  regexp_replace(replace(replace(p_name, 'red', 'blue'), 'blue', 'green'), '^[a-z]+ ', 'the ') AS rewritten FROM part""")
def scalars_string(t):
    p = t.read("part")
    wide = F.translate("p_brand", "Bn#", "Ｂｎ＃")
    padded = F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    return p.select(
        "p_partkey", text.text_or_null(padded).alias("cleaned"), text.fold_key(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias("folded"),
        text.market_name_key(F.concat(F.lit("台"), F.col("p_name"), F.lit("台"))).alias("market_key"),
        text.fold_width(wide).alias("narrow"), text.nfkc(wide).alias("normalized"),
        text.rewrite(F.col("p_name"), [("red", "blue"), ("blue", "green")], [("^[a-z]+ ", "the ")]).alias("rewritten"),
    )


@query("scalars_date", """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS order_date, lpad(CAST(year(o_orderdate) - 1911 AS VARCHAR), 3, '0') || strftime(o_orderdate, '.%m.%d') AS era_text,
  isodow(o_orderdate) - 1 AS weekday, CAST(CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS shifted,
  CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_first, o_orderkey % 3 = 1 AS is_zoned, count(*) AS orders
FROM orders GROUP BY o_orderdate, o_orderkey % 3 = 1""")
def scalars_date(t):
    day = F.col("o_orderdate").cast("date")
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd'T'10:00:00"), F.when(F.col("o_orderkey") % 3 == 1, "+08:00").when(F.col("o_orderkey") % 3 == 0, "+8").otherwise(""))
    return t.read("orders").groupBy(day.alias("order_date"), dates.is_zoned_timestamp(stamp).alias("is_zoned")).agg(
        F.count(F.lit(1)).alias("orders")
    ).select(
        "order_date", dates.to_era_text(F.col("order_date")).alias("era_text"), dates.python_weekday(F.col("order_date")).alias("weekday"),
        dates.shift_months(F.trunc("order_date", "month"), 3).alias("shifted"),
        dates.month_start(F.date_format("order_date", "yyyy-MM")).alias("month_first"), "is_zoned", "orders",
    )


def _r3(x):
    return F.floor(x * 1000.0 + 0.5).cast("double") / 1000.0


# Isometric latitude, the sphere's transverse projection, then the series by its numeric coefficients for GRS80.
@query("tm2_project", """WITH g AS (SELECT vec_id, radians(24.0 + embedding[2]::DOUBLE) AS lat, radians(embedding[1]::DOUBLE) AS lon, 0.08181919104281579::DOUBLE AS ecc FROM embeddings),
iso AS (SELECT vec_id, lon, asinh(tan(lat)) - ecc * atanh(ecc * sin(lat)) AS psi FROM g),
sphere AS (SELECT vec_id, atan2(sinh(psi), cos(lon)) AS u, asinh(sin(lon) / sqrt(sinh(psi) * sinh(psi) + cos(lon) * cos(lon))) AS v FROM iso),
term AS (SELECT vec_id, u, v, unnest([1, 2, 3, 4]) AS j, unnest([8.377318247344344e-4, 7.608527788826164e-7, 1.1976380191731537e-9, 2.443376242510368e-12]::DOUBLE[]) AS c FROM sphere),
total AS (SELECT vec_id, any_value(u) + sum(c * sin(2 * j * u) * cosh(2 * j * v)) AS up, any_value(v) + sum(c * cos(2 * j * u) * sinh(2 * j * v)) AS across FROM term GROUP BY vec_id)
SELECT vec_id, floor((250000 + 0.9999 * 6367449.145771048::DOUBLE * across) * 1000.0 + 0.5) / 1000.0 AS easting, floor(0.9999 * 6367449.145771048::DOUBLE * up * 1000.0 + 0.5) / 1000.0 AS northing FROM total""")
def tm2_project(t):
    longitude = F.lit(121.0) + F.get("embedding", F.lit(0)).cast("double")
    latitude = F.lit(24.0) + F.get("embedding", F.lit(1)).cast("double")
    east, north = spatial.transverse_mercator(longitude, latitude)
    return t.read("embeddings").select("vec_id", _r3(east).alias("easting"), _r3(north).alias("northing"))


def _points(t):
    return t.read("embeddings").select(
        "vec_id", F.col("label").alias("polygon"),
        F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"),
    )


def _polygons(t):
    """One diamond with a square hole per label, sized by the label's points."""
    b = _points(t).groupBy("polygon").agg(
        (F.min("x") * 0.75).alias("x0"), (F.max("x") * 0.75).alias("x9"), (F.min("y") * 0.75).alias("y0"), (F.max("y") * 0.75).alias("y9")
    )
    corners = ((0, 0, "x0", None), (0, 1, None, "y9"), (0, 2, "x9", None), (0, 3, None, "y0"))

    def vertex(ring, seq, x, y):
        return F.struct(F.lit(ring).alias("ring"), F.lit(seq).alias("seq"), x.alias("x"), y.alias("y"))

    zero = F.lit(0.0)
    outer = [vertex(r, s, F.col(x) if x else zero, F.col(y) if y else zero) for r, s, x, y in corners]
    hole = [vertex(1, i, F.lit(a), F.lit(c)) for i, (a, c) in enumerate(((-0.03, -0.03), (-0.03, 0.03), (0.03, 0.03), (0.03, -0.03)))]
    return b.select("polygon", F.explode(F.array(*outer, *hole)).alias("v")).select("polygon", "v.*")


_POLY = """WITH pt AS (SELECT vec_id, label AS polygon, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT polygon, min(x) * 0.75::DOUBLE AS x0, max(x) * 0.75::DOUBLE AS x9, min(y) * 0.75::DOUBLE AS y0, max(y) * 0.75::DOUBLE AS y9 FROM pt GROUP BY polygon),
edges AS (
  SELECT polygon, 0 AS ring, x0 AS x1, 0::DOUBLE AS y1, 0::DOUBLE AS x2, y9 AS y2 FROM b UNION ALL SELECT polygon, 0, 0, y9, x9, 0 FROM b
  UNION ALL SELECT polygon, 0, x9, 0, 0, y0 FROM b UNION ALL SELECT polygon, 0, 0, y0, x0, 0 FROM b
  UNION ALL SELECT polygon, 1, unnest([-0.03, -0.03, 0.03, 0.03])::DOUBLE, unnest([-0.03, 0.03, 0.03, -0.03])::DOUBLE, unnest([-0.03, 0.03, 0.03, -0.03])::DOUBLE, unnest([0.03, 0.03, -0.03, -0.03])::DOUBLE FROM b)
"""


@query("point_in_polygon", _POLY + """SELECT vec_id, polygon::BIGINT AS polygon, x, y,
  count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS is_inside
FROM pt JOIN edges USING (polygon) GROUP BY vec_id, polygon, x, y""")
def point_in_polygon(t):
    return spatial.points_in_polygon(_points(t), spatial.polygon_edges(_polygons(t)))


@query("ring_area", _POLY + f"""SELECT polygon::BIGINT AS polygon, ring::BIGINT AS ring, {o.r6('abs(sum(x1 * y2 - x2 * y1) / 2)')} AS area, count(*) AS vertices FROM edges GROUP BY polygon, ring""")
def ring_area(t):
    return spatial.ring_areas(_polygons(t)).withColumn("area", numeric.round6(F.col("area")))


@query("fit_box", _POLY + f""", f AS (SELECT pt.*, min(x) OVER w AS a, max(x) OVER w AS c, min(y) OVER w AS d, max(y) OVER w AS e FROM pt WINDOW w AS (PARTITION BY polygon)),
g AS (SELECT *, least(760::DOUBLE / (c - a), 280::DOUBLE / (e - d)) AS s FROM f)
SELECT vec_id, polygon::BIGINT AS polygon, x, y, {o.r6('10 + (760 - (c - a) * s) / 2 + (x - a) * s')} AS fit_x, {o.r6('20 + (280 - (e - d) * s) / 2 + (e - y) * s')} AS fit_y FROM g""")
def fit_box(t):
    out = spatial.fit_to_box(_points(t), "polygon", (10.0, 20.0, 760.0, 280.0))
    return out.withColumns({"fit_x": numeric.round6(F.col("fit_x")), "fit_y": numeric.round6(F.col("fit_y"))})


@query("require_matched", o.with_ctes(o.CLEAN, o.daily(), o.SEASONS) + """,
n AS (SELECT * FROM obs JOIN nation ON n_nationkey = market_code),
r AS (SELECT 'seasonality' AS rule, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM seasons s WHERE s.canonical_id = dayp.canonical_id)) AS unmatched FROM dayp
  UNION ALL SELECT 'registered_market', count(*), 0 FROM obs
  UNION ALL SELECT 'market_name', count(*), count(*) FILTER (row_b % 50 = 7) FROM n WHERE n_regionkey < 4)
SELECT rule, rows, unmatched, CASE WHEN unmatched > 0 THEN 'refused' ELSE 'published' END AS outcome FROM r""")
def require_matched(t):
    """Daily prices must have a season entry, observations a market, and market names must not drift: two are refused."""
    season = quality.require_matched(panel.daily_prices(t.observations), t.seasons, ["canonical_id"], "seasonality")
    nation = t.read("nation").select(F.col("n_nationkey").alias("market_code"), "n_name")
    market = quality.require_matched(t.observations, nation, ["market_code"], "registered_market")
    named = quality.require_none(scope_plans.scoped(t), F.col("name_drift"), "market_name")
    out = []
    for checked in (season, market, named):
        folder = work_folder(t.spark, f"checked-{checked.rule}")
        try:
            quality.publish_checked(checked.rows, folder, [checked])
            outcome = "published"
        except quality.ContractViolation:
            outcome = "refused"
        assert is_complete(t.spark, folder) == (outcome == "published")
        out.append((checked.rule, *checked.counts(), outcome))
    return t.spark.createDataFrame(out, "rule string, rows bigint, unmatched bigint, outcome string")
