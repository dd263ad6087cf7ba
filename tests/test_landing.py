import pytest
from pyspark.sql import functions as F

from marketpanel.functions import dates, numeric, text
from marketpanel.sources import landing, sinks


def values(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_era_dates(spark):
    out = values(spark, ["115.08.25", "2026.8.5", "2026-08-25T10:00", "115.02.30", "x", "115.8", " 099.12.31 "],
                 dates.era_date(F.col("t")).cast("string"))
    assert out == ["2026-08-25", "2026-08-05", "2026-08-25", None, None, None, "2010-12-31"]


def test_lenient_and_event_dates(spark):
    given = ["2026/08/25 10:00", "20260825", "2026-13-01", "2026", None]
    assert values(spark, given, dates.lenient_date(F.col("t")).cast("string")) == ["2026-08-25", None, None, None, None]
    assert values(spark, given, dates.event_date(F.col("t")).cast("string")) == ["2026-08-25", "2026-08-25", None, None, None]


def test_numbers(spark):
    given = ["20", " 2.5 ", "1e3", "-1", "NaN", "inf", "12d", "", "1e999", ".5", None]
    assert values(spark, given, numeric.parse_number(F.col("t"))) == [20, 2.5, 1000, None, None, None, None, None, None, 0.5, None]
    assert values(spark, ["1,250", "42.5", "bad", "-1", "true"], numeric.parse_amount(F.col("t"))) == [1250, 42.5, None, None, None]


def test_hundredths_are_never_rounded_away(spark):
    assert values(spark, ["20", "20.55", "20.555", "0.1"], landing.exact_amount(F.col("t")).cast("string")) == ["20.000000", "20.550000", "20.555000", "0.100000"]
    exact = values(spark, ["12.345", "4999.994", "5000.123", "12345.678", "0.1234567", "1e3", "-1", "NaN", "9" * 40], landing.exact_amount(F.col("t")).cast("string"))
    assert exact == ["12.345000", "4999.994000", "5000.123000", "12345.678000", None, "1000.000000", None, None, None]


def test_number_states_fold_width(spark):
    folded = text.fold_width(F.col("t"))
    given = ["-", "－", "—", "", "0", "１２．５", "1,200", "N/A"]
    assert values(spark, given, numeric.number_state(folded)) == [
        "missing", "missing", "missing", "missing", "zero_reported", "valid", "valid", "unreadable"]
    assert values(spark, ["１２．５（元／公斤）"], folded, text.nfkc(F.col("t"))) == [("12.5(元/公斤)", "12.5(元/公斤)")]


def test_price_per_kilogram(spark):
    frame = spark.createDataFrame([(60.0,), (45.0,), (33.0,), (None,)], "p double")
    assert [r[0] for r in frame.select(numeric.per_kilogram(F.col("p"))).collect()] == [100, 75, 55, None]


@pytest.mark.parametrize("ratio, price, volume", [
    (0.85, 25, 8), (0.95, 20, 8), (1.0, 15, 12), (1.05, 10, 12), (1.15, 5, 12), (1.16, 0, 12), (1.25, 0, 15), (0.4, 25, 0), (None, 0, 0)])
def test_ladders(spark, ratio, price, volume):
    row = spark.createDataFrame([(ratio,)], "r double").select(
        numeric.price_points(F.col("r")), numeric.volume_points(F.col("r"))).first()
    assert tuple(row) == (price, volume)


def test_exact_ratio_half_up_and_long_variant(spark):
    rows = [(1, 3), (2, 3), (1, 800000), (0, 5), (5, 0), (10**15, 7)]
    frame = spark.createDataFrame(rows, "n bigint, d bigint")
    out = frame.select(numeric.ratio_micro(F.col("n"), F.col("d")), numeric.ratio_micro_long(F.col("n"), F.col("d"))).collect()
    wanted = [(2 * n * 10000 + d) // (2 * d) if d else None for n, d in rows]
    assert [r[0] for r in out] == wanted and [r[1] for r in out] == wanted


def test_zoned_timestamps(spark):
    given = ["2026-08-25T10:00:00Z", "2026-08-25T10:00:00+08:00", "2026-08-25T10:00:00", "2026-13-25T10:00:00Z", "fixture"]
    assert values(spark, given, dates.is_zoned_timestamp(F.col("t"))) == [True, True, False, False, False]


def test_coarse_places(spark):
    given = ["屏東縣內埔鄉光明路1號", "台北市大安區", "市區3號縣", "nowhere", " "]
    assert values(spark, given, text.coarse_place(F.col("t"))) == ["屏東縣", "台北市", "市區3號縣", None, None]


def test_pages_of_json(spark):
    pages = spark.createDataFrame([
        (1, '[{"id":1,"type":"a"},{"type":"b"}]'), (2, "<html>"), (3, "[]"), (4, '[{"id":1,"type":"a"}')], "page int, body string")
    out = sorted((r.page, r.seq, r.reject) for r in landing.page_rows(pages).collect() if r.seq is not None)
    assert out == [(1, 0, None), (1, 1, "missing_required")]
    bad = {r.page for r in landing.page_rows(pages).collect() if r.reject == "unreadable_page"}
    assert bad == {2, 3, 4}


def test_page_set(spark):
    pages = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "<p>"), ("c", 4, "z"), ("d", 1, "v"), ("d", 4, "z"), ("e", 1, " ")], "b string, p int, body string")
    out = {r.b: r for r in landing.page_set_checks(pages, "b", "p", "body", 100).collect()}
    assert (out["a"].status, out["b"].status, out["c"].status, out["d"].status, out["e"].status) == (
        "complete", "repeated_page", "html_body", "page_gap", "empty_body")
    assert out["c"].missing_pages == 2 and out["c"].html_bodies == 1
    assert sorted((r.b, r.missing_page) for r in landing.page_gaps(pages, "b", "p").collect()) == [("c", 2), ("d", 2)]


def test_pinned_headers_and_widths(spark):
    files = spark.createDataFrame([
        (1, "﻿序號,項目,平均(元/台斤)\r\n1, 甘藍 ,\"1,250\"\n\n"),
        (2, "類別,交易量（公斤）,平均價格（元／公斤）\n魚,1,2\n魚,1\n雞,1,2,3"),
        (3, "a,b\n1,2"), (4, '"序號",項目,"平均(元/台斤)"\n1,"a\nb","1,250"')], "f int, raw_text string")
    out = sorted(tuple(r) for r in landing.csv_rows(files).select("f", "line_no", "contract", "c1", "c2", "problem").collect())
    assert out == [
        (1, 1, "retail-3col", "甘藍", "1,250", None),
        (2, 1, "supply-v0", "1", "2", None), (2, 2, "supply-v0", "1", None, "row_width"), (2, 3, "supply-v0", "1", "2", "row_width"),
        (3, 1, None, "2", None, "unknown_header"), (4, 1, "retail-3col", "a\nb", "1,250", None)]


def test_long_cells_and_many_lines(spark):
    """A quoted cell of 1 MB, one of doubled quotes alone, and a file of 100,000 lines, read in one pass each."""
    import time

    header = "序號,項目,平均(元/台斤)\n"
    long = "x,\n" * 350_000
    files = spark.createDataFrame([
        (1, header + f'1,"{long}",2\n3,y,4'), (2, header + '1,"' + '""' * 200_000 + '",2'), (3, header + "1,甘藍,2\n" * 100_000),
        (4, "\ufeff㈠号,項目\n1,2"), (5, "序號,項目,平均（元／台斤）\u3000\n1,\"a\"\"b\",2")], "f int, raw_text string")
    start = time.time()
    out = landing.csv_rows(files).filter("f <> 3").select("f", "line_no", "contract", "c1", "c2", "problem").collect()
    by = {(r.f, r.line_no): r for r in out}
    assert by[1, 1].c1 == long and by[1, 1].c2 == "2" and by[1, 2].c1 == "y" and by[1, 1].problem is None
    assert by[2, 1].c1 == '"' * 200_000 and by[4, 1].problem == "unknown_header" and (by[5, 1].contract, by[5, 1].c1) == ("retail-3col", 'a"b')
    many = landing.csv_rows(files.filter("f = 3"))
    assert many.filter("problem IS NULL").count() == 100_000 and time.time() - start < 60


TABLE = """<html><table class="x table-a-products"><tr><th>h</th></tr>
<tr><td data-th="種類">水果</td><td data-th="農產品">香&amp;蕉 <b>大</b></td><td data-th="品種名稱">北蕉</td><td data-th="縣市">屏東縣</td>
<td data-th="行政區">內埔鄉</td><td data-th="盛產月份">3月、 8 月</td></tr>
<tr><td data-th="種類">蔬菜</td><td data-th="農產品">甘藍</td><td data-th="品種名稱">初秋</td><td data-th="縣市">雲林縣</td><td data-th="行政區">西螺鎮</td><td data-th="盛產月份">1月、13月</td></tr>
</table><table><tr><td data-th="種類">outside</td></tr></table></html>"""


def test_result_table(spark):
    pages = spark.createDataFrame([(1, TABLE), (2, "<p>none</p>"), (3, None)], "page_id bigint, html string")
    cells = landing.table_cells(pages, "table-a-products")
    out = landing.product_rows(cells, {"水果": "fruit", "蔬菜": "vegetable"}, 8).orderBy("row_no").collect()
    assert [(r.page_id, r.category, r.display_name, r.months, r.reject) for r in out] == [
        (1, "fruit", "香&蕉 大", [3, 8], None), (1, "vegetable", "甘藍", [1, 13], "month_outside_year")]


def test_result_table_quotes_depth_and_missing_end(spark):
    row = lambda name, inner="": (
        f"<tr><td data-th='種類'>水果</td><td data-th=農產品>{name}{inner}</td><td data-th = \"品種名稱\">v</td>"
        "<td title='a > b' data-th=縣市>屏東縣</td><td data-th=行政區>內埔鄉</td><td data-th=盛產月份>8月</td></tr>")
    inner = "<table class='note'><tr><td>not read</td></tr></table>"
    pages = spark.createDataFrame([
        (1, f"<table class='x products'>{row('a')}</table>"),
        (2, f"<table class=products>{row('b', inner)}<!-- </table> -->{row('c&nbsp;&eacute;')}</table><table>{row('outside')}</table>"),
        (3, f'<table class="products">{row("d")}'), (4, "<TABLE CLASS=products><tr><td>cut"), (5, f"<table class=products-old>{row('other')}</table>"),
    ], "page_id bigint, html string")
    out = landing.product_rows(landing.table_cells(pages, "products"), {"水果": "fruit"}, 8).orderBy("page_id", "row_no").collect()
    assert [(r.page_id, r.display_name, r.category, r.reject) for r in out] == [
        (1, "a", "fruit", None), (2, "b", "fruit", None), (2, "c é", "fruit", None),
        (3, "d", "fruit", "unmatched_table"), (4, None, None, "unmatched_table")]


def test_normalised_rows(spark):
    raw = spark.createDataFrame([
        ("115.08.25", " A1 ", "香蕉", "104", "20", "1000", "s", "m", "9"), ("115.08.25", "Z9", "其他", "104", "NaN", "1", "s", "m", None),
        ("bad", "A2", "x", "1", "1", "1", "s", "m", None), ("115.08.25", "A3", "x", "1", "1", "1", "s", " ", None)],
        "trade_date string, crop_code string, crop_name string, market_code string, avg_price string, volume string, source_id string, market_name string, low_price string")
    raw = raw.selectExpr("*", "'N04' AS category_code", "'21' AS high_price", "CAST(NULL AS string) AS mid_price", "'2026-08-25T10:00:00Z' AS fetched_at")
    items = spark.sql("SELECT 'banana' AS canonical_id, 'Banana' AS display_name, 'fruit' AS category, true AS enabled, array('A1') AS market_crop_codes"
                      " UNION ALL SELECT 'off', 'Off', 'fruit', false, array('A2')")
    out = {r.crop_code: r for r in landing.normalize_rows(raw, items).collect()}
    assert (out["A1"].canonical_id, out["A1"].price, out["A1"].volume, out["A1"].reject) == ("banana", 20, 1000, None)
    assert (out["Z9"].category, out["Z9"].display_name, out["Z9"].reject) == ("unknown", "其他", "bad_price")
    assert (out["A2"].canonical_id, out["A2"].reject) == (None, "bad_date")
    assert (out["A1"].schema_version, out["A1"].low_price, out["A1"].mid_price, out["A3"].reject) == ("1.0", 9, 0, "missing_required")
    lower = {r.crop_code: r.row_hash for r in landing.normalize_rows(raw.withColumn("low_price", F.lit("8")), items).collect()}
    later = {r.crop_code: r.row_hash for r in landing.normalize_rows(raw.withColumn("fetched_at", F.lit("x")), items).collect()}
    assert lower["A1"] != out["A1"].row_hash and later["A1"] == out["A1"].row_hash
    again = landing.normalize_rows(raw.repartition(3), items).collect()
    assert {r.crop_code: r.row_hash for r in again} == {k: r.row_hash for k, r in out.items()}


def test_partition_overwrite_touches_only_given_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "d string, v int")
    sinks.overwrite_partitions(first, path, "d")
    sinks.overwrite_partitions(spark.createDataFrame([("2026-01-02", 9)], "d string, v int"), path, "d")
    assert sorted((str(r.d), r.v) for r in spark.read.parquet(path).collect()) == [("2026-01-01", 1), ("2026-01-02", 9)]
    plan = spark.read.parquet(path).filter("d = '2026-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan


def test_snapshots_and_exports(spark, tmp_path):
    path = str(tmp_path / "s")
    one = spark.createDataFrame([("a", 1, None)], "k string, v int, n string")
    sinks.write_snapshot(one, path, "2026-01-01")
    sinks.write_snapshot(one.withColumn("v", F.lit(2)), path, "2026-01-02")
    assert [r.v for r in sinks.current_snapshot(spark, path).collect()] == [2]
    assert sinks.json_lines(one).first().line == '{"k":"a","n":null,"v":1}'
    sinks.write_csv(one.coalesce(1), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["k,v,n", "a,1,"]
    sinks.write_json(one, str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":"a","n":null,"v":1}']


def test_pagination_links_and_sequence(spark):
    def page(numbers, nxt):
        links = "".join(f'<a href="?page={n}" title="第{n}頁">{n}</a>' for n in numbers)
        return f'<ul class="pagination">{links}<a href="{nxt}" title="下一頁">next</a></ul>'

    pages = spark.createDataFrame([
        ("a", 1, page([1, 2], "x?type=1&amp;page=2&period=8")), ("a", 2, page([1, 2], "#")),
        ("b", 1, page([1, 3], "x?type=1&page=3")), ("c", 1, page([1, 2], "#"))], "batch string, page_no int, html string")
    read = landing.pagination(pages)
    out = {(r.batch, r.page_no): (r.has_current, r.advertised_last, r.next_page) for r in read.collect()}
    assert out["a", 1] == (True, 2, 2) and out["a", 2] == (True, 2, None)
    status = {r.batch: r.status for r in landing.page_sequence(read, "batch", "page_no").collect()}
    assert status == {"a": "complete", "b": "not_sequential", "c": "terminated_early"}


def test_page_sets_end_with_a_short_page(spark):
    full, json = '[{"a":1},{"a":%d}]', "application/json"
    rows = []
    for batch, bodies in {
        "ok": [full % 2, full % 3, "[]"], "limit": [full % 2, full % 3, full % 4], "open": [full % 2], "inside": [full % 2, '[{"a":1}]', full % 4],
        "bad": [full % 2, "{}"], "broken": ["nothing"], "twice": [full % 2, full % 2, "[]"], "none": ["[]"],
    }.items():
        rows += [(batch, k, body, json) for k, body in enumerate(bodies)]
    rows += [("html", 0, "[]", "text/html"), ("untyped", 0, "[]", None)]
    out = landing.page_end_checks(spark.createDataFrame(rows, "b string, p int, body string, t string"), "b", "p", "body", "t", 2, 3)
    assert {r.b: r.status for r in out.collect()} == {
        "ok": "complete", "limit": "page_limit", "open": "not_ended", "inside": "short_page_inside", "bad": "malformed", "broken": "malformed", "twice": "repeated_page",
        "none": "no_rows", "html": "not_json", "untyped": "not_json"}


def test_pages_without_rows_are_no_copies_of_each_other(spark):
    full, json = '[{"a":1},{"a":2}]', "application/json"
    rows = [("errors", k, body, json) for k, body in enumerate(['{"error": 1}', '{"error": 1}', full, "[]", "[]"])]
    rows += [("copies", k, body, json) for k, body in enumerate([full, '{"error": 1}', full, '{"error": 1}', full])]
    out = landing.page_end_checks(spark.createDataFrame(rows, "b string, p int, body string, t string"), "b", "p", "body", "t", 2, 9)
    assert {r.b: (r.repeated_pages, r.malformed_pages) for r in out.collect()} == {"errors": (0, 2), "copies": (2, 2)}


def test_a_page_must_name_itself(spark):
    pages = spark.createDataFrame([("a", 1, True, 2, 2), ("a", 2, True, 2, None), ("b", 1, False, 2, 2), ("b", 2, True, 2, None), ("c", 1, None, 2, 3)], "b string, p int, has_current boolean, advertised_last int, next_page int")
    assert {r.b: r.status for r in landing.page_sequence(pages, "b", "p").collect()} == {"a": "complete", "b": "current_page_unnamed", "c": "not_sequential"}


def test_rows_account_for_raw_records(spark):
    pages = spark.createDataFrame([("a", '[{"x":1},{"x":2}]'), ("a", "[]"), ("b", "[1]"), ("c", "{"), ("d", '[{"x":1}]'), ("e", None)], "b string, body string")
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("f",)], "b string")
    out = {r.b: (r.raw_records, r.normalized_records, r.status) for r in landing.raw_manifest(pages, rows, "b", "body").collect()}
    assert out == {
        "a": (2, 2, "success"), "b": (1, 1, "record_not_object"), "c": (0, 0, "unreadable_page"), "d": (1, 0, "records_not_accounted"), "e": (0, 0, "unreadable_page"),
        "f": (0, 1, "records_not_accounted")}


def test_a_filter_on_the_reason_makes_no_text_twice(spark):
    """The filter goes below the join to where texts are made; there each of them is named once or twice, not for each rule."""
    texts = ["5.", ".5", "+0.1000000000", "9" * 32 + ".123456", "1\t", " 7\n", "1e2", "1e-7", "1e-6", "", "x", "NaN", "-1", "9" * 33, "0.1234567", None, "12d", "Infinity"]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", "t", F.concat(F.lit("115.08."), F.lpad((F.col("i") + 1).cast("string"), 2, "0")).alias("trade_date"), F.lit("N05").alias("category_code"), F.lit("A1").alias("crop_code"),
        F.lit("c").alias("crop_name"), F.lit("104").alias("market_code"), F.lit("m").alias("market_name"), F.lit("2").alias("high_price"), F.reverse(F.reverse("t")).alias("mid_price"),
        F.lit("1").alias("low_price"), F.lit("1").alias("avg_price"), F.lit("3").alias("volume"), F.lit("s").alias("source_id"), F.lit("f").alias("fetched_at"))
    items = spark.createDataFrame([("i", "n", "c", True, ["A1"])], "canonical_id string, display_name string, category string, enabled boolean, market_crop_codes array<string>")
    rows = landing.normalize_rows(raw, items)
    right = {r.i for r in raw.select("i", landing.exact_amount(F.coalesce("t", F.lit("0"))).alias("a")).collect() if r.a is not None}
    found = rows.select(F.dayofmonth("transaction_date").alias("day"), "reject", "mid_price").collect()
    assert {r.day - 1 for r in found if r.reject is None} == right == {r.day - 1 for r in found if r.mid_price is not None}
    assert {r.reject for r in found} == {None, "bad_price"}
    kept = rows.filter("reject IS NULL").groupBy("transaction_date").count()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(reverse(") <= 1


def test_a_number_reads_its_text_once(spark):
    given = ["-0", "-1e-999", "1,2,3", ",", "-5", "+7", "1e309", " 4\t", None, "", "٣"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    found = rows.select(numeric.parse_amount(F.col("t")).alias("v"), "i").orderBy("i").collect()
    assert [r.v for r in found] == [0.0, 0.0, 123.0, None, None, 7.0, None, 4.0, None, None, None]
    assert [str(r.v) for r in found[:2]] == ["0.0", "0.0"]
    kept = rows.select(numeric.parse_amount(F.reverse(F.reverse("t"))).alias("v")).filter("v IS NOT NULL").groupBy().count()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("reverse(reverse(") <= 2  # its form and its value
