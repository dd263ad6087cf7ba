import math

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import quality, spatial


def test_violations_and_gate(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, -1, None), (3, None, "b")], "k int, v int, s string")
    found = quality.violations(rows, F.col("k"), [("negative", F.col("v") < 0), ("unnamed", F.col("s").isNull())])
    assert sorted(map(tuple, found.collect())) == [("negative", "2"), ("negative", "3"), ("unnamed", "2")]
    with pytest.raises(quality.ContractViolation, match="negative: 2"):
        quality.require_clean(found)
    quality.require_clean(found, ["other"])


def test_urls(spark):
    given = ["https://a.example/x", "http://a.example/x", "https://b.example/x", "https://u:p@a.example/x", "https://a.example:8443/x",
             "https://a.example:443/x", "https://a.example", "https://a.example/x#top", "https://a.example/x y"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string")
    out = [r[0] for r in frame.orderBy("i").select(quality.https_url_problem(F.col("u"), ["a.example"])).collect()]
    assert out == [None, "not_https", "host_not_allowed", "user_info", "port", None, "no_path", "fragment", "host_not_allowed"]


def test_json_contract(spark):
    given = ['{"a":"1","b":2}', '{"a":"1"}', '{"a":"1","b":2,"c":3}', '{"a":"1","a":"2","b":1}', '{"a":"1","b":NaN}', '{"a":"1","b":{"x":1,"x":2}}', "[1]", "nope", '{"a":"z","b":2}']
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(given)], "i int, d string")
    out = [r.problem for r in quality.json_contract(frame, "d", ["a", "b"], [("bad_a", "$.a", "^[0-9]$")]).orderBy("i").collect()]
    assert out == [None, "missing_field", "unknown_field", "duplicate_key", "constant", "duplicate_key", "not_object", "not_json", "bad_a"]


def test_texts(spark):
    texts = spark.createDataFrame([(1, "x AKIA1"), (2, "Bearer abc"), (3, 'token = "' + "a1" * 20 + '"'), (4, "fine"), (5, "NT$ 5"), (6, "NT$ 5 ok"), (7, "y" * 2000 + "AKIA")], "i int, t string")
    assert sorted(map(tuple, quality.secret_hits(texts, "t").collect())) == [(1, "AKIA"), (2, "bearer "), (3, "token_assignment"), (7, "AKIA")]
    out = sorted(map(tuple, quality.text_policy(texts, "t", ["fine"], trigger="NT$", disclaimer="ok").collect()))
    assert out == [(4, "prohibited:fine"), (5, "missing_disclaimer"), (7, "too_long")]


def test_links(spark):
    pages = spark.createDataFrame([
        (1, "https://h/a", '<a href="/b?x=1">b</a><a href="/zz#p">z</a><a href="https://else/">e</a><a href="#top">t</a><p id="k"></p><p id="k"></p>'),
        (2, "https://h/b#frag", '<a href="/a">a</a><p id="k"></p>')], "page_id int, url string, html string")
    assert [(r.target, r.links) for r in quality.broken_links(pages).collect()] == [("https://h/zz", 1)]
    assert [(r.page_id, r.value) for r in quality.repeated_attributes(pages, "id").collect()] == [(1, "k")]


def test_reconcile_names_fields(spark):
    a = spark.createDataFrame([(1, 5, "x"), (2, 6, None)], "k int, v int, s string")
    b = spark.createDataFrame([(1, 5, "y"), (3, 7, "z")], "k int, v int, s string")
    out = sorted((r.k, r.field) for r in quality.reconcile(a, b, ["k"]).collect())
    assert out == [(1, "s"), (2, "v"), (3, "s"), (3, "v")]
    assert quality.reconcile(a, a, ["k"]).count() == 0


def test_projection_of_the_central_meridian(spark):
    frame = spark.createDataFrame([(121.0, 0.0), (121.0, 25.0), (121.5654, 25.0330)], "lon double, lat double")
    east, north = spatial.transverse_mercator(F.col("lon"), F.col("lat"))
    rows = frame.select(east.alias("x"), north.alias("y")).collect()
    assert rows[0].x == 250000 and abs(rows[0].y) < 1e-6
    assert rows[1].x == 250000 and rows[1].y == pytest.approx(2766054.17 * 0.9999, abs=0.1)
    assert rows[2].x == pytest.approx(307050, abs=60) and rows[2].y == pytest.approx(2769500, abs=120)


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]


def vertices(spark):
    rows = [("p", ring, i, x, y) for ring, points in enumerate((SQUARE, HOLE)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "polygon string, ring int, seq int, x double, y double")


def test_even_odd_with_a_hole(spark):
    points = spark.createDataFrame([("p", 0.5, 0.5), ("p", 2.0, 2.0), ("p", 9.0, 2.0), ("p", 3.5, 2.0), ("q", 1.0, 1.0)], "polygon string, x double, y double")
    out = {(r.polygon, r.x, r.y): r.is_inside for r in spatial.points_in_polygon(points, spatial.polygon_edges(vertices(spark))).collect()}
    assert out == {("p", 0.5, 0.5): True, ("p", 2.0, 2.0): False, ("p", 9.0, 2.0): False, ("p", 3.5, 2.0): True, ("q", 1.0, 1.0): False}


def test_ring_areas(spark):
    assert {r.ring: r.area for r in spatial.ring_areas(vertices(spark)).collect()} == {0: 16.0, 1: 4.0}


def test_fit_keeps_the_aspect(spark):
    points = spark.createDataFrame([("g", 0.0, 0.0), ("g", 10.0, 5.0)], "g string, x double, y double")
    out = spatial.fit_to_box(points, "g", (0.0, 0.0, 100.0, 100.0)).orderBy("x").collect()
    assert [(r.fit_x, r.fit_y) for r in out] == [(0.0, 75.0), (100.0, 25.0)]
    assert math.isclose(out[1].fit_x - out[0].fit_x, 2 * (out[0].fit_y - out[1].fit_y))


def test_a_join_without_a_match_refuses_what_it_wrote(spark, tmp_path):
    from marketpanel.sources.sinks import is_complete

    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, name string")
    good = quality.require_matched(left.filter("k IS NOT NULL"), right, ["k"], "known")
    quality.publish_checked(good.rows, str(tmp_path / "good"), [good])
    assert good.counts() == (2, 0) and sorted(r.name for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["x", "y"]
    bad = quality.require_matched(left, right.filter("k = 'a'"), ["k"], "known")
    with pytest.raises(quality.ContractViolation, match="known: 2"):
        quality.publish_checked(bad.rows, str(tmp_path / "bad"), [bad])
    assert not (tmp_path / "bad").exists() and not is_complete(spark, str(tmp_path / "bad"))
    drift = quality.require_none(left, F.col("v") > 2, "drift")
    drift.rows.count()
    assert drift.counts() == (3, 1)


def test_repeated_ids_in_either_quotes(spark):
    pages = spark.createDataFrame([(1, """<a id="x"></a><b ID = 'x'></b><c data-id="x"></c>"""), (2, """<a id='y'></a><a id="z"></a>""")], "page_id int, html string")
    assert [(r.page_id, r.value, r.occurrences) for r in quality.repeated_attributes(pages, "id").collect()] == [(1, "x", 2)]
