from marketpanel.llm.common import ORACLES, QUERIES
from marketpanel.llm.url_filter import judge_urls
from tests.parity import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_matches_oracle(spark):
    assert compare(QUERIES["op4_url_filter"](spark, SF_DIR), connect(SF_DIR), ORACLES["op4_url_filter"]) == []


def test_parts_rules_and_odd_rows(spark):
    urls = [
        "http://WWW.Example.com/en/1?x#y", "http://m.example.com/en/1", "ftp://example.com/fr/", "https://a.net/es/q", "https://a.net/esp",
        "a.net/es/", None, "", "http://example.com", "http://notexample.com/en/x", "x://y://z/", "http://h#f/en/",
    ]
    pages = spark.createDataFrame([(i, u, 1, "p") for i, u in enumerate(urls)] + [(None, None, 1, "p")], "page_id bigint, url string, host int, path string")
    rows = {r.page_id: r for r in judge_urls(pages, spark.createDataFrame([], "page_id bigint, good int")).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("m.example.com", "/en/1", "example.com/en/"), ("example.com", "/fr/", "com/"),
        ("a.net", "/es/q", "net/es/"), ("a.net", "/esp", None), ("", "", None), ("", "", None), ("", "", None), ("example.com", "", None),
        ("notexample.com", "/en/x", "com/"), ("y:", "//z/", None), ("h", "", None),
    ]
    assert {rows[i].verdict for i in (1, 3)} == {"block"} and {rows[i].verdict for i in (0, 2)} == {"allow"}
    assert judge_urls(pages.limit(0), spark.createDataFrame([], "page_id bigint, good int")).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows, good = [], []
    for i in range(600):  # many pages of a bad host, few of good ones
        host = "bad.spam.org" if i < 200 else f"h{i % 40}.fine.org"
        rows.append((i, f"https://{host}/x"))
        good.append((i, int(i >= 200)))
    rows += [(1000, "https://bad.spam.org/new"), (1001, "https://h1.fine.org/new"), (1002, "https://never.fine.org/"), (1003, "https://unknown.example/")]
    out = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(good, "page_id bigint, good int")).collect()}
    assert out[1000].verdict == "block" and out[1001].verdict == "allow" and out[1002].verdict == "allow"
    assert out[1000].bound < out[1003].bound < out[1001].bound


def test_query_on_planted_hosts(spark, tmp_path):
    """Tables whose labels do tell hosts apart: the method itself blocks, and equals its SQL."""
    import duckdb

    rows = [(i, f"https://{'bad.spam.org' if i < 80 else f'h{i % 9}.fine.org'}/a/{i}") for i in range(260)] + [(900, "https://bad.spam.org/new"), (901, "https://bad.net/fr/x"), (902, None)]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i >= 80)) for i in range(260)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = QUERIES["op4_url_filter"](spark, str(tmp_path))
    assert compare(found, con, ORACLES["op4_url_filter"]) == []
    verdicts = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    assert verdicts[900] == (None, "block") and verdicts[100] == (None, "allow") and verdicts[901] == ("net/fr/", "block")
    assert sum(v == (None, "block") for v in verdicts.values()) == 81
