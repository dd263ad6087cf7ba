import math

from pyspark.sql import functions as F

from marketpanel.llm.quality_rules import binomial_tail, certified_cutoffs, keep_good, quality_verdicts, text_stats
from tests.parity import compare, connect
from marketpanel.llm.common import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_matches_oracle(spark):
    assert compare(QUERIES["op8_quality_rules"](spark, SF_DIR), connect(SF_DIR), ORACLES["op8_quality_rules"]) == []


def test_stats_of_a_text(spark):
    text = "a b c d e x a b c d e\n\nsame line\nsame line\n \n100% #1 <b>"
    s = text_stats(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()._stats
    assert (s.n_words, s.n_symbols, s.n_dup_lines, s.n_lines) == (18, 4, 1, 4)
    assert s.word_chars == len("".join(text.split()))
    assert s.n_repeat_words == 10
    wide = text_stats(spark.createDataFrame([(1, "a " * 20)], "doc_id int, text string")).first()._stats
    assert wide.n_repeat_words == 20


def test_binomial_tail(spark):
    cases = [(1000, 0), (1000, 4), (5000, 2), (100_000, 430)]
    rows = spark.createDataFrame(cases, "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), 0.005).alias("p")).collect()
    for (n, k), r in zip(cases, rows):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.005) + (n - j) * math.log(0.995)) for j in range(k + 1))
        assert abs(r.p - want) < 1e-9


def test_cutoffs_stop_before_good_documents_are_rejected(spark):
    stats = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_lines:long>"
    # A third of the good ones have 15 % symbols, so no cutoff at or below may be chosen.
    rows = [(i, "en", (100, 400, 60 if i % 3 == 0 else 0, 0, 0, 10)) for i in range(6000)] + [(9000 + i, "xx", (100, 400, 0, 0, 0, 10)) for i in range(20)]
    labels = spark.range(0, 9100).selectExpr("id AS doc_id", "1 AS quality")
    cut = {r.stratum: r for r in certified_cutoffs(spark.createDataFrame(rows, f"doc_id long, lang string, _stats {stats}"), labels).collect()}
    # All statistics go along one path, so the others stop with it.
    assert cut["en"].symbol_rate == 0.16 and cut["en"].word_length == 20.0
    assert cut["xx"].symbol_rate is None  # too few labels


def test_odd_rows(odd_docs, no_docs, odd_labels):
    rows = {(r.doc_id, r.n_words): r for r in quality_verdicts(odd_docs, odd_labels).collect()}
    assert len(rows) == 10 and not rows[3, 0].kept and rows[3, 0].base_failed and rows[5, 0].n_lines == 0
    assert rows[1, 10].kept and rows[6, 30000].n_repeat_words > 20_000
    kept = keep_good(odd_docs, odd_labels)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, r.slot) for r in kept.collect()) == [(0, "s"), (1, "s"), (2, "s"), (2, "s"), (8, "s")]
    assert quality_verdicts(no_docs, odd_labels).count() == 0 and keep_good(no_docs, odd_labels.filter("false")).count() == 0


def test_the_query_certifies_cutoffs(spark):
    """At this size English has labels enough; the method rejects documents that the base rules keep, and few good ones."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_quality_rules"](spark, sf)
    assert compare(rows, connect(sf), ORACLES["op8_quality_rules"]) == []
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    beyond = [r.doc_id for r in rows.collect() if not r.kept and not r.base_failed]
    assert len(beyond) > 10 and sum(d in good for d in beyond) <= 0.02 * len(good) + 3
