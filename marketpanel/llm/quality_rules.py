"""Quality rules whose cutoffs are certified on labelled documents.

The statistics are cut together: a step holds a cutoff of each, and a document at or above any of them is
rejected. In each stratum the steps are tried from the loosest to the tightest (a fixed order, so testing
several of them needs no correction) as long as an exact binomial test shows that a step rejects no more than
`risk` of the good documents that pass the base rules. The level is divided by the number of strata, so all chosen steps hold together
with probability 1 - delta. A stratum with too few labels (of four, 217 good ones at least) certifies nothing
and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketpanel.llm.common import query, table
from marketpanel.sources.sinks import materialize

# Statistic -> cutoffs from loosest to tightest; a document at or above the chosen one is rejected.
CUTOFFS = {
    "symbol_rate": (0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1),
    "line_rate": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "repeat_rate": (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06),
    "word_length": (60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0),
}
RISK = 0.02
DELTA = 0.05
MIN_WORDS = 10
MOST_REPEATED = 20  # per cent of the words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_stats(docs: DataFrame) -> DataFrame:
    """`docs` plus the struct column `_stats` of STATS, computed in the row. A null text has none of anything.

    Windows are compared within a text by 64-bit hashes; only texts in which two are equal sort them.
    """
    step = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    step = step.withColumn("_words", F.expr(r"array_remove(split(_text, '[\\x20\\x09-\\x0D]+'), '')"))
    step = step.withColumn("_lines", F.expr(r"filter(split(_text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    step = step.withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
    step = step.withColumn("_windows", F.expr(
        "CASE WHEN size(_hashes) < 5 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_hashes) - 5), "
        "i -> xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2], _hashes[i + 3], _hashes[i + 4])) END"
    ))
    step = step.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN array_sort(transform(_windows, (h, i) -> struct(h, i))) END"
    ))
    step = step.withColumn("_starts", F.expr(
        "array_sort(transform(filter(transform(_sorted, (s, j) -> struct(s.i AS i, "
        "coalesce(get(_sorted, j - 1).h = s.h, false) OR coalesce(get(_sorted, j + 1).h = s.h, false) AS twice)), s -> s.twice), s -> s.i))"
    ))
    stats = F.struct(
        F.expr("CAST(size(_words) AS bigint)").alias("n_words"),
        F.expr("CAST(length(array_join(_words, '')) AS bigint)").alias("word_chars"),
        F.expr("CAST(regexp_count(_text, '[#*$%&|<>]') AS bigint)").alias("n_symbols"),
        F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS bigint)").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(transform(_starts, (s, k) -> least(5, coalesce(get(_starts, k + 1) - s, 5))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
        F.expr("CAST(size(_lines) AS bigint)").alias("n_lines"),
    )
    return step.select(*[F.col(f"`{c}`") for c in docs.columns], stats.alias("_stats"))


def base_failed() -> Column:
    return (F.col("_stats.n_words") < MIN_WORDS) | (
        100 * F.col("_stats.n_repeat_words") > MOST_REPEATED * F.col("_stats.n_words")
    )


def rates() -> dict[str, Column]:
    share = lambda a, b: F.col(f"_stats.{a}") / F.greatest(F.col(f"_stats.{b}"), F.lit(1))
    return {
        "symbol_rate": share("n_symbols", "word_chars"), "line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    }


def stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def _log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, shifted by 12 so that it is exact to the last digits for small n."""
    x = n + F.lit(13.0)
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    shift = F.lit(0.0)
    for i in range(1, 13):
        shift = shift + F.log(n + F.lit(float(i)))
    return series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed down from k until the terms are nothing beside it.

    Only values far below 1/2 matter, where the first term is the largest.
    """
    n, k = n.cast("double"), k.cast("double")
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(60) + 12 * F.sqrt(n * p)).cast("int"))
    odds = (1 - p) / p
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (k - j) / (n - k + j + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")),
    )["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first) * total)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA,
                      cutoffs: dict[str, tuple[float, ...]] = CUTOFFS) -> DataFrame:
    """(stratum, one cutoff a statistic or null), from the documents labelled as good. `risk` is the
    share of good documents, of those that the base rules keep, that all statistics together may reject.

    Of several labels of a document the best counts; null labels count as none.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality")).filter("_quality = 1").select("doc_id")
    held = stats.filter(~base_failed()).select("doc_id", stratum().alias("stratum"), "_stats").join(good, "doc_id", "left_semi")
    values, steps = rates(), min(len(cs) for cs in cutoffs.values())
    counts = []
    for i in range(steps):
        beyond = F.lit(False)
        for name, cs in cutoffs.items():
            beyond = beyond | (values[name] >= cs[i])
        counts.append(F.struct(F.lit(i).alias("i"), F.sum(beyond.cast("bigint")).alias("k")))
    each = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("tests"))
    each = each.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    tests = each.select("stratum", "n", "strata", F.explode("tests").alias("t")).select("stratum", "n", "strata", "t.*")
    tests = tests.withColumn("ok", binomial_tail(F.col("n"), F.col("k"), risk) <= delta / F.col("strata"))
    so_far = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    chosen = tests.withColumn("certified", F.min("ok").over(so_far)).groupBy("stratum").agg(F.max(F.when(F.col("certified"), F.col("i"))).alias("i"))
    return chosen.select("stratum", *[F.get(F.array(*[F.lit(c) for c in cs]), F.col("i")).alias(name) for name, cs in cutoffs.items()])


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`stats` plus `base_failed` and `kept`. The cutoffs have a row a stratum and were written, so Spark
    knows their size when it chooses the join."""
    names = list(CUTOFFS)
    table_ = cutoffs.select(F.col("stratum").alias("_stratum"), F.struct(*names).alias("_cut"))
    joined = stats.withColumn("_stratum", stratum()).join(table_, "_stratum", "left")
    beyond = F.lit(False)
    for name, value in rates().items():
        beyond = beyond | F.coalesce(value >= F.col(f"_cut.{name}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_stratum", "_cut")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, STATS, base_failed and kept of each row of `docs` (doc_id, text, lang).

    A null or empty text has no words and fails; a null language is a stratum of its own; a null
    doc_id has no label; repeated rows are judged alike; an empty table gives an empty result. Other
    columns are not read.
    """
    stats = materialize(text_stats(_plain(docs)).select("doc_id", "lang", "_stats"), "quality-stats")
    cutoffs = materialize(certified_cutoffs(stats, labels), "quality-cutoffs")
    return judge(stats, cutoffs).select("doc_id", "_stats.*", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns.

    Rows and statistics are written once: the cutoffs read the narrow columns of labelled documents, and the
    verdict then filters written values (Spark would otherwise copy the statistics into the filter).
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang"), F.col("text"))
    held = materialize(text_stats(packed).drop("text"), "quality-rows")
    cutoffs = materialize(certified_cutoffs(held, labels), "quality-cutoffs")
    return judge(held, cutoffs).filter("kept").select("row.*")


_WORDS_SQL = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT r, doc_id, stratum, t, {_WORDS_SQL} AS words,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM base
), win AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM split, unnest(range(1, len(words) - 3)) AS u(i) WHERE len(words) >= 5
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY r
), st AS (
  SELECT s.r, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM split s LEFT JOIN rep ON rep.r = s.r
), val AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1),
          n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)] AS v FROM st
), grid AS (
  SELECT i, [[0.5,0.4,0.3,0.25,0.2,0.16,0.13,0.1][i], [0.9,0.8,0.7,0.6,0.5,0.4,0.3,0.25][i], [0.2,0.18,0.16,0.14,0.12,0.1,0.08,0.06][i], [60,50,40,30,25,20,17,15][i]]::DOUBLE[] AS c
  FROM unnest(range(1, 9)) AS u(i)
), good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (
  SELECT stratum, i, count(*) AS n, count(*) FILTER (v[1] >= c[1] OR v[2] >= c[2] OR v[3] >= c[3] OR v[4] >= c[4]) AS k
  FROM val SEMI JOIN good USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL
), tested AS (
  SELECT stratum, i, k < 0.02 * n AND list_sum(list_transform(range(k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1)
      - lgamma(n - x + 1) + x * ln(0.02) + (n - x) * ln(0.98)))) <= 0.05 / (SELECT count(DISTINCT stratum) FROM held) AS ok
  FROM held
), run AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY i) AS so_far FROM tested),
cut AS (SELECT stratum, c FROM (SELECT stratum, max(i) AS i FROM run WHERE so_far GROUP BY stratum) JOIN grid USING (i)),
beyond AS (SELECT r FROM val JOIN cut USING (stratum) WHERE v[1] >= c[1] OR v[2] >= c[2] OR v[3] >= c[3] OR v[4] >= c[4])
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM beyond) AS kept
FROM val
"""


@query("op8_quality_rules", ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines")
