"""Fail-closed data-quality jobs.

A check is a pair (rule, violated). All row rules of a table fold into one pass; a violation is a
row (rule, key), and a job refuses its output when a blocking rule has rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpanel.schemas import FEED_STATES, MARKET_STATES
from marketpanel.sources.sinks import remove_folder

# Literal marks of credentials and embedded payloads.
SECRET_MARKS = (
    "AKIA", "ghp_", "glpat-", "github_pat_", "sk-", "-----BEGIN PRIVATE KEY-----", "bearer ", "base64,",
)
SECRET_PATTERNS = (("token_assignment", r'token = "[0-9a-f]{40}"'),)
# The longest advice text and its prohibited claims.
LONGEST_TEXT = 1200
PROHIBITED_CLAIMS = ("保證划算", "一定便宜", "療效", "治療", "本日成交來自")


class ContractViolation(ValueError):
    """A blocking rule found rows."""


def violations(rows: DataFrame, key: Column, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """All broken row rules in one pass. A rule whose predicate is NULL counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
    )
    return rows.select(F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def duplicate_keys(rows: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """Keys which must be unique and are not."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(
        F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key")
    )


def require_clean(found: DataFrame, blocking: Sequence[str] | None = None) -> None:
    """Refuse to go on when a blocking rule has rows. Only rule names and counts reach the driver."""
    held = found if blocking is None else found.filter(F.col("rule").isin(*blocking))
    counts = held.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()
    if counts:
        raise ContractViolation(", ".join(f"{row['rule']}: {row['n']}" for row in counts))


class Matched:
    """A left join whose unmatched rows are counted while it runs; `check` refuses what it gave if there are any."""

    def __init__(self, rows: DataFrame, rule: str, observation: Observation):
        self.rows, self.rule, self._observation = rows, rule, observation

    def counts(self) -> tuple[int, int]:
        """(rows, unmatched rows), once a job over `rows` has ended; waits for one."""
        seen = self._observation.get
        return seen["rows"], seen["unmatched"]

    def check(self) -> None:
        unmatched = self.counts()[1]
        if unmatched:
            raise ContractViolation(f"{self.rule}: {unmatched}")


def require_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> Matched:
    """`left` with the columns of its rows in `right`, of which every row must have one. The count costs no pass of its
    own: it is a metric of the job that reads the join. A key that is NULL has no match."""
    marked = right.withColumn("_matched", F.lit(True))
    joined = left.join(marked, list(keys), "left")
    seen = Observation(f"{rule}-{uuid.uuid4().hex}")
    counted = joined.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_matched").isNull()).alias("unmatched"))
    return Matched(counted.drop("_matched"), rule, seen)


def require_none(rows: DataFrame, bad: Column, rule: str) -> Matched:
    """`rows`, of which none may be `bad` (NULL is bad), counted in the same way."""
    seen = Observation(f"{rule}-{uuid.uuid4().hex}")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("unmatched"))
    return Matched(counted, rule, seen)


def publish_checked(rows: DataFrame, path: str, checks: Sequence[Matched]) -> None:
    """Write `rows` and keep them only if every check made on the way passes; a refused folder is removed."""
    rows.write.mode("errorifexists").parquet(path)
    try:
        for check in checks:
            check.check()
    except ContractViolation:
        remove_folder(rows.sparkSession, path)
        raise


def status_rules() -> list[tuple[str, Column]]:
    """Contract of a publication status row."""
    return [
        ("unknown_status", ~F.col("status").isin(*MARKET_STATES)),
        ("unknown_feed_status", ~F.col("feed_status").isin(*FEED_STATES)),
        ("unknown_calendar_feed_status", ~F.col("calendar_feed_status").isin(*FEED_STATES)),
        ("negative_count", (F.col("observed_record_count") < 0) | (F.col("covered_count") < 0)),
        ("covered_above_expected", F.col("covered_count") > F.col("expected_count")),
        ("resolved_after_requested", F.coalesce(F.col("resolved_date") > F.col("transaction_date"), F.lit(False))),
    ]


def registry_rules() -> list[tuple[str, Column]]:
    """Contract of a lot before publishing."""
    place = F.col("place")
    return [
        ("missing_tracecode", F.col("tracecode").isNull()),
        ("no_coarse_place", place.isNull()),
        ("place_not_coarse", place.isNotNull() & ~place.rlike("[縣市]$")),
        ("unmapped_product", F.col("canonical_id").isNull()),
        ("unknown_validity", F.col("valid_date").isNull()),
        ("unknown_certification", ~F.col("certification_status").isin("active", "expired", "unknown")),
    ]


def https_url_problem(url: Column, hosts: Sequence[str]) -> Column:
    """First reason why a URL is not an allow-listed HTTPS address, else NULL."""
    valid = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    port = F.regexp_extract(url, r"^[a-z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    return (
        F.when(~F.startswith(url, F.lit("https://")), "not_https")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "user_info")
        .when(~valid.isin(*hosts), "host_not_allowed")
        .when(~port.isin("", "443"), "port")
        .when(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")) == "", "no_path")
        .when(F.try_parse_url(url, F.lit("REF")).isNotNull(), "fragment")
    )


def _strict(text: str | None) -> str | None:
    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise KeyError("duplicate_key")
        return dict(pairs)

    def constant(name):
        raise KeyError("constant")

    try:
        value = json.loads(text or "", object_pairs_hook=unique, parse_constant=constant)
    except KeyError as problem:
        return problem.args[0]
    except ValueError:
        return "not_json"
    return None if isinstance(value, dict) else "not_object"


@F.pandas_udf(T.StringType())
def strict_json_problem(texts: pd.Series) -> pd.Series:
    """Duplicate keys and NaN constants, which the built-in parser accepts silently."""
    return texts.map(_strict)


def json_contract(
    documents: DataFrame, text: str, required: Sequence[str], rules: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """First problem of each JSON document against a closed contract.

    `rules` are (problem, JSON path, pattern). Key sets compare natively; only the strict syntax
    test runs in Python, in Arrow batches.
    """
    keys = F.json_object_keys(F.col(text))
    names = F.array(*[F.lit(name) for name in required])
    problem = F.coalesce(
        F.col("_syntax"),
        F.when(F.size(F.array_except(names, keys)) > 0, "missing_field"),
        F.when(F.size(F.array_except(keys, names)) > 0, "unknown_field"),
        *[
            F.when(~F.coalesce(F.get_json_object(text, path), F.lit("")).rlike(pattern), name)
            for name, path, pattern in rules
        ],
    )
    return documents.withColumn("_syntax", strict_json_problem(F.col(text))).withColumn("problem", problem).drop("_syntax")


def secret_hits(texts: DataFrame, body: str, marks: Sequence[str] = SECRET_MARKS,
                patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS) -> DataFrame:
    """One row per mark or pattern found anywhere in a text, letter case ignored for marks."""
    lowered = texts.withColumn("_low", F.lower(body))
    found = [F.when(F.contains("_low", F.lit(mark.lower())), F.lit(mark)) for mark in marks]
    found += [F.when(F.col(body).rlike(pattern), F.lit(name)) for name, pattern in patterns]
    keep = [c for c in texts.columns if c != body]
    return lowered.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("hit"))


def text_policy(
    texts: DataFrame, body: str, prohibited: Sequence[str] = PROHIBITED_CLAIMS, longest: int = LONGEST_TEXT,
    trigger: str | None = None, disclaimer: str | None = None,
) -> DataFrame:
    """Broken text rules, one row per text and rule."""
    text = F.col(body)
    rules = [(f"prohibited:{claim}", F.contains(text, F.lit(claim))) for claim in prohibited]
    rules.append(("too_long", F.length(text) > longest))
    if trigger and disclaimer:
        rules.append(("missing_disclaimer", F.contains(text, F.lit(trigger)) & ~F.contains(text, F.lit(disclaimer))))
    keep = [c for c in texts.columns if c != body]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return texts.select(*keep, F.explode(broken).alias("rule"))


# A link attribute of a, link, area, script, img or iframe, in either kind of quotes.
_LINK = r"""(?is)<(?:a|link|area|script|img|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def resolved(page: Column, href: Column) -> Column:
    """Absolute address of a link without its query and fragment, as seen from the address of its page."""
    site = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    own = F.regexp_replace(F.regexp_replace(page, r"^https?://[^/?#]+", ""), r"[?#].*$", "")
    target = F.regexp_replace(href, r"[?#].*$", "")
    folder = F.regexp_replace(F.when(own == "", "/").otherwise(own), r"[^/]*$", "")
    path = F.when(target == "", own).when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    # Segment by segment: "." is nothing, ".." takes the last one away.
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, step: F.when(step == ".", done)
        .when(step == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(step))),
    )
    last = F.element_at(steps, -1)
    ends = F.when(last.isin(".", "..") , F.lit("/")).otherwise(F.lit(""))
    return F.concat(site, F.array_join(kept, "/"), ends)


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Absolute targets of site links; external schemes, anchors, mail and script links are left out."""
    both = F.zip_with(
        F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.regexp_extract_all(html, F.lit(_LINK), F.lit(2)), lambda a, b: F.concat(a, b)
    )
    out = pages.select("page_id", F.col(url).alias("_page"), F.explode(both).alias("href"))
    inside = out.filter(~F.col("href").rlike("(?i)^([a-z][a-z0-9+.-]*:|//|#)"))
    return inside.select("page_id", "href", resolved(F.col("_page"), F.col("href")).alias("target"))


def broken_links(pages: DataFrame) -> DataFrame:
    """Targets without a page. Links collapse to distinct targets before the anti-join, so a target
    linked from everywhere is one row."""
    targets = page_links(pages).groupBy("target").agg(F.count(F.lit(1)).alias("links"))
    known = pages.select(resolved(F.col("url"), F.lit("")).alias("target")).distinct()
    return targets.join(known, "target", "left_anti")


def repeated_attributes(pages: DataFrame, attribute: str, html: str = "html") -> DataFrame:
    """Values of an attribute, in either kind of quotes, which occur more than once in a page."""
    pattern = F.lit(rf"""(?i)(?<![\w-]){attribute}\s*=\s*(?:"([^"]*)"|'([^']*)')""")
    values = F.zip_with(F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2)), lambda a, b: F.concat(a, b))
    return pages.select("page_id", F.explode(values).alias("value")).groupBy("page_id", "value").agg(
        F.count(F.lit(1)).alias("occurrences")
    ).filter("occurrences > 1")


def reconcile(published: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed differences of a published table and its recomputation, one row per differing field."""
    fields = [c for c in published.columns if c not in keys]
    left = published.select(*keys, F.struct(*fields).alias("_p"))
    right = recomputed.select(*keys, F.struct(*fields).alias("_r"))
    joined = left.join(right, list(keys), "full").filter(~F.col("_p").eqNullSafe(F.col("_r")))
    entries = [
        F.when(
            ~F.col(f"_p.{c}").eqNullSafe(F.col(f"_r.{c}")),
            F.struct(F.lit(c).alias("field"), F.col(f"_p.{c}").cast("string").alias("published"),
                     F.col(f"_r.{c}").cast("string").alias("recomputed")),
        )
        for c in fields
    ]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(*keys, "d.*")


def build_gate(daily: DataFrame, expected: DataFrame, statuses: DataFrame) -> DataFrame:
    """Whether each day covers every configured item, and its source warnings."""
    covered = daily.join(expected, "canonical_id", "left_semi").groupBy("transaction_date").agg(
        F.count_distinct("canonical_id").alias("covered_items")
    )
    size = expected.select(F.count_distinct("canonical_id")).scalar()
    warnings = F.array_compact(F.array(
        F.when(F.col("market_status") == "fixture", "market data is a fixture"),
        F.when(F.col("season_status") == "fallback", "seasonality uses manual fallback"),
        F.when(F.col("season_status") == "stale", "seasonality uses stale last-known-good data"),
        F.lit("advice uses deterministic fallback"),
    ))
    out = covered.withColumn("expected_items", size).join(statuses, "transaction_date", "left")
    return out.select(
        "transaction_date", "covered_items", "expected_items",
        (F.col("covered_items") == F.col("expected_items")).alias("is_complete"), warnings.alias("warnings"),
    )
