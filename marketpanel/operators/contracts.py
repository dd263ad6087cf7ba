"""Contracts of published tables: what a table says about itself is counted again from its rows.

Every contract returns violations, one row a broken rule of a published unit (a snapshot, a run, a document), with
how many rows break it and the first of them. A predicate that is NULL counts as broken. `quality.require_clean` stops
a job on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpanel.schemas import FINAL_ROLE, SOURCE_ROLES
from marketpanel.sources.sinks import materialize

HASH = "^sha256:[0-9a-f]{64}$"
SOURCE_ID = "^[a-z0-9][a-z0-9._-]*$"
# States of a snapshot's source.
SNAPSHOT_STATES = ("fixture", "live", "stale")


def broken(bad: Column) -> Column:
    return F.coalesce(bad, F.lit(True))


def _entry(rule: str, rows: Column, first: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), rows.cast("bigint").alias("rows"), first.cast("string").alias("first_key"))


def _listed(rows: DataFrame, keys: Sequence[str], entries: Sequence[Column]) -> DataFrame:
    """One row a rule that has rows."""
    found = F.filter(F.array(*entries), lambda e: e["rows"] > 0)
    return rows.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")


def snapshot_violations(
    rows: DataFrame, profile: DataFrame, group: Sequence[str], identity: str, rules: Sequence[tuple[str, Column]],
    counts: dict[str, Column], profile_rules: Sequence[tuple[str, Column]],
) -> DataFrame:
    """Broken rules of stored snapshots: of their rows, their ids and the profile stored beside them.

    `rules` hold for each row, `profile_rules` for each profile; `counts` are aggregates by the name of the profile's
    field. Rows are read once: flags, ids and counts of a snapshot come from one aggregate, whose state combines before
    the shuffle. A profile without rows counts none; rows without a profile are a violation.
    """
    keys = list(group)
    flags = {f"_bad_{i}": broken(bad) for i, (_, bad) in enumerate(rules)}
    flagged = rows.withColumns(flags)
    recounted = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct(identity).alias("_ids"), F.count(identity).alias("_named"),
        *[F.count_if(f).alias(f) for f in flags], *[F.min(F.when(F.col(f), F.col(identity))).alias(f"{f}_first") for f in flags],
        *[c.alias(f"_count_{name}") for name, c in counts.items()],
    )
    stored = profile.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[F.col(c).alias(f"_stored_{c}") for c in counts], F.lit(True).alias("_has"),
                            *[broken(bad).alias(f"_profile_{i}") for i, (_, bad) in enumerate(profile_rules)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = recounted.join(stored, same, "full").withColumns({k: F.coalesce(F.col(k), F.col(f"_of_{k}")) for k in keys})
    none, label = F.lit(None).cast("string"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    entries = [_entry(rule, F.col(f), F.col(f"{f}_first")) for f, (rule, _) in zip(flags, rules)]
    entries += [
        _entry(f"repeated_{identity}", F.col("_named") - F.col("_ids"), none),
        _entry(f"missing_{identity}", F.col("_rows") - F.col("_named"), none),
        _entry("missing_profile", F.col("_has").isNull().cast("bigint"), label),
    ]
    entries += [_entry(rule, F.col(f"_profile_{i}").cast("bigint"), label) for i, (rule, _) in enumerate(profile_rules)]
    for name in counts:
        differs = F.col("_has") & ~F.col(f"_stored_{name}").eqNullSafe(F.coalesce(F.col(f"_count_{name}"), F.lit(0)))
        said = F.concat_ws("/", F.coalesce(F.col(f"_stored_{name}").cast("string"), F.lit("null")), F.coalesce(F.col(f"_count_{name}"), F.lit(0)).cast("string"))
        entries.append(_entry(f"profile_{name}", differs.cast("bigint"), said))
    return _listed(joined, keys, entries)


def lot_snapshot_violations(lots: DataFrame, profile: DataFrame, group: Sequence[str], source_id: str) -> DataFrame:
    """Contract of a registry snapshot: `lots` are its published rows, `profile` one row a snapshot."""
    place, status = F.col("place"), F.col("certification_status")
    return snapshot_violations(
        lots, profile, group, "tracecode",
        [
            ("row_source", F.col("source_id") != source_id),
            ("certification_status", ~status.isin("active", "expired", "unknown")),
            ("place_not_coarse", place.isNotNull() & (place != "") & ~place.rlike("[縣市]$")),
        ],
        {
            "published_record_count": F.count(F.lit(1)), "active_record_count": F.count_if(status == "active"),
            "operator_count": F.count_distinct("org_id"), "mapped_item_count": F.count_distinct("canonical_id"),
        },
        [
            ("profile_source", F.col("source_id") != source_id), ("profile_status", ~F.col("source_status").isin(*SNAPSHOT_STATES)),
            ("profile_hash", ~F.col("content_hash").rlike(HASH)),
        ],
    )


def event_snapshot_violations(events: DataFrame, profile: DataFrame, day: str, source_id: str, prefix: str) -> DataFrame:
    """Contract of a day's market events: they never enter aggregates or scores, are of the requested day, and their
    amounts are numbers of at least zero."""
    return snapshot_violations(
        events, profile, [day], "event_id",
        [
            ("event_identity", ~F.startswith("event_id", F.lit(prefix))), ("row_source", F.col("source_id") != source_id),
            ("row_in_aggregate", F.col("eligible_for_market_aggregate")), ("row_in_score", F.col("affects_buy_score")),
            ("row_date", F.col("transaction_date") != F.col(day)),
            ("row_number", ~((F.col("amount") >= 0) & (F.col("volume") >= 0))),
        ],
        {
            "published_record_count": F.count(F.lit(1)), "mapped_item_count": F.count_distinct("canonical_id"),
            "market_count": F.count_distinct("market_code"),
        },
        [
            ("profile_source", F.col("source_id") != source_id), ("profile_status", ~F.col("source_status").isin(*SNAPSHOT_STATES)),
            ("profile_hash", ~F.col("content_hash").rlike(HASH)), ("profile_in_aggregate", F.col("eligible_for_market_aggregate")),
            ("profile_in_score", F.col("affects_buy_score")),
        ],
    )


def run_violations(runs: DataFrame, candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """Contract of source runs, the decisions between their candidates and the summary of a document: (document, rule,
    rows, first_key).

    `runs` has a row a run of a document, `candidates` a row a candidate of a decision (with the selected observation
    id of its decision), `summary` a row a document. The three are read as published, never the observations; candidates
    may be derived, and are read a few times, each time into small folds or numbers. Counts
    must agree along each run: raw = normalised = eligible + suppressed, no run has more candidates or chosen ones
    than it says, and the document's totals are those of its runs.
    """
    document = ["document"]
    final = F.col("source_role") == FINAL_ROLE
    counted = ("raw_count", "normalized_count", "eligible_count", "suppressed_count")
    negative = F.lit(False)
    for c in counted:
        negative = negative | (F.col(c) < 0)
    run_rules = [
        ("run_id", ~F.col("run_id").rlike(HASH)), ("run_source_id", ~F.col("source_id").rlike(SOURCE_ID)),
        ("run_role", ~F.col("source_role").isin(*SOURCE_ROLES)), ("run_content_hash", ~F.col("content_hash").rlike(HASH)),
        ("run_precedence", F.col("source_precedence") < 0), ("run_http_status", ~F.col("http_status").between(100, 599)),
        ("run_count_negative", negative), ("run_raw_not_accounted", F.col("normalized_count") != F.col("raw_count")),
        ("run_counts_do_not_add", F.col("eligible_count") + F.col("suppressed_count") != F.col("normalized_count")),
        ("run_not_final_eligible", ~final & (F.col("eligible_count") > 0)),
    ]
    candidate_rules = [
        ("candidate_hash", ~(F.col("observation_id").rlike(HASH) & F.col("row_hash").rlike(HASH))),
        ("candidate_role", ~F.col("source_role").isin(*SOURCE_ROLES)), ("candidate_precedence", F.col("source_precedence") < 0),
        ("candidate_not_final_eligible", F.col("is_eligible") & ~final),
        ("candidate_supersedes", F.col("supersedes").isNotNull() & ~F.col("supersedes").rlike(HASH)),
    ]

    def of_rows(rows: DataFrame, rules, key: str) -> DataFrame:
        flags = {f"_bad_{i}": broken(bad) for i, (_, bad) in enumerate(rules)}
        # Only rows that break a rule are folded, as the first of them are texts.
        bad = F.lit(False)
        for f in flags:
            bad = bad | F.col(f)
        seen = rows.withColumns(flags).filter(bad).groupBy("document").agg(
            *[F.count_if(f).alias(f) for f in flags], *[F.min(F.when(F.col(f), F.col(key))).alias(f"{f}_first") for f in flags])
        return _listed(seen, document, [_entry(rule, F.col(f), F.col(f"{f}_first")) for f, (rule, _) in zip(flags, rules)])

    def per_document(rows: DataFrame, rule: str, key: str) -> DataFrame:
        return rows.groupBy("document").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("rows"), F.min(F.col(key).cast("string")).alias("first_key"))

    repeated_runs = runs.groupBy("document", "run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Ids meet by their hash, and in full where hashes meet.
    hashed = candidates.withColumn("_hash", F.xxhash64("observation_id"))
    met_ids = materialize(hashed.groupBy("document", "_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "met-ids")
    repeated_ids = hashed.join(met_ids, ["document", "_hash"], "left_semi").groupBy("document", "observation_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Ids of a decision are only compared, so two hashes under different seeds stand for them and nothing is sorted.
    both = lambda c: [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c))) for seed in (1, 2)]
    differs, same = F.lit(False), F.lit(True)
    states = []
    for i, (chosen, selected) in enumerate(zip(both("observation_id"), both("selected"))):
        states += [F.max(F.when(F.col("is_eligible"), chosen)).alias(f"chosen{i}"), F.min(selected).alias(f"low{i}"), F.max(selected).alias(f"high{i}")]
        differs = differs | ~F.col(f"low{i}").eqNullSafe(F.col(f"high{i}"))
        same = same & F.col(f"chosen{i}").eqNullSafe(F.col(f"high{i}"))
    decisions = materialize(candidates.groupBy("document", "identity").agg(F.count_if("is_eligible").alias("eligible"), *states), "contract-decisions")
    several = decisions.filter("eligible > 1")
    unmatched = decisions.filter((F.col("eligible") <= 1) & (differs | ~same))
    # Candidates fold to a row a run, and meet the runs there.
    used = materialize(candidates.groupBy("document", "run_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("is_eligible").alias("chosen")), "contract-runs")
    met = used.join(runs.groupBy("document", "run_id").agg(F.max("normalized_count").alias("has"), F.max("eligible_count").alias("may")), ["document", "run_id"], "left")
    orphans = met.filter(F.col("has").isNull())
    beyond = met.filter((F.col("candidates") > F.col("has")) | (F.col("chosen") > F.col("may")))
    totals = runs.groupBy("document").agg(F.sum("normalized_count").alias("n"), F.sum("eligible_count").alias("e"), F.sum("suppressed_count").alias("s")).join(
        decisions.groupBy("document").agg(F.count(F.lit(1)).alias("d")), "document", "left")
    agreed = (
        F.col("observation_count").eqNullSafe(F.col("n")) & F.col("eligible_total").eqNullSafe(F.col("e"))
        & F.col("suppressed_total").eqNullSafe(F.col("s")) & F.col("decision_count").eqNullSafe(F.coalesce("d", F.lit(0)))
    )
    wrong = summary.join(totals, "document", "full").filter(~agreed)
    parts = [
        of_rows(runs, run_rules, "source_id"), of_rows(candidates, candidate_rules, "observation_id"),
        per_document(repeated_runs, "run_id_repeated", "run_id"), per_document(repeated_ids, "observation_id_repeated", "observation_id"),
        per_document(several, "several_eligible", "identity"), per_document(unmatched, "selected_not_eligible", "identity"),
        per_document(orphans, "candidate_without_run", "run_id"), per_document(beyond, "run_has_fewer_rows", "run_id"),
        per_document(wrong, "summary", "document"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
