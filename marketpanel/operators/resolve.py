"""Competing sources, corrections and run evidence.

The economic identity of a transaction is the grouping key throughout. Every job here reduces with
combinable aggregates first, and goes back to row level only through `skew.attach`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.functions.text import row_hash
from marketpanel.operators.skew import attach, content_digest
from marketpanel.schemas import FINAL_ROLE
from marketpanel.sources.adapters import observation_id
from marketpanel.sources.sinks import materialize
from marketpanel.sources.tables import ARRIVAL, IDENTITY


def upsert(
    rows: DataFrame,
    chunk: Column,
    keys: Sequence[str] = IDENTITY,
    order: Sequence[str] = ARRIVAL,
    value: str = "row_hash",
) -> DataFrame:
    """One row per key: the first row of the last run of equal hashes.

    A later row with the same hash is not a correction, so the stored row (and its fetch time)
    stays; a later row with another hash replaces it.

    Rows are read once. A window finds the runs inside (key, chunk); each chunk is folded to its
    first and last hash and the start of its last run, without a further exchange; a second window
    over those summaries decides where the last run of the key began. `chunk` must grow with
    `order`, and bounds what one task holds of a hot key.
    """
    rest = [c for c in rows.columns if c not in keys]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    marked = rows.withColumn("_chunk", chunk).withColumn("_before", F.lag(F.struct(value)).over(inside))
    starts = F.col("_before").isNotNull() & ~F.col(f"_before.{value}").eqNullSafe(F.col(value))
    row = F.struct(*order, F.struct(*rest).alias("row"))
    chunks = marked.groupBy(*keys, "_chunk").agg(
        F.min(row).alias("_first"),
        F.max(F.struct(*order, F.col(value).alias("value"))).alias("_last"),
        F.max(F.when(starts, row)).alias("_inner"),
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = F.lag("_last").over(across)
    begins = F.col("_carried").isNull() | ~F.col("_carried.value").eqNullSafe(F.col(f"_first.row.{value}"))
    run = F.coalesce(F.col("_inner"), F.when(begins, F.col("_first")))
    return (
        chunks.withColumn("_carried", carried)
        .withColumn("_run", run)
        .groupBy(*keys)
        .agg(F.max("_run").alias("_run"))
        .select(*keys, "_run.row.*")
    )


def _final() -> Column:
    return F.col("source_role") == FINAL_ROLE


def winners(observations: DataFrame) -> DataFrame:
    """Authoritative winner per identity: highest precedence, then latest arrival.

    Two sources at the top precedence are an ambiguity: `is_ambiguous` is set and the identity has
    no winner, so nothing is chosen silently. One combinable aggregate: the lowest and the highest
    source name at the top precedence tell whether there are several.
    """
    final, rank = _final(), F.col("source_precedence")
    picked = observations.groupBy(*IDENTITY).agg(
        F.max(F.when(final, F.struct(rank.alias("rank"), F.struct(*ARRIVAL).alias("last"), "source_id"))).alias("best"),
        F.max(F.when(final, F.struct(rank.alias("rank"), "source_id"))).alias("_high"),
        F.min(F.when(final, F.struct((-rank).alias("rank"), F.col("source_id")))).alias("_low"),
        F.count(F.lit(1)).alias("candidate_rows"),
        F.count_if(final).alias("authoritative_rows"),
    )
    ambiguous = F.coalesce(F.col("_low.source_id") != F.col("_high.source_id"), F.lit(False))
    chosen = F.when(~ambiguous, F.col("best"))
    return picked.select(
        *IDENTITY, chosen["last"].alias("winner"), chosen["source_id"].alias("winner_source"),
        "candidate_rows", "authoritative_rows", ambiguous.alias("is_ambiguous"),
    )


_SOURCE = (*IDENTITY, "source_role", "source_id", "source_precedence")


def contents(observations: DataFrame) -> DataFrame:
    """One row a content (identity, role, source, precedence, hash), with its `last` arrival."""
    return observations.groupBy(*_SOURCE, "row_hash").agg(F.max(F.struct(*ARRIVAL)).alias("last"))


def latest_contents(found: DataFrame) -> DataFrame:
    """The two latest contents of each identity, role, source and precedence; all that a resolution can ask for.

    Contents of several batches may be added up (`merged_contents`) and cut again: one that is cut has two later ones
    before it, whose last arrivals can only grow, so it is not missed unless it arrives again.
    """
    newest = Window.partitionBy(*_SOURCE).orderBy(F.desc("last"))
    return found.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2).drop("_n")


def merged_contents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Latest contents of two tables of latest contents."""
    both = stored.select(*fresh.columns).unionByName(fresh)
    return latest_contents(both.groupBy(*_SOURCE, "row_hash").agg(F.max("last").alias("last")))


def resolve(observations: DataFrame) -> DataFrame:
    """Winners with the record they supersede: the latest other row which was provisional or came
    from the same source, and differs in content.

    Per identity, role, source and precedence only the two latest contents can matter (one may be
    the winner's own), so copies collapse first, older contents are cut before the exchange of the
    window, and what meets per identity is bounded by the number of sources.
    """
    return resolved(latest_contents(contents(observations)))


def resolved(kept: DataFrame) -> DataFrame:
    """The resolution of each identity from its latest contents."""
    fields = ("source_precedence", "last", "row_hash", "source_id", "source_role")
    grouped = kept.groupBy(*IDENTITY).agg(F.collect_list(F.struct(*fields)).alias("_c"))
    finals = grouped.withColumn("_f", F.filter("_c", lambda c: c["source_role"] == FINAL_ROLE)).withColumn(
        "_top", F.array_max("_f")
    )
    sources = F.transform(
        F.filter("_f", lambda c: c["source_precedence"] == F.col("_top.source_precedence")), lambda c: c["source_id"]
    )
    judged = finals.withColumn("is_ambiguous", F.size(F.array_distinct(sources)) > 1).withColumn(
        "_win", F.when(~F.col("is_ambiguous"), F.col("_top"))
    )
    replaced = F.filter(
        "_c",
        lambda c: (c["row_hash"] != F.col("_win.row_hash"))
        & ((c["source_role"] == "provisional") | (c["source_id"] == F.col("_win.source_id"))),
    )
    latest = F.array_max(F.transform(replaced, lambda c: F.struct(c["last"].alias("last"), c["row_hash"].alias("row_hash"))))
    return judged.select(
        *IDENTITY,
        F.col("_win.last").alias("winner"),
        F.col("_win.row_hash").alias("winner_hash"),
        F.col("_win.source_id").alias("winner_source"),
        F.col("_win.source_precedence").alias("winner_precedence"),
        "is_ambiguous",
        F.when(F.col("_win").isNotNull(), latest["row_hash"]).alias("supersedes_hash"),
    )


def decisions(observations: DataFrame) -> DataFrame:
    """Candidate rows of every identity which needed a decision: several candidates or no winner.

    One row per candidate instead of a nested list, because one identity may hold any number.
    """
    selected = winners(observations)
    # Written, so that its size is known before the observations are exchanged to meet it.
    needed = materialize(
        selected.filter((F.col("candidate_rows") > 1) | F.col("winner").isNull()).select(*IDENTITY, "winner", "is_ambiguous"), "needed-decisions")
    position = F.struct(*ARRIVAL)
    return attach(
        observations, needed, IDENTITY
    ).select(
        *IDENTITY, *ARRIVAL, "source_id", "source_role", "source_precedence", "row_hash",
        F.coalesce(F.col("winner") == position, F.lit(False)).alias("is_eligible"),
        "is_ambiguous",
    ).withColumn(
        "observation_id",
        observation_id(run_id(), F.col("row_hash"), *[F.col(c) for c in ARRIVAL]),
    )


def run_id() -> Column:
    """A run is one source and one requested period."""
    return row_hash(F.col("source_id"), F.col("transaction_date"))


def run_evidence(observations: DataFrame) -> DataFrame:
    """Counts per run (source and requested period); they must reconcile by construction.

    Rows are read once: they fold to one row per identity and source, which holds its count and its highest
    authoritative precedence. A source wins an identity if it alone has the highest of all.
    """
    folded = observations.groupBy(*IDENTITY, "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(_final(), F.col("source_precedence"))).alias("top")
    )
    identity = Window.partitionBy(*IDENTITY)
    ranked = folded.withColumn("_best", F.max("top").over(identity))
    ranked = ranked.withColumn("_holders", F.count_if(F.col("top") == F.col("_best")).over(identity))
    wins = F.coalesce((F.col("top") == F.col("_best")) & (F.col("_holders") == 1), F.lit(False))
    return ranked.groupBy("source_id", "transaction_date").agg(
        F.sum("n").alias("normalized_count"), F.count_if(wins).alias("eligible_count")
    ).select(
        run_id().alias("run_id"), "source_id", "transaction_date", "normalized_count", "eligible_count",
        (F.col("normalized_count") - F.col("eligible_count")).alias("suppressed_count"),
    )


def precedence_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows which may not replace what is stored: lower precedence, or an equal one from
    another source. `stored` has one row per identity."""
    prior = stored.select(
        *IDENTITY, F.col("source_id").alias("stored_source"),
        F.col("source_precedence").alias("stored_precedence"),
    )
    joined = attach(incoming, prior, IDENTITY).filter(F.col("source_id") != F.col("stored_source"))
    rule = refusal(F.col("source_precedence"), F.col("stored_precedence"))
    return joined.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def refusal(incoming: Column, stored: Column) -> Column:
    """Why a row of another source may not replace a stored one, by their precedences; null if it may."""
    return (
        F.when(incoming.isNull() | stored.isNull(), "missing_precedence")
        .when(incoming < stored, "lower_precedence")
        .when(incoming == stored, "ambiguous_source")
    )


def winning_rows(observations: DataFrame) -> DataFrame:
    """The rows that win their identity, one each; identities without a winner have none."""
    best = winners(observations).filter(F.col("winner").isNotNull()).select(*IDENTITY, "winner")
    return attach(observations, best, IDENTITY).filter(F.struct(*ARRIVAL) == F.col("winner")).drop("winner")


def guarded_merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(stored, incoming, rule, kept) per identity of two tables with a row an identity: structs of their rows, why the
    incoming one is refused, and which is kept. One full join decides all of it: a refused row and one of equal hash
    leave what is stored."""
    left = stored.select(F.struct(*[F.col(c) for c in stored.columns]).alias("stored"))
    right = incoming.select(F.struct(*[F.col(c) for c in incoming.columns]).alias("incoming"))
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(f"stored.{c}").eqNullSafe(F.col(f"incoming.{c}"))
    joined = left.join(right, same, "full")
    both = F.col("stored").isNotNull() & F.col("incoming").isNotNull()
    other = both & ~F.col("stored.source_id").eqNullSafe(F.col("incoming.source_id"))
    rule = F.when(other, refusal(F.col("incoming.source_precedence"), F.col("stored.source_precedence")))
    stays = F.col("incoming").isNull() | F.col("rule").isNotNull() | (both & F.col("stored.row_hash").eqNullSafe(F.col("incoming.row_hash")))
    return joined.withColumn("rule", rule).withColumn("kept", F.when(stays, F.col("stored")).otherwise(F.col("incoming")))


def batch_manifest(rows: DataFrame, batch: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Manifest per batch: covered dates, count, order-free content hash, range status."""
    shape = [
        F.min("observed_on").alias("first_date"),
        F.max("observed_on").alias("last_date"),
        F.count_if(~F.col("observed_on").between(start, end)).alias("outside_rows"),
    ]
    return content_digest(rows, batch, F.substring("row_hash", 8, 64), shape).withColumn(
        "status", F.when(F.col("outside_rows") > 0, "outside_requested_range").otherwise("success")
    )


def duplicate_keys(rows: DataFrame, keys: Sequence[str], payload: str, order: Sequence[str]) -> DataFrame:
    """Keys seen more than once: equal payloads collapse to a stable first row, unequal ones are a
    conflict. Minimum and maximum of the payload hash decide, so the state is constant per key."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        (F.min(payload) != F.max(payload)).alias("is_conflict"),
        F.min(F.struct(payload, *order)).alias("kept"),
    ).filter(F.col("copies") > 1)
