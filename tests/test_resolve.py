import random

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import resolve, skew
from marketpanel.sources.tables import ARRIVAL, IDENTITY


def brute_upsert(rows):
    kept = {}
    for key, seq, value in sorted(rows, key=lambda r: r[1]):
        if key not in kept or kept[key][1] != value:
            kept[key] = (seq, value)
    return kept


@pytest.mark.parametrize("seed, width", [(1, 1), (2, 3), (3, 10), (4, 1000)])
def test_upsert_equals_sequential_rule_for_any_chunk(spark, seed, width):
    rng = random.Random(seed)
    rows = [(rng.choice("abcc"), seq, rng.choice("xyz")) for seq in range(400)]
    frame = spark.createDataFrame(rows, "k string, seq int, h string").repartition(5)
    out = resolve.upsert(frame, F.floor(F.col("seq") / width), ["k"], ["seq"], "h")
    assert {r.k: (r.seq, r.h) for r in out.collect()} == brute_upsert(rows)


def test_one_hot_key_of_copies(spark):
    rows = [("hot", i, "same") for i in range(500)] + [("cold", 1000, "x")]
    frame = spark.createDataFrame(rows, "k string, seq int, h string")
    out = resolve.upsert(frame, F.floor(F.col("seq") / 16), ["k"], ["seq"], "h")
    assert {r.k: r.seq for r in out.collect()} == {"hot": 0, "cold": 1000}


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_runs_are_numbered_across_chunks(spark, width):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), seq, rng.choice(["x", "y", None])) for seq in range(200)]
    frame = spark.createDataFrame(rows, "k string, seq int, h string")
    out = skew.sequence_runs(frame, ["k"], ["seq"], "h", F.floor(F.col("seq") / width)).collect()
    state, wanted = {}, {}
    for k, seq, h in rows:
        n, last = state.get(k, (0, object()))
        state[k] = (n + (h != last), h)
        wanted[seq] = (h != last, state[k][0])
    assert {r.seq: (r.is_start, r.run_no) for r in out} == wanted


def feed(spark, rows):
    """(batch, market, role, source, precedence, hash)"""
    full = [(b, 1, 1, 1, "2026-08-01", m, "A1", "daily", role, src, p, h) for b, m, role, src, p, h in rows]
    names = [*ARRIVAL, *IDENTITY, "source_role", "source_id", "source_precedence", "row_hash"]
    return spark.createDataFrame(full, names)


FINAL = "authoritative_final"


def one(spark, rows):
    return resolve.resolve(feed(spark, rows)).first()


def test_higher_precedence_wins_over_later_arrival(spark):
    out = one(spark, [(1, 1, FINAL, "a", 20, "h1"), (2, 1, FINAL, "b", 10, "h2")])
    assert (out.winner_hash, out.winner_source, out.supersedes_hash) == ("h1", "a", None)


def test_last_row_of_a_source_wins_and_names_what_it_replaces(spark):
    out = one(spark, [(1, 1, FINAL, "a", 10, "h1"), (2, 1, FINAL, "a", 10, "h2"), (3, 1, FINAL, "a", 10, "h3")])
    assert (out.winner_hash, out.supersedes_hash) == ("h3", "h2")
    out = one(spark, [(1, 1, FINAL, "a", 10, "h1"), (2, 1, "provisional", "p", 99, "h9"), (3, 1, FINAL, "a", 10, "h1")])
    assert (out.winner_hash, out.supersedes_hash) == ("h1", "h9")


def test_equal_precedence_of_two_sources_is_ambiguous(spark):
    rows = [(1, 1, FINAL, "a", 10, "h1"), (2, 1, FINAL, "b", 10, "h2")]
    out = one(spark, rows)
    assert out.is_ambiguous and out.winner is None
    assert resolve.winners(feed(spark, rows)).first().winner is None
    apart = feed(spark, [(1, 1, FINAL, "a", 10, "h1"), (2, 2, FINAL, "b", 10, "h2")])
    assert not any(r.is_ambiguous for r in resolve.resolve(apart).collect())


def test_non_final_roles_are_evidence_only(spark):
    rows = feed(spark, [(1, 1, r, "a", 10, "h") for r in ("provisional", "validation", "contextual")])
    assert resolve.resolve(rows).first().winner is None
    assert all(not r.is_eligible for r in resolve.decisions(rows).collect())


def brute_resolve(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    out = {}
    for market, group in groups.items():
        finals = [r for r in group if r[2] == FINAL]
        if not finals:
            out[market] = (None, None)
            continue
        top = max(r[4] for r in finals)
        best = [r for r in finals if r[4] == top]
        if len({r[3] for r in best}) > 1:
            out[market] = ("ambiguous", None)
            continue
        win = max(best)
        prior = [r for r in group if r is not win and r[5] != win[5] and (r[2] == "provisional" or r[3] == win[3])]
        out[market] = (win[5], max(prior)[5] if prior else None)
    return out


def test_resolution_against_the_plain_rule(spark):
    rng = random.Random(3)
    rows = [
        (b, rng.randrange(40), rng.choice([FINAL, FINAL, "provisional", "validation"]), *rng.choice([("a", 10), ("b", 20), ("c", 20)]), rng.choice("uvw"))
        for b in range(300)
    ]
    found = resolve.resolve(feed(spark, rows)).collect()
    assert {r.market_code: ("ambiguous" if r.is_ambiguous else r.winner_hash, r.supersedes_hash) for r in found} == brute_resolve(rows)


def test_run_counts_reconcile(spark):
    rng = random.Random(4)
    rows = [(b, rng.randrange(9), rng.choice([FINAL, "provisional"]), rng.choice("ab"), 10, rng.choice("uv")) for b in range(80)]
    runs = resolve.run_evidence(feed(spark, rows)).collect()
    assert sum(r.normalized_count for r in runs) == 80
    assert all(r.normalized_count == r.eligible_count + r.suppressed_count for r in runs)


def test_stored_precedence_guard(spark):
    stored = feed(spark, [(1, 1, FINAL, "a", 20, "h1"), (1, 2, FINAL, "a", 10, "h1"), (1, 3, FINAL, "a", 10, "h1")])
    incoming = feed(spark, [(2, 1, FINAL, "b", 10, "h"), (2, 2, FINAL, "b", 10, "h"), (2, 3, FINAL, "b", 20, "h"), (3, 1, FINAL, "a", 1, "h")])
    rules = {r.market_code: r.rule for r in resolve.precedence_conflicts(stored, incoming).collect()}
    assert rules == {1: "lower_precedence", 2: "ambiguous_source"}


def test_digest_ignores_order_and_sees_content(spark):
    rows = [(i % 3, f"{i:064x}"[-64:]) for i in range(90)]
    def digest(data, parts):
        frame = spark.createDataFrame(data, "g int, h string").repartition(parts)
        return {r.g: r.content_hash for r in skew.content_digest(frame, ["g"], F.sha2("h", 256)).collect()}
    base = digest(rows, 3)
    assert digest(rows[::-1], 7) == base
    changed = digest(rows[:-1] + [(2, "f" * 64)], 3)
    assert changed[2] != base[2] and changed[0] == base[0]
    assert digest(rows + rows[:1], 3)[0] != base[0]


def test_attach_lets_adaptive_execution_split_a_hot_key(spark):
    """A third and more of the rows under one key: the join must shuffle both sides right below it
    and the hot partition must be split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 200_000, 1, 16).select(
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
        )
        per_key = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        joined = skew.attach(facts, per_key, ["k"])
        assert joined.count() == 200_000
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.groupBy("k").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).filter("n <> c")
        assert rows.count() == 0
        frame = joined.select("k", "v", "n")
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
