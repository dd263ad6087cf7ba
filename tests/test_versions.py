import random

import pytest
from pyspark.sql import functions as F

from marketpanel.operators import resolve
from marketpanel.sources import sinks, versions
from marketpanel.sources.tables import ARRIVAL, IDENTITY
from marketpanel.streaming import resolution, upserts
from tests.test_streaming import KEYS, SCHEMA, batch, feed, table

OBS = (
    "batch_no bigint, page_no int, row_a bigint, row_b bigint, transaction_date date, market_code int, crop_code string, "
    "dataset_semantics string, source_role string, source_id string, source_precedence int, row_hash string"
)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def put(spark, path, name, rows, schema="day string, k string, v int"):
    frame = spark.createDataFrame(rows, schema)
    versions.commit(frame, path, name, "day", frame)


def test_commits_replace_whole_partitions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "day string, k string, v int"
    assert versions.current(spark, path, "day") is None and versions.last_commit(spark, path) == 0
    put(spark, path, "a-0", [("2026-08-01", "a", 1), ("2026-08-02", "b", 2), (None, "n", 3)])
    put(spark, path, "a-1", [("2026-08-01", "a", 9)])
    put(spark, path, "a-0", [("2026-08-01", "lost", 0)])  # a replay of a known name does nothing
    now = versions.current(spark, path, "day", schema)
    assert rows_of(now, "day", "k", "v") == [("2026-08-01", "a", 9), ("2026-08-02", "b", 2), (None, "n", 3)]
    # A partition that ends up without rows is empty, the others stay.
    some = spark.createDataFrame([("2026-08-02", "x", 0)], schema)
    versions.commit(some.limit(0), path, "b-0", "day", some)
    assert rows_of(versions.current(spark, path, "day", schema), "k") == [("a",), ("n",)]
    touched = spark.createDataFrame([("2026-08-01",)], "day string")
    assert rows_of(versions.current(spark, path, "day", schema, touched), "k") == [("a",)]
    assert versions.last_commit(spark, path) == 3


def test_a_crash_leaves_the_table_and_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, "a-0", [("2026-08-01", "a", 1)])
    # Rows are written, pointers are not complete: nothing of it counts, and the batch can run again.
    frame = spark.createDataFrame([("2026-08-01", "a", 2)], "day string, k string, v int")
    sinks.overwrite_folder(frame, f"{path}/rows/{versions.VERSION}=a-1", "day")
    frame.write.parquet(f"{path}/commits/2")
    (tmp_path / "t/commits/2/_SUCCESS").unlink()
    assert rows_of(versions.current(spark, path, "day"), "v") == [(1,)]
    put(spark, path, "a-1", [("2026-08-01", "a", 2)])
    assert rows_of(versions.current(spark, path, "day"), "v") == [(2,)]
    seen = versions.last_commit(spark, path)
    put(spark, path, "other-0", [("2026-08-01", "a", 3)])
    with pytest.raises(versions.ConcurrentWriter):
        versions.commit(frame, path, "late", "day", frame, seen)
    assert rows_of(versions.current(spark, path, "day"), "v") == [(3,)]


def test_pointers_fold_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FOLD_BEYOND", 3)
    path = str(tmp_path / "t")
    for k in range(6):
        put(spark, path, f"a-{k}", [(f"2026-08-0{1 + k % 2}", "a", k)])
    assert len(sinks.folders(spark, f"{path}/commits")) <= 4
    assert versions.committed(spark, path, "a-0") and not versions.committed(spark, path, "a-9")
    before = rows_of(versions.current(spark, path, "day"), "v")
    assert versions.vacuum(spark, path) == 4 and rows_of(versions.current(spark, path, "day"), "v") == before == [(4,), (5,)]


def test_columns_may_come_later(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, "a-0", [("2026-08-01", "a", 1)])
    put(spark, path, "a-1", [("2026-08-02", "b", 2, "new")], "day string, k string, v int, note string")
    now = versions.current(spark, path, "day", "day string, k string, v int, note string")
    assert rows_of(now, "k", "note") == [("a", None), ("b", "new")]


def test_many_touched_partitions_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LITERALS", 2)
    path = str(tmp_path / "t")
    put(spark, path, "a-0", [*[(f"2026-08-0{d}", "k", d) for d in range(1, 8)], (None, "k", 0)])
    touched = spark.createDataFrame([("2026-08-01",), ("2026-08-03",), ("2026-08-05",), (None,)], "day string")
    stored = versions.current(spark, path, "day", "day string, k string, v int", touched)
    assert rows_of(stored, "v") == [(0,), (1,), (3,), (5,)]


def test_two_checkpoints_of_one_table(spark, tmp_path):
    """Another stream's batch 0, or that of a stream whose checkpoint was lost, is a batch of its own."""
    first, second = feed(4, 60), [(d, k, seq, "new") for d, k, seq, _ in feed(5, 20)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in{n}"))
        running = upserts.upsert_stream(
            stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint{n}", KEYS, ["seq"], "h", "day", lambda: F.floor(F.col("seq") / 16))
        running.awaitTermination()
    assert table(spark, str(tmp_path)) == batch(spark, first + second)
    # The stage of a committed batch goes at the next start of its stream.
    stages = lambda: [f for d in sinks.folders(spark, f"{tmp_path}/table-stage") for f in sinks.folders(spark, d) if not f.endswith("first")]
    before = len(stages())
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in1"))
    upserts.upsert_stream(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint1", KEYS, ["seq"], "h", "day", lambda: F.floor(F.col("seq") / 16)).awaitTermination()
    assert len(stages()) == before - 1 and table(spark, str(tmp_path)) == batch(spark, first + second)


def observation(n, source="src_0", rank=10, role="authoritative_final", content="x", market=1, day="2026-08-01"):
    return (n, 1, 1, 1, day, market, "c", "daily", role, source, rank, content)


def frame(spark, rows):
    return spark.createDataFrame(rows, OBS.replace("transaction_date date", "transaction_date string")).withColumn("transaction_date", F.to_date("transaction_date"))


def test_stored_rows_are_guarded(spark, tmp_path):
    path = str(tmp_path / "t")
    publish = lambda name, rows, **how: rows_of(resolution.publish_observations(frame(spark, rows), path, name, **how), "market_code", "source_id", "stored_source", "rule")
    now = lambda: rows_of(resolution.published(spark, path), "market_code", "source_id", "row_hash", "batch_no")
    assert publish("a-0", [observation(1), observation(1, market=2), observation(2, market=3), observation(3, "src_1", market=3), observation(1, role="provisional", market=4)]) == []
    assert now() == [(1, "src_0", "x", 1), (2, "src_0", "x", 1)]  # market 3 is ambiguous, 4 has nothing final
    refused = publish("b-0", [
        observation(5, "low", 5, content="y"), observation(5, "equal", 10, content="y", market=2), observation(5, content="x", market=5),
    ])
    assert refused == [(1, "low", "src_0", "lower_precedence"), (2, "equal", "src_0", "ambiguous_source")]
    assert now() == [(1, "src_0", "x", 1), (2, "src_0", "x", 1), (5, "src_0", "x", 5)]
    assert publish("b-0", [observation(9, "high", 99, content="z")]) == refused  # a replay
    assert publish("a-0", [observation(1)]) == []  # a replay of a batch of which nothing was refused
    # The same source corrects, equal content stays, a higher precedence replaces.
    assert publish("b-1", [observation(6, content="y"), observation(6, market=2), observation(6, "high", 20, content="z", market=5)]) == []
    assert now() == [(1, "src_0", "y", 6), (2, "src_0", "x", 1), (5, "high", "z", 6)]
    with pytest.raises(resolution.PrecedenceRefused, match="lower_precedence: 1"):
        resolution.publish_observations(frame(spark, [observation(7, "low", 1, content="q"), observation(7, market=8)]), path, "c-0", strict=True)
    assert now() == [(1, "src_0", "y", 6), (2, "src_0", "x", 1), (5, "high", "z", 6)]
    missing = frame(spark, [observation(8, "none", None, content="q")])
    assert rows_of(resolution.publish_observations(missing, path, "d-0"), "rule") == [("missing_precedence",)]


def test_resolution_of_batches_in_any_order(spark, tmp_path):
    rng = random.Random(11)
    rows = [
        (n, 1, rng.randrange(3), 1, f"2026-08-0{rng.randrange(1, 4)}", rng.randrange(2), "c", "daily",
         rng.choice(["authoritative_final", "authoritative_final", "provisional", "validation"]), rng.choice("ab"), rng.choice([10, 10, 20]), rng.choice("xyz"))
        for n in range(240)
    ]
    want = rows_of(resolve.resolve(frame(spark, rows)), *IDENTITY, "winner", "winner_hash", "is_ambiguous", "supersedes_hash")
    rng.shuffle(rows)
    for k in range(4):
        resolution.merge_resolution(frame(spark, rows[k * 60:k * 60 + 60]), str(tmp_path / "t"), f"s-{k}")
        resolution.merge_resolution(frame(spark, rows[:30]), str(tmp_path / "t"), f"s-{k}")  # known, not added again
    got = resolution.resolution(spark, str(tmp_path / "t"))
    assert rows_of(got, *IDENTITY, "winner", "winner_hash", "is_ambiguous", "supersedes_hash") == want
    kept = versions.current(spark, str(tmp_path / "t"), "transaction_date")
    assert kept.groupBy(*IDENTITY, "source_role", "source_id", "source_precedence").count().filter("count > 2").isEmpty()
    assert {c for c in kept.columns} == {*IDENTITY, "source_role", "source_id", "source_precedence", "row_hash", "last"} and len(ARRIVAL) == 4
