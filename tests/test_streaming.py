import random

from pyspark.sql import functions as F

from marketpanel.operators import resolve
from marketpanel.sources import sinks
from marketpanel.streaming import upserts

SCHEMA = "day string, k string, seq int, h string"
KEYS = ["day", "k"]


def feed(seed=1, n=300):
    rng = random.Random(seed)
    return [(f"2026-08-0{rng.randrange(1, 5)}", rng.choice("ab"), seq, rng.choice("xyz")) for seq in range(n)]


def write_parts(spark, rows, path, parts):
    """Files which arrive one by one, each holding late corrections of earlier days."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    running = upserts.upsert_stream(
        stream, f"{folder}/table", f"{folder}/checkpoint", KEYS, ["seq"], "h", "day", lambda: F.floor(F.col("seq") / 16))
    running.awaitTermination()
    return running


def table(spark, folder):
    return {(str(r.day), r.k): (r.seq, r.h) for r in spark.read.parquet(f"{folder}/table").collect()}


def batch(spark, rows):
    """The batch job over rows in the order in which they arrive."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ingest int, " + SCHEMA)
    out = resolve.upsert(frame, F.floor(F.col("ingest") / 16), KEYS, ["ingest"], "h")
    return {(r.day, r.k): (r.seq, r.h) for r in out.collect()}


def test_micro_batches_equal_the_batch_job(spark, tmp_path):
    rows = feed()
    write_parts(spark, rows, str(tmp_path / "in"), 4)
    run(spark, str(tmp_path / "in"), str(tmp_path))
    assert table(spark, str(tmp_path)) == batch(spark, rows)
    more = [(d, k, seq + 1000, h) for d, k, seq, h in feed(2, 40)]
    write_parts(spark, more, str(tmp_path / "in"), 1)
    run(spark, str(tmp_path / "in"), str(tmp_path))
    assert table(spark, str(tmp_path)) == batch(spark, rows + more)


def test_a_row_out_of_order_counts_when_it_arrives(spark, tmp_path):
    """A@10 and A@20, then B@15: the later batch corrects, in both forms."""
    parts = ([("2026-08-01", "k", 10, "A"), ("2026-08-01", "k", 20, "A")], [("2026-08-01", "k", 15, "B")])
    for rows in parts:
        write_parts(spark, rows, str(tmp_path / "in"), 1)
        run(spark, str(tmp_path / "in"), str(tmp_path))
    assert table(spark, str(tmp_path)) == batch(spark, [r for p in parts for r in p]) == {("2026-08-01", "k"): (15, "B")}


def test_replay_after_a_crash_while_publishing(spark, tmp_path):
    """The stage is complete and the partition is gone: the stored key must come back."""
    path, stage = str(tmp_path / "t"), str(tmp_path / "s")
    old = spark.createDataFrame([("2026-08-01", "old", 1, "x")], SCHEMA)
    new = spark.createDataFrame([("2026-08-01", "new", 2, "y")], SCHEMA)
    merge = lambda rows, name: upserts.merge_partitions(
        spark, rows, path, f"{stage}/{name}", KEYS, ["seq"], "h", "day", F.floor(F.col("seq") / 16))
    merge(old, 0)
    merge(new, 1)
    sinks.remove_folder(spark, f"{path}/day=2026-08-01")
    merge(new, 1)
    assert {r.k for r in spark.read.parquet(path).collect()} == {"old", "new"}


def test_touched_days_are_pruned_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(f"2026-08-0{d}", "k", d, "x") for d in range(1, 8)], SCHEMA).write.partitionBy("day").parquet(path)
    batch_ = spark.createDataFrame([("2026-08-03", "k", 9, "y")], SCHEMA).withColumn("day", F.to_date("day"))
    stored = sinks.only_partitions(spark.read.parquet(path), "day", sinks.touched_partitions(batch_, "day"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "2026-08-03" in plan.split("PartitionFilters")[1].split("]")[0] and len(stored.inputFiles()) and stored.count() == 1


def test_unique_stream_drops_copies_however_late(spark, tmp_path):
    source = str(tmp_path / "in")
    for rows in ([("2026-08-09 10:00:00", 1), ("2026-08-01 10:00:00", 2)], [("2026-08-09 10:00:00", 1), ("2026-08-01 10:00:00", 2), ("2026-01-01 00:00:00", 3)]):
        frame = spark.createDataFrame(rows, "t string, id int").select(F.col("t").cast("timestamp").alias("ts"), "id")
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("ts timestamp, id int").option("maxFilesPerTrigger", 1).parquet(source)
    upserts.unique_stream(stream, "ts", "id", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = feed(3, 80)
    frame = spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):
        upserts.merge_partitions(
            spark, frame, str(tmp_path / "t"), str(tmp_path / "s"), KEYS, ["seq"], "h", "day", F.floor(F.col("seq") / 16))
    assert {(str(r.day), r.k): (r.seq, r.h) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == batch(spark, rows)


def test_daily_totals_follow_updates(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "ts timestamp, item string, v bigint"
    for part in ([("2026-08-01 10:00:00", "a", 1), ("2026-08-02 10:00:00", "a", 2)], [("2026-08-01 11:00:00", "a", 5), ("2026-08-02 09:00:00", "b", 7), ("2026-01-01 09:00:00", "b", 4)]):
        frame = spark.createDataFrame(part, "t string, item string, v bigint").select(F.col("t").cast("timestamp").alias("ts"), "item", "v")
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    upserts.daily_totals_stream(stream, "ts", "item", F.col("v"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    out = {(str(r.day), r.item): (r.event_count, r.total_c) for r in upserts.daily_totals(spark, str(tmp_path / "t"), "item").collect()}
    assert out == {("2026-08-01", "a"): (2, 6), ("2026-08-02", "a"): (1, 2), ("2026-08-02", "b"): (1, 7), ("2026-01-01", "b"): (1, 4)}


def test_failed_fetch_keeps_the_old_date(spark):
    live = spark.sql("SELECT * FROM VALUES ('a', 1, DATE '2026-08-02'), ('b', NULL, DATE '2026-08-02'), ('c', NULL, DATE '2026-08-02') AS t(k, value, as_of_date)")
    last = spark.sql("SELECT 'b' AS k, 9 AS value, DATE '2026-08-01' AS as_of_date")
    out = {r.k: (r.value, str(r.as_of_date), r.source_status) for r in upserts.with_stale_fallback(live, last, ["k"]).collect()}
    assert out == {"a": (1, "2026-08-02", "live"), "b": (9, "2026-08-01", "stale"), "c": (None, "None", "unavailable")}
