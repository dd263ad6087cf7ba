"""Micro-batch forms of the batch jobs.

Nothing is dropped for being late: no job here has a watermark. A batch names the partitions that it
touches, so stored history is pruned to them. Each sink can be replayed: either a batch writes a folder
of its own, or its result is finished in a stage before the table changes, and a replay publishes that
stage without reading the table again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.operators.resolve import upsert
from marketpanel.sources.sinks import (
    files, folders, is_complete, only_touched, overwrite_partitions, read_or_none, remove_folder,
)


def merge_partitions(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    stage: str,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    partition: str,
    chunk: Column,
) -> None:
    """Upsert `incoming` into the touched partitions of a date-partitioned table.

    `stage` names the batch. The merged partitions are finished there before the table changes; if the
    stage is complete (the batch ran before and broke off while publishing, when stored partitions may be
    gone), it is published as it is.
    """
    if not is_complete(spark, stage):
        stored = read_or_none(spark, path)
        if stored is not None:
            stored = only_touched(stored, incoming, partition).select(*incoming.columns)
            incoming = stored.unionByName(incoming)
        upsert(incoming, chunk, keys, order, value).write.mode("overwrite").parquet(stage)
    overwrite_partitions(spark.read.parquet(stage), path, partition)


def upsert_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    partition: str,
    chunk: Callable[[], Column],
):
    """Start the correction-safe upsert of a stream; processes what is there and stops.

    A row counts as later than all rows of the batches before, whatever its own order, as in the batch job
    over rows ordered by (ingest, order); `ingest` is stored beside the row. So it need not be known where
    the run of a stored row ended. Batches of another stream into the same table (or of this one after its
    checkpoint was lost) count as later than all that is stored: a batch's number follows the highest one stored
    when its stream began. A stage is named by the stream's own id, so none is taken for another's; that of a
    committed batch is removed by the next batch or the next start.
    """
    spark, stage = stream.sparkSession, f"{path}-stage"
    _drop_committed(spark, stage, checkpoint)

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{stage}/{stream_id(spark, checkpoint)}"
        stamped = batch.withColumn("ingest", F.lit(_first_ingest(spark, own, path) + batch_id).cast("bigint"))
        merge_partitions(
            spark, stamped, path, f"{own}/{batch_id}", keys, ["ingest", *order], value, partition, F.struct("ingest", chunk())
        )
        remove_folder(spark, f"{own}/{batch_id - 1}")  # its batch is committed

    return started(stream, apply, checkpoint)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream has from its checkpoint on, so another after the checkpoint is made anew."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def _first_ingest(spark: SparkSession, own: str, path: str) -> int:
    """What is added to a stream's batch numbers, decided and written down before its first batch changes the table."""
    note = f"{own}/first"
    if not is_complete(spark, note):
        stored = read_or_none(spark, path)
        last = None if stored is None else stored.agg(F.max("ingest")).first()[0]
        spark.range(1).select(F.lit(0 if last is None else last + 1).cast("bigint").alias("first")).write.mode("overwrite").parquet(note)
    return spark.read.parquet(note).first()[0]


def _drop_committed(spark: SparkSession, stage: str, checkpoint: str) -> None:
    """Remove the stages of a stream's batches that its checkpoint knows as committed."""
    done = set(files(spark, f"{checkpoint}/commits"))
    if done:
        own = f"{stage}/{stream_id(spark, checkpoint)}"
        for folder in folders(spark, own):
            if folder.rsplit("/", 1)[-1] in done:
                remove_folder(spark, folder)


def started(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _own_folder(rows: DataFrame, path: str, batch_id: int, partition: str) -> None:
    """Rows of a batch in a folder of its own; a replay writes the same folder again."""
    rows.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/batch_id={batch_id}")


def daily_totals_stream(stream: DataFrame, ts: str, item: str, amount: Column, path: str, checkpoint: str):
    """Daily totals per item as partial sums a batch; `daily_totals` adds them up. A late row adds to its
    own day in its own batch, so no state is held and nothing is too late. Days are UTC days."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(day.alias("day"), item).agg(F.count(F.lit(1)).alias("event_count"), F.sum(amount).alias("total_c"))
        _own_folder(sums, path, batch_id, "day")

    return started(stream, apply, checkpoint)


def daily_totals(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(day, item, event_count, total_c) over all batches; a filter on `day` prunes."""
    return spark.read.parquet(path).groupBy("day", item).agg(
        F.sum("event_count").alias("event_count"), F.sum("total_c").alias("total_c")
    )


def unique_stream(stream: DataFrame, ts: str, key: str, path: str, checkpoint: str):
    """Exact duplicates dropped, however late one arrives: a batch's rows are compared with the stored rows
    of the days that it touches. Copies of a row have one time, and so one day."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("day", day).dropDuplicates([key])
        stored = read_or_none(spark, path)
        if stored is not None:
            before = stored.filter(F.col("batch_id") < batch_id)
            known = only_touched(before, fresh, "day").select(key)
            fresh = fresh.join(known, key, "left_anti")
        _own_folder(fresh, path, batch_id, "day")

    return started(stream, apply, checkpoint)


def with_stale_fallback(live: DataFrame, last_good: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stream-static join: a key whose fetch failed keeps its last good value, labelled stale and
    under its own date."""
    old = last_good.select(*keys, F.col("value").alias("_old"), F.col("as_of_date").alias("_old_date"))
    joined = live.join(old, list(keys), "left")
    failed = F.col("value").isNull()
    return joined.select(
        *keys,
        F.coalesce("value", "_old").alias("value"),
        F.when(failed, F.col("_old_date")).otherwise(F.col("as_of_date")).alias("as_of_date"),
        F.when(~failed, "live").when(F.col("_old").isNotNull(), "stale").otherwise("unavailable").alias("source_status"),
    )
