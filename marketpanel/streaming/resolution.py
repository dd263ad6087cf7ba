"""Source resolution over what has arrived so far.

The stored tables are versioned (`sources.versions`): a batch reads the partitions that it touches, and its result
counts once its commit is complete. A batch is known by its stream's id and its number, so a replay does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpanel.operators import resolve
from marketpanel.sources import versions
from marketpanel.sources.sinks import materialize, overwrite_folder
from marketpanel.streaming.upserts import started, stream_id

PARTITION = "transaction_date"


def merge_resolution(batch: DataFrame, path: str, name: str) -> None:
    """Add the observations of a batch to the stored state: the two latest contents of each source an identity.

    State is bounded by the number of sources, however often an identity arrives, and rows may come in any order.
    """
    spark = batch.sparkSession
    if versions.committed(spark, path, name):
        return
    seen = versions.last_commit(spark, path)
    fresh = materialize(resolve.latest_contents(resolve.contents(batch)), "resolution-batch")
    stored = versions.current(spark, path, PARTITION, fresh.schema, touched=fresh)
    merged = fresh if stored is None else resolve.merged_contents(stored, fresh)
    versions.commit(merged, path, name, PARTITION, fresh, seen)


def resolve_stream(stream: DataFrame, path: str, checkpoint: str):
    """Start the resolution of a stream of observations; processes what is there and stops."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_resolution(batch, path, f"{stream_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return started(stream, apply, checkpoint)


def resolution(spark: SparkSession, path: str) -> DataFrame | None:
    """What `resolve` gives over all batches so far, or None before the first."""
    kept = versions.current(spark, path, PARTITION)
    return None if kept is None else resolve.resolved(kept)


def publish_observations(batch: DataFrame, path: str, name: str, strict: bool = False) -> DataFrame:
    """Publish the winning observations of a batch in the stored table, one row an identity; returns those refused.

    The batch is resolved first, so what is ambiguous in itself publishes nothing. A winner of a lower precedence than
    the stored row's, or of an equal one from another source, is refused before any partition changes; `strict` then
    refuses the batch as a whole. A row of equal hash is no correction and leaves the stored one. The refused rows
    (those of the incoming row plus stored_source and rule) are kept under the batch's name beside the table.
    """
    spark, refused = batch.sparkSession, f"{path}/refused/{versions.VERSION}={name}"
    won = resolve.winning_rows(batch)
    schema = T.StructType([*won.schema.fields, T.StructField("stored_source", T.StringType()), T.StructField("rule", T.StringType())])
    if versions.committed(spark, path, name):
        return spark.read.schema(schema).parquet(refused)
    seen = versions.last_commit(spark, path)
    won = materialize(won, "published-winners")
    stored = versions.current(spark, path, PARTITION, won.schema, touched=won)
    stored = won.limit(0) if stored is None else stored.select(*won.columns)
    merged = materialize(resolve.guarded_merge(stored, won), "published-merge")
    broken = merged.filter(F.col("rule").isNotNull()).select("incoming.*", F.col("stored.source_id").alias("stored_source"), "rule")
    if strict and not broken.isEmpty():
        raise PrecedenceRefused(f"{name}: " + ", ".join(f"{r['rule']}: {r['count']}" for r in broken.groupBy("rule").count().orderBy("rule").collect()))
    overwrite_folder(broken, refused, PARTITION)
    versions.commit(merged.select("kept.*"), path, name, PARTITION, won, seen)
    return spark.read.schema(schema).parquet(refused)


class PrecedenceRefused(ValueError):
    """A batch has rows that may not replace what is stored."""


def published(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.current(spark, path, PARTITION)
