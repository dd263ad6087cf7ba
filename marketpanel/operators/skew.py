"""Plan shapes which survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(facts: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table back to the rows it came from.

    A plain join would reuse the aggregate's partitioning, and adaptive execution cannot split a
    hot partition which feeds an aggregate. The extra derived key makes both sides shuffle right
    below the join, so a hot key is split over many tasks; a small `per_key` side still turns into
    a broadcast at run time, on its measured size.
    """
    tag = F.xxhash64(*keys)
    left = facts.withColumn("_spread", tag)
    right = per_key.withColumn("_spread", tag)
    return left.join(right, [*keys, "_spread"], how).drop("_spread")


def sequence_runs(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    chunk: Column,
) -> DataFrame:
    """Number the runs of equal consecutive `value` per key, in `order`.

    Adds `is_start` (first row of a run) and `run_no` (1-based). `chunk` must grow with `order` and
    bound the rows of one chunk (for example a batch number divided by a constant): windows work
    inside (key, chunk), one summary row per chunk carries the result across chunks, so no task
    ever holds all rows of a hot key.
    """
    chunked = rows.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    marked = chunked.withColumn("_prev", F.lag(F.struct(value)).over(inside)).withColumn(
        "_inner_start",
        F.col("_prev").isNotNull() & ~F.col(f"_prev.{value}").eqNullSafe(F.col(value)),
    ).withColumn("_head", F.col("_prev").isNull())

    position = F.struct(*order)
    chunks = marked.groupBy(*keys, "_chunk").agg(
        F.count_if("_inner_start").alias("_inner"),
        F.min_by(F.struct(value), position).alias("_first"),
        F.max_by(F.struct(value), position).alias("_last"),
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        chunks.withColumn("_carry", F.lag("_last").over(across))
        .withColumn(
            "_head_start",
            F.col("_carry").isNull() | ~F.col(f"_carry.{value}").eqNullSafe(F.col(f"_first.{value}")),
        )
        .withColumn("_starts", F.col("_inner") + F.col("_head_start").cast("long"))
        .withColumn("_base", F.coalesce(F.sum("_starts").over(before), F.lit(0)))
        .select(*keys, "_chunk", "_head_start", "_base")
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.join(chunks, [*keys, "_chunk"]).withColumn(
        "is_start", F.when(F.col("_head"), F.col("_head_start")).otherwise(F.col("_inner_start"))
    )
    return numbered.withColumn(
        "run_no", F.col("_base") + F.sum(F.col("is_start").cast("long")).over(upto)
    ).drop("_chunk", "_prev", "_inner_start", "_head", "_head_start", "_base")


def content_digest(
    rows: DataFrame, keys: Sequence[str], hash_hex: Column, others: Sequence[Column] = ()
) -> DataFrame:
    """Order-free digest of the row hashes of a group.

    Four 60-bit lanes of every row hash are summed, so the state is constant per group, the partial
    sums combine before the shuffle, and a group may hold any number of rows. Equal sets give equal
    digests in any order; duplicates count. `others` are further aggregates of the same pass.
    """
    lanes = [
        F.sum(F.conv(F.substring(hash_hex, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        .cast("decimal(38,0)").cast("string").alias(f"_lane{i}")
        for i in range(4)
    ]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"), *lanes, *others)
    names = [f"_lane{i}" for i in range(4)]
    text = F.concat_ws("|", F.col("record_count").cast("string"), *names)
    return sums.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(text, 256))).drop(*names)
