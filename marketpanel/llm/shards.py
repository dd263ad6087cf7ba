"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketpanel.llm.common import query, table
from marketpanel.sources.sinks import materialize

SHARDS = 40
# Rows that one task permutes at a time, before and after the exchange.
ROWS_PER_PART = 250_000
# Bound of the matrix: at most so many partitions, whose counts the driver sees.
MOST_PARTS = 4_096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` from good + bad without return, by inversion outwards from
    the mode, in as many steps as the distribution is wide."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    while True:
        u = rng.random() - top
        if u <= 0:
            return mode
        left = right = mode
        p_left = p_right = top
        while left > lo or right < hi:
            if right < hi:
                p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
                right += 1
                u -= p_right
                if u <= 0:
                    return right
            if left > lo:
                p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
                left -= 1
                u -= p_left
                if u <= 0:
                    return left
            if max(p_left if left > lo else 0.0, p_right if right < hi else 0.0) < 1e-300:
                break  # rounding left a rest; draw again


def communication_matrix(counts: list[int], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """Rows of partition i that go to shard j, as a uniform permutation would deal them: row sums are
    `counts`, column sums are `sizes`."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes differ")
    room, out = list(sizes), []
    for n in counts:
        rest, row = sum(room), []
        for j, size in enumerate(room):
            rest -= size
            k = hypergeometric(rng, size, rest, n)
            row.append(k)
            room[j] -= k
            n -= k
        out.append(row)
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """All columns and rows of `docs` plus `shard` and `slot` (both bigint).

    Each row gets a number of its own, so nulls, ties and repeated rows are rows like others and no
    key can be hot. Shard sizes differ by at most one, slots run from 0 without gaps, and an empty
    table gives an empty result. Columns of `docs` named shard or slot are replaced.
    Rows are written once to the shared folder: their numbers must be the same in the counting and
    the dealing pass, also after the loss of an executor.
    """
    spark = docs.sparkSession
    held = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = materialize(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.monotonically_increasing_id().alias("uid")),
        "shard-rows",
    )
    total = rows.count()
    parts = max(64, min(MOST_PARTS, -(-total // rows_per_part)))
    random_key = lambda k: F.xxhash64(F.col("uid"), F.lit(seed * 10 + k))
    keyed = rows.withColumn("part", F.pmod(random_key(0), F.lit(parts)).cast("int"))
    found = dict(keyed.groupBy("part").count().collect())  # at most MOST_PARTS rows
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([found.get(p, 0) for p in range(parts)], sizes, random.Random(seed))
    ends = []
    for p, row in enumerate(matrix):
        at = 0
        ends.append({"part": p, "ends": [at := at + k for k in row]})
    deals = spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:int,ends:array<bigint>>>")).alias("d")
    ).select("d.*")

    permuted = keyed.withColumn(
        "place", F.row_number().over(Window.partitionBy("part").orderBy(random_key(1), "uid")) - 1
    )
    dealt = permuted.join(deals, "part").select(
        "row", "uid", F.expr("size(filter(ends, e -> e <= place))").cast("bigint").alias("shard")
    )
    subs = max(1, -(-total // (shards * rows_per_part)))
    dealt = dealt.withColumn("sub", F.pmod(random_key(2), F.lit(subs)).cast("int"))
    placed = dealt.withColumn(
        "slot", F.row_number().over(Window.partitionBy("shard", "sub").orderBy(random_key(3), "uid")) - 1
    )
    if subs > 1:
        before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        starts = dealt.groupBy("shard", "sub").count().select(
            "shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
        )
        placed = placed.join(starts, ["shard", "sub"]).withColumn("slot", F.col("slot") + F.col("start"))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in held], "shard", F.col("slot").cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """The shuffled rows as Parquet, one folder a shard, in the order of the slots within each file."""
    placed = shuffle_into_shards(docs, shards, seed)
    placed.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


@query("op2_shards")
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
