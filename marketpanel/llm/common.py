"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(job: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = job
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, body, extra...): the text as UTF-8 bytes, null as empty."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body"), *extra)


def cuts(values: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, end) of slices of strings or binaries that hold about `limit` bytes each, one value at least."""
    sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(values)]
    yield from ((lo, hi) for lo, hi in zip(starts, starts[1:]) if hi > lo)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        for lo, hi in cuts(batch.column(column), limit):
            yield batch.slice(lo, hi - lo)


_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX[1])
    x ^= x >> np.uint64(31)
    return x


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each window of `width` word hashes, by one polynomial; empty if there is none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
    return mix64(total)


class WordHashes:
    """64-bit hashes of words, remembered while the memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
