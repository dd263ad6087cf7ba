"""Compression of vectors to codes of their parts.

Components become integers, a vector is cut into PARTS parts, and a codebook a part is learned by rounds of
assignment and averaging, the ids deciding where it starts. The nearest entry is searched in the
Walsh-Hadamard domain: parts and entries are padded with zeros to a power of two and transformed by integer
butterflies, which scales squared distances by the padded length exactly. Coefficients are compared in
sequency order, slow ones first, as these tell most of smooth parts, and an entry leaves as soon as its sum
passes the whole distance of the best one so far. All of it is integer work, so codes, codebooks and errors
do not depend on partitions, order or machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, table
from marketpanel.operators.skew import attach
from marketpanel.sources.sinks import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Products of vectors, entries and components that one step of a task holds at most.
STEP = 1 << 20


@cache
def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes, each number once."""
    places = np.arange(size)
    changes = [np.count_nonzero(np.diff(np.bitwise_count(k & places) & 1)) for k in range(size)]
    return np.argsort(changes)


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer transform of the last axis, padded to a power of two, in sequency order."""
    width = x.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., :width] = x
    half = 1
    while half < size:
        pairs = out.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        low, high = pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]
        out = np.stack([low, high], axis=-2).reshape(out.shape)
        half *= 2
    return out[..., sequency_order(size)]


def exact(x: np.ndarray, largest: int) -> np.ndarray:
    """`x` as 64-bit integers if no sum of squares can leave them, else as Python's integers."""
    width = max(1, x.shape[-1])
    if 8 * width * width * (largest + 1) ** 2 < 1 << 63:  # padded length < 2 * width, differences <= 2 * largest
        return x
    return x.astype(object)


def magnitude(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of `entries` to each row of `parts`, the lowest of equals, and its squared distance."""
    n, k = len(parts), len(entries)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, parts.dtype)
    largest = max(magnitude(parts), magnitude(entries))
    x, c = walsh(exact(parts, largest)), walsh(exact(entries, largest))
    size = x.shape[1]
    at = min(2, size)
    first = ((x[:, None, :at] - c[None, :, :at]) ** 2).sum(axis=2)
    guess = first.argmin(axis=1)
    bound = ((x - c[guess]) ** 2).sum(axis=1)
    rows, cols = np.nonzero(first <= bound[:, None])
    sums = first[rows, cols]
    while at < size:
        to = min(size, 2 * at)
        sums = sums + ((x[rows, at:to] - c[cols, at:to]) ** 2).sum(axis=1)
        alive = sums <= bound[rows]
        rows, cols, sums = rows[alive], cols[alive], sums[alive]
        at = to
    # The guess itself is never eliminated, so every row has a survivor; rows and entries come in order.
    order = np.lexsort((cols, sums, rows)) if sums.dtype != object else sorted(range(len(rows)), key=lambda i: (rows[i], sums[i], cols[i]))
    order = np.asarray(order, np.int64)
    best = order[np.r_[True, np.diff(rows[order]) > 0]]
    return cols[best], sums[best] // size


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(slice, its vectors as vectors x PARTS x width)."""
    step = max(1, STEP // (ENTRIES * max(1, width)))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            piece = batch.slice(lo, step)
            flat = piece.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            held = flat.reshape(piece.num_rows, -1)
            padded = np.zeros((piece.num_rows, PARTS * width), np.int64)
            padded[:, :held.shape[1]] = held
            yield piece, padded.reshape(piece.num_rows, PARTS, width)


def _sums(books: list[np.ndarray], width: int):
    """A task that adds up the parts of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        totals = np.zeros((PARTS, ENTRIES, width), object)
        for _, vectors in _matrices(batches, width):
            for p, book in enumerate(books):
                index, _ = nearest(vectors[:, p], book)
                for e in np.unique(index).tolist():
                    own = vectors[index == e, p]
                    largest = magnitude(own)
                    counts[p, e] += len(own)
                    totals[p, e] += (own if len(own) * largest < 1 << 62 else own.astype(object)).sum(axis=0).astype(object)
        rows = [(p, e, int(counts[p, e]), [Decimal(int(v)) for v in totals[p, e]]) for p, e in np.argwhere(counts).tolist()]
        parts, entries, ns, sums = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(ns, pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _codes(books: list[np.ndarray], width: int):
    """A task that assigns the parts for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, vectors in _matrices(batches, width):
            found = [nearest(vectors[:, p], book) for p, book in enumerate(books)]
            codes = ["".join(f"{k:02x}" for k in ks) for ks in zip(*[index.tolist() for index, _ in found])]
            errors = [sum(ds) for ds in zip(*[distance.tolist() for _, distance in found])]
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array(codes, pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec) of the rows whose vector holds finite numbers only: floor(SCALE * x), as longs."""
    v = F.col("embedding").cast("array<double>")
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("string")
    return rows.filter(finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.transform(v, lambda x: F.floor(x * SCALE).cast("bigint")).alias("vec")
    )


def learn(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks, one a part, of integer vectors of one length, and the length of a part.

    They start as the parts of the vectors of the smallest ids (nulls last; of equal ids the least vector first).
    A round passes over all vectors; a task sends one row of sums an entry, and only the codebooks themselves
    (PARTS x ENTRIES entries, whatever the number of vectors) come to the driver. No entries: no vectors.
    """
    starts = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    width = -(-len(starts[0].vec) // PARTS) if starts else 0
    cut = np.zeros((len(starts), PARTS * width), np.int64)
    for k, row in enumerate(starts):
        cut[k, :len(row.vec)] = row.vec
    books = list(np.moveaxis(cut.reshape(len(starts), PARTS, width), 1, 0))
    for _ in range(rounds if starts else 0):
        sums = vectors.mapInArrow(_sums(books, width), "part int, entry int, n bigint, sums array<decimal(38,0)>")
        places = sums.select("part", "entry", "n", F.posexplode_outer("sums").alias("i", "x"))
        means = places.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        books = [book.copy() for book in books]
        for m in means:
            if m.i is not None:
                books[m.part][m.entry, m.i] = int(m.x) // m.n
    return books, width


def codebook_digest(books: list[np.ndarray], length: int) -> str:
    """SHA-256 of all components by part, entry and position, those that pad a vector of `length` left out."""
    width = books[0].shape[1] if books else 0
    values = [str(v) for p, book in enumerate(books) for entry in book for v in entry[:max(0, length - p * width)].tolist()]
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def compress(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], int]:
    """Codes (vec_id, label, code, error) of the vectors of `rows` (vec_id, embedding, label), the codebooks and
    the length of a vector.

    Rows whose vector is null or holds a null or non-finite component have no code and no row. Vectors have one
    length, that of the smallest id; rows of another are left out too. A length that PARTS does not divide is
    padded with zeros. Components beyond a long saturate; an error beyond a long is null. Repeated rows count
    each; null ids and labels do no harm; an empty table gives no codes. Other columns are not read.
    """
    whole = materialize(integer_vectors(rows), "vector-integers")
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(1).select(F.size("vec").alias("n")).collect()
    length = first[0].n if first else 0
    vectors = whole.filter(F.size("vec") == length)
    books, width = learn(vectors, rounds)
    return vectors.mapInArrow(_codes(books, width), "vec_id bigint, label string, code string, error bigint"), books, length


def label_errors(codes: DataFrame) -> DataFrame:
    """`codes` plus label_error, the errors of its label added up; null labels are one. A sum beyond a long is null."""
    keyed = codes.withColumn("key", F.concat(F.when(F.col("label").isNull(), "-").otherwise("+"), F.coalesce("label", F.lit(""))))
    sums = keyed.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    return attach(keyed, sums, ["key"]).drop("key")


def _oracle() -> str:
    rounds = ""
    for t in range(ROUNDS + 1):
        rounds += f""", d{t} AS MATERIALIZED (
  SELECT r, p, k, dist FROM (SELECT q.r, q.p, c.k, sum((q.x - c.x) * (q.x - c.x)) AS dist FROM q JOIN c{t} c USING (p, i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dist, k) = 1)"""
        if t < ROUNDS:
            rounds += f""", m{t} AS (SELECT p, k, i, sum(x) AS s, count(*) AS n FROM q JOIN d{t} USING (r, p) GROUP BY ALL),
c{t + 1} AS MATERIALIZED (SELECT p, k, i, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{t} LEFT JOIN m{t} USING (p, k, i))"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT r, j // (len(e) // {PARTS}) AS p, j % (len(e) // {PARTS}) AS i, CAST(floor(e[j + 1]::DOUBLE * {SCALE}) AS BIGINT) AS x
  FROM v, unnest(range(len(e))) AS u(j)
), seed AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT p, k, i, x FROM q JOIN seed USING (r)){rounds},
coded AS (
  SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""


@query("op12_vector_codes", _oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books, length = compress(table(spark, sf_dir, "embeddings"))
    held = label_errors(materialize(codes, "vector-codes"))
    return held.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books, length)).alias("codebooks_sha256"))
