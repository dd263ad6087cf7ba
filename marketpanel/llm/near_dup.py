"""Near duplicates by b-bit MinHash.

A document is the set of its distinct five-word shingles. Copies of a set collapse to one class first.
Bands of full minima give candidates; signatures keep the low bits of the minima, and the share of
equal ones, corrected for chance collisions, estimates the similarity. Inside a bucket not all pairs are
emitted but a maximal spanning forest of those that the estimate admits, which joins the same classes.
The loose groups so found are compared on their full sets, in blocks, and again only a spanning forest
of the confirmed links leaves a block. So no link that joins two components is lost but by the bands
(at most 1e-7 at the threshold, as their number follows from it) or the margin of the estimate (5 deviations).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import WordHashes, mix64, query, slices, table, text_bytes, window_hashes
from marketpanel.llm.components import components
from marketpanel.sources.sinks import materialize

WIDTH = 5
ROWS = 5
BITS = 4
# Shared and united shingles: linked if LINK[1] * shared >= LINK[0] * united.
LINK = (85, 100)
MISSED = 1e-7  # share of the pairs at the threshold that no band may bring together


def bands_for(link: tuple[int, int]) -> int:
    """The fewest bands that miss a pair at the threshold with a probability of at most MISSED."""
    together = (link[0] / link[1]) ** ROWS
    return 1 if together >= 1 else math.ceil(math.log(MISSED) / math.log1p(-together))


LANES = bands_for(LINK) * ROWS
MARGIN = 0.17
# Members, and their shingles, of a chunk; a group compares two chunks.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
SLICE = 4 << 20


def _permutations(lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, 2 * lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = mix64(base)
    return mixed[:lanes] | np.uint64(1), mixed[lanes:]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes; a short one is one shingle."""
    if 0 < len(words) < WIDTH:
        return window_hashes(words, len(words)) ^ np.uint64(len(words))
    return np.unique(window_hashes(words, WIDTH))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over the set."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        values = np.multiply.outer(a, shingles[at:at + 512])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def pack_bits(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum in 64-bit words; spare lanes are zero."""
    words = -(-len(least) * BITS // 64)
    lanes = np.zeros(words * 64 // BITS, np.uint64)
    lanes[:len(least)] = mix64(least) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(lanes.reshape(words, -1) << shifts, axis=1)


def estimate(one: np.ndarray, many: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Similarity of a packed signature to each of `many`: equal lanes by bit counts, less the 2^-BITS of
    unequal minima whose low bits agree by chance."""
    x = many ^ one
    x = x | (x >> np.uint64(2))
    x = (x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)
    equal = 1 - np.bitwise_count(x).sum(axis=1) / lanes
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def _each_set(batches: Iterator[pa.RecordBatch]):
    """(slice, row, shingle set) of each document."""
    hashes = WordHashes()
    for batch in slices(batches, "body", SLICE):
        words = [body.lower().split() for body in batch.column("body").to_pylist()]
        flat = hashes([w for ws in words for w in ws])
        at = 0
        for row, ws in enumerate(words):
            yield batch, row, shingle_set(flat[at:at + len(ws)])
            at += len(ws)


def _sketch(bands: int):
    """A task that makes the sizes, digests, band keys and signatures of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = _permutations(bands * ROWS)
        spread = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        rows: list[tuple] = []
        for batch, row, found in _each_set(batches):
            doc_id = batch.column("doc_id")[row].as_py()
            if not len(found):
                rows.append((doc_id, 0, None, None, None))
            else:
                least = minima(found, a, b)
                keys = window_hashes(least, ROWS)[::ROWS] ^ spread
                digest = xxhash.xxh3_128_digest(found.tobytes())
                rows.append((doc_id, len(found), digest, keys.astype(np.int64).tolist(), pack_bits(least).tobytes()))
            if len(rows) >= 2000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    return run


_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary()),
])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _SKETCH]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SKETCH)], schema=_SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch, row, found in _each_set(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(row, 1), pa.array([xxhash.xxh3_128_digest(found.tobytes())], pa.binary()),
             pa.array([found.astype(np.int64)], pa.list_(pa.int64()))],
            names=["id", "digest", "shingles"],
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each run of equal (key, i, j) in sorted rows that has two rows or more."""
    held: list[pa.RecordBatch] = []

    def starts(rows: pa.Table) -> np.ndarray:
        key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
        return np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1

    def cut(rows: pa.Table, stops: list[int]):
        for lo, hi in zip(stops, stops[1:]):
            if hi - lo > 1:
                yield rows.slice(lo, hi - lo)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = starts(rows).tolist()
        yield from cut(rows, [0, *at])
        held = rows.slice(at[-1] if at else 0).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from cut(rows, [0, *starts(rows).tolist(), rows.num_rows])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_batches(each):
    """A task that sends on the pairs that `each` finds in its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches):
            found += each(group)
            if len(found) > 20_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _forest(least: float, lanes: int):
    """Pairs of a maximal spanning forest of the estimates in a group, grown from its first member."""

    def each(group: pa.Table) -> list[tuple[int, int]]:
        ids = group.column("id").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
        found, m = [], len(ids)
        best, near = estimate(sig[0], sig, lanes), np.zeros(m, np.int64)
        best[0] = -2.0
        out = np.arange(m) > 0
        for _ in range(m - 1):
            x = int(np.argmax(best))
            if best[x] >= least:
                found.append((int(ids[x]), int(ids[near[x]])))
            out[x] = False
            if m > 2:
                new = estimate(sig[x], sig, lanes)
                better = out & (new > best)
                best[better], near[better] = new[better], x
            best[x] = -2.0
        return found

    return each


def _confirmed(link: tuple[int, int]):
    """Pairs of a spanning forest of the links in a group, judged on the full sets."""

    def each(group: pa.Table) -> list[tuple[int, int]]:
        ids, lists = group.column("id").to_numpy(), group.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy()
        sizes, values = np.diff(offsets), lists.values.to_numpy()[offsets[0]:offsets[-1]]
        if len(ids) == 2:
            shared = sizes.sum() - len(np.unique(values))
            return [(int(ids[0]), int(ids[1]))] if link[1] * shared >= link[0] * (sizes.sum() - shared) else []
        starts = offsets[:-1] - offsets[0]
        names, places = np.unique(values, return_inverse=True)
        mark, root, found = np.zeros(len(names), np.int64), np.arange(len(ids)), []
        for x in range(len(ids) - 1):
            if (root == root[x]).all():
                break
            own = places[starts[x]:starts[x] + sizes[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[places], starts)
            mark[own] = 0
            linked = np.flatnonzero((link[1] * shared >= link[0] * (sizes[x] + sizes - shared)) & (root != root[x]))
            for y in linked.tolist():
                if root[y] != root[x]:
                    found.append((int(ids[x]), int(ids[y])))
                    root[root == root[y]] = root[x]
        return found

    return each


def _in_groups(members: DataFrame, chunks, each) -> DataFrame:
    """Pairs that `each` finds among the members of a key. A key of many is cut into `chunks`, and each two
    chunks meet in a group of their own, so no group grows with the number of members."""
    rows = members.withColumn("_n", F.greatest(F.lit(1), chunks.cast("int"))).withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_n")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).filter((F.col("_c") != F.col("_o")) | (F.col("_n") == 1))
    rows = rows.withColumns({"i": F.least("_c", "_o").cast("int"), "j": F.greatest("_c", "_o").cast("int")}).drop("m", "n", "_n", "_c", "_o")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(_in_batches(each), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def near_duplicates(docs: DataFrame, link: tuple[int, int] = LINK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a row of `docs` (doc_id, text).

    A null or empty text, or one of blanks, has an empty set and is linked with nothing. Rows that
    repeat a doc_id are one document in the result: linked if any of them is, kept or dropped together.
    A row with a null doc_id stands alone, has a null component and is kept. Other columns are not read.
    """
    least, bands = link[0] / link[1] - MARGIN, bands_for(link)
    sketches = materialize(
        text_bytes(docs).mapInArrow(_sketch(bands), "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, sig binary"),
        "near-sketches",
    )
    named = sketches.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = materialize(
        named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("sig").alias("sig")),
        "near-classes",
    )
    banded = classes.select("id", "digest", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = materialize(banded.join(shared, "key"), "near-buckets")
    members = placed.join(classes.select("digest", "sig"), "digest").select("key", "m", "id", "sig")
    near = materialize(_in_groups(members, F.ceil(F.col("m") / CHUNK), _forest(least, bands * ROWS)), "near-pairs")
    loose = materialize(components(near), "near-loose")
    # The sets of these classes are made again from the texts, as most documents never need theirs. Both
    # joins are told to shuffle, so that the plan is the same for any size.
    wanted = classes.join(loose, "id", "left_semi").select("id", "digest")
    texts = text_bytes(docs).join(wanted.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "id bigint, digest binary, shingles array<bigint>").join(wanted.hint("merge"), ["id", "digest"], "left_semi")
    sets = materialize(sets.dropDuplicates(["id", "digest"]).select("id", "shingles"), "near-sets")
    sized = sets.select("id", F.size("shingles").alias("n")).join(loose, "id").groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    grouped = sets.join(loose.join(sized, "label"), "id").withColumnRenamed("label", "key")
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("n") / CHUNK_SHINGLES))
    links = materialize(_in_groups(grouped, chunks, _confirmed(link)), "near-links")
    labels = materialize(components(links), "near-labels")
    classes_ = classes.select("digest", "id", "copies")
    moved = materialize(
        classes_.join(labels, "id", "left").withColumn("component", F.coalesce("label", "id")).filter("copies > 1 OR component <> id").select("digest", "component"),
        "near-moved",
    )
    out = sketches.select("doc_id", "n_shingles", "digest").join(moved, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, link: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `docs` without those linked to an earlier document: of each group the smallest doc_id
    stays. Columns are as given; rows that repeat a doc_id stay or go together."""
    gone = materialize(near_duplicates(docs, link).filter(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op6_near_dup")
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
