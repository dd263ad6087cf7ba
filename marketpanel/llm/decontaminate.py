"""Benchmark decontamination by greedy string tiling.

Documents and items that share a seed of MIN_MATCH words are tiled: the longest matches of words that
no tile holds yet are marked first, found by running Karp-Rabin hashes, so passages are caught in any
order. A document is contaminated if the tiles cover at least THRESHOLD of some item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import WordHashes, cuts, query, slices, table, text_bytes, window_hashes

MIN_MATCH = 5
THRESHOLD = 0.5
# Text of the benchmark that is broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20
SLICE = 1 << 20
# Words whose hashes a worker remembers.
REMEMBERED = 100_000
_BASE = 0x9E3779B97F4A7C15
_FIRST_LENGTH = 20


def _running(words: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Prefix hashes, from which that of any window follows."""
    prefix = [0]
    for w in words.tolist():
        prefix.append((prefix[-1] * _BASE + w) & 0xFFFFFFFFFFFFFFFF)
    return words, prefix


def _windows(prefix: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each window of `s` free words."""
    power, run = pow(_BASE, s, 1 << 64), 0
    for end, ok in enumerate(free, 1):
        run = run + 1 if ok else 0
        if run >= s:
            yield end - s, (prefix[end] - prefix[end - s] * power) & 0xFFFFFFFFFFFFFFFF


def tile(item: np.ndarray, text: np.ndarray, free_text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles of two word hash sequences. Of equally long
    matches the earliest in the item, then in the text, is marked."""
    p, p_prefix = item.tolist(), _running(item)[1]
    t, t_prefix = text.tolist(), _running(text)[1]
    free_p, free_t = [True] * len(p), free_text.tolist()
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(_FIRST_LENGTH, len(p), len(t)))
    while True:
        at: dict[int, list[int]] = {}
        for j, h in _windows(t_prefix, free_t, s):
            at.setdefault(h, []).append(j)
        found: dict[int, list[tuple[int, int]]] = {}
        longest = 0
        for i, h in _windows(p_prefix, free_p, s):
            for j in at.get(h, ()):
                if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                    continue  # part of the match that starts one word before
                k = 0
                while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k >= s:
                    found.setdefault(k, []).append((i, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        while found:
            k = max(found)
            for i, j in sorted(found.pop(k)):
                spans = [(free_p[i + x] and free_t[j + x]) for x in range(k)]
                if all(spans):
                    tiles.append((i, j, k))
                    free_p[i:i + k] = [False] * k
                    free_t[j:j + k] = [False] * k
                    continue
                start = 0  # what tiles have left of the match waits for its turn
                for x in range(k + 1):
                    if x == k or not spans[x]:
                        if x - start >= s:
                            found.setdefault(x - start, []).append((i + start, j + start))
                        start = x + 1
        if s == least:
            return tiles
        s = max(least, s // 2)


class Items:
    """The words of a block of items and where each seed is found."""

    def __init__(self, rows: list[tuple[str, bytes]], least: int):
        hashes = WordHashes()
        self.least = least
        self.names = [name for name, _ in rows]
        self.words = [hashes(text.lower().split()) for _, text in rows]
        seeds = [window_hashes(w, least) for w in self.words]
        flat = np.concatenate([*seeds, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.items = np.repeat(np.arange(len(rows)), [len(x) for x in seeds])[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.seeds & np.uint64(len(self.bits) - 1)] = True

    def coverage(self, words: np.ndarray, hits: np.ndarray, seeds: np.ndarray) -> list[tuple[str, float]]:
        """(item, covered share) of each item that shares a seed with a document, `hits` being the places
        of its windows that are seeds."""
        lo, hi = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        candidates = np.unique(np.concatenate([self.items[a:b] for a, b in zip(lo, hi)]))
        # No tile reaches beyond the windows that are seeds, so the other words are left out.
        inside = np.zeros(len(words) + 1, np.int32)
        np.add.at(inside, hits, 1)
        np.add.at(inside, hits + self.least, -1)
        held = np.cumsum(inside[:-1]) > 0
        places = np.flatnonzero(held)
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        text = np.insert(words[places], gaps, np.uint64(0))
        free = np.insert(np.ones(len(places), bool), gaps, False)
        out = []
        for k in candidates.tolist():
            item = self.words[k]
            covered = sum(length for _, _, length in tile(item, text, free, self.least))
            out.append((self.names[k], covered / len(item)))
        return out


def _found(items: Items, hashes: WordHashes, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[str, float]]]]:
    """Word counts of the texts of a slice, and {row: coverage of items}."""
    least = items.least
    words = [text.lower().split() for text in texts.to_pylist()]
    counts = np.array([len(w) for w in words])
    flat = hashes([w for ws in words for w in ws])
    out: dict[int, list[tuple[str, float]]] = {}
    windows = window_hashes(flat, least)
    hits = np.flatnonzero(items.bits[windows & np.uint64(len(items.bits) - 1)])
    if len(hits) and len(items.seeds):
        at = np.minimum(np.searchsorted(items.seeds, windows[hits]), len(items.seeds) - 1)
        hits = hits[items.seeds[at] == windows[hits]]
        stops = np.cumsum(counts)
        rows = np.searchsorted(stops, hits, "right")
        whole = hits + least <= stops[rows]  # not across two documents
        hits, rows = hits[whole], rows[whole]
        for row in np.unique(rows).tolist():
            own = hits[rows == row] if len(rows) < 64 else hits[np.searchsorted(rows, row):np.searchsorted(rows, row, "right")]
            start = int(stops[row] - counts[row])
            out[row] = items.coverage(flat[start:int(stops[row])], own - start, windows[own])
    return counts, out


def _blocks(benchmark: DataFrame, least: int) -> Iterator[Items]:
    """The benchmark in blocks of about BLOCK_BYTES, each small enough to be broadcast."""
    rows = benchmark.filter("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").cast("binary").alias("body")
    )
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).orderBy("item", "body").collect()
        yield Items([(r.item, bytes(r.body)) for r in part], least)


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, best_coverage, items, contaminated), one row a row of `docs` (doc_id, text);
    `items` lists the items of `benchmark` (item_id, text) covered to the threshold, by id.

    A null or empty text has no words and is clean; a document is found by its words alone, so a null
    doc_id and repeated rows are judged like others. Items that are null, or of fewer than `least` words,
    match nothing. Items are named by their id as text, null ones "null". A benchmark larger than a block
    is taken block by block, each adding to the findings of the rows.
    """
    spark = docs.sparkSession
    rows = text_bytes(docs).withColumns({
        "n_words": F.lit(0).cast("bigint"), "best_coverage": F.lit(0.0), "items": F.array().cast("array<string>"),
    })

    def job(items, names_=tuple(rows.columns)):
        def run(batches):
            hashes = WordHashes(REMEMBERED)
            for batch in slices(batches, "body", SLICE):
                counts, found = _found(items.value, hashes, batch.column("body"))
                best = batch.column("best_coverage").to_pylist()
                names = batch.column("items").to_pylist()
                for row, covered in found.items():
                    best[row] = max(best[row], *(c for _, c in covered))
                    names[row] = sorted([*names[row], *(n for n, c in covered if c >= threshold)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("body"), pa.array(counts, pa.int64()), pa.array(best, pa.float64()), pa.array(names, pa.list_(pa.string()))],
                    names=list(names_),
                )
        return run

    blocks = _blocks(benchmark, least)
    for items in chain([next(blocks, Items([], least))], blocks):
        rows = rows.mapInArrow(job(spark.sparkContext.broadcast(items)), rows.schema)
    return rows.drop("body").withColumn("contaminated", F.size("items") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that no item covers to the threshold, with their own columns. Null and empty texts
    stay. Only the text goes to Python, and only a flag comes back."""
    spark = docs.sparkSession

    def clean(items):
        @F.arrow_udf("boolean")
        def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            hashes = WordHashes(REMEMBERED)
            for texts in parts:
                keep = np.ones(len(texts), bool)
                for lo, hi in cuts(texts, SLICE):
                    for row, covered in _found(items.value, hashes, texts.slice(lo, hi - lo))[1].items():
                        keep[lo + row] = max(c for _, c in covered) < threshold
                yield pa.array(keep)

        return judge

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    for items in _blocks(benchmark, least):
        docs = docs.filter(clean(spark.sparkContext.broadcast(items))(body))
    return docs


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "best_coverage", "contaminated", F.array_join("items", ",").alias("items"))
