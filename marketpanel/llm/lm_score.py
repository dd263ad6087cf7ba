"""Language-model scores by online logistic context mixing.

A text's stream of bytes is scored as a whole: its words, a blank after each and an end mark. What predicts a symbol
is the four symbols before it and the word so far. So the symbols of a word beyond its third depend on the
word alone, and its first three, its edge, on the three symbols before its blank, too. A block of documents becomes
counts of words and of edges, with the places where they are. Words are counted over the whole corpus and sorted into
parts; a part has exact counts of all beginnings of its words, with sums over all parts of those that cross its
borders. The orders' tables come from the counts of all sequences of five symbols and grow with these. Mixing weights
are learned online on how the counts of one half of the training documents predict the other half; the final counts
are of both. Scores of words go back to the blocks by a join on the word; edges are scored where they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, slices, table, text_bytes
from marketpanel.llm.mixing import END, HEAD, Mixer, Positions, Tables, edge_codes, edge_positions, merged, order_tables, word_codes, word_positions
from marketpanel.sources.sinks import materialize

FOLDS, HELD_FOLD = 7, 2
BLOCK_BYTES, BLOCK_DOCS = 32 << 20, 1 << 16  # places of documents are 16-bit numbers
SLICE = 4 << 20
BATCH = 20_000  # rows that are counted or scored at once
PART_WORDS = 50_000  # different words of a part, about
STEP = 16_000  # symbols of a learning step
MIXERS = 16  # tasks that average what others have learned


def in_fold(doc_id: Column) -> Column:
    """Whether the rows are held out, by the id alone; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def _stream(bodies: list[list[bytes]]) -> np.ndarray:
    """Edges of the words of texts, whose last word is the end mark."""
    sizes = np.fromiter((len(w) for words in bodies for w in words), np.int64)
    stream = np.frombuffer(b"".join(b"\0\0\0 " + b" ".join(words) for words in bodies), np.uint8)
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(sizes + 1) - (sizes + 1) + 4 + 3 * np.repeat(np.arange(len(bodies)), lengths)
    counts = np.minimum(sizes + 1, HEAD)
    counts[np.cumsum(lengths) - 1] = 1
    return edge_codes(stream, starts, counts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, edge, a, b, postings): training occurrences of a word or an edge by half and the places of the
    documents that have it, once for each occurrence; and one row without either that lists the documents."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    codes: dict[bytes, int] = {}
    docs: list[tuple] = []  # doc_id, half, scored bytes
    found: list[np.ndarray] = []
    edges: list[np.ndarray] = []
    size = 0

    def rows(block: int, kind: str, keys, counts: list[np.ndarray], ends: np.ndarray, raw: bytes) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 20_000):
            stop = min(len(keys), at + 20_000)
            cuts = np.r_[ends[at - 1] if at else 0, ends[at:stop]] * 2
            postings = pa.Array.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer((cuts - cuts[0]).astype(np.int32).tobytes()), pa.py_buffer(raw[cuts[0]:cuts[-1]])])
            own = {"key": pa.nulls(stop - at, pa.binary()), "edge": pa.nulls(stop - at, pa.int64())}
            own[kind] = pa.array(keys[at:stop], own[kind].type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(stop - at, block), pa.int64()), own["key"], own["edge"], pa.array(counts[0][at:stop], pa.int64()), pa.array(counts[1][at:stop], pa.int64()), postings],
                names=["block", "key", "edge", "a", "b", "postings"],
            )

    def out() -> Iterator[pa.RecordBatch]:
        block = (part << 32) | number
        lengths = np.array([len(f) for f in found], np.int64)
        owner = np.repeat(np.arange(len(docs), dtype=np.uint16), lengths)
        halves = np.array([d[1] for d in docs], np.int8)
        flat = np.concatenate(found)
        found.clear()
        half = halves[owner]
        counts = [np.bincount(flat[half == h], minlength=len(codes)) for h in (1, 2)]
        ends = np.cumsum(np.bincount(flat, minlength=len(codes)))
        raw = owner[np.argsort(flat, kind="stable")].tobytes()
        del flat, half
        yield from rows(block, "key", list(codes), counts, ends, raw)
        codes.clear()
        flat = np.concatenate(edges)
        edges.clear()
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        del order
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        keys, half = flat[starts].astype(np.int64), halves[owner]
        del flat
        counts = [np.add.reduceat((half == h).astype(np.int64), starts) for h in (1, 2)]
        yield from rows(block, "edge", keys, counts, np.r_[starts[1:], len(owner)], owner.tobytes())
        ids = np.array([d[0] or 0 for d in docs], np.int64)
        null = np.array([d[0] is None for d in docs], np.uint8)
        bytes_ = np.array([d[2] for d in docs], np.int64)
        listed = len(docs).to_bytes(4, "little") + ids.tobytes() + lengths.tobytes() + bytes_.tobytes() + null.tobytes() + (half_of(docs) == 0).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([listed], pa.binary())],
            names=["block", "key", "edge", "a", "b", "postings"],
        )

    for batch in slices(batches, "body", SLICE):
        bodies: list[list[bytes]] = []
        for doc_id, body, half in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "half"))):
            words = body.lower().split()
            words.append(END)
            found.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int32, len(words)))
            bodies.append(words)
            docs.append((doc_id, half, sum(map(len, words)) + len(words) - 1))
            size += len(body)
            if size >= BLOCK_BYTES or len(docs) >= BLOCK_DOCS:
                edges.append(_stream(bodies))
                yield from out()
                number, size = number + 1, 0
                codes, docs, found, bodies = {}, [], [], []
        if bodies:
            edges.append(_stream(bodies))
    if docs:
        yield from out()


def half_of(docs: list[tuple]) -> np.ndarray:
    return np.array([d[1] for d in docs], np.int64)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().astype(np.float64) for c in names]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sequence, a, b): counts of five symbols in rows (key, edge, a, b) of words or edges."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            rows = batch.slice(at, BATCH)
            if rows.column("key").null_count:
                positions, owner = edge_positions(rows.column("edge").to_numpy())
            else:
                positions, counts = word_positions(rows.column("key").to_pylist())
                owner = np.repeat(np.arange(rows.num_rows), counts)
            found, place = np.unique(positions.sequences(), return_inverse=True)
            sums = [np.bincount(place, w[owner], len(found)).astype(np.int64) for w in _numbers(rows, "a", "b")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (found, *sums)], names=["sequence", "a", "b"])


def learn_orders(words: DataFrame, edges: DataFrame) -> list[Tables]:
    """Tables of half a and of all training texts. Their size follows the different sequences of five symbols."""
    parts = [x.filter("a + b > 0").select("key", "edge", "a", "b").mapInArrow(_sequences, "sequence bigint, a bigint, b bigint") for x in (words, edges)]
    found = parts[0].unionByName(parts[1]).groupBy("sequence").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    a, b = _numbers(found, "a", "b")
    return order_tables(found.column("sequence").to_numpy(), [a, a + b])


def spanning_sums(words: DataFrame) -> dict[bytes, np.ndarray]:
    """Sums (half a or all, next symbol) of the beginnings that words of several parts share."""
    borders = words.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()
    found: dict[bytes, int] = {}
    for left, right in zip(borders, borders[1:]):
        size = 0
        low, high = bytes(left.high), bytes(right.low)
        while size < min(len(low), len(high)) and low[size] == high[size]:
            size += 1
        for k in range(HEAD, size + 1):
            found.setdefault(low[:k], len(found))
    if not found:
        return {}
    shared = words.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, (Counter(), Counter())
        for batch in batches:
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b"))):
                at = HEAD
                while (place := known.get(key[:at])) is not None and at <= len(key):
                    cell = place << 8 | (key[at] if at < len(key) else 0x20)
                    sums[0][cell] += a
                    sums[1][cell] += a + b
                    at += 1
        cells = list(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cells, [sums[0][c] for c in cells], [sums[1][c] for c in cells])], names=["cell", "a", "n"])

    out = np.zeros((len(found), 2, 256))
    for r in words.filter("a + b > 0").mapInArrow(run, "cell bigint, a bigint, n bigint").groupBy("cell").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).collect():
        out[r.cell >> 8, :, r.cell & 255] = r.a, r.n
    return {beginning: out[k] for beginning, k in found.items()}


def _part(rows: pa.Table, spanning: dict[bytes, np.ndarray], which: int) -> tuple[pa.Table, Positions, np.ndarray]:
    """(rows sorted by word and blank, their positions, how many each word has). `which`: counts of half a or of all."""
    words = rows.column("key").to_pylist()
    low, high = min(words), max(words)
    own = {x: spanning[x][which:which + 1] for key in (low, high) for k in range(HEAD, len(key) + 1) if (x := key[:k]) in spanning} if spanning else {}
    order = sorted(range(len(words)), key=lambda k: words[k] + b" ")
    rows = rows.take(pa.array(order, pa.int64()))
    words = [words[k] for k in order]
    a, b = _numbers(rows, "a", "b")
    positions, counts = word_positions(words)
    positions.words = word_codes(words, [a + b if which else a], own)[0]
    return rows, positions, counts


def _learned(mixers: list[Mixer]) -> pa.RecordBatch:
    m = merged(mixers)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.weights, m.ones, m.seen, m.gate_seen)], names=["w", "o", "s", "g"])


def _mixers(rows) -> list[Mixer]:
    empty = Mixer()
    return [Mixer(*(np.frombuffer(r[k]).reshape(x.shape) for k, x in enumerate((empty.weights, empty.ones, empty.seen, empty.gate_seen)))) for r in rows]


def learn_mixer(words: DataFrame, edges: DataFrame, tables: Tables, spanning: dict[bytes, np.ndarray]) -> Mixer:
    """Weights from the symbols of half b under the counts of half a, online in each part, then averaged in two steps."""
    shared = words.sparkSession.sparkContext.broadcast((tables, spanning))
    schema = "w binary, o binary, s binary, g binary"

    def learn(mixer: Mixer, positions: Positions, weights: np.ndarray, step: int) -> int:
        # In a mixed order: the learner must not see words of one beginning together.
        order = np.random.default_rng(7).permutation(np.flatnonzero(weights))
        for at in range(0, len(order), STEP):
            rows = order[at:at + STEP]
            mixer.learn(positions.take(rows), weights[rows], shared.value[0], 1.0 / (1 + step / 20) ** 0.5)
            step += 1
        return step

    def of_words(rows: pa.Table) -> pa.Table:
        rows, positions, counts = _part(rows, shared.value[1], 0)
        mixer = Mixer()
        learn(mixer, positions, np.repeat(_numbers(rows, "b")[0], counts), 0)
        return pa.Table.from_batches([_learned([mixer])])

    def of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, step = Mixer(), 0
        for batch in batches:
            positions, owner = edge_positions(batch.column("edge").to_numpy())
            step = learn(mixer, positions, _numbers(batch, "b")[0][owner], step)
        yield _learned([mixer])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = None
        for batch in batches:
            for own in _mixers(zip(*(batch.column(c).to_pylist() for c in "wosg"))):
                mixer = merged([own] if mixer is None else [mixer, own])
        if mixer is not None:
            yield _learned([mixer])

    learned = words.select("part", "key", "a", "b").groupBy("part").applyInArrow(of_words, schema).unionByName(
        edges.filter("b > 0").select("edge", "b").mapInArrow(of_edges, schema)
    )
    return merged(_mixers(learned.repartition(MIXERS).mapInArrow(average, schema).collect()))


def _in_steps(mixer: Mixer, positions: Positions, tables: Tables) -> np.ndarray:
    size = len(positions.symbols)
    return np.concatenate([np.zeros(0), *(mixer.log10(positions.take(slice(at, at + 8 * BATCH)), tables) for at in range(0, size, 8 * BATCH))])


def _scored(shared):
    """A part's words to (key, c, logp): the training count and the log10 probability of the symbols beyond the edge."""

    def run(rows: pa.Table) -> pa.Table:
        tables, mixer, spanning = shared.value
        rows, positions, counts = _part(rows, spanning, 1)
        logp = np.bincount(np.repeat(np.arange(len(counts)), counts), _in_steps(mixer, positions, tables), len(counts))
        a, b = _numbers(rows, "a", "b")
        return pa.table([rows.column("key"), pa.array((a + b).astype(np.int64)), pa.array(logp, pa.float64())], names=["key", "c", "logp"])

    return run


def _scored_edges(shared):
    """Edges to (block, postings, c, logp): sums of their log10 probabilities by the place of a document; c is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, mixer, _ = shared.value
        block, sums = None, np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([sums[:np.flatnonzero(sums)[-1] + 1].tobytes()], pa.binary()), pa.array([-1], pa.int64()), pa.array([None], pa.float64())],
                names=["block", "postings", "c", "logp"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            positions, owner = edge_positions(batch.column("edge").to_numpy())
            logp = np.bincount(owner, _in_steps(mixer, positions, tables), batch.num_rows)
            blocks = batch.column("block").to_numpy()
            stops = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(stops, stops[1:]):
                if blocks[lo] != block:
                    if block is not None:
                        yield out()
                    block, sums = blocks[lo], np.zeros(BLOCK_DOCS)
                postings = batch.column("postings").slice(lo, hi - lo).to_pylist()
                times = np.fromiter(map(len, postings), np.int64, len(postings)) // 2
                sums += np.bincount(np.frombuffer(b"".join(postings), np.uint16), np.repeat(logp[lo:hi], times), BLOCK_DOCS)
        if block is not None:
            yield out()

    return run


def _per_document(total: int, distinct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(float(total) + distinct + 1)
        listed: bytes | None = None
        block = None
        sums = np.zeros((3, 1 << 16))

        def out() -> pa.RecordBatch:
            n = int.from_bytes(listed[:4], "little")
            ids, counts, bytes_ = np.frombuffer(listed, np.int64, 3 * n, 4).reshape(3, n)
            null, held = np.frombuffer(listed, np.uint8, 2 * n, 4 + 24 * n).reshape(2, n).astype(bool)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null), pa.array(held), pa.array(counts), pa.array(np.rint(sums[0, :n]).astype(np.int64)),
                 pa.array(np.full(n, total), pa.int64()), pa.array(sums[1, :n]), pa.array(sums[2, :n]), pa.array(-sums[2, :n] / np.log10(2) / bytes_)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            stops = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(stops, stops[1:]):
                if hi == lo:
                    continue
                if blocks[lo] != block:
                    if block is not None:
                        yield out()
                    block, listed, sums = blocks[lo], None, np.zeros((3, 1 << 16))
                rows = batch.slice(lo, hi - lo)
                postings, null = rows.column("postings").to_pylist(), rows.column("c").is_null().to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(null).tolist():
                    listed, postings[k] = postings[k], b""
                c = rows.column("c").fill_null(0).to_numpy()
                for k in np.flatnonzero(c < 0).tolist():
                    own, postings[k] = np.frombuffer(postings[k]), b""
                    sums[2, :len(own)] += own
                places = np.frombuffer(b"".join(postings), np.uint16)
                times = np.fromiter(map(len, postings), np.int64, len(postings)) // 2
                logp = rows.column("logp").fill_null(0.0).to_numpy()
                for k, value in enumerate(((c > 0).astype(float), np.log10(np.maximum(c, 0) + 1.0) - base, logp)):
                    sums[k] += np.bincount(places, np.repeat(value, times), 1 << 16)
        if block is not None:
            yield out()

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row of `docs` (doc_id, text).

    Scores are log10 probabilities of the stream of a text: its words, a blank after each, and the end; the last column is the score's bits
    over the bytes of the stream. A null or empty text has the end alone.
    Learning is from rows outside the held fold; a null doc_id is in none and is learned from. Repeated rows
    count as often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    half = F.when(in_fold(F.col("doc_id")), 0).otherwise(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 + 1).cast("int")
    rows = text_bytes(docs).withColumn("half", half)
    blocks = materialize(rows.mapInArrow(_blocks, "block bigint, key binary, edge bigint, a bigint, b bigint, postings binary"), "lm-blocks")
    counted = blocks.filter("key IS NOT NULL").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = max(1, blocks.filter("key IS NOT NULL").agg(F.approx_count_distinct("key", 0.02)).first()[0] // PART_WORDS)
    words = materialize(counted.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "lm-words").withColumn("edge", F.lit(None).cast("bigint"))
    edges = blocks.filter("edge IS NOT NULL")
    first, both = learn_orders(words, edges)
    spanning = spanning_sums(words)
    mixer = learn_mixer(words, edges, first, spanning)
    shared = spark.sparkContext.broadcast((both, mixer, spanning))
    scored = words.select("part", "key", "a", "b").groupBy("part").applyInArrow(_scored(shared), "key binary, c bigint, logp double")
    sums = words.agg(F.count_if(F.col("a") + F.col("b") > 0).alias("distinct"), F.sum(F.col("a") + F.col("b")).alias("n")).first()
    total, distinct = int(sums.n or 0), int(sums.distinct or 0)
    placed = blocks.filter("key IS NOT NULL").select("key", "block", "postings").join(scored, "key").drop("key")
    schema = "block bigint, postings binary, c bigint, logp double"
    placed = placed.unionByName(edges.select("block", "edge", "postings").mapInArrow(_scored_edges(shared), schema))
    listed = blocks.filter("key IS NULL AND edge IS NULL").select("block", "postings", F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("double").alias("logp"))
    dealt = placed.unionByName(listed).repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(
        _per_document(total, distinct),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
    )


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
