"""Byte-pair encoding by a pair occurrence index.

All different words of a slice lie in one array of symbols. An index maps each pair that has a merge to
its places; active ranks are applied in ascending order to all places at once, and only the neighbours
of a merged place change their pairs. Words are split as the tokenizer's own file says: NFC, white space
to a blank, lower case, then a pattern; bytes become symbols, the last one of a word with its end mark.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, slices, table

SLICE = 6 << 20
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """The parts of a tokenizer file of this kind (BPE with an end-of-word mark)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"]:
            raise ValueError("a tokenizer of another kind")
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = split["pattern"]["Regex"]
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + mark] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has no merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count a word) of words that are not empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths)
    symbols = vocabulary.inner[data]
    symbols[ends - 1] = vocabulary.last[data[ends - 1]]
    place = np.arange(len(data), dtype=np.int64)
    after, before = place + 1, place - 1
    after[ends - 1] = -1
    before[ends - lengths] = -1

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        rank = vocabulary.ranks(symbols[at], symbols[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(part)

    note(np.flatnonzero(after >= 0))
    while active:
        rank = heapq.heappop(active)
        at = np.unique(np.concatenate(index.pop(rank)))  # two merges beside each other note a pair twice
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        at = at[(symbols[at] == a) & (after[at] >= 0)]
        at = at[symbols[after[at]] == b]
        if a == b and len(at) > 1:
            # Of places that overlap in a run, every second one is merged, from the left.
            starts = np.r_[True, after[at[:-1]] != at[1:]]
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        symbols[at] = vocabulary.made[rank]
        symbols[gone] = -1
        after[at] = follow
        inside = follow >= 0
        before[follow[inside]] = at[inside]
        lead = before[at]
        note(np.concatenate([lead[lead >= 0], at[inside]]))
    left = symbols >= 0
    return symbols[left], np.add.reduceat(left.astype(np.int64), ends - lengths)


class Encoder:
    """Encodes texts; the ids of words are remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}"))
        # The same pattern where all characters are ASCII, for the faster library.
        ascii_pattern = vocabulary.pattern.replace(r"[\p{L}]", "[a-z]").replace(r"\p{L}", "a-z").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")
        self.split_ascii = re.compile(ascii_pattern, re.ASCII)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")")
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)
        if self.vocabulary.special:
            self.codes = {w: k for k, w in enumerate(self.vocabulary.special)}
            self.ids = np.array(list(self.vocabulary.special.values()), np.int32)
            self.counts = np.ones(len(self.ids), np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Each character by itself: no special form of sigma at the end of a word.
        return self.split.findall(text.replace("Σ", "σ").lower())

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._words(part)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, count a text)."""
        if len(self.codes) > CACHE_WORDS:
            self._forget()
        split = [self.words(t) for t in texts]
        fresh = list(dict.fromkeys(w for ws in split for w in set(ws).difference(self.codes)))
        if fresh:
            ids, counts = encode_words(self.vocabulary, [w.encode() for w in fresh])
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts
        lengths = np.array([len(ws) for ws in split], np.int64)
        known = self.codes.__getitem__
        codes = np.fromiter((known(w) for ws in split for w in ws), np.int64, int(lengths.sum()))
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - self.starts[codes], counts)
        totals = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
        return self.ids[at], np.diff(totals)


def decode(tokens: dict[int, str], ids: list[int]) -> str:
    """The file names no decoder: tokens are joined by blanks."""
    return " ".join(map(tokens.__getitem__, ids))


def encode_and_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row of `docs` (doc_id, text), special tokens as in the file and none added.

    A null or empty text has no ids and decodes to the empty text. Rows are encoded by their text alone,
    so nulls and repeats in doc_id do no harm; an empty table gives an empty result. The driver reads
    the vocabulary (its size is fixed) and broadcasts it.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        encoder = Encoder(vocabulary)
        for batch in slices(batches, "text", SLICE):
            ids, counts = encoder(batch.column("text").to_pylist())
            stops = np.r_[0, np.cumsum(counts)]
            listed = ids.tolist()
            decoded = [decode(vocabulary.tokens, listed[lo:hi]) for lo, hi in zip(stops.tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), default_vocabulary())
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
