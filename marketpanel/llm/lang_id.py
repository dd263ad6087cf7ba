"""Language of a text by its words first, by their letters where a word is new.

A word that the learned texts hold is scored by its log frequency in each language. A word that none holds falls
back on its character n-grams, the word's ends included: the longest length of which any is known decides, from
LONGEST letters down to one. The languages' scores add up over the words; the posterior of the best one is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.common import query, slices, table

LONGEST = 5
SMOOTHING = 0.5
# The model is fitted on a sample of the labelled texts: about LEARN_BYTES, in equal shares of the languages, drawn by
# the hash of the row; what a small language leaves is not given to others. It holds at most so many of the words and
# n-grams, the most frequent ones. These three are the bounds of what a driver and a worker hold.
LEARN_BYTES = 16 << 20
WORDS = 200_000
GRAMS = 200_000
SLICE = 1 << 20
REMEMBERED = 100_000
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none if there is no letter."""
    found = _WORD.findall(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between its ends."""
    held = f"<{word}>"
    return [held[k:k + n] for k in range(len(held) - n + 1)]


@dataclass
class Languages:
    names: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    held: np.ndarray | None = None

    def evidence(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language, or the mean of that of its known n-grams of one length."""
        at = self.words.get(word)
        if at is not None:
            return self.word_logs[at]
        for n in range(LONGEST, 0, -1):
            found = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if found:
                return self.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.names))

    def rows(self, words: list[str]) -> np.ndarray:
        """Evidence of each word. A worker remembers at most REMEMBERED words, or those of one slice."""
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.held, fresh = {}, None, set(words)
        if fresh:
            start = len(self.known)
            self.known.update(zip(fresh, range(start, start + len(fresh))))
            found = np.array([self.evidence(w) for w in fresh])
            self.held = found if self.held is None else np.concatenate([self.held, found])
        return self.held[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; of equal ones the first by name."""
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        lists = [words_of(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        evidence = self.rows(flat) if flat else np.empty((0, len(self.names)))
        ends = np.cumsum([len(ws) for ws in lists])
        out = []
        for end, ws in zip(ends.tolist(), lists):
            if not ws:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.prior + evidence[end - len(ws):end].sum(axis=0)
            best = int(total.argmax())
            out.append((self.names[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def held_out() -> Column:
    """Rows that are not learned from: CRC-32 of the id as text, 1 modulo 3. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, term, n): words (size 0) and n-grams (size n) of a slice, counted."""
    for batch in slices(batches, "text", SLICE):
        counts: Counter[tuple[str, int, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(words_of(text)).items():
                counts[lang, 0, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams_of(word, size):
                        counts[lang, size, gram] += n
        langs, sizes, terms = zip(*counts) if counts else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), pa.array(counts.values(), pa.int64())],
            names=["lang", "size", "term", "n"],
        )


def _logs(found: pa.Table, totals: dict[tuple[str, int], tuple[int, int]], names: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Place of each term and its log frequency in each language. A term that a language lacks is taken as frequent as
    SMOOTHING of a term in the language with the most text, so that a language of little text does not seem to allow
    anything."""
    sizes = found.column("size").to_numpy()
    out = np.empty((len(sizes), len(names)))
    for size in np.unique(sizes).tolist():
        own, least = sizes == size, SMOOTHING / max(n for (_, s), (n, _) in totals.items() if s == size)
        for j, name in enumerate(names):
            total, kinds = totals.get((name, size), (1, 0))
            out[own, j] = np.log((found.column(f"n_{j}").to_numpy()[own] / total + least) / (1 + least * kinds))
    return {term: k for k, term in enumerate(found.column("term").to_pylist())}, out


def fit(docs: DataFrame, learn_bytes: int = LEARN_BYTES, words: int = WORDS, grams: int = GRAMS) -> Languages:
    """The model from `docs` (text, lang), rows without a language left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    labelled = docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), text.alias("text"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("lang").collect()
    names, all_docs = [s.lang for s in sizes], sum(s.docs for s in sizes)
    if not names:
        return Languages([], np.empty(0), {}, np.empty((0, 0)), {}, np.empty((0, 0)))
    share = F.lit(0.0)
    for s in sizes:
        share = F.when(F.col("lang") == s.lang, min(1.0, learn_bytes / len(names) / max(1, s.bytes)) * 1.0).otherwise(share)
    chance = F.xxhash64("text", "lang") / 2.0**64 + 0.5
    terms = labelled.filter(chance <= share).mapInArrow(_counted, "lang string, size int, term string, n bigint")
    counts = terms.groupBy("lang", "size", "term").agg(F.sum("n").alias("n")).persist()
    try:
        totals = {(t.lang, t.size): (t.n, t.kinds) for t in counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
        by_language = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n_{j}") for j, name in enumerate(names)]
        each = counts.groupBy("size", "term").agg(F.sum("n").alias("n"), *by_language)
        most = lambda rows, limit: rows.orderBy(F.desc("n"), "size", "term").limit(limit).drop("n").toArrow()
        known = _logs(most(each.filter("size = 0"), words), totals, names)
        parts = _logs(most(each.filter("size > 0"), grams), totals, names)
    finally:
        counts.unpersist()
    prior = np.log([s.docs / all_docs for s in sizes])
    return Languages(names, prior, *known, *parts)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score), one row a row of `docs` (doc_id, text).

    A text that is null or has no letter is `und` with score 0, as is any text of a model without languages. Other
    texts get one of the model's languages, also if no word or letter of them is known: then the most frequent. Rows
    are judged by their text alone, whole and in slices, so null and repeated ids and long texts do no harm; an empty
    table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            langs, scores = zip(*shared.value.judge(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


@query("op11_language")
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
