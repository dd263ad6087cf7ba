"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult or threat (with a weight), intent, target, negation, report, quote or other.
Small machines read them side by side and are composed into one: a target beside an insult raises
its weight, a negation just before lowers it, reported or quoted speech lowers it, and a threat counts in
full only with intent or target. A clause scores the weighted sum of what its path accepts; only clauses
with an insult or threat are read. Boosted trees turn a text's clause scores into a probability.

The weights of words and stems are lower bounds of their log odds among labelled training documents, so
that the lexicon follows the labels' languages. Half of the labelled documents outside the held fold gives the lexicon,
the other half the trees; all of them are learned from.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.boosting import BoostedTrees
from marketpanel.llm.common import query, slices, table
from marketpanel.sources.sinks import materialize

FOLDS, HELD_FOLD = 5, 0
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that count as stems
LEAST_DOCS = 3
DEVIATIONS = 2.5
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 5.0
SLICE = 4 << 20
WIDTH = 11  # features of a text

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE = range(8)
# Words that are symbols before anything is learned, in the languages of the corpus.
WORDS = {
    INSULT: "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting",
    THREAT: "kill hurt destroy beat punish töten umbringen tuer frapper matar golpear",
    INTENT: "will gonna shall must werde werden vais allons voy vamos",
    TARGET: "you your yours u he she him her they them du dich dir ihr euch tu toi te vous tú te usted ellos",
    NEGATION: "not never no without isn't aren't don't nicht kein keine nie pas jamais sans no nunca sin",
    REPORT: "said says say called wrote quoted reported claims sagte sagt schrieb dit écrit dijo escribió",
}
SEED_WEIGHT = 1.0
_EDGES = ".,;:!?()[]{}<>\"'`#$%&*|«»„“”"
_END = re.compile(r"[.,;:!?]")


@dataclass(frozen=True)
class Machine:
    """A transducer: next state of (state, symbol) and the factor it lends to an insult or a threat read in a state."""

    states: int
    step: dict[tuple[int, int], int]
    default: tuple[int, ...]  # next state on any other symbol
    factor: dict[tuple[int, int], float]


def _counting(symbol: int, reach: int, insult: float, threat: float, otherwise: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """State k > 0: the symbol was read reach - k words ago; it lends its factors as long as k > 0."""
    default = tuple(max(0, k - 1) for k in range(reach + 1))
    factor = {(k, INSULT): insult if k else otherwise[0] for k in range(reach + 1)}
    factor |= {(k, THREAT): threat if k else otherwise[1] for k in range(reach + 1)}
    return Machine(reach + 1, {(k, symbol): reach for k in range(reach + 1)}, default, factor)


MACHINES = (
    _counting(TARGET, 4, 1.5, 1.5),
    _counting(NEGATION, 3, 0.3, 0.3),
    _counting(INTENT, 3, 1.0, 2.0, (1.0, 0.5)),
    # Reported speech lasts to the end of the clause, a quotation to its closing mark.
    Machine(2, {(0, REPORT): 1}, (0, 1), {(1, INSULT): 0.6, (1, THREAT): 0.6}),
    Machine(2, {(0, QUOTE): 1, (1, QUOTE): 0}, (0, 1), {(1, INSULT): 0.7, (1, THREAT): 0.7}),
)


def compose(machines=MACHINES) -> tuple[np.ndarray, np.ndarray]:
    """(next state, factor) of the product machine, each by [state, symbol]."""
    states = list(itertools.product(*(range(m.states) for m in machines)))
    number = {s: k for k, s in enumerate(states)}
    follow, factor = np.zeros((len(states), 8), np.int32), np.ones((len(states), 8))
    for s, symbol in itertools.product(states, range(8)):
        parts = tuple(m.step.get((q, symbol), m.default[q]) for m, q in zip(machines, s))
        follow[number[s], symbol] = number[parts]
        for m, q in zip(machines, s):
            factor[number[s], symbol] *= m.factor.get((q, symbol), 1.0)
    return follow, factor


class Grammar:
    """Symbols and weights of words, and the composed machine that reads them."""

    def __init__(self, lexicon: dict[str, float]):
        """`lexicon`: weight of a word, or of a stem that ends in *."""
        self.weights = dict(lexicon)
        self.symbols = {w: s for s, ws in reversed(WORDS.items()) for w in ws.split()}
        self.follow, self.factor = compose()
        self.known: dict[str, tuple[int, float, bool]] = {}

    def _symbol(self, word: str) -> tuple[int, float, bool]:
        """(symbol, weight, ends a clause) of a word as it stands in the text."""
        core, ends = word.strip(_EDGES), bool(_END.search(word[-3:]))
        weight = max([self.weights.get(core, 0.0), *(self.weights.get(core[:k] + "*", 0.0) for k in STEMS if len(core) > k)])
        symbol = self.symbols.get(core, OTHER)
        if symbol in (INSULT, THREAT):
            return symbol, max(weight, SEED_WEIGHT), ends
        if weight and symbol == OTHER:
            return INSULT, weight, ends
        if symbol == OTHER and ('"' in word or "“" in word or "”" in word):
            symbol = QUOTE
        return symbol, 0.0, ends

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > 400_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self._symbol(w)
        symbols, weights, ends = zip(*map(self.known.__getitem__, words)) if words else ((), (), ())
        return np.array(symbols, np.int8), np.array(weights), np.array(ends, bool)

    def clauses(self, symbols: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> list[float]:
        """Scores of the clauses with an insult or a threat."""
        marked = np.flatnonzero(weights)
        if not len(marked):
            return []
        stops = np.flatnonzero(ends)
        out, done = [], -1
        for at in marked.tolist():
            if at <= done:
                continue
            k = int(np.searchsorted(stops, at))
            first, done = (int(stops[k - 1]) + 1 if k else 0), int(stops[k]) if k < len(stops) else len(symbols) - 1
            # The state forgets what lies more than a few words back, but for reports and quotations.
            state, total = 0, 0.0
            for s, w in zip(symbols[first:done + 1].tolist(), weights[first:done + 1].tolist()):
                if w:
                    total += w * self.factor[state, s]
                state = self.follow[state, s]
            out.append(total)
        return out

    def features(self, symbols: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> list[float]:
        scores = sorted(self.clauses(symbols, weights, ends), reverse=True)
        n = max(1, len(symbols))
        marked = weights[weights > 0]
        found = [
            sum(scores), *(scores[:3] + [0.0] * 3)[:3], len(scores), sum(scores) / n, len(marked), len(marked) / n,
            float(marked.max()) if len(marked) else 0.0, float(np.sort(marked)[-2]) if len(marked) > 1 else 0.0, float(np.log1p(len(symbols))),
        ]
        return [round(x, 4) for x in found]  # so that a table has a bounded number of different ones


def in_fold(doc_id: Column) -> Column:
    """Whether the rows are held out, by the id alone; a null id is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def _texts(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def _terms(text: str) -> set[str]:
    words = {w.strip(_EDGES) for w in text.lower().split()} - {""}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each label with the word or stem, from (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update(_terms(text))
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0]))], names=["term", "toxic", "clean"]
            )

    return docs.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def learn_lexicon(docs: DataFrame) -> dict[str, float]:
    """Words and stems whose log odds of a toxic document are surely high, from all rows."""
    n = {r.toxic: r["count"] for r in docs.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}
    a, c = F.col("toxic"), F.col("clean")
    b, d = n[1] - a, n[0] - c
    odds = F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    kept = term_counts(docs).filter(a >= LEAST_DOCS).select("term", (odds - DEVIATIONS * error).alias("weight")).filter(F.col("weight") >= LEAST_WEIGHT)
    return {r.term: min(r.weight, MOST_WEIGHT) for r in kept.collect()}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees | None
    share: float  # of toxic documents among those of the trees, the score without trees


def _features(docs: DataFrame, lexicon: dict[str, float], *extra: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value)
        for batch in slices(batches, "text", SLICE):
            rows = [grammar.features(*grammar.read(t.lower().split())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in extra), pa.array(rows, pa.list_(pa.float64()))], names=[*extra, "x"]
            )

    kinds = dict(docs.dtypes)
    return docs.select(*extra, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in extra) + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from all labelled documents outside the held fold. Of several labels of a document the highest counts,
    null labels count as none. The lexicon comes from counts of terms and the trees from sums over all rows.

    Labels are joined by an exchange at any size, so that what moves is a fixed share of the input.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    ).hint("shuffle_hash")
    rows = _texts(docs).filter(~in_fold(F.col("doc_id")))
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    # Terms are counted once a document, so a text takes each of its words along once.
    once = F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("text")
    lexicon = learn_lexicon(rows.filter(first).select("doc_id", once).join(known, "doc_id"))
    # Features are narrow, so it is these that meet the labels, not the texts.
    seen = _features(rows.filter(~first), lexicon, "doc_id").join(known, "doc_id").select(
        "x", F.col("toxic").alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("held")
    )
    seen = materialize(seen, "toxicity-features")
    share = seen.agg(F.avg("y")).first()[0] or 0.0
    if not 0 < share < 1:
        return ToxicityModel(lexicon, None, share)
    trees = BoostedTrees()
    trees.fit_rows(seen, WIDTH)
    return ToxicityModel(lexicon, trees, share)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of each row of `docs` (doc_id, text): the probability of the label, from the text alone.

    A null or empty text, and one without a marked clause, gets the trees' score for no evidence. Null and
    repeated doc_ids do no harm; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, trees = Grammar(shared.value.lexicon), shared.value.trees
        for batch in slices(batches, "text", SLICE):
            rows = [grammar.features(*grammar.read(t.lower().split())) for t in batch.column("text").to_pylist()]
            scores = trees.predict(np.array(rows)) if trees else np.full(len(rows), shared.value.share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, score double")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
