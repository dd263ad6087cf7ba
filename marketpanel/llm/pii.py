"""Personal data by candidates and boosted trees.

Exact patterns give the base spans, which always stay. High-recall generators propose more spans, which
may overlap; boosted trees judge them by their format and the words around them. The trees learn from
candidates that the exact patterns decide: one that meets a valid base span is right if the kinds agree,
one of a base shape that fails its test is wrong; a written-out address is judged by its domain, colon groups
by whether they are an IPv6 address. All of them are learned from, weighted by kind, form and label, so that no rare one starves. Scores are calibrated on a third of the candidates that the trees did not see,
and a kind's threshold is the least one whose calibrated precision, less its error, is high enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpanel.llm.boosting import BoostedTrees, isotonic, sigmoid
from marketpanel.llm.common import cuts, query, slices, table
from marketpanel.sources.sinks import materialize

KINDS = ("email", "ip", "card", "phone")
# The candidates of decided label weigh so much in the trees, all together: each kind, form and label has an equal share,
# spread over all its candidates; one that has fewer counts them full, and what it leaves goes to the others.
WEIGHT = 20_000
DIGITS = 4  # of a score; calibration counts all candidates of each score
PRECISION = 0.98
LEAST_LABELS = 50  # of each label and kind; below, a kind adds nothing
SLICE = 8 << 20
REDACT_SLICE = 1 << 20
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match starts where a run of digits does, so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms.
_AT = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s?[\[(<{]\s?(?:at|AT|@)\s?[\])>}]\s?([A-Za-z0-9-]{1,63}(?:(?:\.|\s\.\s?|\s?[\[(]\s?(?:dot|DOT|\.)\s?[\])]\s?)[A-Za-z0-9-]{1,63}){1,4})")
_CHAIN = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().\-/]{0,2}[0-9])++")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_DOT = re.compile(r"\s?[\[(]\s?(?:dot|DOT|\.)\s?[\])]\s?|\s\.\s?")
# Words that announce a kind, in the 40 characters before.
_CUES = {
    "email": ("mail", "contact", "write to", "@"), "ip": ("ip", "host", "server", "addr", "gateway"),
    "card": ("card", "visa", "credit", "debit", "iban", "account"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
}
_OTHER_CUES = ("token", "key", "version", "id", "=", "#", "isbn", "page", "$")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that no long word is read again and again."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def shapes(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of all spans of the base shapes."""
    out: list[tuple[str, int, int, bool]] = [("email", a, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            out.append(("ip", *m.span(), all(len(p) < 4 and int(p or 0) <= 255 for p in parts)))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            out.append(("card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits)))
        for m in _PHONE.finditer(text):
            out.append(("phone", *m.span(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def by_place(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def loose(text: str) -> list[Span]:
    """High-recall proposals; they overlap each other and the base spans."""
    out: list[Span] = []
    if "at" in text or "AT" in text or "@" in text:
        out += [("email", *m.span()) for m in _AT.finditer(text)] if re.search(r"[\[(<{]\s?(?:at|AT|@)", text) else []
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if 9 <= digits <= 15:
                out.append(("phone", *m.span()))
            if 12 <= digits <= 19:
                out.append(("card", *m.span()))
    if ":" in text:
        out += [("ip", *m.span()) for m in _COLONS.finditer(text)]
    return out


def holds(kind: str, span: str) -> bool | None:
    """Whether a written-out email has a right name and domain, or colon groups are an IPv6 address; None for
    other spans, which have no test of their own."""
    if kind == "email" and (m := _AT.fullmatch(span)):
        labels = _DOT.sub(".", m[2]).split(".")
        return (
            all(x and x[0] != "-" and x[-1] != "-" for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()
            and all(m[1].split("."))
        )
    if kind == "ip" and ":" in span:
        try:
            return bool(IPv6Address(span))
        except ValueError:
            return False
    return None


def decided(text: str) -> list[tuple[str, int, int, bool, bool]]:
    """(kind, start, end, label, loose) of the proposals whose label tests decide: one that overlaps valid base
    spans is right if one of them is of its kind, one of a base shape that fails is wrong, and others by `holds`."""
    shaped = shapes(text)
    valid = [(k, a, b) for k, a, b, good in shaped if good]
    failed = {(k, a, b) for k, a, b, good in shaped if not good and b - a >= 7}
    base = {s[:3] for s in shaped}
    out = []
    for kind, a, b in dict.fromkeys([*(s[:3] for s in shaped), *loose(text)]):
        over = {k for k, x, y in valid if a < y and x < b}
        label = kind in over if over or (kind, a, b) in failed else holds(kind, text[a:b])
        if label is not None:
            out.append((kind, a, b, label, (kind, a, b) not in base))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and surroundings of a span; not the tests that decide the base spans."""
    span, before, after = text[start:end], text[max(0, start - 40):start].lower(), text[end:end + 20].lower()
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    return [
        float(KINDS.index(kind)), len(span), digits, letters, len(span) - digits - letters, len(groups), max(groups), min(groups),
        groups[0], groups[-1], span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["),
        len(set(span)) / max(1, len(span)), float(span[0] == "0"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("", "\n")), float(after[:1] in ("", "\n", ".", ",")),
        float(any(c in before for c in _CUES[kind])), float(any(c in before for k, cs in _CUES.items() if k != kind for c in cs)),
        float(any(c in before for c in _OTHER_CUES)), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
    ]


WIDTH = len(features("0", "card", 0, 1))


@dataclass
class PrivateModel:
    trees: BoostedTrees | None
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span], shaped: list[tuple[str, int, int, bool]]) -> list[Span]:
        """Proposals at or above their kind's threshold, the best first, apart from base spans and each other."""
        if self.trees is None or not self.thresholds:
            return []
        decided = {(k, a, b) for k, a, b, _ in shaped}
        spans = [s for s in loose(text) if s not in decided and s[0] in self.thresholds]
        if not spans:
            return []
        scores = np.round(self.trees.predict(np.array([features(text, *s) for s in spans], float)), DIGITS)
        taken = [(a, b) for _, a, b in base]
        out: list[Span] = []
        for score, span in sorted(zip(scores.tolist(), spans), key=lambda x: (-x[0], x[1][1], KINDS.index(x[1][0]), x[1][2])):
            if score >= self.thresholds[span[0]] and all(span[2] <= a or b <= span[1] for a, b in taken):
                taken.append(span[1:])
                out.append(span)
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def training_candidates(docs: DataFrame) -> DataFrame:
    """(place, kind, valid, loose, x) of every span whose label tests decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for kind, a, b, valid, form in decided(text):
                    rows.append((f"{doc_id}:{kind}:{a}:{b}", kind, valid, form, features(text, kind, a, b)))
            columns = list(zip(*rows)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["place", "kind", "valid", "loose", "x"])

    # Texts without a digit, an @, an "at" in brackets or colons have no candidate and are not sent to Python.
    some = F.col("text").rlike(r"[0-9@]|[\[(<{]\s?(?:at|AT)|[A-Fa-f]:[A-Fa-f]")
    return _texts(docs).filter(some).mapInArrow(run, "place string, kind string, valid boolean, loose boolean, x array<double>")


def quotas(counts: list[int], size: int) -> list[int]:
    """Weight of each group of `size`: the counts of the small groups, and equal shares of what they leave."""
    out = [0] * len(counts)
    for left, k in zip(range(len(counts), 0, -1), sorted(range(len(counts)), key=counts.__getitem__)):
        out[k] = min(counts[k], size // left)
        size -= out[k]
    return out


def fit(docs: DataFrame, sample: int = WEIGHT, precision: float = PRECISION) -> PrivateModel:
    """Trees and thresholds from all candidates; `sample` is what they weigh together in the trees, and leaves none out.
    Without both labels there is no model."""
    candidates = materialize(training_candidates(docs), "pii-candidates")
    groups = ("kind", "loose", "valid")
    held = F.crc32(F.col("place").cast("binary")) % 3 == 0
    counts = candidates.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(~held).alias("learned")).orderBy(*groups).collect()
    if min(sum(c.learned for c in counts if c.valid == label) for label in (True, False)) < LEAST_LABELS:
        return PrivateModel(None, {})
    weight = F.lit(0.0)
    for c, size in zip(counts, quotas([c.n for c in counts], sample)):
        weight = F.when((F.col("kind") == c.kind) & (F.col("loose") == c.loose) & (F.col("valid") == c.valid), size / c.n).otherwise(weight)
    trees = BoostedTrees()
    coded = trees.fit_rows(candidates.select("x", "kind", "loose", F.col("valid").cast("int").alias("y"), weight.alias("w"), held.alias("held")), WIDTH)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("y"), batch.column("n"), pa.array(np.round(sigmoid(trees.margin(bins)), DIGITS))], names=["kind", "y", "n", "score"]
            )

    # Only loose forms are added; those of emails and addresses share no shape with the base spans.
    own = coded.filter(F.col("held") & (F.col("loose") | ~F.col("kind").isin("email", "ip"))).select("bins", "kind", "y", "n")
    by_score = own.mapInArrow(scored, "kind string, y int, n bigint, score double").groupBy("kind", "score").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("valid")
    ).collect()  # at most 10,001 scores a kind
    thresholds = {}
    for kind in KINDS:
        scores, n, valid = np.array(sorted((r.score, r.n, r.valid) for r in by_score if r.kind == kind), float).reshape(-1, 3).T
        if min(valid.sum(), (n - valid).sum()) < LEAST_LABELS:
            continue
        ends, shares = isotonic(scores, valid / n, n)
        for low, share in zip(np.r_[-1.0, ends[:-1]], shares):
            above = n[scores > low].sum()
            if share - np.sqrt(share * (1 - share) / above + 0.25 / above**2) >= precision:
                thresholds[kind] = float(np.nextafter(low, 1))
                break
    return PrivateModel(trees, thresholds)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _as_arrow(lists: list[list[Span]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in lists], _SPANS)


def _judged(model: PrivateModel, text: str) -> tuple[list[Span], list[Span]]:
    if not text or ("@" not in text and not _DIGIT.search(text) and ":" not in text and "at" not in text and "AT" not in text):
        return [], []
    shaped = shapes(text)
    base = [(k, a, b) for k, a, b, valid in shaped if valid]
    return by_place(base), model.added(text, base, shaped)


def find_private(docs: DataFrame, model: PrivateModel | None = None) -> DataFrame:
    """(doc_id, base, added) of each row of `docs` (doc_id, text): lists of (kind, start, end) in code points.

    A null or empty text has none. Rows are judged by their text alone, so null and repeated doc_ids do no
    harm; an empty table gives an empty result. No pattern reads a part of a text more than a few times,
    so long texts and long runs of digits or letters cost in proportion.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = [_judged(shared.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _as_arrow([b for b, _ in found]), _as_arrow([by_place(a) for _, a in found])], names=["doc_id", "base", "added"]
            )

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return _texts(docs).mapInArrow(run, f"doc_id bigint, base {spans}, added {spans}")


def mask(text: str, spans: list[Span]) -> str:
    """`text` with each span replaced by its kind in brackets; spans that overlap become one, of the first kind."""
    out, end = [], 0
    held: list[list] = []
    for kind, a, b in by_place(spans):
        if held and a < held[-1][2]:
            held[-1][2] = max(held[-1][2], b)
        else:
            held.append([kind, a, b])
    for kind, a, b in held:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: PrivateModel | None = None) -> DataFrame:
    """`docs` with all found spans masked in `text`; null texts stay null, other columns as they are and out of
    Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.arrow_udf("string")
    def masked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            done = []
            for lo, hi in cuts(texts, REDACT_SLICE):
                out = []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    base, added = _judged(shared.value, text or "")
                    out.append(mask(text, base + added) if base or added else text)
                done.append(pa.array(out, pa.string()))
            yield pa.concat_arrays(done)

    return docs.select(*[
        masked(F.col(f"`{c}`").cast("string")).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns
    ])


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
