import math
import zlib
from collections import Counter

import numpy as np

from marketpanel.llm import lang_id
from marketpanel.llm.common import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def brute(docs):
    """(language, score) of each text by plain dictionaries over the learned rows."""
    learned = [(d, t or "", lang) for d, t, lang in docs if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    names = sorted({lang for _, _, lang in learned})
    counts = {(lang, n): Counter() for lang in names for n in range(6)}
    for _, text, lang in learned:
        for w in lang_id.words_of(text):
            counts[lang, 0][w] += 1
            for n in range(1, 6):
                for k in range(len(w) + 3 - n):
                    counts[lang, n][f"<{w}>"[k:k + n]] += 1
    most = [max(counts[lang, n].total() for lang in names) for n in range(6)]

    def log(lang, n, x):
        own, least = counts[lang, n], 0.5 / most[n]
        return math.log((own[x] / own.total() + least) / (1 + least * len(own)))

    out = {}
    for d, text, _ in docs:
        words = lang_id.words_of(text or "")
        total = {lang: math.log(sum(x == lang for _, _, x in learned) / len(learned)) for lang in names}
        for w in words:
            if any(counts[lang, 0][w] for lang in names):
                for lang in names:
                    total[lang] += log(lang, 0, w)
                continue
            for n in range(5, 0, -1):
                found = [g for g in (f"<{w}>"[k:k + n] for k in range(len(w) + 3 - n)) if any(counts[lang, n][g] for lang in names)]
                if found:
                    for lang in names:
                        total[lang] += sum(log(lang, n, g) for g in found) / len(found)
                    break
        best = max(names, key=lambda x: total[x])
        out[d] = (best, 1 / sum(math.exp(v - total[best]) for v in total.values())) if words else ("und", 0.0)
    return out


def test_query_against_plain_counts(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = brute(docs)
    rows = QUERIES["op11_language"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == want[r.doc_id][0] and math.isclose(r.score, want[r.doc_id][1], rel_tol=1e-6)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [(r.lang_pred, lang[r.doc_id]) for r in QUERIES["op11_language"](spark, sf).collect() if r.held_out and lang[r.doc_id] is not None]
    assert len(held) > 300 and sum(p == y for p, y in held) / len(held) > 0.99


def test_backoff_from_words_to_letters(spark):
    rows = [("the house and the street", "en"), ("das haus und die straße", "de")] * 5
    model = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    judge = lambda text: model.judge([text])[0]
    assert judge("THE Street")[0] == "en" and judge("die Straße")[0] == "de"
    assert "straßen" not in model.words and judge("straßen")[0] == "de"  # by its 5-grams
    assert "qqqqße" not in model.words and judge("qqqqße")[0] == "de"  # by shorter ones
    assert judge("123 !? ½")[0] == "und" and judge("") == ("und", 0.0) and judge("日本")[0] in ("de", "en")
    # A bounded sample and a bounded model still judge all texts.
    small = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"), words=1, grams=40)
    assert len(small.words) == 1 and len(small.grams) == 40 and small.judge(["die straße"])[0][0] == "de"


def test_odd_rows(spark, odd_docs, no_docs):
    model = lang_id.fit(odd_docs)
    rows = lang_id.identify(odd_docs, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[1].lang_pred == "en"
    assert lang_id.identify(no_docs, model).count() == 0
    nothing = lang_id.fit(no_docs)
    assert nothing.names == [] and {r.lang_pred for r in lang_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert np.isfinite(model.word_logs).all()
