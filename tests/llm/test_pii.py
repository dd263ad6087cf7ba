import hashlib
import random
import re
import time

import numpy as np

from marketpanel.llm import pii
from marketpanel.llm.boosting import BoostedTrees, isotonic
from marketpanel.llm.common import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    """The patterns as given, applied plainly."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            good = (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and doubled % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("ab.@@-+ 0123456789()..  12%é") for _ in range(rng.randrange(40)))
        assert ["%s:%d:%d" % s for s in pii.by_place([x[:3] for x in pii.shapes(text) if x[3]])] == base(text)


def test_long_runs_take_time_in_proportion():
    start = time.time()
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "1 " * 200_000, "1." * 200_000, "@" * 200_000, "a@b" * 100_000, ":" * 200_000):
        pii.shapes(text)
        pii.loose(text)
    assert time.time() - start < 20


def test_query_against_plain_patterns(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_pii"](spark, SF_DIR).collect()}
    for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        want = base(d.text or "")
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(rows[d.doc_id].spans.split(",")) | {""}
        assert sum(rows[d.doc_id][f"n_{k}"] for k in pii.KINDS) == len(want)


def test_trees_add_loose_phones_and_leave_versions(spark):
    rng = random.Random(2)
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    docs = [(i, f"word call +1 {number()} word") for i in range(400)]
    docs += [(1000 + i, f"host {rng.randrange(1, 255)}.{rng.randrange(100, 255)}.{rng.randrange(100, 255)}.{rng.randrange(100, 255)} up") for i in range(400)]
    model = pii.fit(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert "phone" in model.thresholds
    text = "please call 1 (504) 555-2652 today"
    assert ("phone", 12, 28) in model.added(text, [], [])
    assert model.added("version 1.2.3 and 2024-01-02 in room 12", [], []) == []


def test_written_out_emails_and_colon_groups_get_thresholds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    group = lambda: f"{rng.randrange(1 << 16):04x}"
    docs = [f"please mail {word()} [at] {word()} [dot] com today" for _ in range(400)]
    docs += [f"value {word()} [at] {rng.randrange(1, 99)}.{rng.randrange(1, 99)} measured" for _ in range(400)]
    docs += [f"host {':'.join(group() for _ in range(8))} up" for _ in range(400)]
    docs += [f"key {':'.join(group()[:2] for _ in range(6))} end" for _ in range(400)]
    docs += [f"call +1 (504) 555-{k % 10000:04d} or host 300.1.{k % 256}.1" for k in range(6000)]  # many of other kinds
    model = pii.fit(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), sample=6000)
    assert {"email", "ip"} <= model.thresholds.keys()
    added = lambda text: [text[a:b] for _, a, b in model.added(text, [], [])]
    assert added("please mail jane [at] mail [dot] com. Then go") == ["jane [at] mail [dot] com"]
    assert added("host 2001:0db8:0000:0000:0000:ff00:0042:8329 up") == ["2001:0db8:0000:0000:0000:ff00:0042:8329"]
    assert added("value speed [at] 12.50 measured") == [] and added("key 00:1b:44:11:3a:b7 end") == []
    assert pii.quotas([5, 1000, 20, 1000], 100) == [5, 37, 20, 38] and pii.quotas([3, 4], 100) == [3, 4]


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    ends, shares = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert ends.tolist() == [0.1, 0.3, 0.4] and shares.tolist() == [0, 0.5, 1]


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find_private(odd_docs).collect()
    assert len(rows) == 11 and [sum(len(r.base) for r in rows if r.doc_id == d) for d in (1, 3, 6, 8)] == [0, 0, 0, 4]
    masked = pii.redact(odd_docs)
    assert masked.schema.fieldNames() == odd_docs.columns
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[8] == "Mail [EMAIL] or [PHONE], card [CARD], host [IP] Übung ΑΣ <|endoftext|>" and text[3] is None
    assert pii.mask("+1 4111 1111 1111 1111 x", [("card", 3, 22), ("phone", 0, 22)]) == "[PHONE] x"
    assert pii.find_private(no_docs).count() == 0 and pii.redact(no_docs).count() == 0


def test_trees_and_thresholds_come_from_all_candidates(spark):
    """Fitted by a table as by an array; a small weight leaves no candidate out of edges, trees or calibration."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    held = np.arange(3000) % 3 == 0
    rows = spark.createDataFrame([(r.tolist(), int(v), 1.0, bool(h)) for r, v, h in zip(x, y, held)], "x array<double>, y int, w double, held boolean")
    whole, by_rows = BoostedTrees().fit(x[~held], y[~held].astype(float)), BoostedTrees()
    coded = by_rows.fit_rows(rows.repartition(7), 3)
    assert coded.agg({"n": "sum"}).first()[0] == 3000
    near = np.abs(whole.predict(x) - by_rows.predict(x))  # the edges of bins are not interpolated
    assert near.mean() < 0.01 and ((by_rows.predict(x[held]) >= 0.5) == y[held]).mean() > 0.95
    again = BoostedTrees()
    again.fit_rows(rows.repartition(2), 3)
    assert (again.predict(x) == by_rows.predict(x)).all()  # however the rows are dealt
    # 300 right and 300 wrong emails among 6,600 candidates.
    docs = [f"call +1 (504) 555-{k:04d} or host 300.1.{k % 256}.{k}" for k in range(3000)]
    docs += [f"value {k} [at] {k % 97}.{k % 89}" for k in range(300)] + [f"mail a{k} [at] mail [dot] com" for k in range(300)]
    model = pii.fit(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), sample=200)
    assert "email" in model.thresholds  # 200 candidates hold too few of either label for it
