import math
import zlib
from collections import Counter

from marketpanel.llm import toxicity
from marketpanel.llm.common import QUERIES
from marketpanel.llm.licenses import Notices, find_licenses, scan
from marketpanel.llm.lm_score import score_texts

SF_DIR = "/root/testdata/sf0.001"


def test_language_model_against_plain_counts(spark):
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in QUERIES["op9_lm_score"](spark, SF_DIR).collect()}
    assert rows.keys() == tokens.keys()
    for d, ws in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    # On held-out texts the model needs fewer bits than a table of bytes would.
    bits = -sum(rows[d].score for d in held if held[d]) / math.log10(2)
    size = sum(len(w) + 1 for d in held if held[d] for w in tokens[d])
    order0 = Counter(b for ws in tokens.values() for w in ws for b in w + b" ")
    entropy = -sum(k / order0.total() * math.log2(k / order0.total()) for k in order0.values())
    assert bits / size < 0.8 * entropy


def test_language_model_odd_rows(odd_docs, no_docs):
    rows = score_texts(odd_docs).collect()
    assert len(rows) == 11 and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].n_tokens == by[4].n_tokens == 1 and by[6].n_tokens == 30_001
    assert score_texts(no_docs).count() == 0


def test_language_model_over_many_small_documents(spark):
    """More documents in one task than a block may hold."""
    docs = spark.range(0, 70_000, 1, 1).selectExpr("id AS doc_id", "concat('word', id % 7, ' end') AS text")
    rows = score_texts(docs)
    assert rows.select("doc_id").distinct().count() == 70_000 and rows.filter("n_tokens <> 3").count() == 0
    assert rows.select("base_score").distinct().count() <= 7


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar({"zorg": 2.0, "blar*": 3.0})
    score = lambda text: grammar.clauses(*grammar.read(text.lower().split()))
    assert score("nothing here. at all") == []
    assert score("we saw a zorg") == [2.0]
    assert score("you zorg, other words. a blarish thing") == [3.0, 3.0]  # a target beside it; a stem
    assert math.isclose(score("you are not a zorg")[0], 2.0 * 1.5 * 0.3)
    assert math.isclose(score("she said that zorg")[0], 2.0 * 0.6 * 1.5)
    assert score("i will kill you")[0] > score("a kill was made")[0]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.92


def test_toxicity_odd_rows(odd_docs, no_docs, odd_labels):
    for labels in (odd_labels, odd_labels.limit(0)):
        model = toxicity.fit(odd_docs, labels)
        rows = toxicity.score_toxicity(odd_docs, model).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(no_docs, toxicity.fit(no_docs, odd_labels)).count() == 0


def test_license_wording():
    notices = Notices()
    found = lambda text: [m["license"] for m in scan(notices, text)[1]]
    filler = " ".join(f"word{i}" for i in range(60))
    assert found(f"{filler}\nReleased under the MIT License.\n{filler}") == ["MIT"]
    assert found("LICENSED*** UNDER### THE$$$ APACHE%%% LICENSE,&&& VERSION*** 2.0") == ["Apache-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 7.") == []
    assert found("a driving license is needed, and a license plate") == []
    assert found(f"Released under the MIT License. {filler} Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]


def test_negated_notices_and_spdx_lines():
    notices = Notices()
    found = lambda text: [m["license"] for m in scan(notices, text)[1]]
    assert found("This work is not licensed under the GNU General Public License, version 3.") == []
    assert found("It is not released under the MIT License.") == [] and found("This isn't licensed under the Apache License, Version 2.0.") == []
    assert found("Not sold in stores. It is released under the MIT License.") == ["MIT"]
    for name in ("BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-only", "CC0-1.0", "ISC", "EPL-2.0", "MIT", "Apache-2.0", "LGPL-2.1-or-later"):
        assert found(f"// SPDX-License-Identifier: {name}\nint main() {{ return 0; }}") == [name]
    assert found("SPDX-License-Identifier: Something-Else-1.0") == []


def test_licenses_against_plain_search(spark, odd_docs, no_docs):
    import re

    known = {
        "GPL-3.0": "this work is licensed under the gnu general public license version 3", "MIT": "released under the mit license",
        "Apache-2.0": "licensed under the apache license version 2.0", "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    }
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.licenses for r in QUERIES["op10_licenses"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (d.text or "").lower()))
        assert rows[d.doc_id] == ",".join(sorted(k for k, w in known.items() if w in words))
    assert find_licenses(odd_docs).count() == 11 and find_licenses(odd_docs).filter("n_candidates > 0").count() == 0 and find_licenses(no_docs).count() == 0


def test_licenses_side_by_side_and_long():
    lines = {
        "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    }
    notices = Notices()
    for a in lines:
        for b in lines:
            text = f"{lines[a]} {lines[b]}"
            found = scan(notices, text)[1]
            assert [m["license"] for m in found] == [a, b]
            assert [text[m["start"]:m["end"]] + "." for m in found] == [lines[a], lines[b]] and not any(m["differences"] for m in found)
    assert [m["license"] for m in scan(notices, " ".join([*lines.values()] * 3))[1]] == [*lines] * 3
    # A notice of more words than a short block holds, found as a whole with its cue at its begin or end.
    long = " ".join(f"term{i}" for i in range(150))
    filler = " ".join(f"word{i}" for i in range(60))
    for text in (f"Licensed for {long}", f"{long} end of license"):
        assert [(m["license"], m["differences"]) for m in scan(Notices([("Long", text, "term149")]), f"{filler} {text} {filler}")[1]] == [("Long", "")]


def test_license_families():
    notices = Notices()
    found = lambda text: [m["license"] for m in scan(notices, text)[1]]
    opening = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    two = opening + """ provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
"""
    advertising = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by Some Company.
"""
    names = """Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
    tail = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    assert found(two + tail) == ["BSD-2-Clause"]
    for holder in ("the copyright holder", "the University of California, Berkeley"):
        assert found(f"{two}3. {names.format(holder)}{tail}") == ["BSD-3-Clause"]
        assert found(f"{two}{advertising}4. {names.format(holder)}{tail}") == ["BSD-4-Clause"]
    assert found(opening + ".") == ["BSD"]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for text in (f"Licensed under CC {kind} 4.0.", f"License: CC-{kind}-4.0", f"This page is licensed under CC {kind} 4.0"):
            assert found(text) == [f"CC-{kind}-4.0"], text
    assert found("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == ["CC-BY-NC-4.0"]
    assert found("Licensed under CC BY-NC 3.0.") == []


def test_every_license_line_of_the_documents(spark):
    import re

    known = {
        "GPL-3.0": "this work is licensed under the gnu general public license version 3", "MIT": "released under the mit license",
        "Apache-2.0": "licensed under the apache license version 2.0", "CC-BY-NC-4.0": "licensed under cc by nc 4.0",
    }
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.licenses for r in QUERIES["op10_licenses"](spark, sf).collect()}
    seen = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (d.text or "").lower()))
        expected = sorted(k for k, w in known.items() if w in words)
        seen.update(expected)
        assert rows[d.doc_id] == ",".join(expected)
        # No line with a cue is left without a match.
        assert bool(expected) == bool(re.search("licen[cs]|spdx", words))
    assert seen == known.keys()


def test_language_model_bits_per_byte(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, " one  TWO\nthree "), (3, None), (4, "\u00fcber")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in score_texts(docs).collect()}
    for d, size in {1: 15, 2: 15, 3: 1, 4: 7}.items():  # words with a blank after each, and the end
        assert math.isclose(rows[d].bits_per_byte, -rows[d].score / math.log10(2) / size, rel_tol=1e-9)


def test_language_model_reads_across_words(spark):
    """The order of words counts; with the same words before and after, a text scores as the one it repeats."""
    texts = ["the cat sat on the mat while a dog ran home"] * 40 + ["home ran dog a while mat the on sat cat the", "the cat sat on the mat while a dog ran home"]
    rows = {r.doc_id: r for r in score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows[40].n_tokens == rows[41].n_tokens and math.isclose(rows[40].base_score, rows[41].base_score)
    assert rows[41].score > rows[40].score + 5
    assert math.isclose(rows[41].score, rows[0].score, rel_tol=1e-9)


def test_positions_are_the_stream():
    from marketpanel.llm import lm_score, mixing

    bodies = [[b"the", b"a", b"of", b"\n"], [b"\n"], [b"wonder", b"x", b"yes", b"\n"]]
    found = Counter(mixing.edge_positions(lm_score._stream(bodies))[0].sequences().tolist())
    found.update(mixing.word_positions([w for words in bodies for w in words])[0].sequences().tolist())
    streams = [b"\0\0\0 " + b" ".join(words) for words in bodies]
    assert found == Counter(int.from_bytes(s[k - 4:k + 1], "big") for s in streams for k in range(4, len(s)))


def test_word_counts_over_parts(spark, monkeypatch):
    """Counts of a word so far are those of all words, however these are cut into parts."""
    import random

    import numpy as np

    from marketpanel.llm import lm_score, mixing

    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"ab\x01") for _ in range(rng.randint(1, 9))) for _ in range(900)})
    counts = {w: (rng.randint(0, 5), rng.randint(0, 5)) for w in words}
    rows = spark.createDataFrame([(w, *counts[w], k // 40) for k, w in enumerate(words)], "key binary, a bigint, b bigint, part int")
    spanning = lm_score.spanning_sums(rows)
    assert len(spanning) > 5
    below = Counter()
    for w, (a, b) in counts.items():
        for k in range(3, len(w) + 1):
            for j in range(9):
                below[w[:k], j, ((w + b" ")[k] | 256) >> (8 - j)] += a + b
    for at in range(0, len(words), 40):
        part = words[at:at + 40]
        taken, positions, sizes = lm_score._part(rows.filter(f"part = {at // 40}").toArrow(), spanning, 1)
        assert sorted(taken.column("key").to_pylist()) == part
        expected = []
        for w in taken.column("key").to_pylist():
            for k in range(3, len(w) + 1):
                nodes = [((w + b" ")[k] | 256) >> (8 - j) for j in range(8)]
                expected.append([mixing.packed(*(np.array([float(below[w[:k], j + 1, n << 1 | bit])]) for bit in (0, 1)))[0] for j, n in enumerate(nodes)])
        assert (positions.words == np.array(expected).reshape(-1, 8)).all()


def test_tables_grow_with_the_sequences():
    import numpy as np

    from marketpanel.llm.mixing import order_tables

    sizes = [len(order_tables(np.arange(n) * 7919, [np.ones(n)])[0].codes) for n in (1_000, 10_000, 100_000)]
    assert sizes[0] < sizes[1] / 4 < sizes[2] / 16


def test_toxicity_learns_from_all_labels(spark):
    """What only the labelled documents of the largest hashes show is learned, too."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ids = spark.range(45_000).select(F.col("id").alias("doc_id"))
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id")))
    late = ids.filter(~toxicity.in_fold(F.col("doc_id"))).withColumn("toxic", (rank > 30_000).cast("int"))
    text = F.when(F.col("toxic") == 1, "you are a zorgx they say").otherwise("nothing to see here today")
    model = toxicity.fit(late.select("doc_id", text.alias("text")), late)
    assert model.lexicon.get("zorgx", 0) > 1
    new = spark.createDataFrame([(1, "what a zorgx you are"), (2, "nothing here today")], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(new, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_toxicity_moves_words_once_at_any_size_of_labels(spark, monkeypatch):
    """The labels' join is the same exchange below and above the limit of broadcasts, and a text takes no word along twice."""
    rows = [(k, "\u00dcbung one  One,\ttwo. " * 50 + "\u0391\u03a3 \u0391\u03a3, one\u00a0two") for k in range(200)] + [(200, None), (None, "one"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 200, 2)] + [(k, 1) for k in range(1, 200, 4)], "doc_id bigint, toxic int")
    learned = []
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda docs: learned.append(docs) or {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            toxicity.fit(docs, labels)
            plan = learned[-1]._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    given = {d: t for d, t in rows if d in toxic and d != 7}
    found = [r for r in learned[-1].filter("doc_id <> 7").collect()]
    assert found and all(r.toxic == toxic[r.doc_id] and toxicity._terms(r.text) == toxicity._terms(given[r.doc_id]) for r in found)
    assert all(len(r.text) < len(given[r.doc_id]) / 10 for r in found)
