import random

import numpy as np
from pyspark.sql import functions as F

from marketpanel.llm.components import components
from marketpanel.llm.common import QUERIES, mix64
from marketpanel.llm.near_dup import LANES, _permutations, drop_near_duplicates, estimate, minima, near_duplicates, pack_bits

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, lo=85, hi=100):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if hi * shared >= lo * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 600), (600, 500)]
    out = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert {out[k] for k in range(10, 41)} == {10} and {out[k] for k in range(100, 140)} == {100} and out[600] == 500 and 7 not in out


def test_estimate_is_unbiased():
    a, b = _permutations()
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        common = mix64(rng.integers(0, 1 << 62, 600).astype(np.uint64))
        own = mix64(rng.integers(0, 1 << 62, 200).astype(np.uint64))
        x, y = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
        errors.append(estimate(pack_bits(minima(x, a, b)), pack_bits(minima(y, a, b))[None])[0] - 600 / 800)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06 and LANES == 140


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_near_dup"](spark, SF_DIR).collect()}
    assert found == {d: (n, c, c == d) for d, (n, c) in brute(docs).items()}


def test_group_of_many_near_copies(spark):
    """More members than a chunk holds, at all distances from the first, so chains and blocks both matter."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 700):
        words = list(docs[rng.randrange(len(docs))][1].split()) if i % 3 else list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = brute(docs)
    assert found == want and len({c for _, c in want.values()}) > 20


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].component_id, by[2].component_id, by[2].kept) == (1, 1, False)
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[7].n_shingles == 1
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    assert near_duplicates(no_docs).count() == 0 and drop_near_duplicates(no_docs).agg(F.count("*")).first()[0] == 0


def test_bands_follow_from_the_link():
    from marketpanel.llm.near_dup import bands_for

    assert (bands_for((85, 100)), bands_for((80, 100))) == (28, 41)
    for link in ((85, 100), (80, 100), (50, 100)):
        assert (1 - (link[0] / link[1]) ** 5) ** bands_for(link) <= 1e-7


def test_sketches_have_the_bands_of_their_link():
    import pyarrow as pa

    from marketpanel.llm.near_dup import _sketch

    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "body": [b"a b c d e f g h"]})
    for bands in (28, 41):
        [rows] = _sketch(bands)(iter([docs]))
        assert len(rows.column("keys")[0].as_py()) == bands and len(rows.column("sig")[0].as_py()) == -(-bands * 5 * 4 // 64) * 8
