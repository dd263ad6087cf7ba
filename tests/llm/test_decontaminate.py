import numpy as np

from marketpanel.llm.common import QUERIES, WordHashes
from marketpanel.llm.decontaminate import contamination, drop_contaminated, tile
from marketpanel.llm import decontaminate

SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def greedy(p, t, least=5):
    """Plain greedy tiling: the longest unmarked match first, the earliest of equals."""
    fp, ft, total = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and fp[i + k] and ft[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        total += k
        fp[i:i + k] = [False] * k
        ft[j:j + k] = [False] * k


def covered(item, text):
    h = WordHashes()
    p, t = h(words(item)), h(words(text))
    return sum(k for _, _, k in tile(p, t, np.ones(len(t), bool)))


def test_tiles_equal_plain_greedy():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = " ".join(f"w{x}" for x in rng.integers(0, 4, 40))
        text = " ".join(f"w{x}" for x in rng.integers(0, 4, 60))
        assert covered(item, text) == greedy(words(item), words(text))


def test_reordered_passage_is_caught():
    a, b, c = ([f"{x}{i}" for i in range(8)] for x in "abc")
    assert covered(" ".join(a + b + c), " ".join(c + ["z"] + a + ["y"] + b)) == 24


def test_query_against_brute_force(spark):
    items = {str(r.item_id): words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    seeds = {}
    for name, w in items.items():
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k:k + 5]), set()).add(name)
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        w = words(r.text)
        near = set().union(*(seeds.get(tuple(w[k:k + 5]), set()) for k in range(max(0, len(w) - 4))))
        shares = {n: greedy(items[n], w) / len(items[n]) for n in near}
        hit = sorted(n for n, s in shares.items() if s >= 0.5)
        want[r.doc_id] = (len(w), max(shares.values(), default=0.0), bool(hit), ",".join(hit))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_decontaminate"](spark, SF_DIR).collect()}
    assert got == want and any(x[2] for x in want.values())


def test_odd_rows_and_blocks(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy"), (2, None), (None, "bob@example.org or +1 (504) 555-2652, card 4111 1111"), (3, "too short"), (4, "")],
        "item_id bigint, text string",
    )
    for size in (decontaminate.BLOCK_BYTES, 40):  # the second takes several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = contamination(odd_docs, bench).collect()
        assert len(rows) == 11
        assert sorted((r.doc_id, r["items"]) for r in rows if r.contaminated) == [(1, ["1"]), (2, ["1"]), (2, ["1"]), (8, ["null"])]
        kept = drop_contaminated(odd_docs, bench)
        assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 7]
    assert contamination(no_docs, bench).count() == 0 and contamination(odd_docs, bench.limit(0)).filter("contaminated").count() == 0
