import random
from collections import Counter

from marketpanel.llm.shards import communication_matrix, hypergeometric, shuffle_into_shards


def test_matrix_has_both_margins():
    rng = random.Random(1)
    counts, sizes = [0, 5, 17, 300, 1], [100, 100, 100, 23]
    matrix = communication_matrix(counts, sizes, rng)
    assert [sum(r) for r in matrix] == counts
    assert [sum(c) for c in zip(*matrix)] == sizes


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(2)
    seen = Counter(hypergeometric(rng, 6, 4, 5) for _ in range(20_000))
    from math import comb

    for k in range(1, 6):
        assert abs(seen[k] / 20_000 - comb(6, k) * comb(4, 5 - k) / comb(10, 5)) < 0.02
    assert hypergeometric(rng, 10**10, 10**10, 10**9) > 4 * 10**8  # large counts are drawn as well


def test_rows_are_kept_and_shards_are_even(odd_docs):
    out = shuffle_into_shards(odd_docs, shards=4, rows_per_part=1).collect()
    assert Counter(r.shard for r in out) == {0: 3, 1: 3, 2: 3, 3: 2}
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(3 if s < 3 else 2))
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in odd_docs.collect())


def test_uniform_over_seeds(spark):
    docs = spark.range(40).selectExpr("id AS doc_id").coalesce(1)
    first = [shuffle_into_shards(docs, 4, seed).filter("doc_id = 0").first() for seed in range(12)]
    assert len({(r.shard, r.slot) for r in first}) > 6


def test_empty_and_native(no_docs, odd_docs):
    assert shuffle_into_shards(no_docs, 3).collect() == []
    plan = shuffle_into_shards(odd_docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_against_plain_rows(spark):
    """Sizes, checksums, law and slots of every document of the table; counts of the shards at most one apart."""
    import zlib

    from marketpanel.llm.common import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_shards"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {d: (len(t) + 16, zlib.crc32(t), "rows", None) for d, t in texts.items()} and len(rows) == len(texts)
    held = Counter(r.shard for r in rows)
    assert set(held) == set(range(40)) and max(held.values()) - min(held.values()) <= 1
    for shard, n in held.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
