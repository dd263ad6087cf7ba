import numpy as np

from marketpanel.llm import vector_codes as vc
from marketpanel.llm.common import ORACLES, QUERIES
from tests.parity import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def plain(parts, entries):
    """Nearest entries by Python's own integers."""
    out = []
    for x in parts.tolist():
        out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(entries.tolist())))
    return [k for _, k in out], [d for d, _ in out]


def test_sequency_order_and_transform():
    for size in (1, 2, 8, 64):
        h = vc.walsh(np.eye(size, dtype=np.int64)).T
        assert (np.count_nonzero(np.diff(h, axis=1), axis=1) == np.arange(size)).all()
        assert (h @ h.T == size * np.eye(size, dtype=np.int64)).all()


def test_early_elimination_is_exact():
    rng = np.random.default_rng(1)
    for d, low, high in ((1, -3, 3), (5, -2, 2), (8, -500, 500), (13, -1, 1), (8, -(1 << 40), 1 << 40), (3, -(1 << 62), 1 << 62)):
        parts, entries = rng.integers(low, high, (200, d)), rng.integers(low, high, (16, d))
        entries[5] = entries[2]  # a tie goes to the lower index
        index, distance = vc.nearest(parts, entries)
        want = plain(parts, entries)
        assert index.tolist() == want[0] and distance.tolist() == want[1] and 5 not in index.tolist()
    index, distance = vc.nearest(np.array([[-(1 << 63), 0]]), np.array([[(1 << 63) - 1, 0]]))
    assert index.tolist() == [0] and distance.tolist() == [((1 << 64) - 1) ** 2]
    assert vc.nearest(np.zeros((0, 4), np.int64), np.zeros((2, 4), np.int64))[0].tolist() == []


def test_query_against_sql(spark):
    assert compare(QUERIES["op12_vector_codes"](spark, SF_DIR), connect(SF_DIR), ORACLES["op12_vector_codes"]) == []


def test_odd_vectors_against_sql(spark, tmp_path):
    """Nulls, non-finite numbers, repeated vectors, tied ids and null labels, in several files."""
    import duckdb

    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=16)], int(k % 3) if k % 5 else None) for k in range(60)]
    rows += [(100 + k, [0.25] * 16, 7) for k in range(30)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [float("nan")] * 16, 1), (-4, [float("inf")] + [0.0] * 15, None), (5, rows[5][1], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    frame.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(QUERIES["op12_vector_codes"](spark, str(tmp_path)), con, ORACLES["op12_vector_codes"]) == []


def test_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, label string, vec string, code int, key int, n int"
    rows = [
        (None, [1.0] * 11, None, "x", 1, 1, 1), (3, [0.5] * 11, "a", "x", 1, 1, 1), (3, [0.5] * 11, "a", "x", 1, 1, 1),
        (4, [2.0] * 10, "a", "x", 1, 1, 1), (5, [], "a", "x", 1, 1, 1), (6, [1e300] * 11, "b", "x", 1, 1, 1),
    ]
    codes, books, length = vc.compress(spark.createDataFrame(rows, schema))
    got = sorted(((r.vec_id or 0, r.code, r.error, r.label_error) for r in vc.label_errors(codes).collect()), key=str)
    assert length == 11 and [g[0] for g in got] == [0, 3, 3, 6] and all(g[2] == 0 for g in got)
    assert len(vc.codebook_digest(books, length)) == 64
    for empty in (spark.createDataFrame([], schema), spark.createDataFrame([(1, None, None, None, None, None, None)], schema)):
        codes, books, length = vc.compress(empty)
        assert vc.label_errors(codes).count() == 0 and books == [] or length == 0
    codes, _, length = vc.compress(spark.createDataFrame([(1, [], "a", "x", 1, 1, 1)], schema))
    assert length == 0 and [(r.code, r.error) for r in codes.collect()] == [("00" * 8, 0)]
