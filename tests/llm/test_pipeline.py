import corpus_pipeline
from marketpanel.llm.bpe import default_vocabulary
from tests.llm.test_decontaminate import greedy, words
from tests.llm.test_near_dup import brute
from tests.llm.test_pii import PATTERNS, base

SF_DIR = "/root/testdata/sf0.001"


def repeated(w):
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    return len({i + j for i, g in enumerate(windows) if windows.count(g) > 1 for j in range(5)})


def test_run_against_brute_force(spark):
    """At this size no cutoff is certified, so the base rules alone decide the first stage, and no kind of span
    is added to the base spans."""
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    kept = {d: t for d, t in docs.items() if len(words(t)) >= 10 and 100 * repeated(words(t)) <= 20 * len(words(t))}
    kept = {d: t for d, t in kept.items() if brute_cache(kept)[d][1] == d}
    items = [words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    seeds = [{tuple(i[k:k + 5]) for k in range(len(i) - 4)} for i in items]
    clean = {}
    for d, t in kept.items():
        w = words(t)
        own = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        if not any(own & s and greedy(i, w) >= 0.5 * len(i) for i, s in zip(items, seeds)):
            clean[d] = t
    library = Tokenizer.from_file(default_vocabulary())
    want = {}
    for d, t in clean.items():
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base(t)))
        for a, b, kind in reversed([s for k, s in enumerate(spans) if not k or s[0] >= spans[k - 1][1]]):
            t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
        want[d] = library.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert {d for d in got if got[d] != want[d]} == set()
    assert set(PATTERNS) == {"email", "ip", "card", "phone"}


_CACHE = {}


def brute_cache(kept):
    key = len(kept)
    if key not in _CACHE:
        _CACHE[key] = brute(kept.items(), 80, 100)
    return _CACHE[key]


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    """Extra columns may have names that the stages use themselves."""
    plain = odd_docs.select("doc_id", "text", "lang", "source")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, least in ((plain, 3), (odd_docs, 3), (no_docs, 0)):
        names = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            assert k == 4 or docs.columns == names
        assert docs.count() >= least
