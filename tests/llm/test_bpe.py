import hashlib
import random

import pytest

from marketpanel.llm.bpe import Encoder, Vocabulary, default_vocabulary, encode_and_decode
from marketpanel.llm.common import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_random_texts_equal_the_library(library):
    with open(default_vocabulary(), encoding="utf-8") as file:
        encoder = Encoder(Vocabulary(file.read()))
    rng = random.Random(3)
    alphabet = "abcEFG  '\n\t.,!?#12345éÈß日本ΣςİıǅªⅧ½́ ​　\x1c\x85😀<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["", "a" * 3000, "aaaaaaaaaaa", "<|endoftext|>x<|startoftext|><|endoftext|>", "it's we'll I'M", "ΑΣ ΑΣ."]
    ids, counts = encoder(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at += n


def test_query_equals_the_library(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, SF_DIR).collect()} == want


def test_odd_rows(odd_docs, no_docs, library):
    rows = encode_and_decode(odd_docs, default_vocabulary()).collect()
    assert len(rows) == 11 and sum(not r.ids and r.decoded == "" for r in rows) == 4
    texts = {r.doc_id: r.text or "" for r in odd_docs.filter("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    assert encode_and_decode(no_docs, default_vocabulary()).count() == 0
