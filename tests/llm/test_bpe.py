import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from leakloom.llm import bpe

FILE = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
WHOLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(FILE), special_tokens={})
CASES = [None, "", " ", "\n\n", "<|endoftext|> plain", "a" * 5000, "ab" * 700, "!" * 3001, "漢字かな交じり文 " * 40, "é" * 600, "Hello  world, it's   100% “quoted”\r\n\tx y", "\x00\x01\x7f", "🙂🙂👩‍👩‍👧 " * 9, "word " * 20_000, " " * 777 + "x", "aaaaabaaaaab" * 60]


def ids(text):
    return WHOLE.encode_ordinary(text or "")


def test_as_tiktoken_and_back(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(3, CASES[3]), (None, "x y")], "doc_id long, text string").coalesce(2)
    for r in bpe.decoded(bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        assert r.ids == ids(r.text), (r.text or "")[:50]
        assert bytes(r.decoded).decode() == (r.text or "")
    for r in bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).collect():
        own = ids(r.text)
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, ids int")
    got = bpe.encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.columns == ["doc_id", "text", "ids_in", "ids"] and got.first().ids_in == 5
    assert bpe.encoded(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    lists = spark.createDataFrame([(None,), ([],), (ids("ab cd"),)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decoded(lists, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()] == [None, b"", b"ab cd"]


CODECS = [bpe.Codec(FILE, P.PATTERN, spaced) for spaced in (False, True)]


def check(own, texts, whole=WHOLE):
    sizes, ids = own.encoded(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n : end].tolist() == whole.encode_ordinary(text or ""), text[:80]
    assert own.decoded(sizes, ids) == [(t or "").encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=400) | st.text("ab !1é", max_size=900) | st.text(" \n\ta.'s\x85\xa0\u2003\u3000漢é🙂\x1c", max_size=60), max_size=4))
def test_random_texts(texts):
    for own in CODECS:
        check(own, texts)


def test_query(spark):
    got = {r.doc_id: r for r in bpe.op2(spark, f"{DATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        own = ids(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_long_words_of_any_vocabulary():
    """Ranks in no order of training: a pair that arises may be of a lower rank than the one before."""
    rng = random.Random(5)
    for _ in range(12):
        tokens = [bytes([b]) for b in range(256)]
        some = {"".join(rng.choices("abc", k=rng.randint(2, 5))).encode() for _ in range(60)}
        tokens += rng.sample(sorted(some), len(some))
        file = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
        whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(file), special_tokens={})
        check(bpe.Codec(file, P.PATTERN), ["".join(rng.choices("abc", k=k)) for k in (300, 700, 2000, 100)] + ["a" * 999, "abc" * 200], whole)


def test_many_levels():
    levels = bpe.LEVELS
    try:
        bpe.LEVELS = 3  # the query is called again and again
        check(bpe.Codec(FILE, P.PATTERN), ["incomprehensibilities" + "xyzzy" * 100])
    finally:
        bpe.LEVELS = levels


def test_pieces_of_equal_hash(monkeypatch):
    monkeypatch.setattr(bpe.common.Rolling, "of", lambda self, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    check(bpe.Codec(FILE, P.PATTERN, True), ["the cat and the dog, a fig or a fog", "the fog and a cat", None, ""])


def test_forgets():
    kept = bpe.KEPT
    try:
        bpe.KEPT = 3
        own = bpe.Codec(FILE, P.PATTERN, True)
        for _ in range(3):
            check(own, ["one two three four five", "six seven", "one"])
    finally:
        bpe.KEPT = kept
