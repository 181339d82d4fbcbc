import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from leakloom.llm import bpe, token_counts

FILE = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
OWN = token_counts.Counter(FILE, P.PATTERN)
TEXT = st.text(max_size=60) | st.text("ab '\n1.  s", max_size=400) | st.sampled_from(["it's", "don't  ", "   ", "12 34", "\n \n", "'ll've", "x " * 300])


def whole(text):
    return len(OWN.encoding.encode_ordinary(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=5), st.lists(st.tuples(st.integers(-5, 900), st.integers(-5, 60), TEXT), max_size=8))
def test_edits_count_as_the_whole_text(parts, edits):
    text = "".join(parts)
    tree = token_counts.Tree(text, OWN)
    assert tree.total == whole(text)
    for start, n, new in edits:
        tree.edit(start, start + n, new)
        a = max(0, min(start, len(text)))
        b = max(a, min(start + n, len(text)))
        text = text[:a] + new + text[b:]
        assert "".join(tree.words()) == text
        assert tree.total == whole(text) and tree.length == len(text)


def test_an_edit_encodes_little():
    tree = token_counts.Tree("some words of a long text, " * 5000, OWN)
    tree.edit(60_000, 60_003, "new")
    assert 0 < tree.encoded < 40
    tree.edit(10, 10, "many more words " * 500)
    before = tree.encoded
    tree.edit(70_000, 70_010, "")
    assert tree.encoded - before < 40


@given(st.lists(st.integers(0, 2**31 - 1) | st.integers(0, 300), max_size=30))
def test_packed_numbers_come_back(numbers):
    assert token_counts.unpacked(pa.py_buffer(token_counts.packed(numbers))) == numbers


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (3, "abc " * 50_000, None), (None, "Hello there, world", 1)], "doc_id long, text string, n_tokens int")
    docs = docs.withColumn("edits", token_counts.three_edits())
    got = token_counts.edited(token_counts.trees(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.columns[:4] == ["doc_id", "text", "n_tokens_in", "edits"]
    rows = got.collect()
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == whole(text)
        for e in r.edits:
            a = max(0, min(e.start, len(text)))
            b = max(a, min(e.end, len(text)))
            text = text[:a] + e.text + text[b:]
        assert r.n_tokens_after == whole(text)
    assert len(rows) == 5 and bpe is not None
    assert token_counts.edited(token_counts.trees(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    none = docs.limit(1).withColumn("edits", docs.edits.isNull().cast("string").cast("int").cast("string")).drop("edits").selectExpr("*", f"cast(null as {token_counts.EDIT}) as edits")
    assert token_counts.edited(token_counts.trees(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first().n_encoded == 0
