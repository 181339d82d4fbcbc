import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from conftest import DATA
from test_decontaminate import brute as windows
from test_simhash import brute_components, brute_print

from leakloom.llm import bpe, common

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark):
    """Each stage against a brute-force version on what the one before it left."""
    sf = f"{DATA}/sf0.01"
    docs = common.table(spark, sf, "documents")
    kept = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count(), name
    start, good, cut, apart, clean, last = kept
    assert all(start[i] == r for i, r in good.items())
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    assert all(i in good for i in start if labels.get(i) == 1 and len((start[i].text or "").split()) >= 200)
    assert cut.keys() == good.keys() and all(cut[i].n_chars == len(cut[i].text) for i in cut if cut[i].text != good[i].text)
    assert any(cut[i].text != good[i].text for i in cut)
    roots = brute_components([(i, brute_print(r.text)) for i, r in cut.items()])
    assert apart == {i: cut[i] for i in cut if roots[i] == i}
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    hit = {i for i, (_, h, _) in zip(apart, windows([(i, r.text) for i, r in apart.items()], items), strict=True) if h}
    assert hit and clean == {i: r for i, r in apart.items() if i not in hit}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    assert last.keys() == clean.keys()
    for i, r in last.items():
        ids = own.encode_ordinary(clean[i].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_equals_its_stages(spark):
    sf = f"{DATA}/sf0.001"
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf))
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(docs.collect())


def test_null_and_clashing_columns(spark):
    rows = [(1, None, "en", "s", 0, "a", 1), (None, "words " * 80, "en", "s", 480, "b", 2), (3, "", None, None, None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_removed int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            assert stage(spark, some, f"{DATA}/sf0.001").columns == docs.columns, name
            stage(spark, some, f"{DATA}/sf0.001").collect()
