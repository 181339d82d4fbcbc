import re

import numpy as np
from conftest import DATA

from leakloom.llm import common, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
BEFORE = "doc_id long, text string"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, again = set(), 0
    for x in lines:
        again += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 400 else None
    if marked is None:
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        marked = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(marked), n < 50 or 100 * len(marked) > 50 * n


CASES = [None, "", " \n\t", "a b c a b c", "one two three " * 60, "é ü 漢字  x y\n\nab\r\nab\r\nab\n ab", "#*$%&|<> " * 3, "\x00 \x0b\x0c\x1c x", "w " * 49, " ".join(f"w{i}" for i in range(50)), "long " * 30_000, "x" * 100_000]


def test_counts_match_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(1, CASES[5]), (None, "a b")]
    docs += [(r.doc_id, r.text) for r in common.table(spark, f"{DATA}/sf0.001", "documents").limit(60).collect()]
    got = quality.score(spark.createDataFrame(docs, BEFORE).coalesce(1), None).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (*(r[k] for k in quality.STATS), r.base_failed) == brute(r.text), r.text and r.text[:80]
        assert r.kept == (not r.base_failed) and r.good is None


def test_model_separates_and_keeps_clean_documents(spark):
    docs, labels = (common.table(spark, f"{DATA}/sf0.1", x) for x in ("documents", "labels"))
    # every second label is for the fit alone
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = np.mean([r.kept for r in got if r.quality == 1])
    bad = np.mean([r.kept for r in got if r.quality == 0])
    assert good > 0.97 and bad < 0.2
    share = np.mean([r.good for r in got])
    assert abs(share - np.mean([r.quality for r in got])) < 0.1  # calibrated


def test_edges(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", None)], "doc_id long, text string, kept string")
    got = quality.rules(docs, labels)
    assert got.columns == ["doc_id", "text", "kept_in", *quality.STATS, "base_failed", "good", "kept"]
    assert [(r.kept_in, r.kept, r.good) for r in got.orderBy("doc_id").collect()] == [("x", False, None), (None, False, None)]
    assert quality.rules(docs.limit(0), labels.limit(0)).count() == 0


def test_bounded_sample_is_whole_below_the_bound(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], BEFORE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.labelled(docs, labels, 100).count() == 20
    assert quality.labelled(docs, labels, 5).count() == 5
