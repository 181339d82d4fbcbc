import math
import re
from collections import Counter

from conftest import DATA

from leakloom.llm import licenses

KEY = re.compile(licenses.KEYWORDS[4:], re.I)
NAME = re.compile(licenses.LICENCE_FILE[4:], re.I)
TERM = re.compile(licenses.TERM)


def brute(files, least=licenses.LEAST):
    """(license, found, origin) of each (path, text)."""
    forms = [(k, x) for k, v in licenses.HEADERS.items() for x in v] + list(licenses.WHOLE.items())
    units = []
    for no, (path, text) in enumerate(files):
        if text is None:
            continue
        if path is not None and NAME.search(path):
            units.append((no, -1, text))
        if KEY.search(text):
            units += [(no, i, x) for i, x in enumerate(re.split(r"\n|(?<=[.;])\s+", text)) if KEY.search(x)]
            run, place = [], -2
            for x in [*re.split(r"\n[ \t\r]*\n\s*", text), ""]:
                if KEY.search(x):
                    run.append(x)
                elif run:
                    units.append((no, place, "\n".join(run)))
                    run, place = [], place - 1
    bags = [(no, place, Counter(TERM.findall(text.lower()))) for no, place, text in units]
    df = Counter(t for _, _, bag in bags for t in bag)

    def weighed(bag):
        return {t: n * (math.log((1 + len(units)) / (1 + df[t])) + 1) for t, n in bag.items()}

    vectors = [(name, weighed(Counter(TERM.findall(x.lower())))) for name, x in forms]
    best = {}
    for no, place, bag in bags:
        own = weighed(bag)
        size = math.sqrt(sum(x * x for x in own.values()))
        for name, other in vectors:
            dot = sum(x * other[t] for t, x in own.items() if t in other)
            if size and (score := round(dot / size / math.sqrt(sum(x * x for x in other.values())), 9)) >= least:
                best[no] = min(best.get(no, (9,)), (-score, place, name)) if no in best else (-score, place, name)
    folder = lambda p: p.rpartition("/")[0]
    grants = {}
    for no, (path, _) in enumerate(files):
        if path is not None and NAME.search(path) and no in best:
            own = (best[no][0], path, best[no][2])
            grants[folder(path)] = min(grants.get(folder(path), own), own)
    out = []
    for no, (path, _) in enumerate(files):
        if no in best:
            out.append((best[no][2], "file" if path is not None and NAME.search(path) else "header", None))
            continue
        at, got = folder(path) if path is not None else None, None
        while at is not None and got is None:
            got = grants.get(at)
            at = folder(at) if at else None
        out.append((got[2], "inherited", got[1]) if got else (None, None, None))
    return out


FILES = [
    ("a/LICENSE", "The MIT License. " + licenses.WHOLE["MIT"]),
    ("a/b/x.py", "Licensed under the Apache License, Version 2.0 (the License);\ncode"),
    ("a/b/c/y.py", "no header"),
    ("a/b/c/y.py", "no header"),
    ("a/d/COPYING.txt", "GNU General Public License version 3, 29 June 2007. " + licenses.WHOLE["GPL-3.0"]),
    ("a/d/e/z.c", ""),
    ("a/d/e/f/w.c", None),
    ("q/r.txt", "All rights reserved. Other words."),
    ("top.txt", "a license to drive and other things that are no licence at all, with many more words around it"),
    (None, "nothing"),
    (None, "Released under the MIT license."),
    ("", "x"),
    ("g/license", "not one at all"),
    ("g/h.txt", "long text " * 60_000),
]


def body(name):
    """A licence body without a title: words of the template in lines and paragraphs, with common words between them."""
    words = licenses.WHOLE[name].split()
    lines = [" ".join(words[i : i + 7]) + " and the of this" for i in range(0, len(words), 7)]
    return f"code()\n\n/* copyright 2020 someone */\n{lines[0]}\n\nwithout warranty of any kind\n" + "\n".join(lines[1:]) + "\n\nmore code"


def test_bodies_without_titles(spark):
    files = [(f"{name}/{kind}", body(name) if kind != "empty.txt" else "") for name in licenses.WHOLE for kind in ("x.py", "empty.txt", "LICENSE")]
    got = licenses.scanned(spark.createDataFrame([(i, *x) for i, x in enumerate(files)], "i int, path string, text string")).collect()
    assert [(r.license, r.found, r.origin) for r in sorted(got, key=lambda r: r.i)] == brute(files)
    assert all(r.license == r.path.split("/")[0] for r in got), [(r.path, r.license, r.score) for r in got]


def test_common_and_rare_terms(spark, monkeypatch):
    monkeypatch.setattr(licenses, "COMMON", 0.02)  # some terms in each of the two joins
    got = licenses.scanned(spark.createDataFrame([(i, *x) for i, x in enumerate(FILES)], "i int, path string, text string")).collect()
    assert [(r.license, r.found, r.origin) for r in sorted(got, key=lambda r: r.i)] == brute(FILES)


def test_matches_brute_force(spark):
    got = licenses.scanned(spark.createDataFrame([(i, *x) for i, x in enumerate(FILES)], "i int, path string, text string")).collect()
    want = brute(FILES)
    assert [(r.license, r.found, r.origin) for r in sorted(got, key=lambda r: r.i)] == want
    assert {x[0] for x in want} >= {"MIT", "Apache-2.0", "GPL-3.0", "proprietary", None}
    assert want[3] == ("MIT", "inherited", "a/LICENSE") and want[6] == ("GPL-3.0", "inherited", "a/d/COPYING.txt")


def test_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in licenses.op9(spark, f"{DATA}/sf0.01").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    ids = sorted(docs)
    want = dict(zip(ids, brute([(got[i].path, docs[i]) for i in ids]), strict=True))
    assert {i: (r.license, r.found, r.origin) for i, r in got.items()} == want


def test_edges(spark):
    docs = spark.createDataFrame([("a/b", "MIT license", 1, 2, 3)], "path string, text string, score int, own int, place int")
    got = licenses.scanned(docs)
    assert got.columns == ["path", "score_in", "own", "place", "license", "score", "found", "origin"]
    r = got.first()
    assert (r.score_in, r.own, r.place) == (1, 2, 3)
    assert licenses.scanned(docs.limit(0)).count() == 0
