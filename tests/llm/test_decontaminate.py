import hashlib
import random
import re

from conftest import DATA

from leakloom.llm import common, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """(n_words, hit positions, items) of each document."""
    wanted = {}
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            wanted.setdefault(tuple(own[at : at + window]), set()).add(item)
    sizes = sorted({len(w) for w in wanted})
    out = []
    for _, text in docs:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(own) - size + 1):
                if items_of := wanted.get(tuple(own[at : at + size])):
                    hit.update(range(at, at + size))
                    found |= items_of
        out.append((len(own), hit, found))
    return out


def check(spark, docs, items, **more):
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    want = sorted((d[0] if d[0] is not None else -1, n, sorted(hit), sorted(found)) for d, (n, hit, found) in zip(docs, brute(docs, items), strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [k for a, b in r.spans for k in range(a, b + 1)], list(r["items"])) for r in got) == want
    assert all(r.n_hit == sum(b - a + 1 for a, b in r.spans) for r in got)


def cases():
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "É", "é", "10", "x-y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(99, None), (98, ""), (97, "Only words here!"), (96, items[5][1]), (None, "a a a")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"before {items[i][1]} after, {items[i + 1][1]}") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "!!"), (203, "a " * 40_000), (203, "ONLY words\nhere"), (None, "only words here")]
    return docs, [x for x in items if x[0] is not None]


def test_exact_matches(spark):
    check(spark, *cases())


def test_in_blocks(spark):
    check(spark, *cases(), at_once=40)


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, f"{DATA}/sf0.01", "documents").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, f"{DATA}/sf0.01", "benchmark").collect()]
    got = {r.doc_id: r for r in decontaminate.op8(spark, f"{DATA}/sf0.01").collect()}
    for (i, _), (n, hit, found) in zip(docs, brute(docs, items), strict=True):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item), (2, " ".join(reversed(item.split()))), (3, item.replace(" ", " x ")), (4, item.replace(" ", " x x x x x ")), (5, "one two three")]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), near=20).collect()
    assert {r.doc_id for r in got if r["items"]} == {1} and {r.doc_id for r in got if r.near_items} == {1, 2, 3}


def test_clean_and_edges(spark):
    rows = [(1, "q " * 12, "a", 1), (1, "other", "b", 2), (2, None, None, None), (None, "q " * 12, "c", 3), (3, "r", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, segment int")
    bench = spark.createDataFrame([(5, "q " * 12)], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and sorted((r.doc_id or -1, r["items"]) for r in out.collect()) == [(1, "b"), (2, None), (3, "d")]  # each row by its own text
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5
    assert decontaminate.search(docs.limit(0), bench).count() == 0
