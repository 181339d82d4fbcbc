import random
import re

import numpy as np
import xxhash
from conftest import DATA

from leakloom.llm import common, components, simhash

WORD = re.compile(b"[^\x20\x09-\x0d]+")


def brute_print(text):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fingerprint); the least doc_id reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4).tolist():
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(prints)}


CASES = ["", None, " \t", "one", "One TWO three", "a b c d", "a b c d e f a b c d", "É Ü é ü ß", "x\x0by\x0cz\x1cw\xa0v", "w " * 50_000, "\x00 a b c"]


def test_fingerprints(spark):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(100 + r.doc_id, r.text) for r in common.table(spark, f"{DATA}/sf0.001", "documents").collect()]
    got = simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        assert r.fp & (1 << 64) - 1 == brute_print(r.text), (r.text or "")[:40]


def test_golay_keys_miss_no_link():
    rng = random.Random(5)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = []
    for x in a:
        for k in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << k
        b.append(x)
    sets = []
    for values in (a, b):
        own = [set() for _ in values]
        for i, k in zip(*(v.tolist() for v in simhash.fingerprint_keys(np.array(values, np.uint64).view(np.int64))), strict=True):
            own[i].add(k)
        sets.append(own)
    assert all(x & y for x, y in zip(*sets, strict=True))


def planted(n, groups, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(groups):  # chains: each a few bits from the one before
        x = rng.getrandbits(64)
        for _ in range(12):
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            out.append(x)
    base = rng.getrandbits(64)
    out += [base ^ (1 << k) ^ (1 << j) for k in range(24) for j in range(24)]  # a large bucket
    return out


def test_components_with_large_buckets_in_blocks(spark):
    values = planted(400, 20, 3)
    docs = list(enumerate(values))
    want = brute_components(docs)
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "fp long")
    for size in (16, 64, simhash.BLOCK):
        edges = simhash.links(prints, size=size)
        roots = {r.node: r.root for r in components.least_reachable(edges).collect()}
        got = {}
        for doc, v in docs:
            fp = int(np.uint64(v).view(np.int64))
            got.setdefault(roots.get(fp, fp), []).append(doc)
        assert sorted(map(sorted, got.values())) == sorted(sorted(d for d in want if want[d] == c) for c in set(want.values())), size


def test_query_matches_brute_force(spark):
    rows = common.table(spark, f"{DATA}/sf0.01", "documents").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    want = brute_components(prints)
    got = simhash.op6(spark, f"{DATA}/sf0.01").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints}
    assert len(got) == len(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(5, None, "a"), (3, "", "b"), (None, "", "c"), (7, "x y", "d"), (7, "p q r s t", "e"), (7, "x y", "d")], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.linked(docs).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (7, 7), (7, 7), (7, 7)]
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 7, 7]  # equal ids in two groups: one row of each
    assert simhash.linked(docs.limit(0)).count() == 0 and simhash.kept(docs.limit(0)).count() == 0


def test_least_reachable_on_random_graphs(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.root for r in components.least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
