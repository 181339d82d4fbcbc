import hashlib
import re

from conftest import DATA

from leakloom.llm import common, pii

# the contract's own patterns
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 9 <= len(number) <= 15


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(found)


CASES = [
    None, "", "a@b.c", "x@y", "a@b.c.d@e.f", "@a.b %@%.%", "é漢🙂 a.b+c@d-e.co.uk. then 1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.2.3.4 9.9.9.9.9", "99999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "41111111111111111111111111111111", "0000000000000000 1 2 3", "+1 (521) 555-6210 +49.30.1234567 +1", "++12345678901 +1 23456789012345678",
    "a" * 3000 + "@", "1" * 9000, "1.2." * 500, ("x" * 50 + "@y.zz ") * 300, "+1 " * 400, "a@b." * 300, "foo@bar..com a@-.-", "-@-.a" * 9,
]


def test_base_spans_match_the_contract(spark):
    docs = [(i, t) for i, t in enumerate(CASES)] + [(None, CASES[6]), (3, CASES[6])]
    docs += [(1000 + r.doc_id, r.text) for r in common.table(spark, f"{DATA}/sf0.001", "documents").collect()]
    got = pii.scanned(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "base").collect()
    want = sorted((-1 if i is None else i, brute(t)) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, [(s.start, s.k, s.end) for s in r.base]) for r in got) == want


def test_very_long_texts_stay_near_linear(spark):
    rows = ["a" * 200_000 + "@", "1" * 100_000, "1.2." * 50_000, ("x" * 50 + "@y.zz ") * 4000, "+1 " * 40_000, "a@b." * 30_000, "9.9.9.9 " * 30_000, "555-0199 " * 30_000]
    got = {r.doc_id: len(r.base) for r in pii.scanned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc_id", "base").collect()}
    assert got == {0: 0, 1: 0, 2: 25_000, 3: 4000, 4: 0, 5: 15_000, 6: 30_000, 7: 0}


def test_digests(spark):
    got = {r.doc_id: r for r in pii.op5(spark, f"{DATA}/sf0.001").collect()}
    for r in common.table(spark, f"{DATA}/sf0.001", "documents").collect():
        spans = brute(r.text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"Please call me\nat phone number +1 (521) 555-62{i:02d} soon. Thanks") for i in range(6)]
    rows += [(i, f"Write to user name{i}@example.com today") for i in range(10, 14)]
    rows += [(20, "reach me at phone number 555-0199-22, really"), (21, "order page number 555-0199-22"), (22, "Write to user someone@localhost now"), (23, "ref a1b2c3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.k], s.value) for s in r.added] for r in pii.scanned(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {20: [("phone", "555-0199-22")], 22: [("email", "someone@localhost")]}
    # two seeds are too few
    few = docs.where("doc_id < 2 or doc_id = 20")
    assert not any(r.added for r in pii.scanned(few).collect())


def test_identifiers_with_spaces_and_at_the_beginning(spark):
    rows = [(i, f"call me at phone number +1 (521) 555-62{i:02d} soon") for i in range(6)] + [(i, f"Phone: +1 521 555 62{i:02d}, thanks") for i in range(10, 16)]
    rows += [(30, "reach me at phone number (521) 555-6210 today"), (31, "I said phone number 521 555 6211."), (32, "Phone: 521 555 6212"), (33, "the sum of 521 555 6213 is"), (34, "we got phone number " + "5-" * 300 + "5")]
    rows += [(40 + i, f"my credit card 4111 1111 1111 111{d}") for i, d in enumerate("1111")] + [(50, "a credit card 4111 1111 1111 1112 too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.k], s.value) for s in r.added] for r in pii.scanned(docs, support=1, least=0.3).collect()}
    want = {30: [("phone", "(521) 555-6210")], 31: [("phone", "521 555 6211")], 32: [("phone", "521 555 6212")], 50: [("card", "4111 1111 1111 1112")]}
    assert {k: v for k, v in got.items() if v} == want


def test_accepted_instances_induce_patterns(spark):
    rows = [(i, f"call at phone number +1 521 555 62{i:02d} soon") for i in range(12)]
    rows += [(20, "call at phone number 555-0199-22 soon"), (21, "my fax line 555-0199-22 is"), (22, "her fax line 555-0200-33 is"), (23, "see part no 555-0300-44 there")]
    rows += [(30 + i, f"old fax line +1 521 555 63{i:02d}") for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.added] for r in pii.scanned(docs, support=2, least=0.4).collect()}
    assert {k: v for k, v in got.items() if v} == {20: ["555-0199-22"], 21: ["555-0199-22"], 22: ["555-0200-33"]}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "x", "y", "z")], "doc_id long, text string, row string, base string, score string")
    assert len(pii.scanned(docs).collect()) == 1
    assert pii.scanned(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.scanned(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
