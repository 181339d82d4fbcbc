import random
import re

from conftest import DATA

from leakloom.llm import common, line_dedup


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


def corpus(seed=4, times=5):
    """Documents with one passage of 12 lines at different places, own lines around it, and a common short line."""
    rng = random.Random(seed)
    passage = [words(rng, 9) for _ in range(12)]
    docs = []
    for i in range(times):
        own = [words(rng, 8) for _ in range(rng.randint(1, 9))]
        docs.append((i, "\n".join(["Contents", *own, *passage, words(rng, 5)])))
    docs += [(100 + i, "\n".join(["Contents", *[words(rng, 8) for _ in range(20)]])) for i in range(10)]
    return docs, passage


def test_repeated_passage_stays_once_and_nothing_else_goes(spark):
    docs, passage = corpus()
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        lines = text.split("\n")
        if i == 0 or i >= 100:
            assert got[i].text == text and got[i].n_removed == 0 and got[i].removed == ""
        else:
            want = [x for x in lines if x not in passage]
            assert got[i].text.split("\n") == want and got[i].n_removed == 12 and got[i].n_lines == len(lines)
            gone = [k for span in got[i].removed.split(",") for k in range(int(span.split(":")[0]), int(span.split(":")[1]) + 1)]
            assert [x for k, x in enumerate(lines) if k not in gone] == want


def test_one_long_line(spark):
    rng = random.Random(9)
    line = words(rng, 60)
    short = words(rng, 20)
    docs = [(i, f"{words(rng, 6)}\n{line}\n{words(rng, 6)}") for i in range(3)] + [(i, f"{words(rng, 6)}\n{short}\n{words(rng, 6)}") for i in range(10, 13)]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 10: 0, 11: 0, 12: 0}


def test_every_removed_line_stays_somewhere(spark):
    docs = common.table(spark, f"{DATA}/sf0.01", "documents")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r for r in line_dedup.op7(spark, f"{DATA}/sf0.01").collect()}
    assert before.keys() == after.keys()
    stays = {x for r in after.values() for x in r.text.split("\n")}
    for i, text in before.items():
        r, lines = after[i], text.split("\n")
        gone = [k for span in r.removed.split(",") if span for k in range(int(span.split(":")[0]), int(span.split(":")[1]) + 1)]
        assert len(gone) == r.n_removed and "\n".join(x for k, x in enumerate(lines) if k not in gone) == r.text
        assert all(lines[k] in stays for k in gone)
    assert sum(r.n_removed > 0 for r in after.values()) > 20


def test_edges(spark):
    long = "\n".join(f"line {i} " + "word " * 9 for i in range(3000))
    rows = [(1, None, "p"), (2, "", "q"), (2, "", "q"), (None, long, "r"), (5, long, "s"), (5, long, "s"), (6, "a\n" + long, None), (7, "\n\n\n", ""), (7, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = line_dedup.deduplicated(docs)
    assert got.columns == ["doc_id", "text", "n_removed_in", "n_lines", "n_removed", "removed"] or set(got.columns) == {"doc_id", "text", "n_removed_in", "n_lines", "n_removed", "removed"}
    out = got.collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.n_removed_in): r for r in out}
    assert by[1, "p"].text is None and by[1, "p"].n_lines == 0 and by[2, "q"].text == "" and by[None, "r"].text == long
    assert by[5, "s"].text == long  # the first holder keeps it, both rows alike
    assert by[6, None].text == "a" and by[6, None].n_removed == 3000
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert not re.search("Python|Arrow|Pandas", line_dedup.deduplicated(docs)._jdf.queryExecution().toString())


def common_runs(docs, min_words=50):
    """Brute force: doc_id to the places in runs of over min_words words that are equal to a run of a document with a lower id."""
    texts = {i: text.split("\n") for i, text in docs}
    gone = {i: set() for i in texts}
    for i, own in texts.items():
        for j, other in texts.items():
            for shift in range(-len(other) + 1, len(own)) if j < i else ():
                run = []
                for k in range(len(own) + 1):
                    if k < len(own) and 0 <= k - shift < len(other) and own[k] == other[k - shift]:
                        run.append(k)
                    else:
                        gone[i] |= set(run) if sum(len(own[x].split()) for x in run) > min_words else set()
                        run = []
    return gone


def places(removed):
    return {k for span in removed.split(",") if span for k in range(int(span.split(":")[0]), int(span.split(":")[1]) + 1)}


def test_passages_with_blank_and_frequent_lines_against_brute_force(spark):
    rng = random.Random(11)
    own = lambda: [words(rng, 7) for _ in range(rng.randint(1, 4))]
    apart = [[words(rng, 40) for _ in range(4)], [words(rng, 45), words(rng, 30)]]
    part = [words(rng, 12) for _ in range(3)]
    stock = words(rng, 6)
    docs = [(i, "\n".join([*own(), "", stock, "", *own()])) for i in range(20)]
    docs += [(20 + i, "\n".join([*own(), "\n\n".join(apart[0]), *own()])) for i in range(3)]  # blank lines
    docs += [(30 + i, "\n".join([*own(), apart[1][0], stock, apart[1][1], *own()])) for i in range(3)]  # a frequent line
    docs += [(40 + i, "\n".join([*own(), *part, *own()])) for i in range(8)]  # part of the next, too short alone
    docs += [(50 + i, "\n".join([words(rng, 9), *part, words(random.Random(1), 30), *own()])) for i in range(2)]
    docs += [(60, "\n".join([apart[0][0], "", words(rng, 9)])), (61, "\n".join([words(rng, 9), "", apart[0][1]]))]  # no common run with 20 of over 50 words
    want = common_runs(docs)
    got = {r.doc_id: places(r.removed) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(want[21]) == 7 and len(want[31]) == 3 and len(want[51]) == 4 and not want[60]


def test_random_lines_against_brute_force(spark):
    rng = random.Random(5)
    lines = [words(rng, n) for n in (1, 2, 3, 8, 12, 20, 30, 60)]
    texts = {tuple(rng.choice(lines) for _ in range(rng.randint(3, 9))) for _ in range(60)}
    docs = [(i, "\n".join(x)) for i, x in enumerate(sorted(texts))]
    got = {r.doc_id: places(r.removed) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = common_runs(docs)
    assert all(want[i] <= got[i] for i in want)
    assert sum(len(got[i] - want[i]) for i in want) <= sum(len(x) - len(set(x)) for x in texts)  # more goes only where a text repeats itself


def test_common_and_other_keys_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(6, 40)[0], "doc_id long, text string")
    every = []
    for share in (0, 1 / 100, 1):
        monkeypatch.setattr(line_dedup, "COMMON", share)
        every.append(sorted(tuple(r) for r in line_dedup.deduplicated(docs).collect()))
    assert every[0] == every[1] == every[2] and sum(r[-2] > 0 for r in every[0]) == 39
