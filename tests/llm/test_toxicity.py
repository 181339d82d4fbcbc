import numpy as np
from conftest import DATA

from leakloom.llm import common, toxicity


def features(text, terms=None):
    x = toxicity.Grammar(terms or {}, {}).features(text)
    return None if x is None else dict(zip(toxicity.FEATURES, x.tolist(), strict=True))


def test_composed_table_equals_the_chain():
    reported = toxicity.Transducer(0, {(0, "r"): (1, "o"), (1, "r"): (1, "o"), (1, "i"): (1, "q")})
    denied = toxicity.Transducer(0, {(0, "n"): (1, "o"), (1, "i"): (0, "d"), (1, "q"): (0, "q")})
    table, states = toxicity.composed([reported, denied], ("i", "n", "r", "o"))
    assert sorted(states) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    rng = np.random.default_rng(1)
    for _ in range(50):
        state, one, two = 0, 0, 0
        for symbol in rng.choice(list("inro"), 12):
            one, mid = reported.step(one, symbol)
            two, end = denied.step(two, mid)
            state, got = table[state, symbol]
            assert got == end


def test_clauses_not_words():
    assert features("a fine day") is None and features("") is None and features(None) is None
    plain, denied, quoted = features("you are an idiot."), features("you are not an idiot."), features("he said you are an idiot.")
    assert plain["insult"] > 0 and plain["targeted insult"] > 0
    assert denied["insult"] == 0 and denied["denied insult"] > 0
    assert quoted["insult"] == 0 and quoted["quoted insult"] > 0
    assert features("an idiot.")["targeted insult"] == 0
    for verb in ("aren't", "isn’t", "DON'T"):
        apart = features(f"you {verb} an idiot")
        assert apart["insult"] == 0 and apart["denied insult"] > 0
    assert features("l'idiot")["insult"] > 0
    assert features("you. an idiot.")["targeted insult"] == 0  # another clause
    assert features("I will kill you")["targeted threat"] > 0
    assert features("idiot, " * 3 + "x. idiot")["clauses"] > features("idiot")["clauses"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0), (2, "you idiot " * 40_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score_in", "score"]
    scores = [r.score for r in got.collect()]
    assert scores[0] == scores[1] == scores[2] < 0.3 < scores[3]
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    got = toxicity.op3(spark, f"{DATA}/sf0.1")
    labels = common.table(spark, f"{DATA}/sf0.1", "labels")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in rows if r.toxic == 1 and r.predicted == 1]
    toxic, predicted = sum(r.toxic == 1 for r in rows), sum(r.predicted for r in rows)
    print(len(rows), toxic, predicted, len(hit))
    assert len(hit) / toxic > 0.7 and len(hit) / predicted > 0.85
