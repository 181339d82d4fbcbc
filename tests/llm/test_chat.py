import hashlib
import random

from conftest import DATA

from leakloom.llm import chat, common

HARD = ["[loss]", "[/loss]", "</s><s>", "[/assistant]", "\\[", "\\b", "\\", "]", "[INST] ok [/INST]", "\n", "", "assistant", "[user]a[/user]", "\\o\\\\c", "é🙂"]


def test_examples_read_back(spark):
    rng = random.Random(1)
    convs = {}
    for conv in range(300):
        roles = [rng.choice(["assistant", "assistant", "user", rng.choice(HARD)]) for _ in range(rng.randint(1, 12))]
        convs[conv] = [(r, "".join(rng.choices(HARD, k=rng.randint(0, 4)))) for r in roles]
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (1, 2, 5, 128):
        got = {}
        for r in chat.formatted(table, block).collect():
            got.setdefault(r.conv_id, []).append((r.example, r.target, r.formatted))
        for conv, turns in convs.items():
            examples = sorted(got[conv])
            replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
            assert [n for n, _, _ in examples] == list(range(len(examples)))
            assert [t for _, t, _ in examples if t is not None] == replies
            assert len(examples) == len(replies) + (turns[-1][0] != "assistant")
            for _, target, text in examples:
                read = chat.parsed(text)
                assert [(r, t) for r, t, _ in read] == (turns[: target + 1] if target is not None else turns)
                assert [i for i, x in enumerate(read) if x[2]] == ([target] if target is not None else [])


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} [x]" * 5) for i in range(1200)] + [(2, 0, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.formatted(table)).collect()}
    assert got == brute(rows)


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r[1:])
    out = {}
    for conv, turns in convs.items():
        turns = sorted((-1 if t is None else t, role or "", text or "") for t, role, text in turns)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in common.table(spark, f"{DATA}/sf0.01", "conversations").collect()]
    hard = "</s>[INST] ok [/INST]"
    want = brute([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)])
    got = chat.op10(spark, f"{DATA}/sf0.01").collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_edges(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "first"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, "user", "y" * 300_000), (None, 0, "user", "z"), (3, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = chat.digests(chat.formatted(table)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert chat.formatted(table).where("conv_id = 1").count() == 3  # a reply each
    assert chat.digests(chat.formatted(table.limit(0))).count() == 0
